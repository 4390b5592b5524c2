"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: ASCII white space: what separates words everywhere in this subpackage.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address in the folder that the driver and all executors share."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


#: Texts go to Python so much at a time: 10,000 rows, Spark's own limit, may be any size, which both sides hold more than once.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Shuffle files go as soon as the table they were for is written, not when the driver happens to collect its garbage.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while; those that are set already stay as they are."""
    unset = [k for k in values if spark.conf.get(k, None) is None]
    for k in unset:
        spark.conf.set(k, values[k])
    try:
        yield
    finally:
        for k in unset:
            spark.conf.unset(k)


def _table(df: DataFrame, folder: str) -> DataFrame:
    with settings(df.sparkSession, BATCHES | CLEANUP):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, lost executors cost nothing."""
    return _table(df, fresh_folder(df.sparkSession, name))


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A stored table that is emptied after the block, where all that is made of it is stored, too."""
    folder = fresh_folder(df.sparkSession, name)
    yield _table(df, folder)
    df.sparkSession.range(0).write.mode("overwrite").parquet(folder)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def spare(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document: rows with the same id and the same text are one document."""
    return F.xxhash64(F.col(key), text_of(text))


def crc_bucket(key: str, buckets: int) -> Column:
    """crc32 of an id written as text, modulo ``buckets``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def per_batch(rows: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema):
    """A mapInArrow function from one that maps columns to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = rows({name: batch.column(i) for i, name in enumerate(batch.schema.names)})
            arrays = [pa.array(columns[field.name], type=field.type) for field in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


#: Objects made between two looks of Python's collector for cycles, and how many looks go before a longer one.
COLLECTOR = 100_000, 20, 100


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The mapInArrow function in a worker that returns memory early and seldom looks for cycles.

    What Arrow has freed goes back after every batch and at the end: idle workers stay beside the next
    step's, so what they hold counts against the same executor.  Words and their ids are many small objects
    without cycles, over which the collector would go again and again (a third of the time).
    """

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, before = pa.default_memory_pool(), gc.get_threshold()
        gc.set_threshold(*COLLECTOR)
        try:
            for batch in function(batches):
                yield batch
                del batch
                pool.release_unused()
        finally:
            gc.set_threshold(*before)
            pool.release_unused()

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list ``(a, b)`` of longs, as ``(node, root)``.

    ``root`` is the smallest node reachable; every node of an edge is in the result
    once.  Alternating large-star and small-star steps, each one grouped minimum and
    one equi join; no neighbour list is ever gathered.  Self loops count as nodes,
    repeated edges and empty input are fine; edges with a null end are left out.
    """
    nodes = edges.where("a is not null and b is not null")
    loops = nodes.where("a = b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = nodes.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = stored(links.union(loops).distinct(), "edges")
    loops = current.where("u = v").select(F.col("u").alias("node"))
    current = current.where("u > v")
    before = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        current = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "star")
        state = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = stars.union(roots)
    alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.union(alone)
