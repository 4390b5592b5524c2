"""Inputs of the matcher: which file is what, which column is the text, the CSV readers."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import column_index_from_name, trim_and_compact
from . import bundle, filter_files

# Name parts that decide what a file is.
IGNORED_NAMES = ("__macosx", ".ds_store")
FILTER_NAME_PART = "key"


def column_index_of_parts(parts: DataFrame, name: str, order: str) -> DataFrame:
    """One row ``column_index``: the last part whose name ends in a digit decides, else 0."""
    indexed = parts.select(F.col(order).alias("place"), column_index_from_name(F.col(name)).alias("i"))
    last = F.max_by("i", F.when(F.col("i").isNotNull(), F.col("place")))
    return indexed.agg(F.coalesce(last, F.lit(0)).alias("column_index"))


def input_role(path: Column, root: str = "") -> Column:
    """'filters', 'data' or null, from the lower-cased base name; only what lies below ``root`` counts."""
    name = F.lower(F.substring_index(path, "/", -1))
    below = F.substring_index(path, root.rstrip("/") + "/", -1) if root else path
    ignored = F.lower(below).contains(IGNORED_NAMES[0]) | name.contains(IGNORED_NAMES[1])
    return (
        F.when(ignored | ~name.endswith(".csv"), F.lit(None).cast("string"))
        .when(name.contains(FILTER_NAME_PART), F.lit("filters"))
        .otherwise(F.lit("data"))
    )


def classify_inputs(paths: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """Add ``role`` to a table of paths; files without a role are left out."""
    return paths.withColumn("role", input_role(F.col(path), root)).filter(F.col("role").isNotNull())


def find_inputs(spark: SparkSession, path: str) -> tuple[str, str]:
    """(filter file, data file) below a folder; exactly one of each must exist."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = (
        classify_inputs(files, root=path)
        .groupBy("role")
        .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
        .collect()
    )
    by_role = {row.role: row for row in found}
    for role in ("filters", "data"):
        if role not in by_role:
            raise ValueError(f"no {role} file: one CSV with 'key' in its name and one other CSV are needed")
        if by_role[role].n > 1:
            raise ValueError(f"{by_role[role].n} {role} files, which one counts is not defined")
    return by_role["filters"].path, by_role["data"].path


def _cells_in(record: Column) -> Column:
    """Number of cells of one raw record: quoted cells are emptied, then commas count."""
    bare = F.regexp_replace(record, r'(^|,)"(?:[^"]|"")*+"', "$1")
    return F.size(F.split(bare, ",", -1))


def scan_data_csv(
    spark: SparkSession, path: str, index: int = 0, strict: bool = True, multi_line: bool = False
) -> DataFrame:
    """(filename, content): columns 0 and ``index`` of a CSV with a header, rows may be ragged.

    A row without that column fails the job when ``strict``, else it is dropped;
    an empty cell is kept as empty text.  Normalised corpora have no line breaks
    inside cells, so by default the file is split; ``multi_line`` allows them.
    """
    names = [f"c{i}" for i in range(index + 1)]
    schema = ", ".join(f"{n} string" for n in names) + ", raw string"
    rows = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", str(multi_line).lower())
        .option("mode", "PERMISSIVE")
        .option("columnPruning", "false")  # else a short row is not seen as one
        .option("columnNameOfCorruptRecord", "raw")
        .csv(path)
        .select(*names, "raw")
    )
    text = F.col(names[-1])
    # A null cell is an empty one or a missing one; only the raw record tells which.
    missing = text.isNull() & F.col("raw").isNotNull() & (_cells_in(F.col("raw")) <= index)
    content = F.coalesce(text, F.lit(""))
    if strict:
        content = F.when(missing, F.raise_error(F.lit(f"a row has no column {index}"))).otherwise(content)
    else:
        rows = rows.filter(~missing)
    return rows.select(F.coalesce("c0", F.lit("")).alias("filename"), content.alias("content"))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _records_of(contents: pa.Array) -> pa.Array:
    """All non-empty records of a small filter file, ragged rows as they are; null where one is broken."""

    def parse(content: str | None) -> list | None:
        return None if content is None else [cells for _, cells in filter_files.records(io.StringIO(content, newline=""))]

    return pa.array([parse(c) for c in contents.to_pylist()], type=pa.list_(pa.list_(pa.string())))


def filters_from_csv(files: DataFrame) -> DataFrame:
    """(filename, content) of filter files to (filename, ord, category, anchors).

    No header, ragged rows: the first cell is the category as it is, the others are
    trimmed and blank ones dropped; a row without anchors is skipped, the others
    keep their place in the file as ``ord``.  So is a row whose quote is never closed.
    """
    records = files.select("filename", _records_of.asNondeterministic()("content").alias("records"))
    return filters_of_records(records.select("filename", F.posexplode("records").alias("ord", "cells")))


def filters_of_records(records: DataFrame) -> DataFrame:
    """(filename, ord, cells) to filter rows; null cells, of a broken record, give none."""
    anchors = trim_and_compact(F.slice(F.col("cells"), F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))))
    return (
        records.where(F.col("cells").isNotNull())
        .select(
            "filename",
            F.col("ord").cast("long").alias("ord"),
            F.get(F.col("cells"), F.lit(0)).alias("category"),
            anchors.alias("anchors"),
        )
        .filter(F.size("anchors") > 0)
    )


def _file(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("path").alias("filename"), F.lit(-1).cast("long").alias("member_no"))


def scan_filter_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, category, anchors) of one filter file; invalid bytes are replaced, a byte order mark goes.

    Broken records are passed over and keep their number; ``scan_filter_errors`` lists them.
    """
    return filters_of_records(filter_files.read_filter_records(_file(spark, path))).drop("filename")


def scan_filter_errors(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line_no, error) of the broken records of one filter file."""
    return filter_files.filter_errors(filter_files.read_filter_records(_file(spark, path))).drop("filename")


# ---------------------------------------------------------------- both inputs in one archive
def archive_inputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The 'filters' and the 'data' member of one archive, each as a ``scan_bundle`` row.

    Its central directory is read once.  A root folder that all members share does not count in names;
    exactly one member of each role must exist.
    """
    members = bundle.archived_files(spark, path).where("size >= 0")
    top = F.when(F.col("filename").contains("/"), F.substring_index("filename", "/", 1))
    below = F.substring(F.col("filename"), F.length(F.substring_index("filename", "/", 1)) + 2, F.length("filename"))
    # one row for each pair of roles, with and without the first folder: nine at most
    groups = (
        members.groupBy(input_role(F.col("filename")).alias("whole"), input_role(below).alias("stripped"))
        .agg(
            F.min(F.struct("path", "filename", "member_no", "size")).alias("member"), F.count("*").alias("n"),
            F.min(top).alias("low"), F.max(top).alias("high"), F.every(top.isNotNull()).alias("below"),
        )
        .collect()
    )
    rooted = all(g.below for g in groups) and len({name for g in groups for name in (g.low, g.high)}) == 1
    found: dict[str, DataFrame] = {}
    for role in ("filters", "data"):
        of_role = [g for g in groups if (g.stripped if rooted else g.whole) == role]
        count = sum(g.n for g in of_role)
        if not count:
            raise ValueError(f"no {role} member: one CSV with 'key' in its name and one other CSV are needed")
        if count > 1:
            raise ValueError(f"{count} {role} members, which one counts is not defined")
        found[role] = spark.createDataFrame([of_role[0].member], bundle.MEMBER_SCHEMA)
    return found


_DATA_ARROW = pa.schema([("filename", pa.string()), ("content", pa.string())])


def _data_records(stream, index: int, strict: bool) -> Iterator[tuple[str, str]]:
    csv.field_size_limit(sys.maxsize)
    records = csv.reader(io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=""))
    header = True
    while True:
        try:
            record = next(records, None)
        except csv.Error:  # an unreadable record; the reader goes on with the next line
            continue
        if record is None:
            return
        if header or not record:
            header = header and not record
        elif len(record) > index:
            yield record[0], record[index]
        elif strict:
            raise ValueError(f"a row has no column {index}")


def scan_data_member(members: DataFrame, index: int = 0, strict: bool = True, tasks: int | None = None) -> DataFrame:
    """(filename, content) of data CSVs given as ``scan_bundle`` members, columns 0 and ``index``.

    A member is streamed by one task; its rows are then dealt out to ``tasks``, since encoding them is
    the larger work.  Header, short rows and empty cells as in ``scan_data_csv``; line breaks may stand
    in quotes.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for member in batch.to_pylist():
                with bundle.member_stream(member["path"], member["member_no"]) as stream:
                    names, contents, size = [], [], 0
                    for name, content in _data_records(stream, index, strict):
                        names.append(name)
                        contents.append(content)
                        size += len(content)
                        if len(names) >= bundle.ROWS_PER_BATCH or size >= bundle.BLOCK_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents)], schema=_DATA_ARROW)
                            names, contents, size = [], [], 0
                    if names:
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents)], schema=_DATA_ARROW)

    rows = members.repartition("path", "member_no").mapInArrow(task, "filename string, content string")
    return rows.repartition(tasks or 4 * members.sparkSession.sparkContext.defaultParallelism)
