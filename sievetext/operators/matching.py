"""Nearest filter, threshold, and reports on the matches.

The filter table is checked and read once, its packed words go to every task, and a row takes the
minimum over blocks of filters where it lies; the corpus side is never shuffled or stored for it.
From PIVOTED_FROM filters on, blocks of like filters are passed over by the triangle inequality
(``functions/pivots.py``); the matches are the same.  Category names come by an equi join
on ``ord`` afterwards, so their length does not matter to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.pivots import PivotTable

#: Filters of 384 bits are 56 bytes each in a task, so this many are 235 MB; more are refused.
MOST_FILTERS = 1 << 22
#: From so many on, building the table of pivots pays.
PIVOTED_FROM = 1 << 14


def load_bank(filters: DataFrame) -> tuple[B.FilterBank, DataFrame]:
    """The checked filter table as a bank for the tasks, and its names as (__ord, __category).

    A null or repeated ``ord``, filters of mixed dimension and more than MOST_FILTERS raise,
    whatever the size; null categories stay null.
    """
    columns = filters.select(F.col("ord").cast("long").alias("ord"), "category", F.col("dim").cast("int").alias("dim"), "bits")
    table = columns.limit(MOST_FILTERS + 1).toArrow()
    if table.num_rows > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    names = pa.table({"__ord": table["ord"], "__category": table["category"].cast(pa.string())})
    named = filters.sparkSession.createDataFrame(names) if table.num_rows else None
    if table.num_rows == 0:
        return B.FilterBank(0, np.zeros(0, np.int64), np.zeros((0, 0), "<u8")), named
    if table["ord"].null_count:
        raise ValueError("filter ord values must not be null")
    ords = table["ord"].to_numpy()
    if len(np.unique(ords)) != len(ords):
        raise ValueError("filter ord values must be unique")
    dims = set(table["dim"].unique().to_pylist())
    if len(dims) != 1:
        raise ValueError(f"filters of mixed dimension: {sorted(dims, key=str)}")
    words = B.matrix_of(table["bits"].combine_chunks()).astype("<i8").view("<u8")
    order = np.argsort(ords, kind="stable")
    words = np.ascontiguousarray(words[order])
    dim = dims.pop()
    table = PivotTable.of(words, dim) if len(words) >= PIVOTED_FROM else None
    return B.FilterBank(dim, ords[order], words, table), named


def nearest_filter(
    rows: DataFrame, filters: DataFrame, match: Callable[[Broadcast], Column], threshold: float | None = None
) -> tuple[DataFrame, int]:
    """Rows plus ``best`` = (ord, category, dist) of the nearest filter, and the dimension.

    ``match`` goes straight from the row to the nearest filter of a bank.  An empty filter
    table matches nothing.  Rows that no filter scores above the threshold may be missing.
    """
    bank, names = load_bank(filters)
    if names is None:
        empty = F.lit(None).cast("struct<ord:bigint,category:string,dist:int>")
        return rows.withColumn("best", empty).filter(F.lit(False)), 0
    if threshold is not None:
        bank = replace(bank, limit=B.max_distance(threshold, bank.dim))
    # The planner broadcasts the names only when they are small.
    held = rows.sparkSession.sparkContext.broadcast(bank)  # at most MOST_FILTERS
    found = rows.withColumn("__best", match(held)).join(names, F.col("__best.ord") == F.col("__ord"))
    best = F.struct(F.col("__best.ord").alias("ord"), F.col("__category").alias("category"), F.col("__best.dist").alias("dist"))
    return found.select(*rows.columns, best.alias("best")), bank.dim


def best_match(rows: DataFrame, filters: DataFrame, bits: str = "bits", threshold: float | None = None) -> DataFrame:
    """Nearest filter per row of packed bits; the first filter wins ties.

    Adds ord, category, dist and score.  Packed words carry no dimension, so only their number
    is checked against the filters'.  With a threshold only rows that score above it are kept.
    """
    return _matched(rows, filters, lambda bank: B.match_bits(bank)(F.col(bits)), threshold)


def best_match_vectors(rows: DataFrame, filters: DataFrame, vector: str = "embedding", threshold: float | None = None) -> DataFrame:
    """Nearest filter per row of vectors: binarize and match in one Arrow step."""
    return _matched(rows, filters, lambda bank: B.match_vector(bank)(F.col(vector)), threshold)


def best_match_texts(rows: DataFrame, filters: DataFrame, encoder, text: str = "content", threshold: float | None = None) -> DataFrame:
    """Nearest filter per row of text: encode, binarize and match in one Arrow step."""
    return _matched(rows, filters, lambda bank: B.match_text(encoder, bank)(F.col(text)), threshold)


def _matched(rows: DataFrame, filters: DataFrame, match: Callable[[Broadcast], Column], threshold: float | None) -> DataFrame:
    found = with_score(*nearest_filter(rows, filters, match, threshold))
    return found if threshold is None else threshold_filter(found, threshold)


def with_score(matched: DataFrame, dim: int) -> DataFrame:
    """Unpack ``best``; the dimension goes along as ``dim``."""
    width = dim or 1
    return matched.select(
        *[c for c in matched.columns if c != "best"],
        F.col("best.ord").alias("ord"),
        F.col("best.category").alias("category"),
        F.col("best.dist").alias("dist"),
        F.lit(width).alias("dim"),
        B.bit_similarity(F.col("best.dist"), width).alias("score"),
    )


def threshold_filter(matched: DataFrame, threshold: float, dim: int | None = None) -> DataFrame:
    """Keep rows whose score is strictly above the threshold, as an integer comparison.

    ``1 - dist/dim > t`` is ``dist < dim * (1 - t)``; with decimals on both sides it
    is exact for every dimension.
    """
    if dim is not None:
        return matched.filter(F.col("dist") <= B.max_distance(threshold, dim))
    room = F.lit(f"{threshold}").cast("decimal(20,15)")
    return matched.filter(
        F.col("dist").cast("decimal(10,0)") < F.col("dim").cast("decimal(10,0)") * (F.lit(1) - room)
    )


def score_all(rows: DataFrame, filters: DataFrame, bits: str = "bits") -> DataFrame:
    """Every row with every filter, its distance and score: the full score table.

    The filters travel as one array, read once by a scalar subquery, and each row
    is expanded where it lies; there is no join and no shuffle of the rows.
    """
    packed = F.array_sort(F.collect_list(F.struct("ord", "category", "dim", "bits")))
    array = filters.agg(packed.alias("filters")).scalar()
    expanded = rows.withColumn("f", F.explode(array))
    return expanded.withColumn("dist", B.hamming_distance(F.col(bits), F.col("f.bits"))).select(
        *rows.columns,
        F.col("f.ord").alias("ord"),
        F.col("f.category").alias("category"),
        "dist",
        (F.lit(1.0) - F.col("dist") / F.col("f.dim")).alias("score"),
    )


def match_summary(matches: DataFrame) -> DataFrame:
    """Matched rows, mean and best score per category."""
    return matches.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score")
    )


def reduction(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: rows in, rows out and the share that was kept, of any two tables."""
    counted = rows.select(F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        matches.select(F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return _shares(counted.agg(F.sum("i").alias("rows_in"), F.sum("o").alias("rows_out")))


def reduction_of(matched: DataFrame, threshold: float) -> DataFrame:
    """The same in one pass over rows matched but not yet held against the threshold."""
    room = F.lit(f"{threshold}").cast("decimal(20,15)")
    over = F.col("dist").cast("decimal(10,0)") < F.col("dim").cast("decimal(10,0)") * (F.lit(1) - room)
    return _shares(matched.agg(F.count("*").alias("rows_in"), F.count_if(over).alias("rows_out")))


def _shares(total: DataFrame) -> DataFrame:
    return total.withColumn("kept", F.try_divide(F.col("rows_out").cast("double"), F.col("rows_in")))


def top_k_per_category(matches: DataFrame, k: int, key: str) -> DataFrame:
    """The k best rows of each category, by distance and then key.

    The k best of each of 256 parts of a category come first, so that a hot category
    does not end up whole in one task; every column but ``rank`` stays as it was.
    """
    order = [F.col("dist"), F.col(key)]
    names = [c for c in matches.columns if c != "rank"]
    salt, place = (_spare(matches, name) for name in ("__salt", "__place"))
    within = Window.partitionBy("category", salt).orderBy(*order)
    parts = matches.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(256))).withColumn(place, F.row_number().over(within))
    best = parts.filter(F.col(place) <= k).select(*names)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def _spare(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name = f"_{name}"
    return name
