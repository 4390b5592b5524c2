"""Vector aggregation and the embedding of filter tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.bits import FIXED_ONE, VECTOR_TYPE, embed_text, let, matrix_of, vector_bits
from ..functions.encoders import VectorTable
from ..functions.folds import fixed_rows, fold


#: Parts that a key's partial sums are added up in before its last sum.
SALTS = 32


def _folded(rows: DataFrame, keys: Sequence[str], vector: str, weight: str | None) -> DataFrame:
    """(keys, sums array<long>) by three folds of arrays: in each task, by salted key, and by key.

    With a ``weight`` column, rows count that often and the weights' sum is the last entry.
    """
    named = rows.select(*keys, F.col(vector).cast(VECTOR_TYPE).alias("v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w"))
    named = named.where(F.col("v").isNotNull())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[: len(keys)])
    schema = f"{kinds}{', ' if keys else ''}sums array<bigint>"
    arrow = to_arrow_schema(named.sparkSession.createDataFrame([], schema).schema)
    weighted, n = weight is not None, len(keys)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            matrix = fixed_rows(batch.column(n))
            if weighted:
                counts = pc.fill_null(batch.column(n + 1), 0).to_numpy(zero_copy_only=False)[:, None]
                if matrix.size and int(np.abs(matrix).max()) * int(np.abs(counts).max()) >= 2**63:
                    raise OverflowError("a weighted vector is too large for a sum")
                matrix = np.hstack([matrix * counts, counts])
            return matrix, np.arange(len(matrix))

        yield from fold(batches, n, rows_of, arrow)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(batches, n, lambda batch: (matrix_of(batch.column(n)), np.arange(batch.num_rows)), arrow, sorted_=True)

    columns = [F.col(f"`{key}`") for key in keys]
    partial = named.mapInArrow(first, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = partial.repartition(*columns, "salt").sortWithinPartitions(*columns, "salt").drop("salt").mapInArrow(again, schema)
    if not keys:  # one array a part is left
        return salted.coalesce(1).mapInArrow(again, schema)
    return salted.repartition(*columns).sortWithinPartitions(*columns).mapInArrow(again, schema)


def vector_sum(rows: DataFrame, keys: Sequence[str], vector: str, into: str = "centroid") -> DataFrame:
    """Element-wise sum of a group's vectors as fixed-point longs (units of 2**-32).

    Every task folds its rows into one array per key, and arrays are what is shuffled: their number
    does not grow with the size of a group, and a group that holds a third of all rows costs no more
    than any other.  Long sums do not depend on the order of the rows.  Entries are rounded to that
    unit, null entries count nothing and null vectors are left out; NaN, entries of 2**31 or more, an
    overflow and vectors of mixed dimension raise.
    """
    return _folded(rows, keys, vector, None).withColumnRenamed("sums", into)


def centroid_sum(rows: DataFrame, keys: Sequence[str], vector: str, into: str = "centroid") -> DataFrame:
    """``vector_sum`` as doubles: not divided by the count, not normalised again."""
    fixed = vector_sum(rows, keys, vector, into)
    return fixed.withColumn(into, F.transform(into, lambda x: x / F.lit(FIXED_ONE)))


def masked_mean_pool(
    tokens: DataFrame, keys: Sequence[str], vector: str, mask: str, into: str = "pooled"
) -> DataFrame:
    """Mean of the token vectors whose mask is 1; all-masked groups give zeros, a null mask is 0."""
    sums = _folded(tokens.withColumn("__mask", F.col(mask).cast("long")), keys, vector, "__mask")
    kept = F.greatest(F.element_at("sums", -1).cast("double"), F.lit(1e-9))
    means = let(kept, lambda n: F.transform(F.slice("sums", 1, F.size("sums") - 1), lambda x: x / F.lit(FIXED_ONE) / n))
    return sums.select(*[F.col(f"`{key}`") for key in keys], means.alias(into))


def embed(rows: DataFrame, encoder, text: str, into: str = "embedding") -> DataFrame:
    """Add a unit vector per row with any encoder."""
    if isinstance(encoder, VectorTable):
        return encoder.attach(rows, text, into)
    return rows.withColumn(into, embed_text(encoder)(F.col(text)))


def embed_filters(filters: DataFrame, encoder) -> DataFrame:
    """(ord, category, anchors) to (ord, category, dim, bits).

    Filters without anchors vanish; equal categories stay separate filters.
    """
    return embed_anchors(filters.select("ord", "category", F.explode("anchors").alias("anchor")), encoder)


def embed_anchors(anchors: DataFrame, encoder) -> DataFrame:
    """The same from one row per anchor (ord, category, anchor), any number per filter.

    Each anchor is embedded on its own, the unit vectors of one filter are added up,
    and the sum is binarized.
    """
    return centroid_filters(embed(anchors, encoder, "anchor", "vector"), "vector")


def centroid_filters(vectors: DataFrame, vector: str) -> DataFrame:
    """One filter per (ord, category) from the vectors of its anchors."""
    sums = vector_sum(vectors, ["ord", "category"], vector, "centroid")
    return sums.select(
        "ord", "category", F.size("centroid").alias("dim"), vector_bits()("centroid").alias("bits")
    )
