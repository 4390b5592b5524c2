"""Vectors to bits, bits to distances.

The Arrow functions are the ones used on large inputs.  They are marked
non-deterministic so that the optimizer neither evaluates them twice (a filter on
their result would otherwise be planned with a second copy) nor infers extra
filters from them; their results are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_CEILING, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pivots import PivotTable

WORD_BITS = 64
FIXED_ONE = 4294967296.0  # 2**32: sums of fixed-point entries do not depend on their order
ROWS_TIMES_FILTERS = 1 << 20
FILTERS_PER_BLOCK = 1 << 12
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1 << 10, 1 << 22

VECTOR_TYPE = T.ArrayType(T.DoubleType())
BITS_TYPE = T.ArrayType(T.LongType())
MATCH_TYPE = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("dist", T.IntegerType()),
    ]
)


# ---------------------------------------------------------------- numpy kernels
def matrix_of(vectors: pa.Array) -> np.ndarray:
    """An Arrow list array as a matrix; all rows must have one length."""
    if vectors.null_count:
        raise ValueError("null vector")
    if len(vectors) == 0:
        return np.zeros((0, 0))
    sizes = np.diff(np.asarray(vectors.offsets))
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of mixed dimension: {np.unique(sizes)[:5].tolist()}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), int(sizes[0]))


def above_own_mean(matrix: np.ndarray) -> np.ndarray:
    """True where an entry is strictly above its row's mean.

    Works in integers, where ``x > sum / D`` is ``x > floor(sum / D)``: a float row is
    first scaled by a power of two that keeps its leading bits.  So the order of the
    sum, the scale of the row and rounding play no part, and a constant row has no
    entry above its mean.  A row that is not finite has none either.
    """
    rows, dim = matrix.shape
    if not matrix.size:
        return np.zeros((rows, dim), dtype=bool)
    largest, smallest = matrix.max(axis=1), matrix.min(axis=1)
    if matrix.dtype.kind == "f":
        reach = np.maximum(largest, -smallest).astype(np.float64)
        finite = np.isfinite(reach)
        wide = matrix.astype(np.float64)
        if not finite.all():
            wide[~finite] = 0.0
        _, exponent = np.frexp(np.where(finite, reach, 0.0))
        wide *= np.ldexp(1.0, scaled_bits(dim) - np.maximum(exponent, -900))[:, None]
        whole = np.rint(wide, out=wide).astype(np.int64)
    else:
        whole = matrix.astype(np.int64, copy=False)
        if max(abs(int(largest.max())), abs(int(smallest.min()))) >= 2**62 // dim:
            whole = whole.astype(object)
    return (whole > (whole.sum(axis=1) // dim)[:, None]).astype(bool)


def scaled_bits(dim: int) -> int:
    """Bits an entry may have so that D of them add up inside a long."""
    return min(53, 62 - max(dim - 1, 1).bit_length())


def pack_words(flags: np.ndarray) -> np.ndarray:
    """Bit i of a row goes to word i/64, bit i%64."""
    rows, dim = flags.shape
    words = -(-dim // WORD_BITS)
    packed = np.zeros((rows, words * 8), dtype=np.uint8)
    packed[:, : -(-dim // 8)] = np.packbits(flags, axis=1, bitorder="little")
    return packed.view("<u8")


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their L2 norm; a zero row stays zero."""
    wide = matrix.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))[:, None]
    return np.divide(wide, norms, out=np.zeros_like(wide), where=norms != 0)


def list_array(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


@dataclass(frozen=True)
class FilterBank:
    """The filters, ordered by ``ord``, held by every task."""

    dim: int
    ords: np.ndarray
    words: np.ndarray
    #: For very many filters: the same ones in blocks behind pivots.
    table: PivotTable | None = None
    #: Rows without a filter this near may be left unmatched.
    limit: int | None = None

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and distance of the nearest filter; the first one wins ties.  -1: none within the limit."""
        if self.table is not None:
            return self.table.nearest(rows, self.limit)[:2]
        return self.scan(rows)

    def scan(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing every row with every filter."""
        where = np.zeros(len(rows), dtype=np.int64)
        dist = np.full(len(rows), np.iinfo(np.int32).max, dtype=np.int32)
        for first in range(0, len(self.ords), FILTERS_PER_BLOCK):
            block = self.words[first : first + FILTERS_PER_BLOCK]
            step = max(1, ROWS_TIMES_FILTERS // len(block))
            for start in range(0, len(rows), step):
                columns = np.ascontiguousarray(rows[start : start + step].T)
                total = np.zeros((len(block), columns.shape[1]), dtype=np.int32)
                for w, column in enumerate(columns):
                    total += np.bitwise_count(column[None, :] ^ block[:, w, None])
                best = total.argmin(axis=0)
                low = total[best, np.arange(len(best))]
                part = slice(start, start + step)
                nearer = low < dist[part]  # an equal one in a later block does not count
                where[part] = np.where(nearer, best + first, where[part])
                dist[part] = np.where(nearer, low, dist[part])
        return where, dist

    def match(self, rows: np.ndarray, dim: int) -> pa.Array:
        if len(rows) and dim != self.dim:
            raise ValueError(f"rows have dimension {dim}, filters {self.dim}")
        where, dist = self.nearest(rows)
        return pa.StructArray.from_arrays([pa.array(self.ords[where], mask=where < 0), pa.array(dist, type=pa.int32())], ["ord", "dist"])


# ---------------------------------------------------------------- Arrow functions
def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of TEXTS_AT_ONCE rows and BYTES_AT_ONCE bytes at most, or a single longer text.

    An encoder's matrices are many times as large as the texts, and a batch has up to 10,000 of those.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        room = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES_AT_ONCE, side="right"))
        stop = min(max(room, start + 1), start + TEXTS_AT_ONCE, len(texts))
        yield texts.slice(start, stop - start)
        start = stop


def packed_bits(encoder, texts: pa.Array) -> tuple[np.ndarray, int]:
    """Packed bits of texts, and the dimension of their vectors (0 without texts)."""
    found = [(pack_words(above_own_mean(raw)), raw.shape[1]) for raw in map(encoder.raw, parts_of(texts))]
    dims = {dim for _, dim in found}
    if len(dims) > 1:
        raise ValueError(f"an encoder's vectors have dimensions {sorted(dims)}")
    return (np.concatenate([words for words, _ in found]), dims.pop()) if found else (np.zeros((0, 0), "<u8"), 0)


def embed_text(encoder):
    """text -> unit vector."""

    @F.arrow_udf(VECTOR_TYPE)
    def embed(texts: pa.Array) -> pa.Array:
        return list_array(unit_rows(encoder.raw(texts)))

    return embed.asNondeterministic()


def text_bits(encoder):
    """text -> packed bits, without shipping the vector back to the JVM."""

    @F.arrow_udf(BITS_TYPE)
    def bits(texts: pa.Array) -> pa.Array:
        return list_array(packed_bits(encoder, texts)[0].view("<i8"))

    return bits.asNondeterministic()


def vector_bits():
    """vector -> packed bits."""

    @F.arrow_udf(BITS_TYPE)
    def bits(vectors: pa.Array) -> pa.Array:
        return list_array(pack_words(above_own_mean(matrix_of(vectors))).view("<i8"))

    return bits.asNondeterministic()


def match_text(encoder, bank: Broadcast):
    """text -> nearest filter: encode, binarize and match one Arrow batch at a time.

    The bank is a broadcast variable: it comes to an executor once and is unpickled once a worker.
    """

    @F.arrow_udf(MATCH_TYPE)
    def match(texts: pa.Array) -> pa.Array:
        return bank.value.match(*packed_bits(encoder, texts))

    return match.asNondeterministic()


def match_vector(bank: Broadcast):
    """vector -> nearest filter."""

    @F.arrow_udf(MATCH_TYPE)
    def match(vectors: pa.Array) -> pa.Array:
        matrix = matrix_of(vectors)
        return bank.value.match(pack_words(above_own_mean(matrix)), matrix.shape[1])

    return match.asNondeterministic()


def match_bits(bank: Broadcast):
    """packed bits -> nearest filter."""

    @F.arrow_udf(MATCH_TYPE)
    def match(words: pa.Array) -> pa.Array:
        matrix = matrix_of(words).astype("<i8").view("<u8")
        filters = bank.value
        if len(matrix) and matrix.shape[1] != filters.words.shape[1]:
            raise ValueError(f"rows have {matrix.shape[1]} words, filters {filters.words.shape[1]}")
        return filters.match(matrix, filters.dim)

    return match.asNondeterministic()


# ---------------------------------------------------------------- JVM expressions
def let(value: Column, body) -> Column:
    """Bind ``value`` once, so that a lambda inside ``body`` does not recompute it per element."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(vector: Column) -> Column:
    """v / |v|; a zero vector stays zero."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))
    return let(
        norm,
        lambda n: F.transform(wide, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))),
    )


def to_fixed(x: Column) -> Column:
    """Units of 2**-32, rounded; what does not fit (NaN, 2**31 or more) raises instead of saturating."""
    wide = x.cast("double")
    outside = F.isnan(wide) | (F.abs(wide) >= F.lit(2147483648.0))
    error = F.raise_error(F.lit("a vector entry is NaN or too large for a sum")).cast("bigint")
    return F.when(outside, error).otherwise(F.floor(wide * F.lit(FIXED_ONE) + F.lit(0.5)))


def binarize(vector: Column, dim: int) -> Column:
    """Expression twin of ``vector_bits`` for small inputs, without a Python worker."""
    wide = F.when(F.size(vector) == dim, vector.cast("array<double>")).otherwise(
        F.raise_error(F.lit(f"a vector has not {dim} entries")).cast("array<double>")
    )
    largest = F.array_max(F.transform(wide, lambda x: F.abs(x)))
    # A power of two that brings the largest entry close to, but not over, the allowed bits.
    scale = F.pow(F.lit(2.0), scaled_bits(dim) - 1 - F.ceil(F.log2(F.nullif(largest, F.lit(0.0)))))

    def words(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + x)
        return let(total, lambda s: F.array(*[word(v, s, w) for w in range(-(-dim // WORD_BITS))]))

    def word(v: Column, s: Column, w: int) -> Column:
        flags = F.transform(
            F.slice(v, w * WORD_BITS + 1, WORD_BITS),
            lambda x, i: F.when(x * dim > s, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(0),
        )
        return F.aggregate(flags, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    scaled = let(
        F.coalesce(scale, F.lit(1.0)),
        lambda factor: F.transform(wide, lambda x: F.rint(x * factor).cast("bigint")),
    )
    return let(scaled, words)


def bit_string(words: Column, dim: int) -> Column:
    """The first ``dim`` bits as text, bit 0 first."""
    parts = F.transform(words, lambda w: F.reverse(F.lpad(F.bin(w), WORD_BITS, "0")))
    return F.substring(F.array_join(parts, ""), 1, dim)


def hamming_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c
    )


def bit_similarity(dist: Column, dim) -> Column:
    return F.lit(1.0) - dist / F.lit(float(dim))


def max_distance(threshold: float, dim: int) -> int:
    """Largest distance whose score ``1 - d/dim`` is strictly above the threshold.

    Computed exactly, so that the filter is an integer comparison.
    """
    limit = Decimal(dim) * (1 - Decimal(str(threshold)))
    return int(limit.to_integral_value(rounding=ROUND_CEILING)) - 1
