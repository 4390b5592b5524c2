import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievetext.functions import bits as B


def words_of(vector):
    return B.pack_words(B.above_own_mean(np.array([vector]))).view("<i8")[0].tolist()


@pytest.mark.parametrize(
    ("vector", "words"),
    [
        ([1.0, 2.0, 3.0, 4.0], [12]),
        ([0.0, 0.0, 0.0, 4.0], [8]),
        ([0.5, 0.5, 0.5, 0.5], [0]),
        ([0.1] * 384, [0] * 6),
        ([0.0] * 63 + [1.0], [-9223372036854775808]),
        ([0.0] * 64 + [1.0], [0, 1]),
        ([0] * 5, [0]),
    ],
)
def test_binarize(spark, vector, words):
    assert words_of(vector) == words
    df = spark.createDataFrame([([float(x) for x in vector],)], "v array<double>")
    row = df.select(B.vector_bits()("v").alias("a"), B.binarize(F.col("v"), len(vector)).alias("e")).first()
    assert row.a == words and row.e == words


def test_large_longs_do_not_overflow():
    big = 2**62
    assert B.above_own_mean(np.array([[big, big - 1, big, big - 1]])).tolist() == [[True, False, True, False]]


def test_invariances_and_metric():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(200, 128)).astype(np.float32)
    flags = B.above_own_mean(rows)
    assert (flags == B.above_own_mean(rows * np.float32(8))).all()
    assert (flags == B.above_own_mean(rows.astype(np.float64) * 1e-12)).all()
    assert (flags == B.above_own_mean(rows.astype(np.float64) + 1024.0)).all()
    assert (flags == B.above_own_mean(rows[:, ::-1])[:, ::-1]).all()
    words = B.pack_words(flags)

    def dist(a, b):
        return int(np.bitwise_count(words[a] ^ words[b]).sum())

    for a, b, c in rng.integers(0, 200, size=(300, 3)):
        assert dist(a, a) == 0 and dist(a, b) == dist(b, a)
        assert dist(a, c) <= dist(a, b) + dist(b, c)
        assert dist(a, b) == int((flags[a] != flags[b]).sum())


def test_expression_and_arrow_agree(spark):
    rng = np.random.default_rng(5)
    for dim in (20, 64, 100, 384):
        data = [(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(50, dim)).astype(np.float32))]
        df = spark.createDataFrame(data, "i int, v array<float>")
        both = df.select(
            "i", "v", B.vector_bits()("v").alias("a"), B.binarize(F.col("v"), dim).alias("e")
        ).collect()
        for row in both:
            mean = math.fsum(row.v) / dim
            want = "".join("1" if x > mean else "0" for x in row.v)
            assert row.a == row.e
            assert "".join(f"{w & (2**64 - 1):064b}"[::-1] for w in row.a)[:dim] == want


def test_hamming_and_similarity(spark):
    row = spark.range(1).select(
        B.hamming_distance(F.array(F.lit(12).cast("long")), F.array(F.lit(8).cast("long"))).alias("d"),
        B.hamming_distance(F.array(F.lit(-1).cast("long")), F.array(F.lit(0).cast("long"))).alias("all"),
        B.bit_similarity(F.lit(96), 384).alias("s"),
        B.bit_string(F.array(F.lit(12).cast("long")), 6).alias("b"),
    ).first()
    assert (row.d, row["all"], row.s, row.b) == (1, 64, 0.75, "001100")


@pytest.mark.parametrize(("dim", "limit"), [(384, 134), (64, 22), (128, 44), (20, 6)])
def test_max_distance(dim, limit):
    assert B.max_distance(0.65, dim) == limit
    assert 1 - Decimal(limit) / dim > Decimal("0.65") >= 1 - Decimal(limit + 1) / dim


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.u for r in df.select(B.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert B.unit_rows(np.array([[3, 4], [0, 0]])).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_vectors_of_mixed_dimension_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="mixed dimension"):
        df.select(B.vector_bits()("v")).collect()


class _Counting:
    dim = 64

    def __init__(self):
        self.seen = []

    def raw(self, texts):
        self.seen.append((len(texts), sum(len(t or "") for t in texts.to_pylist())))
        return np.array([[(len(t or "") * (i + 3)) % 11 for i in range(64)] for t in texts.to_pylist()], np.int64).reshape(-1, 64)


def test_a_batch_is_encoded_in_parts_of_bounded_size():
    texts = ["x" * (i % 50) for i in range(3000)] + [None, "y" * (B.BYTES_AT_ONCE + 5), "z", "w" * (B.BYTES_AT_ONCE - 1), "v" * 9]
    encoder = _Counting()
    words, dim = B.packed_bits(encoder, pa.array(texts))
    assert dim == 64 and (words == B.pack_words(B.above_own_mean(_Counting().raw(pa.array(texts))))).all()
    assert sum(n for n, _ in encoder.seen) == len(texts)
    assert all(n <= B.TEXTS_AT_ONCE and (size <= B.BYTES_AT_ONCE or n == 1) for n, size in encoder.seen)
    assert len(B.packed_bits(encoder, pa.array([], pa.string()))[0]) == 0
