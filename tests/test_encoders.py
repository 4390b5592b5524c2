import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievetext.functions import encoders as E
from sievetext.functions.bits import text_bits
from sievetext.functions.encoders import ModelEncoder, VectorTable
from sievetext.operators.vectors import embed


def brute_force(text, dim):
    total = np.zeros(dim, dtype=np.int64)
    for token in re.findall(r"[^\W_]+", text.lower()):
        digest = "".join(hashlib.md5(f"{token}#{k}".encode()).hexdigest() for k in range(dim // 128))
        bits = bin(int(digest, 16))[2:].zfill(dim)
        total += np.array([1 if b == "1" else -1 for b in bits])
    return total


@pytest.mark.parametrize("dim", [128, 384])
def test_hash_encoder_equals_brute_force(dim):
    texts = ["The cat, the CAT; a dog", "", "...", "Étude 12é 你好 x_y", "one", "one one  one\n"]
    got = E.HashEncoder(dim).raw(pa.array([*texts, None]))
    for text, row in zip([*texts, ""], got):
        assert (row == brute_force(text, dim)).all(), text


def test_long_texts_cross_blocks(monkeypatch):
    texts = [" ".join(f"w{i % 97}" for i in range(n)) for n in (1, 50, 0, 333, 7, 1000)]
    want = E.HashEncoder(128).raw(pa.array(texts))
    for size in (1, 13, 64):
        monkeypatch.setattr(E, "TOKENS_PER_BLOCK", size)
        monkeypatch.setattr(E, "CACHED_TOKENS", 10)
        assert (E.HashEncoder(128).raw(pa.array(texts)) == want).all()


def test_sliced_arrow_input():
    texts = pa.array(["skip", "one two", "three", "tail"]).slice(1, 2)
    assert (E.HashEncoder(128).raw(texts) == E.HashEncoder(128).raw(pa.array(["one two", "three"]))).all()


def test_bad_dimension():
    with pytest.raises(ValueError, match="multiple of 128"):
        E.HashEncoder(100)


def test_model_encoder(spark):
    def factory():
        def model(texts):
            return np.array([[len(t), t.count("a"), 1.0, 0.0] for t in texts])

        return model

    encoder = E.ModelEncoder(factory, dim=4, batch_size=2)
    df = spark.createDataFrame([("aa",), ("b",), (None,), ("aaa",), ("x",)], "t string").coalesce(1)
    for row in embed(df, encoder, "t", "v").collect():
        raw = np.array([len(row.t or ""), (row.t or "").count("a"), 1.0, 0.0])
        assert np.allclose(row.v, raw / np.linalg.norm(raw))


def test_model_of_wrong_shape_fails():
    with pytest.raises(ValueError, match="shape"):
        E.ModelEncoder(lambda: lambda texts: np.zeros((len(texts), 3)), dim=4).raw(pa.array(["a"]))


def test_vector_table(spark):
    table = E.VectorTable(spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "k string, e array<double>"), "k", "e")
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "i int, key string")
    rows = {r.i: r.v for r in table.attach(docs, "key", "v").collect()}
    assert rows == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 0.0]}
    with pytest.raises(Exception, match="no vector for key z"):
        table.attach(docs.union(spark.createDataFrame([(4, "z")], "i int, key string")), "key", "v").collect()


def test_text_bits_equal_bits_of_exact_sums(spark):
    from sievetext.functions.bits import above_own_mean, bit_string, text_bits

    encoder = E.HashEncoder(128)
    df = spark.createDataFrame([("alpha beta",), ("",), ("gamma gamma delta",)], "t string")
    for row in df.select("t", bit_string(text_bits(encoder)("t"), 128).alias("b")).collect():
        flags = above_own_mean(brute_force(row.t, 128)[None, :])[0]
        assert row.b == "".join("1" if f else "0" for f in flags)
    assert df.select(F.size(text_bits(encoder)("t")).alias("n")).distinct().collect()[0].n == 2


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.ones((len(texts), 4))

    rows = spark.range(64).repartition(16).selectExpr("cast(id as string) as t")
    rows.select(text_bits(ModelEncoder(factory, 4))("t").alias("b")).write.format("noop").mode("overwrite").save()
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads))


def test_a_repeated_key_in_a_vector_table_raises(spark):
    vectors = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), ("b", [3.0])], "k string, v array<double>")
    rows = spark.createDataFrame([("b",)], "t string")
    assert VectorTable(vectors, "k", "v").attach(rows, "t", "x").first().x == [3.0]
    with pytest.raises(Exception, match="more than one vector"):
        VectorTable(vectors, "k", "v").attach(rows.union(rows.selectExpr("'a'")), "t", "x").collect()
