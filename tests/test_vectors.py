import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievetext.functions import folds
from sievetext.functions.encoders import HashEncoder
from sievetext.operators.vectors import (
    centroid_filters,
    centroid_sum,
    embed_anchors,
    embed_filters,
    masked_mean_pool,
    vector_sum,
)

from .plans import plan_of


def test_centroid_is_a_sum(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 3.0]), ("b", [0.5, -0.5])], "k string, v array<double>")
    got = {r.k: r.centroid for r in centroid_sum(rows, ["k"], "v").collect()}
    assert got == {"a": [1.0, 3.0], "b": [0.5, -0.5]}


def test_sum_does_not_depend_on_partitioning(spark):
    """A third of all rows in one group, any number of partitions: identical longs."""
    rng = np.random.default_rng(11)
    data = [(0 if i % 3 == 0 else i % 50, [float(x) for x in rng.normal(size=16)]) for i in range(3000)]
    rows = spark.createDataFrame(data, "k int, v array<double>")
    results = []
    for parts in (1, 4, 200):
        sums = vector_sum(rows.repartition(parts), ["k"], "v").collect()
        results.append({r.k: r.centroid for r in sums})
    assert results[0] == results[1] == results[2]
    want = np.zeros(16)
    for k, v in data:
        if k == 0:
            want += v
    assert np.allclose(np.array(results[0][0]) / 2**32, want)


def test_masked_mean_pool(spark):
    rows = [(1, [1.0, 3.0], 1), (1, [3.0, 5.0], 1), (1, [9.0, 9.0], 0), (2, [4.0, 4.0], 0)]
    tokens = spark.createDataFrame(rows, "id int, v array<double>, m int")
    got = {r.id: r.pooled for r in masked_mean_pool(tokens, ["id"], "v", "m").collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_filters_from_anchors(spark):
    rows = spark.createDataFrame(
        [(0, "pets", ["my dog is big", "the cat sleeps"]), (1, "none", []), (2, "pets", ["another pet line"])],
        "ord long, category string, anchors array<string>",
    )
    encoder = HashEncoder(128)
    arrays = {r.ord: r for r in embed_filters(rows, encoder).collect()}
    assert set(arrays) == {0, 2} and arrays[0].category == "pets" and arrays[0].dim == 128
    exploded = rows.select("ord", "category", F.explode("anchors").alias("anchor"))
    assert {r.ord: r.bits for r in embed_anchors(exploded, encoder).collect()} == {o: r.bits for o, r in arrays.items()}


def test_sum_and_mean_give_the_same_bits(spark):
    rng = np.random.default_rng(2)
    data = [(0, "c", [float(x) for x in v / np.linalg.norm(v)]) for v in rng.normal(size=(7, 64))]
    rows = spark.createDataFrame(data, "ord long, category string, v array<double>")
    bits = centroid_filters(rows, "v").first().bits
    mean = np.mean([d[2] for d in data], axis=0)
    want = sum(1 << i for i in range(64) if mean[i] > mean.mean())
    assert bits[0] & (2**64 - 1) == want


@pytest.mark.parametrize("entry", [1e30, -1e30, float("nan"), 2147483648.0])
def test_entries_that_do_not_fit_raise(spark, entry):
    rows = spark.createDataFrame([(1, [entry, 0.5])], "k int, v array<double>")
    with pytest.raises(Exception, match="NaN or too large"):
        centroid_sum(rows, ["k"], "v").collect()


def test_sums_are_rounded_to_the_documented_unit(spark):
    rows = spark.createDataFrame([(1, [1e-12, 2.0**-32])], "k int, v array<double>")
    assert centroid_sum(rows, ["k"], "v").first().centroid == [0.0, 2.0**-32]


def test_arrays_are_what_is_shuffled(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1)], "k int, v array<double>, m int")
    for plan in (plan_of(vector_sum(rows, ["k"], "v")), plan_of(masked_mean_pool(rows, ["k"], "v", "m"))):
        assert "Generate" not in plan and "HashAggregate" not in plan and plan.count("MapInArrow") == 3
        assert "hashpartitioning(k" in plan


def test_sums_of_odd_vectors(spark):
    schema = "k string, n int, v array<float>, m int"
    rows = [("a", 1, [1.0, None], 1), ("a", 1, [2.0, 5.0], None), (None, 1, [4.0, 4.0], 2), ("b", 2, None, 1), (None, 1, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r.k, r.n): r.centroid for r in centroid_sum(frame, ["k", "n"], "v").collect()}
    assert got == {("a", 1): [3.0, 5.0], (None, 1): [5.0, 4.0]}
    assert centroid_sum(frame, [], "v").first().centroid == [8.0, 9.0]
    pooled = {r.k: r.pooled for r in masked_mean_pool(frame, ["k"], "v", "m").collect()}
    assert pooled == {"a": [1.0, 0.0], None: [3.0, 8.0 / 3]}
    assert centroid_sum(frame.limit(0), ["k"], "v").collect() == []
    with pytest.raises(Exception, match="mixed dimension"):
        centroid_sum(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "k string, v array<float>").coalesce(1), ["k"], "v").collect()
    with pytest.raises(Exception, match="too large for a long"):
        centroid_sum(spark.createDataFrame([("a", [2.0**30])] * 4, "k string, v array<double>"), ["k"], "v").collect()
    with pytest.raises(Exception, match="NaN or too large"):
        centroid_sum(spark.createDataFrame([("a", [float("nan"), None])], "k string, v array<double>"), ["k"], "v").collect()


def test_a_fold_hands_on_what_it_holds(monkeypatch):
    schema = pa.schema([("k", pa.int64()), ("sums", pa.list_(pa.int64()))])
    keys = [i % 700 for i in range(5000)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(part), pa.array([[k, 1] for k in part], pa.list_(pa.int64()))], schema=schema)
        for part in (keys[i : i + 100] for i in range(0, 5000, 100))
    ]
    rows_of = lambda batch: (folds.matrix_of(batch.column(1)), np.arange(batch.num_rows))
    whole = list(folds.fold(iter(batches), 1, rows_of, schema))
    monkeypatch.setattr(folds, "HELD_BYTES", 4000)
    parts = list(folds.fold(iter(batches), 1, rows_of, schema))
    assert len(whole) == 1 and len(parts) > 5
    total = {}
    for k, sums in (row for part in parts for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
        total[k] = [a + b for a, b in zip(total.get(k, [0, 0]), sums)]
    want = dict(zip(whole[0].column(0).to_pylist(), whole[0].column(1).to_pylist()))
    assert total == want and want[3] == [3 * 8, 8]
    in_order = sorted(keys)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(part), pa.array([[1] for _ in part], pa.list_(pa.int64()))], schema=schema)
        for part in (in_order[i : i + 64] for i in range(0, 5000, 64))
    ]
    once = [k for part in folds.fold(iter(batches), 1, rows_of, schema, sorted_=True) for k in part.column(0).to_pylist()]
    assert once == list(range(700))
