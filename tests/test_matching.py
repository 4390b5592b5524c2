import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievetext.functions import bits as B
from sievetext.functions.encoders import HashEncoder
from sievetext.operators import matching as M
from sievetext.plans.trim import trim_against, trim_vectors
from sievetext.operators.vectors import embed_filters
from tests.plans import plan_of

FILTER_SCHEMA = "ord long, category string, dim int, bits array<bigint>"


def bits_of(flags):
    return [int(w) for w in B.pack_words(np.array([flags], dtype=bool)).view("<i8")[0]]


def random_bits(n, dim, seed):
    return np.random.default_rng(seed).random((n, dim)) > 0.5


@pytest.fixture(scope="module")
def world(spark):
    """300 rows and 40 filters of 128 bits; a third of the rows are copies of one row."""
    rows, filters = random_bits(300, 128, 1), random_bits(40, 128, 2)
    rows[::3] = rows[0]
    filters[7] = filters[3]
    row_df = spark.createDataFrame([(i, bits_of(r)) for i, r in enumerate(rows)], "id long, bits array<bigint>")
    filter_df = spark.createDataFrame(
        [(i, f"c{i}", 128, bits_of(f)) for i, f in enumerate(filters)], FILTER_SCHEMA
    )
    dists = (rows[:, None, :] != filters[None, :, :]).sum(axis=2)
    return row_df, filter_df, dists


def test_best_match_equals_brute_force(world):
    rows, filters, dists = world
    got = {r.id: (r.ord, r.category, r.dist, r.score) for r in M.best_match(rows, filters).collect()}
    for i, row in enumerate(dists):
        best = int(row.argmin())
        assert got[i] == (best, f"c{best}", int(row[best]), 1 - row[best] / 128)


@pytest.mark.parametrize("block", [39, 10, 3, 1])
def test_blocks_of_filters_give_the_same_matches(world, monkeypatch, block):
    rows, filters, _ = world
    bank, _ = M.load_bank(filters)
    matrix = np.array([r.bits for r in rows.orderBy("id").collect()], "<i8").view("<u8")
    want = bank.nearest(matrix)
    monkeypatch.setattr(B, "FILTERS_PER_BLOCK", block)
    for got, wanted in zip(bank.nearest(matrix), want, strict=True):
        assert got.tolist() == wanted.tolist()


@pytest.mark.parametrize("n", [1, 20_000, 100_000])
def test_any_number_of_filters(spark, world, n):
    """One plan, the same rules and nulls whatever the number of filters."""
    rows, _, _ = world
    words = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, (n, 2))
    words[n // 2] = words[0]
    filters = spark.createDataFrame(
        pa.table({"ord": np.arange(n), "category": pa.array([None] * n, pa.string()), "dim": np.full(n, 128, np.int32), "bits": pa.array(words.tolist(), pa.list_(pa.int64()))})
    )
    got = M.best_match(rows, filters)
    some = rows.orderBy("id").limit(20)
    matrix = np.array([r.bits for r in some.collect()], "<i8").view("<u8")
    dists = sum(np.bitwise_count(matrix[:, w, None] ^ words.view("<u8")[None, :, w]).astype(int) for w in range(2))
    found = {r.id: (r.ord, r.category, r.dist) for r in got.filter("id < 20").collect()}
    assert found == {i: (int(d.argmin()), None, int(d.min())) for i, d in enumerate(dists)}
    twice = filters.union(filters.limit(1))
    with pytest.raises(ValueError, match="unique"):
        M.best_match(rows, twice)
    with pytest.raises(ValueError, match="mixed dimension"):
        M.best_match(rows, filters.withColumn("dim", F.when(F.col("ord") == 0, 64).otherwise(128)).union(filters.limit(1).selectExpr("ord + 1000000", "category", "32", "bits")))
    with pytest.raises(ValueError, match="null"):
        M.best_match(rows, filters.union(filters.limit(1).withColumn("ord", F.lit(None).cast("long"))))


def test_long_category_names_are_kept(spark, world):
    rows, _, _ = world
    name = "x" * 5000
    filters = spark.createDataFrame([(0, name, 128, bits_of(random_bits(1, 128, 4)[0]))], FILTER_SCHEMA)
    assert {r.category for r in M.best_match(rows, filters).select("category").collect()} == {name}


def test_score_all(world):
    rows, filters, dists = world
    got = {(r.id, r.ord): r.dist for r in M.score_all(rows, filters).collect()}
    assert len(got) == dists.size
    assert all(got[i, j] == dists[i, j] for i in range(300) for j in range(40))


def test_no_filters_no_rows(spark, world):
    rows, filters, _ = world
    empty = filters.filter("false")
    assert M.best_match(rows, empty).count() == 0
    assert M.score_all(rows, empty).count() == 0


def test_first_filter_wins_ties(spark, world):
    rows, filters, _ = world
    doubled = filters.withColumn("ord", F.col("ord") + 100).union(filters)
    assert M.best_match(rows, doubled).agg(F.max("ord")).first()[0] < 100


def test_mixed_dimensions_fail(spark, world):
    rows, filters, _ = world
    with pytest.raises(ValueError, match="mixed dimension"):
        M.best_match(rows, filters.withColumn("dim", F.when(F.col("ord") == 0, 64).otherwise(F.col("dim"))))
    short = rows.withColumn("bits", F.slice("bits", 1, 1))
    with pytest.raises(Exception, match="words"):
        M.best_match(short, filters).collect()


@pytest.mark.parametrize(("dim", "last"), [(384, 134), (64, 22), (20, 6)])
def test_threshold_is_exact(spark, dim, last):
    rows = spark.range(dim + 1).select(F.col("id").cast("int").alias("dist"), F.lit(dim).alias("dim"))
    for kept in (M.threshold_filter(rows, 0.65), M.threshold_filter(rows, 0.65, dim)):
        assert kept.agg(F.max("dist"), F.count("dist")).first() == (last, last + 1)


def test_row_goes_to_one_category(spark):
    rng = np.random.default_rng(9)
    center = rng.normal(size=64)
    rows = [(i, [float(x) for x in center + rng.normal(scale=0.4, size=64)]) for i in range(100)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    flags = B.above_own_mean(center[None, :])[0]
    filters = spark.createDataFrame([(i, c, 64, bits_of(flags)) for i, c in enumerate("ab")], FILTER_SCHEMA)
    kept = trim_vectors(vectors, filters)
    assert kept.count() == kept.select("id").distinct().count() > 0
    assert {r.category for r in kept.collect()} == {"a"}


@pytest.mark.parametrize("k", [2, 1500])
def test_top_k_with_a_hot_category(spark, k):
    rows = [(i, "hot" if i % 3 else f"c{i % 7}", (i * 7919) % 97) for i in range(6000)]
    matches = spark.createDataFrame(rows, "id long, category string, dist int")
    got = M.top_k_per_category(matches, k, "id")
    want = set()
    for category in {r[1] for r in rows}:
        ordered = sorted((d, i) for i, c, d in rows if c == category)[:k]
        want |= {(i, category, d, rank + 1) for rank, (d, i) in enumerate(ordered)}
    assert {tuple(r) for r in got.select("id", "category", "dist", "rank").collect()} == want
    if k <= 1000:
        assert "WindowGroupLimit" in plan_of(got)


def test_summary_and_reduction(spark):
    matches = spark.createDataFrame([("a", 0.7), ("a", 0.9), ("b", 0.8)], "category string, score double")
    got = {r.category: (r.n_rows, round(r.avg_score, 6), r.max_score) for r in M.match_summary(matches).collect()}
    assert got == {"a": (2, 0.8, 0.9), "b": (1, 0.8, 0.8)}
    totals = M.reduction(matches.unionByName(matches), matches).first()
    assert (totals.rows_in, totals.rows_out, totals.kept) == (6, 3, 0.5)
    nothing = matches.filter("false")
    assert tuple(M.reduction(nothing, nothing).first())[2] is None


def test_corpus_is_scanned_once_without_a_shuffle(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumnRenamed("text", "content")
    filters = spark.createDataFrame([(0, "a", ["one two"])], "ord long, category string, anchors array<string>")
    encoder = HashEncoder(384)
    plan = plan_of(trim_against(docs, embed_filters(filters, encoder), encoder).select("doc_id", "category", "dist"))
    shuffles = plan.replace("BroadcastExchange", "")
    assert "Exchange" not in shuffles and "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("ArrowEvalPython") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "<= 134" in plan


def test_rows_of_another_dimension_fail(spark):
    filters = spark.createDataFrame([(0, "a", ["one two"])], "ord long, category string, anchors array<string>")
    bank = embed_filters(filters, HashEncoder(128))
    docs = spark.createDataFrame([("x",)], "content string")
    with pytest.raises(Exception, match="dimension"):
        trim_against(docs, bank, HashEncoder(384)).collect()
