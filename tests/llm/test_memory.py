"""What tasks hold at once and what steps leave on disk."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievetext.llm import common, ctw, paragraphs, search
from sievetext.llm.common import BATCHES, CLEANUP, row_key, stored


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])


def _batch(texts, held):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(held)], names=["text", "held_out"])


def test_texts_of_a_stored_step_reach_python_in_small_batches(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 1000).alias("text"))
    sizes = [r["size"] for r in stored(texts.mapInArrow(_sizes, "size long"), "sizes").collect()]
    assert sum(sizes) > 30_000_000 and max(sizes) < 5_000_000
    assert all(spark.conf.get(k, None) is None for k in BATCHES | CLEANUP)


def test_settings_of_the_session_stay(spark):
    key = next(iter(BATCHES))
    spark.conf.set(key, "1m")
    try:
        texts = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("abcdefghij"), 1000).alias("text"))
        sizes = stored(texts.mapInArrow(_sizes, "size long"), "sizes").agg(F.max("size")).first()[0]
        assert sizes < 2_000_000 and spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f.getName() for f in (all_files.apply(i) for all_files in [blocks.getAllFiles()] for i in range(all_files.size())) if "shuffle" in f.getName()}

    before = files()
    table = stored(spark.range(100_000).groupBy((F.col("id") * 7 % 1009).alias("k")).agg(F.count("*").alias("n")), "grouped")
    assert not files() - before
    assert table.agg(F.sum("n")).first()[0] == 100_000


def test_counts_of_a_task_are_added_up_over_batches_and_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["", "a b", "", *("".join(rng.choice(list("ab c\n"), 300)) for _ in range(60))]
    held = [i % 5 == 0 for i in range(len(texts))]
    batches = [_batch(texts[i : i + 7], held[i : i + 7]) for i in range(0, len(texts), 7)]
    wanted = {ctw.GRAM: Counter(), ctw.WORD: Counter()}
    for text, is_held in zip(texts, held, strict=True):
        for gram in ctw.text_grams(text.encode()).tolist():
            wanted[ctw.GRAM][gram] += not is_held
        if not is_held:
            wanted[ctw.WORD].update(ctw.word_hashes(ctw.lower_words(text.encode())).tolist())
    for pending, most in ((1 << 21, 1), (400, 100)):
        monkeypatch.setattr(ctw, "PENDING", pending)
        rows = list(ctw._count(iter(batches)))
        found = {ctw.GRAM: Counter(), ctw.WORD: Counter()}
        for row in rows:
            units = row.column("unit").to_numpy().view(np.uint64).tolist()
            assert len(units) == len(set(units))
            for kind, unit, n in zip(row.column("kind").to_pylist(), units, row.column("c").to_pylist(), strict=True):
                found[kind][unit] += n
        assert found == wanted and all(set(found[k]) == set(wanted[k]) for k in found)
        assert all(sum(r.column("kind")[0].as_py() == kind for r in rows) <= most for kind in found)
    assert list(ctw._count(iter([]))) == []


def test_a_shard_of_empty_texts_has_no_result_and_files_keep_arrays(tmp_path):
    empty = search.build(np.arange(3), [np.zeros(0, np.uint64)] * 3, [np.zeros(0, np.uint32)] * 3, 1.0)
    name = search._save(f"file://{tmp_path}", "shard", empty)
    read = search._load(f"file://{tmp_path}", name)
    assert all(np.array_equal(read[k], v) and read[k].dtype == v.dtype for k, v in empty.items())
    index = search.with_heads(read)
    query = [(np.array([5], np.uint64), np.array([1.0]))]
    assert [len(x) for x in search.placed(index, query)[0]] == [0, 0]
    above = search.head_bounds(index, search.placed(index, query))
    assert not above.any()
    assert len(search.best_of(index, *search.placed(index, query)[0], 10, None, above[0])[0]) == 0


def test_impacts_are_at_least_what_postings_add():
    rng = np.random.default_rng(8)
    terms = [np.unique(rng.integers(0, 3000, 60).astype(np.uint64)) for _ in range(400)]
    counts = [rng.integers(1, 9, len(t)).astype(np.uint32) for t in terms]
    index = search.with_heads(search.build(np.arange(400), terms, counts, 60.0))
    tf = index["tf"].astype(np.float64)
    exact = tf * (search.K1 + 1) / (tf + index["norms"][index["docs"]])
    assert (index["impacts"] >= exact).all() and np.allclose(index["impacts"], exact)
    post = index["entry_post"].tolist()
    assert all(index["impacts"][a:b].max() == top for a, b, top in zip(post, post[1:], index["entry_max"], strict=False))


def _passages(spark, copies):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(4000)]
    common = [rng.choices(words, k=90) for _ in range(6)]
    texts = [" ".join(rng.choices(words, k=40) + common[i % 6] + rng.choices(words, k=40)) for i in range(40)]
    texts += [f"{rng.choice(words)}\n{' '.join(common[i % 6])}\n{rng.choice(words)}" for i in range(12)]
    return spark.createDataFrame(list(enumerate(texts)) * copies, "doc_id long, text string").repartition(5)


def test_words_around_runs_are_dealt_out_once(spark, monkeypatch):
    """Words cut out of texts are stored as they are cut; a run's own come with it and only meet its counterpart's."""
    plans, kept, real = {}, {}, paragraphs.stored

    def stored(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return kept.setdefault(name, real(df, name))

    monkeypatch.setattr(paragraphs, "stored", lambda df, name: stored(df, name) if name not in plans else real(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paragraphs.matches(_passages(spark, 3)).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plans["slices"].split("MapInArrow")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    assert plans["run-matches"].count("Exchange hashpartitioning") == 2
    # every document is there three times, what is cut out of it once
    cut = Counter((r["key"], r["s"], r["e"], r["line"], r["run"]) for r in kept["slices"].collect())
    assert len(cut) > 60 and set(cut.values()) == {1}


def test_words_of_slices_are_those_of_their_texts(spark):
    docs = spark.createDataFrame([(1, "a b\u00a0c  d\ne f"), (2, "x y z"), (3, "never asked")], "doc_id long, text string")
    rows = docs.withColumn("key", row_key())
    one, two = (rows.where(f"doc_id = {i}").first()["key"] for i in (1, 2))
    runs = spark.createDataFrame([(two, 2, one, 1, 1, 3, 2, 4, 0)], "key long, doc_id long, o_key long, o_doc_id long, start int, stop int, o_start int, o_stop int, loose int")
    lines = spark.createDataFrame([(one, 1, 2), (one, 1, 2)], "key long, start int, n int")
    got = sorted(((r["key"] == one, r["line"], r["run"], r["words"].decode()) for r in paragraphs._texts_of(rows, runs, lines).collect()), key=str)
    assert got == [(False, False, tuple(runs.first()), "x y z"), (True, False, None, "a b\u00a0c d e f"), (True, True, None, "a b\u00a0c d e f")]


def test_units_and_blocks_go_when_runs_and_lines_are_stored(spark, monkeypatch):
    folders, real = [], common.fresh_folder

    def fresh_folder(session, name):
        folders.append((name, real(session, name)))
        return folders[-1][1]

    monkeypatch.setattr(common, "fresh_folder", fresh_folder)
    docs = _passages(spark, 1)
    rows = paragraphs.repeated_passages(docs).collect()
    assert len({r["doc_id"] for r in rows}) == 46
    sizes = {name: spark.read.parquet(folder).count() for name, folder in folders if name in ("units", "blocks", "run-matches")}
    assert sizes.pop("run-matches") > 0 and sizes == {"units": 0, "blocks": 0}
