"""What the review's findings were about, on rows made here."""

import gc
import inspect
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa

from sievetext.llm import bpe, common, paragraphs, search, token_files, toxicity

ROOT = Path(__file__).resolve().parents[2]


def test_a_search_keeps_k_rows_a_query_whatever_the_shards(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 30) % 200) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id")
    queries = docs.where("doc_id % 50 = 0").selectExpr("doc_id as query_id", "text")
    kept, real = {}, search.stored

    def stored(df, name):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(search, "stored", stored)
    whole = sorted(map(tuple, search.search(docs, queries, k=5).collect()))
    assert kept["shards"].count() == 1
    monkeypatch.setattr(search, "SHARD_DOCS", 50)
    parts = sorted(map(tuple, search.search(docs, queries, k=5).collect()))
    assert kept["shards"].count() > 4
    assert kept["found"].count() == 8 * 5 and parts == whole


def test_a_score_to_beat_from_elsewhere_limits_a_shard():
    rng = np.random.default_rng(3)
    docs = [np.unique(rng.zipf(1.3, 60) % 2000, return_counts=True) for _ in range(3000)]
    terms, counts = [d[0].astype(np.uint64) for d in docs], [d[1] for d in docs]
    halves = [search.build(np.arange(a, a + 1500), terms[a : a + 1500], counts[a : a + 1500], 60.0) for a in (0, 1500)]
    whole = search.build(np.arange(3000), terms, counts, 60.0)
    for q in (0, 1700, 2999):
        weights = rng.random(len(terms[q]))
        ids, scores, *_ = search.top_k(whole, terms[q], weights, 10)
        held = search.top_k(halves[0], terms[q], weights, 10)
        alone = search.top_k(halves[1], terms[q], weights, 10)
        both = search.top_k(halves[1], terms[q], weights, 10, held[:2])
        assert both[0].tolist() == ids.tolist() and both[1].tolist() == scores.tolist()
        assert both[3] <= alone[3]


def test_a_worker_of_the_dedup_loads_no_more_than_it_needs():
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); import sievetext.llm.paragraphs; print('pandas' in sys.modules, 'sievetext.sources.csv_splits' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split() == ["False", "False"]
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); import sievetext; print(all(hasattr(sievetext, n) for n in sievetext.__all__), hasattr(sievetext, 'no_such'))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split() == ["True", "False"]


def test_lean_steps_give_memory_back_and_look_seldom_for_cycles(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    before, seen = gc.get_threshold(), []

    def step(rows):
        for batch in rows:
            seen.append(gc.get_threshold())
            yield batch

    assert len(list(common.lean(step)(iter(batches)))) == 3 and Pool.released == 4
    assert set(seen) == {common.COLLECTOR} and gc.get_threshold() == before
    for function in (bpe.digests, token_files.write, toxicity.score, toxicity.drop_toxic, paragraphs.matches, paragraphs.drop_repeats):
        assert "mapInArrow(lean(" in inspect.getsource(function)


def test_windows_of_one_text_are_dealt_out_once(spark, monkeypatch):
    plans, kept, real = {}, {}, paragraphs.stored

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(paragraphs, "stored", stored)
    schema = "key long, doc_id long, o_key long, o_doc_id long, start int, stop int, met int, o_met int, windows array<long>"
    rows = [(k, k, 9, 9, 10, 60, 0, 0, [100 + k, 7, 200 + k]) for k in (1, 2, 3)] + [(1, 1, 8, 8, 10, 60, 0, 0, [101, 7])]
    found = spark.createDataFrame(rows, schema)
    texts = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(90))) for k in (1, 2, 3)], "key long, text string")
    assert paragraphs._loose_windows(found, texts).count() > 0
    assert sorted(map(tuple, kept["windows"].collect())) == [(7, 1, 1, 11), (7, 2, 2, 11), (7, 3, 3, 11)]
    # shared bands are found before equal rows are: one aggregate by band, one of what is left
    assert plans["windows"].count("Aggregate [") == 2


def test_codes_of_words_are_those_of_a_loop():
    words = ["", "a", "bb", "ccc", "dddd", "\u00e9", "\ud800", "\u4e2d\u6587\u5b57", "a longer word"]
    codes = toxicity.Codes.of(words)
    grams, counts = [], []
    for word in words:
        data = f"<{word}>".encode("utf-8", "surrogatepass")
        own = [zlib.crc32(data[i : i + n]) % toxicity.GRAMS for n in (3, 4, 5) for i in range(max(1, len(data) - n + 1))]
        grams += own
        counts.append(len(own))
        assert codes.words[len(counts) - 1] == zlib.crc32(data) % toxicity.WORDS
    assert codes.grams.tolist() == grams and codes.counts.tolist() == counts
    assert "for i in range" not in inspect.getsource(toxicity.Codes.of)


def test_pieces_with_added_tokens_and_words_of_many_parts():
    pairs = bpe.byte_pairs(bpe.tokenizer_path("word_bpe_49k.json"))
    texts = ["", "plain words, and more", "a <|endoftext|> b", "zq\u00e9x\u4e2d\u6587 it's x\x1cy"]
    for text, found in zip(texts, pairs.pieces(texts), strict=True):
        ids, names, n = bpe._joined(found)
        assert np.frombuffer(ids, "<u4").tolist() == pairs.encode(text) and n == len(ids) // 4
        assert names[:-1].decode("utf-8", "surrogatepass") == pairs.decode(pairs.encode(text))
