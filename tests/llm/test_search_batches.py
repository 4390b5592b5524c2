"""The search takes many queries through a shard at once and reads texts and shards once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from sievetext.llm import search


def _docs(seed, n, words=600):
    rng = np.random.default_rng(seed)
    docs = [np.unique(rng.zipf(1.3, rng.integers(1, 80)) % words, return_counts=True) for _ in range(n)]
    for i in range(0, n, 40):  # copies tie
        docs[i] = docs[0]
    return [d[0].astype(np.uint64) for d in docs], [d[1].astype(np.uint32) for d in docs]


@pytest.mark.parametrize("heads", [0, 20, 768])
def test_queries_together_find_what_scoring_all_finds(monkeypatch, heads):
    monkeypatch.setattr(search, "HEADS", heads)
    monkeypatch.setattr(search, "RUN", 500)
    n, k = 900, 7
    terms, counts = _docs(5, n)
    mean = float(np.mean([c.sum() for c in counts]))
    idf = np.random.default_rng(6).random(600) * 5 + 0.01
    asked = [0, 40, *range(1, n, 29)]
    flat = np.concatenate([terms[q] for q in asked])
    ptr = np.concatenate(([0], np.cumsum([len(terms[q]) for q in asked])))
    weights = np.concatenate([idf[terms[q].astype(int)] * counts[q] for q in asked])
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
    room = {}
    for a in range(0, n, 300):
        ids = np.arange(a, a + 300) * 10
        index = search.with_heads(search.build(ids, terms[a : a + 300], counts[a : a + 300], mean), room)
        known, place = np.unique(flat, return_inverse=True)
        at, own, ends = search.found_by(search.places(index, known)[place], weights, ptr)
        opened, pivots = search.advance(index, at, own, ends, k, best, room=room)
        assert 0 < pivots < len(asked) * 300 and opened <= len(asked) * 5
    dense = np.zeros((n, 600))
    for d in range(n):
        norm = search.K1 * (1 - search.B + search.B * counts[d].sum() / mean)
        dense[d, terms[d].astype(int)] = counts[d] * (search.K1 + 1) / (counts[d] + norm)
    for i, q in enumerate(asked):
        scores = dense[:, terms[q].astype(int)] @ (idf[terms[q].astype(int)] * counts[q])
        want = sorted((-round(s, 5), d * 10) for d, s in enumerate(scores) if s > 0)[:k]
        assert best[i][0].tolist() == [d for _, d in want]
        assert best[i][1] == pytest.approx([-s for s, _ in want], abs=1e-5)


def test_a_partition_of_queries_is_one_file_whatever_its_batches(tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    rows = [(i, list(range(i, i + 3)), [0.5] * 3) for i in range(20)]
    schema = pa.schema([("query_id", pa.int64()), ("terms", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))])

    def files(size):
        table = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        names = [b.column("queries")[0].as_py() for b in search._write_queries(folder)(iter(table.to_batches(size)))]
        return [search._load(folder, name) for name in names]

    (one,) = files(3)
    assert one["ids"].tolist() == list(range(20)) and one["ptr"].tolist() == list(range(0, 61, 3))
    assert one["terms"].tolist() == [t for _, x, _ in rows for t in x] and one["weights"].tolist() == [0.5] * 60
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    assert [len(f["ids"]) for f in files(3)] == [8, 8, 4] == [len(f["ids"]) for f in files(20)]
    monkeypatch.setattr(search, "QUERY_TERMS", 7)
    assert [f["ids"].tolist() for f in files(5)] == [[i, i + 1] for i in range(0, 20, 2)]
    monkeypatch.setattr(search, "QUERY_TERMS", 2)
    assert [f["ids"].tolist() for f in files(5)] == [[i] for i in range(20)]
    assert list(search._write_queries(folder)(iter([]))) == []


@pytest.mark.parametrize("piece", [7, 64, 1 << 21])
def test_words_hash_alike_just_where_they_are_alike(monkeypatch, piece):
    monkeypatch.setattr(search, "PIECE", piece)
    rng, seen, back = random.Random(1), {}, {}
    parts = ["a", "B", "\0", " ", "\t", "\x0b", "\x1c", " ", "é", "Ö", "word", "abcdefgh", "Z" * 17, "q" * 300, "\n", "\r"]
    for n in (0, 1, 3, 30):
        texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 2, 5, 40]))) for _ in range(n)]
        array = pa.array(["left out", *texts, "too"]).slice(1, n)
        for own in (array, array.cast(pa.large_string())):
            hashes, ends = search.term_hashes(own)
            assert ends[-1] == len(hashes)
            for text, a, b in zip(texts, ends, ends[1:]):
                words = text.encode().lower().split()
                assert len(words) == b - a
                for word, value in zip(words, hashes[a:b].tolist()):
                    assert seen.setdefault(word, value) == value and back.setdefault(value, word) == word


def test_a_small_rest_of_documents_is_no_shard_of_its_own(tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 8)
    folder = f"file://{tmp_path}"
    for n, shards in ((8, [8]), (9, [9]), (10, [8, 2]), (19, [8, 8, 3]), (17, [8, 9])):
        batches = pa.table({"doc_id": list(range(n)), "text": [f"w{i} the" for i in range(n)]}).to_batches(5)
        rows = [r for b in search._write_shards(folder)(iter(batches)) for r in b.to_pylist()]
        assert [len(search._load(folder, r["shard"])["ids"]) for r in rows] == shards
        assert sum(r["words"] for r in rows) == 2 * n


def test_queries_of_a_kind_come_together():
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 3, 400)
    docs = [np.unique(rng.zipf(1.3, 40) % 200 + 1000 * c, return_counts=True) for c in kind]
    terms, counts = [d[0].astype(np.uint64) for d in docs], [d[1].astype(np.uint32) for d in docs]
    index = search.with_heads(search.build(np.arange(400), terms, counts, 40.0))
    ptr = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    flat = np.concatenate(terms)
    at = search.places(index, np.unique(flat))[np.unique(flat, return_inverse=True)[1]]
    order = search.kinds(index, *search.found_by(at, np.ones(len(flat)), ptr))
    assert sorted(order.tolist()) == list(range(400))
    assert (np.diff(kind[order]) != 0).sum() < 40 < (np.diff(kind) != 0).sum()


def test_scores_that_round_to_nothing_are_results(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(3)], "doc_id long, text string")
    found = search.search(docs, docs.selectExpr("doc_id as query_id", "text"), k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in found] == [(q, r, r - 1) for q in range(3) for r in (1, 2)]
