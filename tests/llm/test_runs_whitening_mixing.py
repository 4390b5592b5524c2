"""Periodic runs, whitening and mixing against brute force, with the cases that tables may hold."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from sievetext.llm import mixing, runs, whitening
from sievetext.llm.queries import REGISTRY
from tools.check_oracles import compare, duck

SCHEMA = "doc_id long, text string, source string, size long, start long, place string, taken array<int>, v int"
LOOP = "so it goes " * 9


def row(doc_id, text, source="web"):
    return (doc_id, text, source, 7, None, "x", [1, None], 3)


ROWS = [
    row(1, "one two three four five"),
    row(2, LOOP),
    row(2, LOOP),
    row(2, "the same id, another text"),
    row(3, None),
    row(4, ""),
    row(5, " \n\t ", None),
    row(6, "a a a a a a\nb\tb\x0bb b b c", None),
    row(7, " ".join(f"w{i % 97}" for i in range(30_000)), "books"),
    row(8, " ".join(f"w{i}" for i in range(5_000)), "books"),
    row(None, "no id, no source", None),
    row(None, None, None),
    *[row(i, "x y " * (i % 9), f"s{i % 5}") for i in range(100, 180)],
    row(181, "ſ\x85é é é é é é é", "é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def plain_runs(words):
    """Every stretch that each period can be grown to; the smallest period of equal stretches stays."""
    found = {}
    for period in range(1, len(words) // 4 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end > at and end - at + period >= max(6, 4 * period):
                found.setdefault((at, end - at + period), period)
            at = max(end, at + 1)
    return sorted((start, period, length) for (start, length), period in found.items())


def plain_digest(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, q, length in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    longest = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        words = []
        while len(words) < rng.randint(0, 70):
            few = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 6))]
            words += few * rng.randint(1, 9) if rng.random() < 0.6 else [rng.randrange(9)]
        got = runs.runs(np.array(words, dtype=np.int64))
        assert [(s, q, n) for s, n, q in got.tolist()] == plain_runs(words), words


def test_runs_of_strings_rich_in_repeats():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    for words in (fib[-1], morse, [0] * 500, [0, 1] * 300 + [0, 0, 1] * 200, ([0] * 40 + [1]) * 12):
        got = runs.runs(np.array(words, dtype=np.int64))
        assert [(s, q, n) for s, n, q in got.tolist()] == plain_runs(words)


def test_run_digests(spark, docs, none):
    got = Counter(tuple(r) for r in runs.digests(docs).collect())
    assert got == Counter(plain_digest(r[0], r[1]) for r in ROWS)
    assert runs.digests(none).count() == 0
    # 75 has a crc32 divisible by ten
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(f"t{random.Random(i).randrange(5)}" for _ in range(i % 60))) for i in ids]
    got = {tuple(r) for r in runs.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {plain_digest(*r) for r in rows} and any(r[1] for r in got)


def test_run_batches_are_cut_between_documents(monkeypatch):
    texts = [words_of(r[1]) for r in ROWS]
    together = [found.tolist() for found in runs._of_batch(texts)]
    assert together == [next(runs._of_batch([words])).tolist() for words in texts]
    monkeypatch.setattr(runs, "BATCH_WORDS", 100)
    batch = runs.pa.RecordBatch.from_arrays([runs.pa.array([r[0] for r in ROWS]), runs.pa.array([(r[1] or "").encode() for r in ROWS])], ["doc_id", "text"])
    parts = list(runs._batched([batch, batch], False))
    assert [words for _, part in parts for words in part] == texts * 2
    assert all(len(part) == 1 or sum(map(len, part)) <= 100 for _, part in parts)


def test_run_query_on_a_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in REGISTRY["op13_runs"](spark, small).collect()}
    short = [r for r in table if len(words_of(r.text)) <= 400]
    assert len(short) > 50 and {plain_digest(r.doc_id, r.text) for r in short} <= got and len(got) == len(table)


def test_a_long_text_of_one_loop_is_quick():
    found = runs.runs(np.tile(np.arange(3), 100_000))
    assert found.tolist() == [[0, 300_000, 3]]


V_SCHEMA = "vec_id long, embedding array<float>, n int, deviation string, k int, v string"


def vec(vec_id, values):
    return (vec_id, values, 1, "clash", 2, "clash")


def exact_covariance(x):
    n, sums = len(x), x.sum(axis=0)
    away = x.astype(object) * n - sums.astype(object)
    products = away.T.dot(away)
    return np.array([[float(Fraction(int(p), n**3)) for p in line] for line in products]), (away * away).sum(axis=1)


def fixture_vectors(dims=40, rows=300):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(rows, dims)) @ rng.normal(size=(dims, dims))
    return base.astype(np.float32)


def test_polarised_sums_give_the_exact_covariance(spark):
    values = fixture_vectors()
    rows = [vec(i, v.tolist()) for i, v in enumerate(values)]
    rows += [vec(1000, None), vec(1001, [None] + [0.0] * 39), vec(1002, [math.nan] * 40), vec(1003, [math.inf] + [0.0] * 39)]
    rows += [rows[3], vec(None, values[0].tolist())]
    frame = spark.createDataFrame(rows, V_SCHEMA).repartition(5)
    kept = np.vstack([values, values[3:4], values[:1]]).astype(np.float64)
    x = np.floor(kept * 64).astype(np.int64) + 1_000_000
    model = whitening.fit(whitening.usable(frame, "embedding"))
    covariance, deviations = exact_covariance(x)
    assert model.n == len(x) and model.sums == tuple(x.sum(axis=0).tolist())
    eigen = np.linalg.eigvalsh(covariance)[::-1]
    assert np.allclose(model.eigenvalues, eigen[:32], rtol=1e-9)
    assert np.allclose(covariance @ model.components, model.components * model.eigenvalues, atol=1e-7 * eigen[0])
    out = whitening.whiten(frame).collect()
    assert len(out) == len(x) * 32 and Counter(r.component for r in out) == Counter({k: len(x) for k in range(1, 33)})
    assert Counter((r.vec_id, r.deviation) for r in out if r.component == 1) == Counter(zip([*range(300), 3, None], deviations.tolist()))
    expected = (x - x.mean(axis=0)) @ model.components / np.sqrt(model.eigenvalues)
    by_key = {(r.vec_id, r.component): r.whitened for r in out if r.vec_id is not None}
    assert all(abs(by_key[i, k + 1] - expected[i, k]) < 1e-8 for i in range(300) for k in range(32))
    assert all(abs(r.explained - eigen[r.component - 1] / np.trace(covariance)) < 1e-12 for r in out)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-6


def test_square_sums_beyond_a_long():
    x = np.array([[3 * 10**9, -1], [-(3 * 10**9), 5], [7, 2 * 10**9]])
    big = x.astype(object)
    want = {(a, b): int(((big[:, a] + big[:, b]) ** 2).sum()) if a != b else int((big[:, a] ** 2).sum()) for a in (0, 1) for b in range(a, 2)}
    assert whitening.square_sums(x) == want
    assert whitening.square_sums(np.zeros((0, 2), np.int64)) == {}


def test_vectors_without_components(spark):
    frame = lambda rows: spark.createDataFrame(rows, V_SCHEMA)
    for rows in ([], [vec(1, None)], [vec(1, [1.0, 2.0])], [vec(1, [1.0, 2.0])] * 5, [vec(1, []), vec(2, [])]):
        assert whitening.whiten(frame(rows)).collect() == []
    flat = whitening.whiten(frame([vec(i, [float(i), 2.0, 0.0]) for i in range(4)])).collect()
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-12 for r in flat)
    with pytest.raises(Exception, match="different dimensions"):
        whitening.whiten(frame([vec(1, [1.0]), vec(2, [1.0, 2.0])])).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame([vec(1, [1e30]), vec(2, [1.0])])).collect()


def plain_targets(sizes):
    """Shares by weight; what is above twice a source's size goes to the others until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = Fraction(3, 2) * sum(sizes.values()), set()
    target = {s: Fraction(0) for s in names}
    while total:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: Fraction(2 * sizes[s]) if s in full else left * weight[s] / sum(weight[t] for t in open_) for s in names}
        above = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    return target


def test_mix_takes_what_the_targets_say(docs, none):
    out = mixing.taken(docs, block_words=64).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len(words_of(r[1]))) for r in ROWS)
    source_of = {(r[0], len(words_of(r[1]))): r[2] for r in ROWS}
    sizes, got = defaultdict(int), defaultdict(int)
    for r in ROWS:
        sizes[r[2]] += len(words_of(r[1]))
    targets = plain_targets(sizes)
    for r in out:
        source = source_of[r.doc_id, r["size"]]
        got[source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[source]
        assert r.target == pytest.approx(float(targets[source]), rel=1e-12)
    assert all(abs(got[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.taken(docs.repartition(7), block_words=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    assert mixing.taken(none).count() == 0
    empty = mixing.taken(docs.where("text is null or doc_id = 4")).collect()
    assert len(empty) == 3 and all(r.taken == r.target == 0 for r in empty)


def test_slots_are_spread_and_blocks_are_equal(docs):
    placed, parts = mixing.mix(docs, block_words=32)
    parts = parts.collect()
    slots = defaultdict(list)
    for p in parts:
        slots[p.slot].append(p)
    # a slot is of one source and round, and is full unless its source's line or target ends there
    short = Counter()
    for inside in slots.values():
        assert len({(p.place, p["round"]) for p in inside}) == 1
        words = sum(p.words for p in inside)
        assert words <= 32
        short[inside[0].place] += words < 32
    assert max(short.values()) <= 3
    # words of a document come once a round, without gaps
    size = {(r.place, r.start): r["size"] for r in placed.where("size > 0").collect()}
    met = defaultdict(list)
    for p in parts:
        met[p.place, p.start, p["round"]].append((p.first_word, p.words))
    for (place, start, _), spans in met.items():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= size[place, start]
    # each source has its share of every stretch of the schedule, up to a few slots
    order = sorted(slots)
    by_place = Counter(slots[k][0].place for k in order)
    for place, all_ in by_place.items():
        seen = 0
        for i, k in enumerate(order, 1):
            seen += slots[k][0].place == place
            assert abs(seen - all_ * i / len(order)) <= 2 + math.log2(len(order))


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"{rng.choice('aÀ中😀')}{i}": rng.choice([0, 1, 10, 1000, 10**6]) for i in range(200)} | {None: 17, "": 5}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(4)
    out = mixing.with_targets(mixing.ranked_sources(rows)).collect()
    want = plain_targets(sizes)
    assert len(out) == len(sizes) and sorted(r.place for r in out) == list(range(len(sizes)))
    assert all(r.target == pytest.approx(float(want[r.source]), rel=1e-12) for r in out)


def test_running_totals_across_chunks(spark):
    rows = [(g, i // 10, i, (i * 7) % 13) for g in ("a", None) for i in range(95) if g or i % 3]
    frame = spark.createDataFrame([r for r in rows if r[0]], "g string, c long, i long, v long").repartition(4)
    out = sorted(mixing.running(frame, ["g"], "c", [mixing.F.col("i")], mixing.F.col("v"), "s").collect(), key=lambda r: r.i)
    total = 0
    for r in out:
        assert r.s == total
        total += r.v


def test_mixing_equals_sql(spark, small):
    same, text = compare(spark, duck(small), small, "op12_mixing")
    assert same, text
