"""Line comparisons and runs of substring dedup against brute force."""

import random

import numpy as np
import xxhash

from sievetext.llm import paragraphs


def _template_lines(seed: int) -> list[str]:
    """Lines that share most of their words with all others, some of them like another one, some equal."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common = [word() for _ in range(48)]
    lines = []
    for _ in range(200):
        own = [word() for _ in range(rng.choice((6, 9, 14, 20)))]
        base = own + common
        lines.append(base)
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            lines.append(copy)
    rng.shuffle(lines)
    return [" ".join(x) for x in lines]


def _bands(words: list[bytes]) -> set[int]:
    shingles = paragraphs.shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
    return set(paragraphs.line_bands(shingles, np.array([0]), np.array([len(shingles)]))[0].tolist())


def test_hot_bands_lose_no_like_line(spark):
    """Of two like lines with a MinHash band in common the later one goes, or an earlier line is like the earlier one.

    Hardly any like pair has no band in common (here one of 137).
    """
    texts = _template_lines(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    split = [t.encode().split() for t in texts]
    found = paragraphs.matches(docs).where("start = 0").collect()
    gone = {r["doc_id"] for r in found if r["stop"] == len(split[r["doc_id"]])}
    like = [(b, a) for b in range(len(split)) for a in range(b) if paragraphs.jaccard(split[a], split[b]) >= paragraphs.SIMILARITY]
    later = {b for b, _ in like}
    assert len(like) > 100
    missed = [(b, a) for b, a in like if a not in later and b not in gone]
    bands = [_bands(words) for words in split]
    assert not [(b, a) for b, a in missed if bands[a] & bands[b]]
    assert len(missed) <= 0.01 * len(like)
    assert gone <= later


def test_sketch_tells_no_like_sets_apart(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        n = rng.randrange(1, 400)
        base = [rng.getrandbits(64) for _ in range(n)]
        other = [x if rng.random() < rng.choice((0.85, 0.95)) else rng.getrandbits(64) for x in base]
        rows.append([_sketched(x) for x in (base, other)] + [len(set(base) & set(other)) / len(set(base) | set(other))])
    side = "struct<size:int,sketch:array<bigint>>"
    frame = spark.createDataFrame(rows, f"p {side}, f {side}, jaccard double")
    got = frame.select("jaccard", paragraphs.may_be_like("p", "f").alias("may")).collect()
    assert all(r["may"] for r in got if r["jaccard"] >= 0.8)
    assert any(r["jaccard"] >= 0.8 for r in got) and not all(r["may"] for r in got)


def _sketched(hashes: list[int]) -> tuple[int, list[int]]:
    bits = 64 * paragraphs.SKETCH
    words = [0] * paragraphs.SKETCH
    for h in set(hashes):
        words[h % bits // 64] ^= 1 << (h % 64)
    return len(set(hashes)), [w - (1 << 64) if w >> 63 else w for w in words]


def test_equal_stretch_inside_a_run_that_differs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("klmnopqrst", k=7))
    common = [word() for _ in range(120)]
    changed = list(common)
    for place in (60, 62, 64, 66, 68, 70):
        changed[place] = word()
    rows = [(1, " ".join(common)), (2, " ".join([word() for _ in range(30)] + changed + [word() for _ in range(30)]))]
    got = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    taken = {i for r in got for i in range(r["start_word"], r["start_word"] + r["n_words"])}
    assert {r["doc_id"] for r in got} == {2} and taken >= set(range(30, 90)) and taken <= set(range(30, 150))


def test_equal_stretches():
    a, b = [b"x%d" % i for i in range(80)], [b"y"] + [b"x%d" % i for i in range(80)]
    b[41] = b"other"
    assert paragraphs.equal_stretches(a, b, 1) == [(0, 40), (41, 80)]
    assert paragraphs.equal_stretches(a, b, 200) == [] and paragraphs.equal_stretches(a, [], 0) == []


def _repeats_by_brute_force(texts: dict[int, list[str]]) -> tuple[dict[int, set[int]], set[tuple[int, int]]]:
    """(words of each text that lie in 50 words an earlier text has; pairs of texts with 50 words in common)."""
    size = paragraphs.MIN_WORDS
    held: dict[tuple, list[tuple[int, int]]] = {}
    for name, words in sorted(texts.items()):
        for i in range(len(words) - size + 1):
            held.setdefault(tuple(words[i : i + size]), []).append((name, i))
    taken, linked = {}, set()
    for places in held.values():
        for name, i in places:
            linked |= {(o, name) for o, _ in places if o < name}
            if name > places[0][0]:
                taken.setdefault(name, set()).update(range(i, i + size))
    return taken, linked


def _against_brute_force(spark, texts: dict[int, list[str]]) -> None:
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    taken, linked = _repeats_by_brute_force(texts)
    assert linked
    rows = paragraphs.repeated_passages(docs).collect()
    got, classes = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
        classes[r["doc_id"]] = r["component_id"]
        for first in r["first_doc_ids"]:
            assert classes.setdefault(first, r["component_id"]) == r["component_id"]
    for name, words in taken.items():
        assert words <= got.get(name, set()), name
    assert all(classes[a] == classes[b] for a, b in linked)


def _places(words: list[str]) -> list[int]:
    hashes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)
    return paragraphs.block_places(paragraphs.shingle_hashes(hashes), len(words)).tolist()


def test_passage_whose_block_stands_first_in_another_text(spark):
    """The passage that two texts share has one block, which stands first in a text that shares no more of it."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    texts = {}
    while len(texts) < 30:
        shared = [word() for _ in range(50)]
        block = _places(shared)[0]
        other = [word() for _ in range(30)] + shared[block : block + 24] + [word() for _ in range(30)]
        if 30 in _places(other):
            i = len(texts)
            texts[i] = other
            texts[i + 1] = [word() for _ in range(30)] + shared + [word() for _ in range(30)]
            texts[i + 2] = [word() for _ in range(11)] + shared + [word() for _ in range(3)]
    _against_brute_force(spark, texts)


def test_passage_that_stands_later_in_the_first_text(spark):
    """The first text has the block twice, the passage at the second place; texts that say a thing over and over."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    texts = {}
    for i in range(0, 60, 4):
        shared = [word() for _ in range(60)]
        cut = rng.randrange(36)
        texts[i] = [word() for _ in range(9)] + shared[cut : cut + 24] + [word() for _ in range(20)] + shared + [word() for _ in range(5)]
        texts[i + 1] = [word() for _ in range(30)] + shared + [word() for _ in range(30)]
        period = [word() for _ in range(rng.randrange(1, 12))]
        tail = [word() for _ in range(40)]
        texts[i + 2] = [word() for _ in range(30)] + (period * 70)[:40] + tail
        texts[i + 3] = [word() for _ in range(30)] + (period * 70)[len(period) - 40 % len(period) :][: 60] + [word()] + (period * 70)[:40] + tail
    _against_brute_force(spark, texts)


def test_line_like_one_that_goes_is_linked(spark):
    """The second line is like the first and the third, which are not alike: all are of one class."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    texts = []
    for i in range(0, 120, 3):
        first = [word() for _ in range(100)]
        second = [word() if place in (33, 66) else w for place, w in enumerate(first)]
        third = [word() if place in (16, 83) else w for place, w in enumerate(second)]
        texts += [(i, " ".join(first)), (i + 1, " ".join(second)), (i + 2, " ".join(third))]
        a, b, c = (x[1].encode().split() for x in texts[-3:])
        assert paragraphs.jaccard(a, b) >= 0.8 and paragraphs.jaccard(b, c) >= 0.8 and paragraphs.jaccard(a, c) < 0.8
    rows = paragraphs.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["first_doc_ids"], r["component_id"]) for r in rows if r["n_words"] == 100}
    assert all(got[i + 1] == ([i], i) and i + 1 in got[i + 2][0] and got[i + 2][1] == i for i in range(0, 120, 3))
