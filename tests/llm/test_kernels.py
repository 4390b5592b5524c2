"""Numpy and Python kernels against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sievetext.llm import bpe, ctw, packing, paragraphs, search, simhash, token_files, toxicity
from sievetext.llm.encoding import TextEncoder, tokenizer_path

POOL = [*"abcXYZ É é ß İ Σ ς 1 2 3 ' ’ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0　 é ́ 😀 中文字 ﬁ . , ;", "<|endoftext|>", "<|startoftext|>", "'s", "ΑΣ", "zzzz" * 30, "word.", " word"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["", " ", "\n", *("".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(800))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_encoding_equals_the_library(texts, name):
    library = Tokenizer.from_file(tokenizer_path(name))
    library.no_truncation()
    library.no_padding()
    for text, ids in zip(texts, TextEncoder(tokenizer_path(name)).ids(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_encodes_and_decodes_as_the_library(texts):
    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.BytePairs(path)
    library.no_truncation()
    library.no_padding()
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forced_cuts_lie_between_pairs_no_token_has():
    own = bpe.BytePairs(tokenizer_path("word_bpe_49k.json"))
    word = bytes(range(97, 123)) + "éß中".encode()
    parts = own.cut([word, b"the"])
    assert b"".join(parts[0]) == word and parts[1] == [b"the"]
    for a, b in zip(parts[0], parts[0][1:]):
        assert not own.inside[a[-1], b[0]]


def test_a_long_text_is_encoded_in_slices(monkeypatch):
    monkeypatch.setattr("sievetext.llm.encoding.SLICE", 50)
    text = "some words, and more.\n" * 40
    path = tokenizer_path("byte_bpe_50k.json")
    assert next(TextEncoder(path).ids([text])).tolist() == Tokenizer.from_file(path).encode(text).ids


def test_covering_masks_keep_every_near_pair():
    masks = simhash.masks(3, list(range(64)))
    rng = random.Random(0)
    for _ in range(2000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(not difference & m for m in masks)
    for mask in masks:
        dropped = [b for b in range(64) if not mask >> b & 1]
        again = simhash.masks(3, dropped)
        for _ in range(50):
            difference = sum(1 << b for b in rng.sample(dropped, 3))
            assert any(not difference & (mask | m) for m in again)


def test_near_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 62, 30)]]))

    def classes(pairs):
        root = {int(v): int(v) for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for v in root:
            groups.setdefault(find(v), set()).add(v)
        return {frozenset(g) for g in groups.values()}

    a, b = simhash.near_links(values, 3)
    links = zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True)
    near = [(x, y) for x, y in itertools.combinations(values.tolist(), 2) if (x ^ y).bit_count() <= 3]
    assert classes(links) == classes(near)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1999])
def test_perfect_hash_is_one_to_one(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    seeds = token_files.build_hash(keys)
    assert sorted(token_files.slots(keys, seeds, n).tolist()) == list(range(n))


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        token_files.build_hash(np.array([5, 5], np.uint64))


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_places_everything_and_is_best_on_small_cases(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 12) for _ in range(8)]
    counts = {n: lengths.count(n) for n in lengths}
    plan = packing.bin_completion(counts, 12)
    placed = {}
    for pattern, times in plan:
        assert sum(n * q for n, q in pattern) <= 12
        for n, q in pattern:
            placed[n] = placed.get(n, 0) + q * times
    assert placed == counts

    def least(rest, rooms):
        if not rest:
            return len(rooms)
        best = len(lengths)
        for i in range(len(rooms)):
            if rooms[i] >= rest[0]:
                best = min(best, least(rest[1:], rooms[:i] + (rooms[i] - rest[0],) + rooms[i + 1 :]))
        return min(best, least(rest[1:], (*rooms, 12 - rest[0]))) if len(rooms) < best else best

    assert sum(t for _, t in plan) == least(tuple(sorted(lengths, reverse=True)), ())


def test_tree_scores_are_ratios_of_weighted_probabilities(monkeypatch):
    """The score of a byte is P(training + byte) / P(training) of the weighted tree, found plainly."""
    monkeypatch.setattr(ctw, "DEPTH", 2)
    texts = [b"abab", b"abc", b"bca"]

    def weighted(grams):
        total = 0.0
        for bit in range(8):
            for prefix in range(1 << bit):
                own = [((g >> 16, g >> 8 & 255), g >> 7 - bit & 1) for g in grams if (g & 255) >> 8 - bit == prefix]

                def node(rows, depth):
                    a, b = sum(1 for _, x in rows if not x), sum(x for _, x in rows)
                    log_e = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                    if depth == 2 or not rows:
                        return log_e
                    children = sum(node([r for r in rows if r[0][depth] == c], depth + 1) for c in {r[0][depth] for r in rows})
                    return math.log(0.5) + np.logaddexp(log_e, children)

                total += node(own, 0)
        return total

    train = [int(g) for t in texts for g in ctw.text_grams(t)]
    asked = [int(g) for g in ctw.text_grams(b"acbx")]
    grams = np.array(sorted({*train, *asked}), np.uint64)
    counts = np.array([float(train.count(int(g))) for g in grams])
    rows, values = [], {}
    last = grams >> np.uint64(16)
    for top in np.unique(last):
        rows += ctw.root_rows(grams[last == top], counts[last == top])
    root = ctw.root_nodes(rows)
    for top in np.unique(last):
        own = grams[last == top]
        values |= dict(zip(own.tolist(), ctw.gram_scores(own, counts[last == top], root), strict=True))
    before = weighted(train)
    for g in asked:
        assert values[g] == pytest.approx((weighted([*train, g]) - before) / math.log(10), abs=1e-9)


def test_tree_scores_of_a_context_add_up_to_one(monkeypatch):
    monkeypatch.setattr(ctw, "DEPTH", 2)
    train = np.concatenate([ctw.text_grams(t) for t in (b"hello", b"help")])
    context = int(train[0]) & ~255
    grams = np.unique(np.concatenate([train, np.array([context | s for s in range(256)], np.uint64)]))
    counts = np.array([float((train == g).sum()) for g in grams])
    last = grams >> np.uint64(16)
    root = ctw.root_nodes([r for top in np.unique(last) for r in ctw.root_rows(grams[last == top], counts[last == top])])
    own = last == np.uint64(context >> 16)
    score = ctw.gram_scores(grams[own], counts[own], root)
    assert (10 ** score[(grams[own] & ~np.uint64(255)) == context]).sum() == pytest.approx(1)


def test_network_gradients_equal_differences():
    net = toxicity.Net.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes = toxicity.Codes.of(["a", "bb", "ccc", "dddd"])
    places, lengths = np.random.default_rng(0).integers(0, 4, (5, 7)), np.array([7, 3, 1, 5, 7])
    labels = np.array([1, 0, 1, 0, 1.0])
    found = net.gradients(codes, places, lengths, labels)

    def loss():
        z = net.logits(net.gates(net.inputs(codes)), places, lengths).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    for name in ("word", "gram", "ub", "attend", "out", "bias"):
        g = found[name]
        at, value = ((g[0][0], 1), g[1][0, 1]) if isinstance(g, tuple) else ((0,) * net.p[name].ndim, g[(0,) * net.p[name].ndim])
        kept = net.p[name][at]
        net.p[name][at] = kept + 0.01
        above = loss()
        net.p[name][at] = kept - 0.01
        below = loss()
        net.p[name][at] = kept
        assert float(value) == pytest.approx((above - below) / 0.02, rel=2e-3, abs=1e-6)


def test_blocks_are_common_to_any_fifty_words_in_common():
    rng = np.random.default_rng(5)
    for _ in range(50):
        shared = rng.integers(0, 1 << 60, 50, dtype=np.uint64)
        own = [np.concatenate([rng.integers(0, 1 << 60, n, dtype=np.uint64), shared, rng.integers(0, 1 << 60, 30, dtype=np.uint64)]) for n in (7, 90)]
        blocks = [{w[p : p + paragraphs.BLOCK].tobytes() for p in paragraphs.block_places(paragraphs.shingle_hashes(w), len(w))} for w in own]
        assert blocks[0] & blocks[1]


def test_words_of_spans_are_cut():
    assert paragraphs.without_words(" a b\nc d ", [(1, 3)]) == " a d "
    assert paragraphs.without_words("a b", [(0, 2)]) == ""


def test_top_k_of_a_shard_equals_scoring_all():
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.zipf(1.5, 40) % 300, return_counts=True) for _ in range(1500)]
    docs[40] = docs[41] = docs[1200]
    terms, counts = [d[0].astype(np.uint64) for d in docs], [d[1] for d in docs]
    mean = float(np.mean([c.sum() for c in counts]))
    index = search.build(np.arange(1500), terms, counts, mean)
    for q in (3, 40, 77):
        weights = rng.random(len(terms[q]))
        ids, scores, opened, pivots = search.top_k(index, terms[q], weights, 10)
        want = []
        for d in range(1500):
            w = dict(zip(terms[q].tolist(), weights, strict=True))
            tf = dict(zip(terms[d].tolist(), counts[d].tolist(), strict=True))
            norm = search.K1 * (1 - search.B + search.B * counts[d].sum() / mean)
            s = sum(w[t] * tf[t] * (search.K1 + 1) / (tf[t] + norm) for t in sorted(w) if t in tf)
            want.append((-round(s, 6), d))
        want = sorted(want)[:10]
        assert ids.tolist() == [d for _, d in want] and scores.tolist() == pytest.approx([-s for s, _ in want])
        assert opened <= 24 and pivots < 1500
