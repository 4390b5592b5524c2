"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

Two kinds of paragraph are compared.  Lines of at least ``MIN_WORDS`` words get MinHash bands
over five-word shingles, two rows to a band.  As a passage may also stand inside other text,
every text is further cut into blocks of ``BLOCK`` words at places that depend on the words
alone (the least shingle hash of every ``SPAN`` in a row), so any MIN_WORDS words in common hold
a common block; a block has one band, its whole content.

Blocks in one band are the same words, so they meet the band's first one (by doc_id, then place) in
an equi join, never each other; blocks in a row that meet the same other text are one run.  What
stands around a block need not be the first one's: windows of MIN_WORDS words around a run that its
counterpart does not have are bands of their own, and as these are all the words there is to share,
their first one links all (``_loose_windows``).  Equal
lines meet their first one likewise, and only that one gets bands.  Lines in one band need not be
alike: those unlike the band's first are dealt anew by their rarest shingles, of which two like
lines share one for certain, and words that many lines have no longer bring them together
(``rare_bands``, ``line_pairs``).  Each run is verified on the words: run and counterpart are compared
word by word and grown as far as they agree; where they differ, equal stretches stand by
themselves, and a run or a line stands if its shingles' Jaccard is ``SIMILARITY`` or more.  Runs of a
document that touch are one passage, which goes if it has MIN_WORDS or more; its first occurrence
always stays.  Documents that share passages form components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lean, row_key, scratch, spare, stored, text_of
from .encoding import Memory, groups

MIN_WORDS = 50
SHINGLE = 5
SIMILARITY = 0.8
BLOCK = 24
SPAN = MIN_WORDS - BLOCK + 1
BANDS, ROWS = 8, 2
#: A round of line comparisons has so many times the firsts of the round before.
MORE_FIRSTS = 8
#: 64-bit words of the parity sketch that tells many unlike lines apart without their words.
SKETCH = 4
#: Words between two matched stretches of a document that still are one passage.
BRIDGE = 5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64))


def _folded(values: np.ndarray, n: int, count: int) -> np.ndarray:
    """Each of the first ``n`` runs of ``count`` values as one number."""
    total = np.zeros(n, np.uint64)
    for i, power in enumerate(_powers(_ODD, count)):
        total += values[i : i + n] * power
    return _mix(total)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of SHINGLE words, from the words' hashes."""
    return _folded(words, max(0, len(words) - SHINGLE + 1), SHINGLE)


def _of_span(values: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of every SPAN values in a row."""
    width = 1
    while 2 * width <= SPAN:
        values, width = pick(values[:-width], values[width:]), 2 * width
    return pick(values[: len(values) - (SPAN - width)], values[SPAN - width :])


def block_places(shingles: np.ndarray, n_words: int) -> np.ndarray:
    """Where blocks begin: the least shingle hashes of each SPAN places that have room for a block."""
    return places_of_texts(shingles, np.array([0, n_words]))


def places_of_texts(shingles: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The same of texts in a row, whose words begin at ``firsts`` (the last is their end).

    Every MIN_WORDS words in a row have the same places, whatever stands around them.
    """
    n = len(shingles)
    if n < SPAN:
        return np.zeros(0, np.int64)
    ends = np.repeat(firsts[1:], np.diff(firsts))[:n]
    least = _of_span(shingles, np.minimum)
    least[np.arange(len(least)) + MIN_WORDS > ends[: len(least)]] = 0  # of words of two texts
    around = np.zeros(n + SPAN - 1, np.uint64)
    around[SPAN - 1 : SPAN - 1 + len(least)] = least
    starts = np.repeat(firsts[:-1], np.diff(firsts))[:n]
    fits = (np.arange(n) + BLOCK <= ends) & (ends - starts >= MIN_WORDS)
    return np.flatnonzero((_of_span(around, np.maximum) == shingles) & fits)


def line_bands(shingles: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """(lines, BANDS) band hashes of the lines whose shingles lie at starts to stops."""
    salts = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _ODD)
    sizes = stops - starts
    bounds = np.cumsum(sizes) - sizes
    own = shingles[np.repeat(starts - bounds, sizes) + np.arange(sizes.sum())]
    lows = np.stack([np.minimum.reduceat(_mix(own ^ salt), bounds) for salt in salts], axis=1)
    pairs = lows.reshape(len(starts), BANDS, ROWS)
    return _mix(pairs @ _powers(_ODD, ROWS) + np.arange(1, BANDS + 1, dtype=np.uint64))


def _chains(owner: np.ndarray, names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which blocks stay, words of each): equal blocks of one text under SPAN / 2 apart are one longer block."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((places, names, owner))
    o, n, p = owner[order], names[order], places[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(o) != 0) | (n[1:] != n[:-1]) | (np.diff(p) >= SPAN // 2)
    starts = np.flatnonzero(fresh)
    lasts = np.append(starts[1:], len(order)) - 1
    by_place = np.argsort(order[starts])
    return order[starts][by_place], (p[lasts] - p[starts])[by_place] + BLOCK


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = Memory(lambda words: [xxhash.xxh64_digest(w) for w in words], "paragraphs")
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("key")
        place = 0
        for group in groups(batch.column("text").to_pylist()):
            split = [[line.split() for line in t.encode("utf-8", "surrogatepass").split(b"\n")] for t in group]
            flat = [line for lines in split for line in lines]
            words = [word for line in flat for word in line]
            if not words:
                place += len(group)
                continue
            memory.learn([words])
            hashes = np.frombuffer(b"".join(memory.look(words)), ">u8").astype(np.uint64)
            sizes = np.array([len(line) for line in flat], np.int64)
            line_text = np.repeat(np.arange(len(group)), [len(lines) for lines in split])
            lengths = np.bincount(line_text, sizes, len(group)).astype(np.int64)
            firsts = np.concatenate(([0], np.cumsum(lengths)))
            shingles = shingle_hashes(hashes)
            places = places_of_texts(shingles, firsts)
            owner = np.searchsorted(firsts, places, "right") - 1
            blocks = np.zeros(len(places), np.uint64)
            for i, power in enumerate(_powers(_ODD, BLOCK - SHINGLE + 1)):
                blocks += shingles[places + i] * power
            blocks = _mix(blocks)
            stay, n = _chains(owner, blocks, places)
            long = np.flatnonzero(sizes >= MIN_WORDS)
            starts = (np.cumsum(sizes) - sizes)[long]
            bands = line_bands(shingles, starts, starts + sizes[long] - SHINGLE + 1) if len(long) else np.zeros((0, BANDS), np.uint64)
            names = np.array([xxhash.xxh64_intdigest(b" ".join(flat[i])) for i in long], np.uint64)
            owner = np.concatenate([owner[stay], line_text[long]])
            starts = np.concatenate([places[stay], starts]) - firsts[owner]
            rows = pa.array(owner + place)
            place += len(group)
            if len(owner):
                arrays = [pa.array(np.concatenate([blocks[stay], names]).view(np.int64)), ids.take(rows), keys.take(rows)]
                arrays += [pa.array(x.astype(np.int32)) for x in (starts, np.concatenate([n, sizes[long]]))]
                arrays.append(pa.array([None] * len(stay) + list(bands.view(np.int64)), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["band", "doc_id", "key", "start", "n", "bands"])


#: Blocks have no ``bands``; a line's ``band`` is the hash of all its words.
UNITS = "band long, doc_id long, key long, start int, n int, bands array<long>"


RUN = ("key", "doc_id", "o_key", "o_doc_id", "start", "stop", "o_start", "o_stop", "loose")
#: Words s to e of a text: those around a ``run`` of its own, or (no run) those that runs of other texts or lines ask for.
SLICES = "key long, s int, e int, line boolean, run struct<key:long,doc_id:long,o_key:long,o_doc_id:long,start:int,stop:int,o_start:int,o_stop:int,loose:int>, words binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked stretches of words of each text, joined by single spaces."""
    for batch in batches:
        asked = batch.column("asked")
        s, e, line, run = asked.flatten().flatten()
        spans, texts = zip(s.to_pylist(), e.to_pylist(), strict=True), []
        for text, n in zip(batch.column("text").to_pylist(), pc.list_value_length(asked).to_pylist(), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            texts += [b" ".join(words[a:b]) for a, b in islice(spans, n)]
        arrays = [batch.column("key").take(pc.list_parent_indices(asked)), s, e, line, run, pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "s", "e", "line", "run", "words"])


def jaccard(a: list[bytes], b: list[bytes]) -> float:
    """Of the sets of five-word shingles."""
    one, two = ({tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE + 1)} for x in (a, b))
    return len(one & two) / max(1, len(one | two))


def grown(own: list[bytes], at: int, end: int, other: list[bytes], other_at: int) -> tuple[int, int]:
    """The longest stretch around own[at:end] that equals other around other_at; empty if that part differs."""
    if own[at:end] != other[other_at : other_at + end - at]:
        return at, at
    left = 0
    while left < min(at, other_at) and own[at - left - 1] == other[other_at - left - 1]:
        left += 1
    right, other_end = 0, other_at + end - at
    while right < min(len(own) - end, len(other) - other_end) and own[end + right] == other[other_end + right]:
        right += 1
    return at - left, end + right


def equal_stretches(own: list[bytes], other: list[bytes], shift: int) -> list[tuple[int, int]]:
    """Stretches of BLOCK words or more with own[i] == other[i + shift] throughout."""
    low, high = max(0, -shift), min(len(own), len(other) - shift)
    equal = np.array([own[i] == other[i + shift] for i in range(low, high)], bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8))) + low
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= BLOCK]


def loose_windows(words: list[bytes], at: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """(start, hashes) of windows of MIN_WORDS words in a row that no stretch of ``covered`` holds.

    Of the windows in ``words`` only those count whose least shingle begins a block inside at to end.
    """
    if len(words) < MIN_WORDS:
        return []
    count = len(words) - MIN_WORDS + 1
    starts = np.arange(count)
    open_ = np.ones(count, bool)
    for a, b in covered:
        open_[(starts >= a) & (starts + MIN_WORDS <= b)] = False
    if not open_.any():
        return []
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), ">u8").astype(np.uint64)
    shingles = shingle_hashes(hashes)[: count + SPAN - 1]
    inside = np.arange(len(shingles))
    inside = np.where((inside >= at) & (inside + BLOCK <= end), shingles, np.uint64(0xFFFFFFFFFFFFFFFF))
    open_ &= _of_span(inside, np.minimum) == _of_span(shingles, np.minimum)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
    names = _folded(hashes, count, MIN_WORDS).view(np.int64)
    return [(a, names[a:b].tolist()) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


#: ``met`` and ``o_met``: where run and counterpart began before.  Rows with ``windows`` are no matches but
#: windows of a run, from ``start`` on, that its counterpart does not have.
VERIFIED = "key long, doc_id long, o_key long, o_doc_id long, start int, stop int, met int, o_met int, windows array<long>"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (``line`` false): all that stands of each; lines: the whole line or nothing.

    ``loose`` 1: windows that are not in the counterpart as well; 2: all windows.
    """
    names = ("start", "stop", "o_start", "o_stop", "s", "o_s", "words", "o_words", "line", "loose")
    for batch in batches:
        kept, starts, stops, windows = [], [], [], []
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
            start, stop, o_start, o_stop, s, o_s, words, o_words, line, loose = row
            own, other = words.split(b" "), o_words.split(b" ")
            at, end, o_at, o_end = start - s, stop - s, o_start - o_s, o_stop - o_s
            if end - at == o_end - o_at and (whole := grown(own, at, end, other, o_at))[1] > whole[0]:
                found = equal = [whole]
            else:
                found = [(at, end)] if jaccard(own[at:end], other[o_at:o_end]) >= SIMILARITY else []
                equal = [] if line else equal_stretches(own, other, o_at - at)
                found = found + equal
            kept += [i] * len(found)
            starts += [s + a for a, _ in found]
            stops += [s + b for _, b in found]
            windows += [None] * len(found)
            if loose:
                more = loose_windows(own, at, end, equal if loose == 1 else [])
                kept += [i] * len(more)
                starts += [s + a for a, _ in more]
                stops += [s + a + MIN_WORDS for a, _ in more]
                windows += [x for _, x in more]
        rows = pa.array(kept, pa.int64())
        arrays = [batch.column(c).take(rows) for c in ("key", "doc_id", "o_key", "o_doc_id")]
        arrays += [pa.array(starts, pa.int32()), pa.array(stops, pa.int32())]
        arrays += [batch.column(c).take(rows) for c in ("start", "o_start")]
        arrays.append(pa.array(windows, pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "o_key", "o_doc_id", "start", "stop", "met", "o_met", "windows"])


def _around(start: str, stop: str, prefix: str = "") -> dict[str, Column]:
    """The stretch of words that is read for start to stop, as columns s and e."""
    return {f"{prefix}s": F.greatest(F.col(start) - SPAN, F.lit(0)), f"{prefix}e": F.expr(stop) + SPAN}


def _verify(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """The runs that stand, grown, and their loose windows (see VERIFIED); runs have the words around them, from ``s`` on."""
    runs = runs.withColumns(_around("o_start", "o_stop", "o_"))
    others = texts.select(*[F.col(c).alias(f"o_{c}") for c in ("key", "s", "e", "words")])
    pairs = runs.join(others, ["o_key", "o_s", "o_e"])
    names = ["key", "doc_id", "o_key", "o_doc_id", "start", "stop", "o_start", "o_stop", "s", "o_s", "words", "o_words", "line", "loose"]
    return pairs.select(*names).mapInArrow(lean(_verified), VERIFIED)


def _verify_runs(slices: DataFrame) -> DataFrame:
    """All runs of the slices, against the words that they ask for: each run's own words come with it."""
    runs = slices.where("run is not null").select("run.*", "s", "line", "words")
    return _verify(runs, slices.where("run is null and not line"))


def _verify_lines(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of lines; a line may be in many, so its words are found by its place."""
    own = texts.select("key", "s", "e", "words")
    return _verify(pairs.withColumns(_around("start", "stop")).join(own, ["key", "s", "e"]), texts)


def _texts_of(rows: DataFrame, runs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """The words around runs, around their counterparts and around lines (``line`` true), as SLICES.

    Only whole texts are dealt out, not what is cut out of them: equal rows lie side by side then, and one of them is cut.
    """
    run, none = F.struct(*RUN).alias("run"), F.lit(None).alias("run")
    asked = runs.select("key", *[c.alias(n) for n, c in _around("start", "stop").items()], F.lit(False).alias("line"), run)
    asked = asked.union(runs.select("o_key", *[c.alias(n) for n, c in _around("o_start", "o_stop").items()], F.lit(False), none))
    if lines is not None:
        asked = asked.union(lines.select("key", *[c.alias(n) for n, c in _around("start", "(start + n)").items()], F.lit(True), none))
    asked = asked.groupBy("key").agg(F.collect_set(F.struct("s", "e", "line", "run")).alias("asked"))  # stretches of one text
    texts = rows.select("key", "text").join(asked, "key").dropDuplicates(["key"])
    return stored(texts.mapInArrow(lean(_slices), SLICES), "slices")


def _shared_bands(rows: DataFrame, *more: str) -> DataFrame:
    """The rows of bands that two texts have, and two values of each of the columns ``more``."""
    both = ("key", *more)
    bounds = [f(c).alias(f"{name}_{c}") for c in both for name, f in (("low", F.min), ("high", F.max))]
    held = rows.groupBy("band").agg(*bounds).where(" and ".join(f"low_{c} <> high_{c}" for c in both))
    return rows.join(held.select("band"), "band", "left_semi")


def _line_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingle hashes of each line and the parity of how many fall on each bit of a sketch."""
    for batch in batches:
        sets, sketches = [], []
        for start, n, s, text in zip(*(batch.column(c).to_pylist() for c in ("start", "n", "s", "words")), strict=True):
            words = text.split(b" ")[start - s : start - s + n]
            hashes = np.unique(shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)))
            parity = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
            sets.append(hashes.view(np.int64))
            sketches.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
        arrays = [batch.column(c) for c in ("doc_id", "key", "start", "n")] + [pa.array(x, pa.list_(pa.int64())) for x in (sets, sketches)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "start", "n", "shingles", "sketch"])


def may_be_like(p: str, f: str) -> Column:
    """False only where the Jaccard of two lines' shingles is under 4/5, by their ``size`` and ``sketch``.

    Sets of a Jaccard of 4/5 differ in a ninth of their sizes' sum at most, each shingle of one set alone
    turns one bit of the sketch, and one set has 4/5 of the other's shingles at least.
    """
    turned = " + ".join(f"bit_count({p}.sketch[{i}] ^ {f}.sketch[{i}])" for i in range(SKETCH))
    sizes = f"5 * least({p}.size, {f}.size) >= 4 * greatest({p}.size, {f}.size)"
    return F.expr(f"{sizes} and 9 * ({turned}) <= {p}.size + {f}.size")


def rare_bands(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines (doc_id, key, start, n) dealt by their rarest shingles, as rows with a ``band``, size and sketch each.

    Of two sets with a Jaccard of 4/5 or more, in one order of all shingles, the first fifth (and
    one) of each holds a shingle of the other.  The order is by how many of these lines have a shingle, so
    what many lines share stands last; bands that lie in one document only are left out.
    """
    held = lines.select("doc_id", "key", "start", "n").distinct().withColumns(_around("start", "(start + n)"))
    sets = held.join(texts, ["key", "s", "e"]).mapInArrow(lean(_line_shingles), "doc_id long, key long, start int, n int, shingles array<long>, sketch array<long>")
    sets = stored(sets, "line-shingles")
    sets = sets.withColumn("size", F.size("shingles"))
    single = sets.select("doc_id", "key", "start", "n", "size", "sketch", F.explode("shingles").alias("band"))
    counts = single.groupBy("band").agg(F.count("*").alias("lines"))
    ranks = Window.partitionBy("key", "start").orderBy("lines", "band")
    ranked = single.join(counts, "band").withColumn("rank", F.row_number().over(ranks))
    rare = ranked.where("rank <= size div 5 + 1 and lines > 1").drop("lines", "rank")
    return _shared_bands(stored(rare, "rare-bands"))


def line_pairs(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified pairs of lines of one band (band, doc_id, key, start, n), the later one as key.

    Lines of one class are connected by found pairs, and all but its first one (``head``) have a pair with an earlier line.
    A pair of two classes makes them one; only a head that no earlier line is like stays a class by itself.  In a round all
    lines of a band meet those of one class, the one with the fewest lines of each of its salts, however unlike they are.
    These have met all others then and leave the band; what is left in a band are classes that have not met, and
    a band of one class is done.  So of two like lines of a band the pair is found, or both are of one class
    and the later one has another pair with an earlier line.
    After the first round the others are dealt anew by ``rare_bands``, which loses no like pair, and
    go on with more salts; pairs that the sketch tells apart are left out of the join's result.  The number of rounds grows as the
    logarithm of the most classes of one rare shingle.
    """
    names = ["doc_id", "key", "start", "n", "head"]
    first_id = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")  # null ids come first
    left, salts, found, may_be = lines.withColumn("head", F.struct(first_id, "key", "start")), 1, [], F.lit(True)
    while not left.isEmpty():
        if len(found) == 1:
            heads = left.select("key", "start", "head").distinct()
            left, salts = stored(rare_bands(left, texts).join(heads, ["key", "start"]), "lines-rare"), 1
            names, may_be = [*names, "size", "sketch"], may_be_like("p", "f")
        place = F.struct(*names)
        salt = F.pmod(F.xxhash64("head.key", "head.start", F.lit(salts)), F.lit(salts))
        classes = left.groupBy("band", "head").agg(F.count("*").alias("lines"))
        classes = classes.groupBy("band", salt.alias("salt")).agg(F.min(F.struct("lines", "head")).alias("c")).select("band", "c.head")
        firsts = stored(left.join(classes, ["band", "head"]).select("band", place.alias("f")), "line-firsts")
        met = left.select("band", place.alias("p")).join(firsts, "band").where(F.expr("p.key <> f.key and p.head <> f.head") & may_be)
        met = met.select(F.greatest("p", "f").alias("p"), F.least("p", "f").alias("o"))
        met = met.select("p.doc_id", "p.key", "p.start", "p.n", "p.head", *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("doc_id", "key", "start", "n", "head")])
        met = stored(met.distinct(), "line-met")
        ends = {"stop": F.col("start") + F.col("n"), "o_stop": F.col("o_start") + F.col("o_n"), "line": F.lit(True), "loose": F.lit(0)}
        stands = stored(_verify_lines(met.withColumns(ends), texts), "line-pairs")
        found.append(stands)
        like = stands.select("key", F.col("met").alias("start"), "o_key", F.col("o_met").alias("o_start"))
        like = met.join(like, ["key", "start", "o_key", "o_start"], "left_semi")
        earlier = like.groupBy("key", "start").agg(F.min("o_head").alias("o_head"))
        left = left.join(firsts.select("band", "f.key", "f.start"), ["band", "key", "start"], "left_anti").join(earlier, ["key", "start"], "left")
        left = left.withColumn("head", F.least("head", "o_head")).drop("o_head")
        joined = like.select(F.greatest("head", "o_head").alias("head"), F.least("head", "o_head").alias("low"))
        left = left.join(joined.groupBy("head").agg(F.min("low").alias("low")), "head", "left")
        follows = F.expr("head.key <> key or head.start <> start")
        left = left.withColumn("head", F.when(follows, F.least("head", "low")).otherwise(F.col("head"))).drop("low")
        left = stored(_shared_bands(left, "head"), "lines-left")
        salts *= MORE_FIRSTS
    whole = found[0] if found else _verify_lines(_no_runs(lines), texts)
    for stands in found[1:]:
        whole = whole.union(stands)
    return whole


def _no_runs(lines: DataFrame) -> DataFrame:
    empty = lines.limit(0).withColumns({"stop": F.col("start"), "line": F.lit(True), "loose": F.lit(0)})
    return empty.select("line", "loose", "key", "doc_id", "start", "stop", *[F.col(c).alias(f"o_{c}") for c in ("key", "doc_id", "start", "stop")])


def _after_first(rows: DataFrame, words: int) -> DataFrame:
    """The rows of each band with the place of its first one (o_doc_id, o_key, o_start, o_n) and whether they are ``loose``.

    Rows of a band have ``words`` words in common.  Where it has more than two places, two of them may have more in
    common than either has with the first: 1.  Where some hold those words over and over (``n`` is above ``words``),
    they may have it elsewhere than side by side, and the first one with them: 2.
    """
    place = F.struct("doc_id", "key", "start", "n")
    first = rows.groupBy("band").agg(F.min(place).alias("o"), F.count("*").alias("places"), F.max("n").alias("most"))
    loose = F.when(F.col("most") > words, 2).when(F.col("places") > 2, 1).otherwise(0)
    first = first.select("band", *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("doc_id", "key", "start", "n")], loose.alias("loose"))
    return rows.join(first, "band").where("key <> o_key or loose = 2 or start <> o_start").drop("band")


def _runs(met: DataFrame) -> DataFrame:
    """Rows in a row that meet the same text with the same shift, as one."""
    met = met.withColumns({"stop": F.col("start") + F.col("n"), "o_stop": F.col("o_start") + F.col("o_n"), "shift": F.col("start") - F.col("o_start")})
    same = Window.partitionBy("key", "o_key", "shift").orderBy("start")
    reach = F.max("stop").over(same.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col("start") > reach + (SPAN - BLOCK))
    numbered = met.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(same))
    lowest = [F.min(c).alias(c) for c in ("start", "o_start")]
    highest = [F.max(c).alias(c) for c in ("stop", "o_stop", "loose")]
    runs = numbered.groupBy("key", "doc_id", "o_key", "o_doc_id", "shift", "run").agg(*lowest, *highest)
    return runs.drop("run", "shift")


def _loose_windows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Matches of the windows that runs have and their counterparts have not: equal windows meet their first one."""
    names = ("doc_id", "key", "start")
    single = found.where("windows is not null").select(*names, F.posexplode("windows").alias("nth", "band"))
    single = single.select("band", "doc_id", "key", (F.col("start") + F.col("nth")).alias("start"))
    shared = stored(_shared_bands(single).distinct(), "windows")  # most windows are of one text, so the shared ones are few
    # equal windows of one text close to each other are one longer one
    close = Window.partitionBy("band", "key").orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("start").over(close) >= SPAN // 2, F.lit(True))
    chained = shared.withColumn("fresh", fresh.cast("int")).withColumn("nth", F.sum("fresh").over(close))
    chained = chained.groupBy("band", "doc_id", "key", "nth").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + MIN_WORDS).alias("n"))
    runs = _runs(_after_first(chained.drop("nth"), MIN_WORDS).where("key <> o_key"))
    return _verify_runs(_texts_of(rows, stored(runs.withColumn("loose", F.lit(0)), "window-runs")))


def matches(docs: DataFrame) -> DataFrame:
    """Verified stretches (key, doc_id, start, stop) whose words stand in an earlier document (o_key, o_doc_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text_of().alias("text"))
    with scratch(rows.mapInArrow(lean(_units), UNITS), "units") as units:
        with scratch(_shared_bands(units.where("bands is null").drop("bands")), "blocks") as blocks:
            runs = _runs(_after_first(blocks, BLOCK))
            long = units.where("bands is not null")
            same_lines = _after_first(_shared_bands(long.drop("bands")), MIN_WORDS).where("key <> o_key").distinct()
            ends = {"stop": F.col("start") + F.col("n"), "o_stop": F.col("o_start") + F.col("n"), "loose": F.lit(0)}
            runs = runs.unionByName(same_lines.withColumns(ends).drop("n", "o_n"))
            runs = stored(runs.where("key <> o_key or loose > 0"), "runs")
        single = long.groupBy("band").agg(F.min(F.struct("doc_id", "key", "start", "n", "bands")).alias("l"))
        lines = single.select(F.explode("l.bands").alias("band"), "l.doc_id", "l.key", "l.start", "l.n")
        lines = stored(_shared_bands(lines), "lines")
    texts = _texts_of(rows, runs, lines)
    found = stored(_verify_runs(texts), "run-matches")
    whole = found.where("windows is null and key <> o_key").union(_loose_windows(found, rows)).union(line_pairs(lines, texts.where("line")))
    return whole.drop("met", "o_met", "windows")


def passages(found: DataFrame) -> DataFrame:
    """(key, doc_id, start, stop, o_ids): a document's matches that touch, joined, if MIN_WORDS or more."""
    by_place = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("start") > reach + BRIDGE)).cast("int")
    joined = found.withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(by_place))
    joined = joined.groupBy("key", "doc_id", "nth").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_set("o_doc_id")).alias("o_ids"))
    return joined.where(F.col("stop") - F.col("start") >= MIN_WORDS).drop("nth")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage that goes: doc_id, start_word, n_words, first_doc_ids, component_id.

    first_doc_ids: the documents whose earlier occurrence stays; component_id: the smallest doc_id
    of the documents connected by such passages.  Rows with the same id and text are one document;
    documents of one id with other texts are compared like any two, null ids come first.  Null,
    empty and short texts have no passage; other columns are ignored; no rows give no rows.
    """
    found = stored(matches(docs), "matches")
    taken = stored(passages(found), "passages")
    edges = found.join(taken.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("a"), F.col("o_key").alias("b"))
    roots = components(edges.distinct())
    ids = found.select("key", "doc_id").union(found.select("o_key", "o_doc_id")).distinct()
    lowest = roots.join(ids, roots["node"] == ids["key"]).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = roots.join(lowest, "root").select(F.col("node").alias("key"), "component_id")
    rows = taken.join(classes, "key")
    return rows.select("doc_id", F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("o_ids").alias("first_doc_ids"), "component_id")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans (first, end) and the white space after each span."""
    marks = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, stop in sorted(spans):
        kept.append(text[at : marks[start][0]])
        at = marks[stop][0] if stop < len(marks) else len(text)
    return "".join(kept) + text[at:]


def _cut(spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True):
                texts.append(without_words(text, [(x["start"], x["stop"]) for x in own]) if own else text)
            names = [n for n in batch.schema.names if n != spans]
            arrays = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts (n_chars follows if there is one); every row stays."""
    taken = passages(stored(matches(docs), "matches"))
    row, key, spans = (spare(docs, name) for name in ("_row", "_key", "_spans"))
    found = taken.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias(spans)).withColumnRenamed("key", key)
    rows = docs.withColumn(row, row_key())
    rows = rows.join(found, F.col(row) == F.col(key), "left").drop(row, key)
    cut = rows.mapInArrow(lean(_cut(spans)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
