"""Periodic runs of words, found from the maximal pairs of an LCP-interval tree.

A maximal pair is two places i < j from which the same l words follow, with other words (or an end
of the text) before them and after them.  With q = j - i, the q + l words from i on have period q
and no neighbouring word extends them; where l >= (EXPONENT - 1) * q that stretch is a run, so
nothing has to be grown.  Pairs are read off the LCP-interval tree from the bottom up: an interval
holds its places in order, the children of an interval are joined smaller into larger, and a place
is compared with its nearest places of the larger list whose left word is of another class.  A
place farther away can only be at a multiple of the smallest period: where two places are within a
third of what they share, all places between them are at equal steps.  (Lists by class, each met
with all others, give the same pairs in time that is quadratic in the number of classes.)

The tree is built for many documents at once: words are numbered apart for each document, so no
pair spans two of them.  Memory is about 100 bytes a word of a batch; a document is never cut, so
a longer one is a batch of its own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has EXPONENT periods and LEAST_WORDS words at least.
EXPONENT = 4
LEAST_WORDS = 6
#: Words that two places of a run share at least: LEAST_WORDS - 1 with period 1, more with others.
LEAST_SHARED = LEAST_WORDS - 1
#: Words worked on at once, unless one document has more.
BATCH_WORDS = 200_000

RUN_SCHEMA = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary"


def sorted_levels(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places that share 4 words with another one, in suffix order, and ranks by 1, 2, 4... words.

    ``levels[k][i]`` is equal for places whose next 2^k words are equal; place len(ids) has -1.  A
    level moves only places that share their rank, until none do.  Any order of words serves.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.r_[True, ids[order][1:] != ids[order][:-1]] if n else np.zeros(0, bool)
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank], 1
    active = order[~(new & np.r_[new[1:], True])]
    repeated = active
    while len(active):
        key = rank[active] * (n + 1) + rank[np.minimum(active + width, n)] + 1
        moved = np.argsort(key, kind="stable")
        active, key = active[moved], key[moved]
        old, place = rank[active], np.arange(len(active))
        first = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(first, place, 0)) - group
        levels.append(rank)
        active = active[~(first & np.r_[first[1:], True])]
        width *= 2
        if width <= 4:
            repeated = active
    return repeated[np.argsort(rank[repeated])], levels


def shared_words(places: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Of each place after the first, the number of words it shares with the one before."""
    before, after, n = places[:-1], places[1:], len(levels[0]) - 1
    shared = np.zeros(max(len(places) - 1, 0), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(before + shared, n)] == levels[k][np.minimum(after + shared, n)]
        shared += np.where(same, 1 << k, 0)
    return shared


def _joined(one: list[int], other: list[int], shared: int, left: list[int], found: list) -> list[int]:
    """Both children of an interval in one list; maximal pairs across them that are runs go to ``found``."""
    if len(one) < len(other):
        one, other = other, one
    for place in other:
        at = bisect_left(one, place)
        for near in one[at - 1 : at + 1] if at else one[:1]:
            period = abs(near - place)
            if period * (EXPONENT - 1) <= shared and shared + period >= LEAST_WORDS and left[near] != left[place]:
                found.append((min(near, place), shared + period, period))
    if len(other) * 4 < len(one):
        for place in other:
            one.insert(bisect_left(one, place), place)
    else:
        one += other
        one.sort()
    return one


def _interval_runs(places: list[int], shared: list[int], left: list[int], found: list) -> None:
    """Walk one tree from the bottom up; ``shared`` is between neighbouring places."""
    open_: list[tuple[int, list[int]]] = []
    current = [places[0]]
    for place, common in zip(places[1:], shared):
        while open_ and open_[-1][0] >= common:
            words, before = open_.pop()
            current = _joined(before, current, words, left, found)
        open_.append((common, current))
        current = [place]
    while open_:
        words, before = open_.pop()
        current = _joined(before, current, words, left, found)


def runs(ids: np.ndarray) -> np.ndarray:
    """All runs of a sequence of word numbers as rows of start, length and smallest period, in order."""
    places, levels = sorted_levels(ids)
    shared = shared_words(places, levels)
    del levels
    found: list[tuple[int, int, int]] = []
    if len(shared):
        left = np.r_[-1, ids[:-1]]
        # places that share too few words with the one before begin a new tree
        cuts = np.flatnonzero(shared < LEAST_SHARED)
        firsts, ends = np.r_[0, cuts + 1], np.r_[cuts + 1, len(places)]
        tree = np.repeat(np.arange(len(firsts)), ends - firsts)
        # a tree can hold a run only where two of its places are near enough for what it shares
        most = np.maximum.reduceat(np.r_[0, np.where(shared < LEAST_SHARED, 0, shared)], firsts)
        by_place = np.lexsort((places, tree))
        gaps = np.diff(places[by_place])
        near = (tree[1:] == tree[:-1]) & (gaps * (EXPONENT - 1) <= most[tree[1:]])
        for t in np.unique(tree[1:][near]):
            a, b = firsts[t], ends[t]
            part = places[a:b]
            low = int(part.min())
            numbers = left[low : int(part.max()) + 1].tolist() if b - a > (part.max() - low) / 50 else None
            if numbers is None:
                numbers = dict(zip((part - low).tolist(), left[part].tolist()))
            _interval_runs((part - low).tolist(), shared[a : b - 1].tolist(), numbers, batch := [])
            found += [(start + low, length, period) for start, length, period in batch]
    smallest: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        smallest[start, length] = min(period, smallest.get((start, length), period))
    rows = sorted((start, period, length) for (start, length), period in smallest.items())
    return np.array(rows, dtype=np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as op13 reads them: of one document in ten, by the crc32 of its id, the end repeats with a period."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // len(cycle) + 1))[: n - a]


def _of_batch(texts: list[list[bytes]]) -> Iterator[np.ndarray]:
    """The runs of each text, places counted from its own start."""
    numbers, starts, used = [], [0], 0
    for words in texts:
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbers.append(np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)) + used)
        used += len(index)
        starts.append(starts[-1] + len(words))
    found = runs(np.concatenate(numbers)) if numbers else np.zeros((0, 3), np.int64)
    bounds = np.searchsorted(found[:, 0], starts)
    for text, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        yield found[a:b] - [starts[text], 0, 0]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by spaces, without those that a run has after its first period."""
    if len(found):
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, found[:, 0] + found[:, 2], 1)
        np.add.at(change, found[:, 0] + found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def _batched(batches: Iterable[pa.RecordBatch], repeat_ends: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_py() or b"").split()
            if repeat_ends:
                words = looped(words, doc_id)
            if texts and size + len(words) > BATCH_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
    if texts:
        yield ids, texts


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repeat_ends: bool = False) -> DataFrame:
    """The runs of each row's text, in order of start and period, and the text without their repeats.

    Words are separated by ASCII white space only.  Null and empty texts have no words and no runs;
    a null id stays null; repeated rows stay; other columns are ignored; no rows give no rows.
    ``repeat_ends`` reads the words through ``looped`` (a null id counts as an empty one there).
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64())]
        + [(name, pa.list_(pa.int64())) for name in ("starts", "lengths", "periods")]
        + [("collapsed", pa.binary())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batched(batches, repeat_ends):
            found = list(_of_batch(texts))
            columns = [pa.array(ids, pa.int64()), pa.array([len(words) for words in texts], pa.int64())]
            columns += [pa.array([rows[:, k].tolist() for rows in found], pa.list_(pa.int64())) for k in range(3)]
            columns.append(pa.array([collapsed(words, rows) for words, rows in zip(texts, found)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(task, RUN_SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: how many runs it has, its longest one, and digests of all runs and of the collapsed text."""
    rows = find_runs(docs, repeat_ends=True).withColumn("all", F.arrays_zip("starts", "lengths", "periods"))
    longest = "array_max(transform(all, r -> struct(r.lengths as length, -r.starts as s, -r.periods as p)))"
    lines = "array_join(transform(all, r -> concat_ws(',', r.starts, r.lengths, r.periods) || '\n'), '')"
    rows = rows.withColumns({"best": F.expr(longest), "lines": F.expr(lines)})
    return rows.select(
        "doc_id",
        F.size("all").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
