"""Best-fit packing of token pieces into sequences by bin completion.

The plan depends on the pieces' lengths alone, of which there are no more than the capacity.
So tasks count lengths, the plan is made for at most ``capacity`` (length, count) pairs whatever
the corpus, and tasks place their pieces by rank within a length.  Texts are never moved.

Bin completion: the largest piece left opens a sequence, undominated fillings of the room
beside it are looked at in order of waste, and a branch whose waste so far leaves no chance to
beat the incumbent is given up.  The incumbent starts as the best-fit decreasing solution.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored, text_of
from .encoding import encoder, tokenizer_path

Pattern = tuple[tuple[int, int], ...]
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counted lengths: (pattern, how many sequences) pairs."""
    room: dict[int, dict[Pattern, int]] = defaultdict(dict)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                each = capacity // length
                whole, rest = divmod(left, each)
                for q, n in ((each, whole), (rest, 1)):
                    if q and n:
                        group = room[capacity - q * length]
                        group[((length, q),)] = group.get(((length, q),), 0) + n
                break
            pattern, n = room[fit].popitem()
            q = min(fit // length, max(1, left))
            m = min(n, left // q)
            if n > m:
                room[fit][pattern] = n - m
            elif not room[fit]:
                del room[fit]
            new = (*pattern, (length, q))
            group = room[fit - q * length]
            group[new] = group.get(new, 0) + m
            left -= q * m
    return [(pattern, n) for group in room.values() for pattern, n in group.items()]


def fillings(room: int, lengths: list[int], left: dict[int, int], effort: int) -> list[tuple[int, Pattern]]:
    """Undominated fillings of ``room`` as (waste, pattern), least waste first.

    A filling into which a further piece fits is dominated, and so is one whose two pieces
    could be replaced by a single one that is left and no shorter.  ``effort`` bounds the steps.
    """
    found: list[tuple[int, Pattern]] = []
    steps = effort
    shortest = lengths[-1] if lengths else room + 1
    stack: list[tuple[int, int, Pattern]] = [(0, room, ())]
    while stack and steps:
        at, free, taken = stack.pop()
        steps -= 1
        while at < len(lengths) and lengths[at] > free:
            at += 1
        if at == len(lengths) or free < shortest:
            found.append((free, taken))
            if not free:
                break
            continue
        length = lengths[at]
        most = min(free // length, left[length])
        for q in range(0, most + 1):  # the last pushed, most of the longest, is tried first
            stack.append((at + 1, free - q * length, (*taken, (length, q)) if q else taken))
    found.sort(key=lambda x: x[0])
    best = [x for x in found[:8] if not _dominated(*x, lengths[::-1], left)]
    return best or found[:1]


def _dominated(waste: int, pattern: Pattern, ascending: list[int], left: dict[int, int]) -> bool:
    used = dict(pattern)
    flat = [n for n, q in pattern for _ in range(min(q, 2))]
    if len(flat) > 12:
        return False
    for i, a in enumerate(flat):
        for b in flat[i + 1 :]:
            at = bisect_left(ascending, a + b)
            while at < len(ascending) and ascending[at] <= a + b + waste:
                if left[ascending[at]] > used.get(ascending[at], 0):
                    return True
                at += 1
    return False


def bin_completion(counts: dict[int, int], capacity: int, effort: int = 400, branches: int = 300) -> list[tuple[Pattern, int]]:
    """A plan with few sequences: (pattern of (length, pieces), how many sequences).

    ``effort`` bounds the steps per filling and ``branches`` the sequences opened after the
    first descent; every piece is placed whatever they are.
    """
    total = sum(n * q for n, q in counts.items())
    least = max(-(-total // capacity), sum(q for n, q in counts.items() if 2 * n > capacity))
    incumbent = best_fit(counts, capacity)
    bins = sum(n for _, n in incumbent)
    # depth first; a node: (counts left, plan so far, waste so far, sequences so far)
    stack = [(dict(counts), [], 0, 0)]
    opened, descended = 0, False
    while stack and bins > least and opened < branches:
        left, plan, waste, used = stack.pop()
        while left:
            if waste > (bins - 1) * capacity - total:
                break
            largest = max(left)
            rest = {n: q - (n == largest) for n, q in left.items() if q > (n == largest)}
            lengths = sorted((n for n in rest if n <= capacity - largest), reverse=True)
            found = fillings(capacity - largest, lengths, rest, effort)
            for other_waste, other in found[2:0:-1]:
                stack.append(_applied(left, plan, waste, used, largest, other, other_waste))
            del stack[:-branches]
            opened += descended
            left, plan, waste, used = _applied(left, plan, waste, used, largest, found[0][1], found[0][0])
        if not left and used < bins:
            incumbent, bins = plan, used
        descended = True
    return incumbent


def _applied(left, plan, waste, used, largest, filling, free):
    pattern = dict(filling)
    pattern[largest] = pattern.get(largest, 0) + 1
    times = min(left[n] // q for n, q in pattern.items())
    new = {n: left[n] - times * pattern.get(n, 0) for n in left}
    done = tuple(sorted(pattern.items(), reverse=True))
    return {n: q for n, q in new.items() if q}, [*plan, (done, times)], waste + free * times, used + times


def _places(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each (length, first rank): the first sequence, pieces per sequence and the offset."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for pattern, times in plan:
        at = 0
        for length, q in pattern:
            rows.append(((length << 44) + next_rank[length], next_rank[length], sequence, q, at))
            next_rank[length] += q * times
            at += length * q
        sequence += times
    rows.sort()
    names = ("key", "rank", "sequence", "each", "at")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}


def _cut(path: str | None, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path("word_bpe_49k.json")).ids
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            found = encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    n = len(part)
                    rows.append((doc_id, piece, start, n, zlib.crc32(part.tobytes()), task, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _place(places: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(places["key"], (length << 44) + rank, side="right") - 1
            past = rank - places["rank"][at]
            sequence = places["sequence"][at] + past // places["each"][at]
            offset = places["at"][at] + past % places["each"][at] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and ``end_id`` are cut into pieces of ``capacity`` only if they are more;
    the pieces of a sequence lie gapless from 0.  A null text is empty and gives one piece of one
    id; repeated rows and rows with a null id are packed like any other; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = stored(rows.mapInArrow(lean(_cut(path, end_id, capacity)), PIECE_SCHEMA), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("first"))
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    plan = bin_completion({r["length"]: r["n"] for r in counted}, capacity)
    ranked = pieces.join(first, ["length", "task"]).withColumn("rank", F.col("first") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(_places(plan)), schema)
