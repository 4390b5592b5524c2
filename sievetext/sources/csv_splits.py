"""One CSV file in many tasks: record boundaries found in parallel, then splits parsed apart.

Where a record begins can't be told from the middle of a file, since a line break may stand inside
quotes.  So each split of a file is first scanned from every state that the parser may be in where
the split begins, which gives a map from that state to the state at the split's end and to the first
record boundary inside.  The maps of a file, a few numbers a split, are applied one after the other
to give the state at each split's beginning; then every split is parsed from its first boundary on,
by itself, reading on past its end for the record that begins in it.

The states are those of Python's ``csv`` module with default settings: a quote opens a quoted part
only at the beginning of a field, and after a lone carriage return only a line break may follow,
else the file breaks off there.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a split.
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20

RECORD, FIELD_START, FIELD, QUOTED, QUOTE_END, AFTER_CR, BROKEN = range(7)
STATES = range(7)
_LONE_CR = re.compile(rb"\r(?=[^\r\n])")

SPLIT_SCHEMA = "path string, filename string, split_no long, first long, last long"
SCAN_SCHEMA = SPLIT_SCHEMA + ", ends array<int>, boundaries array<long>, field int, problem string"
PARSE_SCHEMA = SPLIT_SCHEMA + ", begin long, field int, problem string"


def advance(data: bytes, state: int) -> tuple[int, int | None]:
    """The state after ``data``, and where the first record boundary in it lies (None: there is none)."""
    at, size, boundary = 0, len(data), None
    while at < size and state != BROKEN:
        if state == QUOTED:
            at = data.find(b'"', at) + 1
            if not at:
                break
            state = QUOTE_END
        elif state in (QUOTE_END, AFTER_CR):
            c = data[at : at + 1]
            at += 1
            if c == b"\n":
                state, boundary = RECORD, at if boundary is None else boundary
            elif c == b"\r":
                state = AFTER_CR
            elif state == AFTER_CR:
                state = BROKEN
            else:
                state = QUOTED if c == b'"' else FIELD_START if c == b"," else FIELD
        else:
            quote = data.find(b'"', at)
            end = quote if quote >= 0 else size
            lone = _LONE_CR.search(data, at, min(end + 1, size))
            stop = lone.start() if lone else end
            if boundary is None and (line := data.find(b"\n", at, stop)) >= 0:
                boundary = line + 1
            if lone:
                return BROKEN, boundary
            if end > at:
                last = data[end - 1 : end]
                state = {b",": FIELD_START, b"\n": RECORD, b"\r": AFTER_CR}.get(last, FIELD)
            at = end
            if quote >= 0 and state != AFTER_CR:
                state = QUOTED if state in (RECORD, FIELD_START) else FIELD
                at += 1
    return state, boundary


def scan_split(blocks: Iterator[bytes]) -> tuple[list[int], list[int | None]]:
    """Of every state at the beginning: the state at the end, and the first boundary's distance.

    Runs that have come to the same state go on as one; all but two mostly do within a line.
    """
    ends, boundaries, passed = list(STATES), [0 if s == RECORD else None for s in STATES], 0
    for block in blocks:
        runs = {state: advance(block, state) for state in set(ends)}
        for start in STATES:
            end, boundary = runs[ends[start]]
            if boundaries[start] is None and boundary is not None:
                boundaries[start] = passed + boundary
            ends[start] = end
        passed += len(block)
    return ends, boundaries


def longest_field_of(lines: Iterator[str]) -> tuple[int | None, str | None]:
    """(place of the longest field of the first data row, problem); both null for a file without data."""
    csv.field_size_limit(sys.maxsize)
    records = csv.reader(lines)
    try:
        next(records, None)
        first = next(records, None)
    except csv.Error as problem:
        return None, str(problem)
    if first is None:
        return None, None
    if not first:
        return None, "the first data row is blank"
    sizes = [len(cell) for cell in first]
    return sizes.index(max(sizes)), None


def _blocks(stream, first: int, last: int) -> Iterator[bytes]:
    stream.seek(first)
    while first < last and (block := stream.read(min(READ_BYTES, last - first))):
        yield block
        first += len(block)


class _Lines:
    """Lines of a stream from an offset on, decoded; ``at`` is the offset after the last one given."""

    def __init__(self, stream, first: int):
        stream.seek(first)
        self.stream, self.at = stream, first

    def __iter__(self):
        return self

    def __next__(self) -> str:
        line = self.stream.readline()
        if not line:
            raise StopIteration
        self.at += len(line)
        return line.decode("utf-8", errors="replace")


def records_between(stream, begin: int, last: int) -> Iterator[list[str]]:
    """The records that begin in [begin, last); ``begin`` is a boundary.  Raises csv.Error where the text breaks off."""
    csv.field_size_limit(sys.maxsize)
    lines = _Lines(stream, begin)
    records = csv.reader(lines)
    while lines.at < last:
        record = next(records, None)
        if record is None:
            return
        yield record


def split_files(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, filename, size) as splits; an empty file has none."""
    numbers = F.explode(F.expr(f"sequence(0L, (size - 1) div {split_bytes})"))
    splits = files.where("size > 0").select("path", "filename", "size", numbers.alias("split_no"))
    return splits.selectExpr(
        "path", "filename", "split_no", f"split_no * {split_bytes} as first", f"least(size, (split_no + 1) * {split_bytes}) as last"
    )


def _scan(open_stream: Callable) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_stream(row["path"]) as stream:
                    ends, boundaries = scan_split(_blocks(stream, row["first"], row["last"]))
                    field = problem = None
                    if row["first"] == 0:
                        field, problem = longest_field_of(_Lines(stream, 0))
                boundaries = [None if b is None else row["first"] + b for b in boundaries]
                values = [*row.values(), ends, boundaries, field, problem]
                yield pa.RecordBatch.from_arrays([pa.array([v], field_.type) for v, field_ in zip(values, SCAN_ARROW)], schema=SCAN_ARROW)

    return task


SCAN_ARROW = pa.schema(
    [("path", pa.string()), ("filename", pa.string()), ("split_no", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]
    + [("ends", pa.list_(pa.int32())), ("boundaries", pa.list_(pa.int64())), ("field", pa.int32()), ("problem", pa.string())]
)


def _chained(scans: pd.DataFrame) -> pd.DataFrame:
    """The splits of one file with the place where each begins to parse; those where no record begins go."""
    scans = scans.sort_values("split_no")
    field, problem = scans.field.iloc[0], scans.problem.iloc[0]
    state, begins = RECORD, []
    for ends, boundaries in zip(scans.ends, scans.boundaries):
        begins.append(None if state == BROKEN else boundaries[state])
        state = ends[state]
    parts = scans[["path", "filename", "split_no", "first", "last"]].copy()
    parts["begin"] = pd.array(begins, dtype="Int64")
    parts["field"] = pd.array([None if pd.isna(field) else int(field)] * len(parts), dtype="Int32")
    parts["problem"] = problem
    if pd.isna(field):  # nothing to parse; the problem is told once
        return parts.iloc[: 0 if problem is None else 1]
    return parts[parts.begin.notna()]


def parse_tasks(files: DataFrame, open_stream: Callable, tasks: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Of (path, filename, size): the splits to parse, with their first boundary and the file's longest field."""
    splits = split_files(files, split_bytes).repartition(tasks, "path", "split_no")
    scans = splits.mapInArrow(_scan(open_stream), SCAN_SCHEMA)
    return scans.groupBy("path").applyInPandas(_chained, PARSE_SCHEMA).repartition(tasks, "path", "split_no")


def split_values(row: dict, stream) -> Iterator[tuple[int, str]]:
    """(row_no, value) of one split of ``parse_tasks``; the header, the record at offset 0, goes."""
    records = records_between(stream, row["begin"], row["last"])
    if row["begin"] == 0:
        next(records, None)
    kept = (record[row["field"]] for record in records if len(record) > row["field"])
    return enumerate(kept)
