"""Filter files read record by record; a broken record is told and passed over.

A record is broken where a quote stays open: nothing ends it before the file does, or it grows
beyond RECORD_CHARS.  Its first line is given up, and reading goes on with the next one.
"""

from __future__ import annotations

import csv
import io
import sys
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import csv_splits
from .bundle import ROWS_PER_BATCH, member_stream

#: A record that is longer and whose quote is still open is broken.
RECORD_CHARS = 1 << 20
OPEN_QUOTE = "a quote is not closed"

RECORD_SCHEMA = "filename string, ord long, line_no long, cells array<string>, error string"
_RECORD_ARROW = pa.schema(
    [("filename", pa.string()), ("ord", pa.int64()), ("line_no", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())]
)


def records(lines: Iterator[str]) -> Iterator[tuple[int, list[str] | None]]:
    """(number of its first line, cells) of every record that is not empty; cells are null for a broken one.

    ``lines`` keep their line breaks, of any kind.  A quote that is open on the last line of all is closed there.
    """
    csv.field_size_limit(sys.maxsize)
    lines, again, line_no = iter(lines), deque(), 0
    while True:
        held, state, size = [], csv_splits.RECORD, 0
        while not held or state == csv_splits.QUOTED:
            line = again.popleft() if again else next(lines, None)
            if line is None:
                break
            held.append(line)
            size += len(line)
            state, _ = csv_splits.advance(line.encode("utf-8", errors="replace"), state)
            if size > RECORD_CHARS and state == csv_splits.QUOTED:
                break
        if not held:
            return
        if state == csv_splits.QUOTED and (len(held) > 1 or size > RECORD_CHARS):
            again.extendleft(reversed(held[1:]))
            del held[1:]
            yield line_no, None
        elif cells := next(csv.reader(held), None):
            yield line_no, cells
        line_no += len(held)


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for member in batch.to_pylist():
            with member_stream(member["path"], member["member_no"]) as stream:
                text = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="")
                lines = (line.removeprefix("\ufeff") if i == 0 else line for i, line in enumerate(text))
                for ord_, (line_no, cells) in enumerate(records(lines)):
                    error = OPEN_QUOTE if cells is None else None
                    rows.append({"filename": member["filename"], "ord": ord_, "line_no": line_no, "cells": cells, "error": error})
                    if len(rows) >= ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
                        rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)


def read_filter_records(members: DataFrame) -> DataFrame:
    """The records of filter files given as ``scan_bundle`` members: (filename, ord, line_no, cells, error).

    ``ord`` is the record's place among the file's records that are not empty, broken ones included.
    """
    spread = members.repartition("path", "member_no").select("path", "filename", "member_no")
    return spread.mapInArrow(_read_records, RECORD_SCHEMA)


def filter_errors(found: DataFrame) -> DataFrame:
    """(filename, ord, line_no, error) of the broken ones of ``read_filter_records``."""
    return found.where(F.col("error").isNotNull()).select("filename", "ord", "line_no", "error")
