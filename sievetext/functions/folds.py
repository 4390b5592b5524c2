"""Sums of vectors as arrays: what a task and a shuffle hold is one array a key, never a row a dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bits import FIXED_ONE, list_array, matrix_of

#: Partial sums that a task holds before it hands them on.
HELD_BYTES = 32 << 20


def fixed_rows(vectors: pa.Array) -> np.ndarray:
    """Rows as whole numbers of 2**-32, rounded; a null entry counts nothing.

    Raises for NaN and for entries of 2**31 or more, and where the vectors differ in length.
    """
    entries = vectors.flatten()
    if entries.null_count:
        offsets = np.asarray(vectors.offsets)
        vectors = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pc.fill_null(entries, 0.0))
    wide = matrix_of(vectors).astype(np.float64)
    if not (np.abs(wide) < 2.0**31).all():
        raise ValueError("a vector entry is NaN or too large for a sum")
    return np.floor(wide * FIXED_ONE + 0.5).astype(np.int64)


def _exact(totals: np.ndarray) -> np.ndarray:
    """Totals of Python's integers as longs."""
    if any(not -(2**63) <= x < 2**63 for x in totals.ravel()):
        raise OverflowError("a vector sum is too large for a long")
    return totals.astype(np.int64)


def _sum_by(codes: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    """Rows added up by group; exact, or an error."""
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(groups))
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    if most * len(rows) < 2**62:
        return np.add.reduceat(rows[order], starts, axis=0)
    return _exact(np.add.reduceat(rows[order].astype(object), starts, axis=0))


class Held:
    """Partial sums by key, in the order in which keys came."""

    def __init__(self):
        self.places: dict[tuple, int] = {}
        self.sums = np.zeros((0, 0), np.int64)

    def add(self, keys: list[tuple], rows: np.ndarray) -> None:
        if self.places and rows.shape[1] != self.sums.shape[1]:
            raise ValueError("vectors of mixed dimension")
        codes = np.array([self.places.setdefault(key, len(self.places)) for key in keys], dtype=np.int64)
        found, codes = np.unique(codes, return_inverse=True)
        sums = _sum_by(codes, rows, len(found))
        if len(self.places) > len(self.sums):
            grown = np.zeros((max(len(self.places), 2 * len(self.sums)), rows.shape[1]), np.int64)
            grown[: len(self.sums)] = self.sums.reshape(len(self.sums), -1) if self.sums.size else 0
            self.sums = grown
        before = self.sums[found]
        added = before + sums
        if (((before ^ added) & (sums ^ added)) < 0).any():  # the sign bit was lost
            raise OverflowError("a vector sum is too large for a long")
        self.sums[found] = added

    def take(self, keep_last: bool = False) -> tuple[list[tuple], np.ndarray]:
        """Keys and sums held so far; the key that came last stays if its rows may go on."""
        keys = list(self.places)
        out = len(keys) - keep_last
        sums = self.sums[:out].copy()
        rest, last = keys[out:], self.sums[out : len(keys)].copy()
        self.places, self.sums = {key: i for i, key in enumerate(rest)}, last
        return keys[:out], sums


def fold(batches: Iterator[pa.RecordBatch], keys: int, rows_of, schema: pa.Schema, sorted_: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches whose first ``keys`` columns are keys to one row of sums a key.

    ``rows_of`` gives a batch's whole-number rows and which of its rows they are.  Where the rows come
    sorted by key, every key comes out once; else a key comes out again whenever the held sums were
    handed on, so that memory is bounded whatever the number of keys.
    """
    held = Held()

    def out(found: tuple[list[tuple], np.ndarray]) -> pa.RecordBatch:
        names, sums = found
        columns = [pa.array([name[i] for name in names], type=schema.field(i).type) for i in range(keys)]
        return pa.RecordBatch.from_arrays([*columns, list_array(sums)], schema=schema)

    for batch in batches:
        rows, kept = rows_of(batch)
        if len(rows):
            columns = [batch.column(i).take(kept).to_pylist() for i in range(keys)]
            held.add(list(zip(*columns)) if keys else [()] * len(rows), rows)
        if sorted_ and len(held.places) > 1 or held.sums.nbytes > HELD_BYTES and not sorted_:
            yield out(held.take(keep_last=sorted_))
    if held.places:
        yield out(held.take())
