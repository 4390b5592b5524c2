"""Nearest packed bits among very many filters, by pivots and the triangle inequality.

Filter tables hold each query's variants one after the other, so like filters lie in runs: a run ends where
two neighbours are ``APART`` of the bits or more from each other, and long runs are halved by two far
apart filters until a block has at most ``BLOCK``.  Each block has a pivot, the majority of its bits, and
the table holds the least and the greatest distance of its filters from it.  For a row at distance d from
the pivot no filter of the block is nearer than ``max(d - greatest, least - d)``.  A row first meets the
block of its nearest pivot; after that it meets a block only if that bound does not exceed what it has
found, and gives a block up after half of the words if no filter can come near enough any more.  A row
whose blocks would cost more than ``SHARE`` of a full scan is compared with all of them at once.  Results
are those of a full scan, ties included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 256
APART = 0.375
SHORT_RUNS = 0.25
SHARE = 0.5
#: What going to a block costs, in comparisons; the rows that go there share it.
VISIT = 2000
#: Row-by-pivot distances held at once.
HELD = 1 << 22


def hamming(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(rows, words) distances of packed bits."""
    total = np.zeros((len(rows), len(words)), np.int16 if words.shape[1] < 512 else np.int32)
    for w in range(words.shape[1]):
        total += np.bitwise_count(rows[:, w, None] ^ words[None, :, w])
    return total


def _halves(words: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members in two halves, those nearer to one of two far apart filters and the others."""
    own = words[members]
    one = hamming(own[:1], own)[0].argmax()
    from_one = hamming(own[one : one + 1], own)[0]
    other = from_one.argmax()
    lean = from_one.astype(np.int32) - hamming(own[other : other + 1], own)[0]
    order = np.argsort(lean, kind="stable")
    middle = len(order) // 2
    return members[order[:middle]], members[order[middle:]]


def _majority(words: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
    return np.packbits(2 * flags.sum(axis=0, dtype=np.int64) > len(flags)).view(words.dtype)


@dataclass(frozen=True)
class PivotTable:
    """Filters in blocks: words and their places in the bank, where blocks begin, pivots, distance ranges."""

    words: np.ndarray
    places: np.ndarray
    starts: np.ndarray
    pivots: np.ndarray
    least: np.ndarray
    greatest: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, dim: int) -> PivotTable | None:
        """The table of a bank's words; None where runs are too short to save work."""
        steps = np.bitwise_count(words[1:] ^ words[:-1]).sum(axis=1, dtype=np.int64)
        runs = np.split(np.arange(len(words)), np.flatnonzero(steps >= APART * dim) + 1)
        if len(runs) > SHORT_RUNS * len(words):
            return None
        waiting, blocks = runs[::-1], []
        while waiting:
            members = waiting.pop()
            if len(members) > BLOCK:
                waiting += _halves(words, members)
            else:
                blocks.append(np.sort(members))  # the first of equals comes first
        pivots = np.stack([_majority(words[members]) for members in blocks])
        spread = [hamming(pivots[i : i + 1], words[members])[0] for i, members in enumerate(blocks)]
        places = np.concatenate(blocks)
        starts = np.concatenate(([0], np.cumsum([len(members) for members in blocks])))
        least, greatest = (np.array([f(x) for x in spread], np.int32) for f in (np.min, np.max))
        return cls(np.ascontiguousarray(words[places]), places, starts, pivots, least, greatest)

    def nearest(self, rows: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Place and distance of each row's nearest filter, the first one on ties, and how many pairs were compared.

        With a ``limit``, a row without a filter at that distance or nearer has place -1 and a distance above it.
        """
        none = np.iinfo(np.int32).max if limit is None else limit + 1
        where, dist, compared = np.full(len(rows), -1, np.int64), np.full(len(rows), none, np.int32), 0
        step = max(1, HELD // len(self.pivots))
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            compared += self._nearest(rows[part], where[part], dist[part])
        return where, dist, compared

    def _nearest(self, rows: np.ndarray, where: np.ndarray, dist: np.ndarray) -> int:
        away = hamming(rows, self.pivots)
        home = away.argmin(axis=1)
        bound = np.maximum(away - self.greatest, self.least - away)
        compared = away.size
        by_home = np.argsort(home, kind="stable")
        homes, first = np.unique(home[by_home], return_index=True)
        for block, asked in zip(homes.tolist(), np.split(by_home, first[1:]), strict=True):
            compared += self._meet(rows, asked, block, where, dist)
        open_ = bound <= dist[:, None]
        open_[np.arange(len(rows)), home] = False  # met
        cost = np.diff(self.starts) + VISIT / np.maximum(1, open_.sum(axis=0))
        many = open_ @ cost.astype(np.float32) > SHARE * len(self.words)
        open_[many] = False
        for block in np.flatnonzero(open_.any(axis=0)).tolist():
            asked = np.flatnonzero(open_[:, block])
            asked = asked[bound[asked, block] <= dist[asked]]
            if len(asked):
                compared += self._meet(rows, asked, block, where, dist)
        rest = np.flatnonzero(many)
        for at in range(0, len(self.words) if len(rest) else 0, 4096):
            compared += self._compare(rows, rest, slice(at, at + 4096), where, dist)
        return compared

    def _meet(self, rows: np.ndarray, asked: np.ndarray, block: int, where: np.ndarray, dist: np.ndarray) -> int:
        return self._compare(rows, asked, slice(self.starts[block], self.starts[block + 1]), where, dist)

    def _compare(self, rows: np.ndarray, asked: np.ndarray, span: slice, where: np.ndarray, dist: np.ndarray) -> int:
        """Compare the asked rows with a stretch of filters, note what is nearer; how many pairs were compared."""
        words, places, half = self.words[span], self.places[span], rows.shape[1] // 2
        compared = asked.size * len(words)
        total = hamming(rows[asked, :half], words[:, :half])
        hopeful = total.min(axis=1) <= dist[asked]
        asked, total = asked[hopeful], total[hopeful]
        total += hamming(rows[asked, half:], words[:, half:])
        low = total.min(axis=1)
        worth = low <= dist[asked]
        asked, total, low = asked[worth], total[worth], low[worth]
        place = np.where(total == low[:, None], places, len(self.places)).min(axis=1) if len(asked) else places[:0]
        nearer = (low < dist[asked]) | ((low == dist[asked]) & (place < where[asked]))
        dist[asked[nearer]], where[asked[nearer]] = low[nearer], place[nearer]
        return compared
