"""The table of pivots gives the matches of a full scan."""

import numpy as np
import pyarrow as pa
import pytest

from sievetext.functions import bits as B
from sievetext.functions import pivots
from sievetext.operators import matching as M


def runs_of(n, per_run, dim, noise, seed):
    """Packed filters in runs of like ones, and rows: like filters, like pivots' opposites, equal to filters."""
    rng = np.random.default_rng(seed)
    cores = rng.random((-(-n // per_run), dim)) > 0.5
    flags = cores[np.arange(n) // per_run] ^ (rng.random((n, dim)) < noise)
    flags[n // 2] = flags[1]  # a tie far apart
    rows = np.concatenate([flags[rng.integers(0, n, 40)] ^ (rng.random((40, dim)) < 0.1), rng.random((40, dim)) > 0.5, flags[[1, n // 2, n - 1]]])
    return B.pack_words(flags), B.pack_words(rows)


@pytest.mark.parametrize(("n", "per_run", "dim", "noise"), [(3000, 30, 384, 0.08), (3000, 700, 128, 0.1), (900, 300, 70, 0.0), (2000, 10, 64, 0.15), (5, 5, 30, 0.1)])
def test_table_equals_scan(n, per_run, dim, noise, monkeypatch):
    words, rows = runs_of(n, per_run, dim, noise, n + dim)
    monkeypatch.setattr(pivots, "APART", 0.45)
    bank = B.FilterBank(dim, np.arange(n), words)
    table = pivots.PivotTable.of(words, dim)
    where, dist = bank.scan(rows)
    for held in (pivots.HELD, 1000):
        monkeypatch.setattr(pivots, "HELD", held)
        got_where, got_dist, _ = table.nearest(rows)
        assert got_where.tolist() == where.tolist() and got_dist.tolist() == dist.tolist()
    for share in (0.0, 1.0):
        monkeypatch.setattr(pivots, "SHARE", share)
        for limit in (0, dim // 8, dim // 3, dim):
            got_where, got_dist, _ = table.nearest(rows, limit)
            near = dist <= limit
            assert got_where.tolist() == np.where(near, where, -1).tolist() and (got_dist[near] == dist[near]).all()
    assert all(len(x) == 0 for x in table.nearest(rows[:0])[:2])


def test_most_pairs_are_skipped_and_short_runs_have_no_table():
    words, rows = runs_of(20_000, 50, 384, 0.08, 3)
    table = pivots.PivotTable.of(words, 384)
    compared = table.nearest(rows, B.max_distance(0.7, 384))[2]
    assert len(table.pivots) >= 400 and compared < 0.05 * len(words) * len(rows)
    assert pivots.PivotTable.of(runs_of(500, 1, 384, 0.0, 4)[0], 384) is None


@pytest.mark.parametrize("threshold", [None, 0.65, 0.95])
def test_jobs_with_and_without_table_agree(spark, monkeypatch, threshold):
    words, rows = runs_of(3000, 30, 384, 0.08, 5)
    cells = pa.array(words.view("<i8").tolist(), pa.list_(pa.int64()))
    filters = spark.createDataFrame(pa.table({"ord": np.arange(3000) * 2, "category": [f"c{i}" for i in range(3000)], "dim": np.full(3000, 384, np.int32), "bits": cells}))
    texts = spark.createDataFrame([(i, [int(w) for w in r]) for i, r in enumerate(rows.view("<i8"))], "id long, bits array<bigint>")
    found = []
    for least in (1, 1 << 30):
        monkeypatch.setattr(M, "PIVOTED_FROM", least)
        found.append(sorted(map(str, M.best_match(texts, filters, threshold=threshold).collect())))
    assert found[0] == found[1] and (len(found[0]) == len(rows) if threshold is None else 0 < len(found[0]) < len(rows))
