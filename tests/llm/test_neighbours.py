"""Nearest neighbours against brute force: recall by kind of data, exact copies, ties, and vectors that take no part."""

import numpy as np
import pytest

from semforge.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def brute(rows, top=10):
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            best = out.setdefault(q, {})
            for i, w in rows:
                if i != q:
                    d = float(np.sqrt(((v - w) ** 2).sum()))
                    best[i] = min(d, best.get(i, np.inf))
    return {q: [(i, d) for d, i in sorted((d, i) for i, d in b.items())][:top] for q, b in out.items()}


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    out = {}
    for q, rows in got.items():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1)) and [x[1:] for x in rows] == sorted((x[1:] for x in rows), key=lambda x: (x[1], x[0]))
        out[q] = [x[1:] for x in rows]
    return out


def test_curve_visits_every_cell_by_neighbouring_steps():
    for axes, bits in ((1, 5), (2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = neighbours.hilbert(grid, bits)
        assert sorted(keys.tolist()) == list(range(1 << bits * axes))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("kind", ["sphere", "clusters", "plane"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    n, dims = 2400, 24
    if kind == "sphere":
        v = rng.normal(size=(n, dims))
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif kind == "clusters":
        # A third of all lies in one dense cluster far from the origin.
        at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
        v = 50 + rng.normal(size=(40, dims))[at] + rng.normal(size=(n, dims)) * np.where(at == 0, 0.001, 0.1)[:, None]
    else:
        v = rng.normal(size=(n, 3)) @ rng.normal(size=(3, dims)) + rng.normal(size=(n, dims)) * 0.01
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    got, want = found(neighbours.neighbours(frame(spark, rows), every=20, cell_rows=64)), {}
    x = np.array(v, np.float32).astype(np.float64)
    hits = 0
    for q in range(0, n, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want[q] = np.lexsort([np.arange(n), d])[:10]
        assert all(abs(d[i] - s) < 1e-12 for i, s in got[q]) and len(got[q]) == 10
        hits += len({i for i, _ in got[q]} & set(want[q].tolist()))
    assert set(got) == set(want) and hits >= 0.93 * 10 * len(want)


def test_small_windows_on_structured_data(spark, monkeypatch):
    """Where there is near and far, a query meets few cells."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 2)) @ rng.normal(size=(2, 16))
    widths, width = [], neighbours._width
    monkeypatch.setattr(neighbours, "_width", lambda *a: widths.append((width(*a), a[4])) or widths[-1][0])
    neighbours.neighbours(frame(spark, [(int(i), x.tolist()) for i, x in enumerate(v)]), every=20, cell_rows=50).count()
    (got, cells) = widths[0]
    assert cells == 80 and got <= 5


def test_copies_ties_and_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    copies = [(i, [1.0, 2.0]) for i in range(0, 3000, 7)] + [(i, [1.0, 2.5]) for i in range(1, 3000, 7)]
    ties = [(10001, [5.0, 0.0]), (10000, [4.0, 0.0]), (10002, [3.0, 0.0]), (10003, [4.0, 1.0]), (10004, [4.0, -1.0])]
    bad = [(20000, None), (20100, []), (20200, [nan, 1.0]), (20300, [inf, 1.0]), (20400, [0.0, -0.0]), (20500, [None, 1.0]), (20600, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    repeated = [(700, [9.0, 9.0]), (30000, [-0.0, 3.0]), (30001, [0.0, 3.0]), (10001, [5.0, 0.0])]
    rows = [*copies, *ties, *bad, *repeated]
    df = frame(spark, rows).withColumnRenamed("label", "score")
    sound = [*copies, *ties, *repeated]
    for size in (4096, 16):
        got = found(neighbours.neighbours(df, cell_rows=size))
        want = brute(sound)
        assert set(got) == set(want)
        if size == 4096:
            assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
            assert all(abs(a - b) < 1e-12 for q in got for (_, a), (_, b) in zip(got[q], want[q]))
        # Copies of a query are all at distance zero, the ten smallest ids first, whatever the cells.
        assert [i for i, d in got[0]] == list(range(7, 77, 7)) and all(d == 0 for _, d in got[0])
    assert neighbours.neighbours(df.limit(0)).count() == 0
    few = found(neighbours.neighbours(frame(spark, [(0, [1.0]), (5, [2.0])])))
    assert few == {0: [(5, 1.0)]}
