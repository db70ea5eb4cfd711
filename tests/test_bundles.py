"""Bundles against plain formulas and planted drifts."""

import numpy as np

from eventloom.functions import bundles
from eventloom.operators import bundles as tables

R = np.random.default_rng(8)
LINE = np.linspace(0, 1, 9)[:, None] * np.array([[3.0, 1, 0, 0, 0]])


def test_frame_and_mix():
    curves = [LINE + 0.1 * R.normal(size=LINE.shape) for _ in range(4)]
    f = bundles.frame(curves, 9)
    x = np.vstack(curves)
    assert f.directions.shape == (5, 5) and np.allclose(f.directions @ f.directions.T, np.eye(5)) and np.isclose(f.share.sum(), 100)
    assert np.allclose(f.share, 100 * np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1] / np.trace(np.cov(x.T)))
    shown = bundles.mixed(f, curves, 5 * bundles.first_axes(5))
    assert np.allclose(shown[1], f.scores(curves[1])[:, :3]) and np.allclose(bundles.mixed(f, curves, np.zeros((5, 3)))[0], 0)


def test_drift():
    still, moved = [LINE, LINE, LINE], [LINE, LINE + np.array([0, 0, 1, 0, 0]), LINE + np.array([0, 0, 2, 0, 0])]
    assert bundles.drift(still) < 1e-9 and bundles.drift([LINE]) == 0
    assert np.isclose(bundles.drift(moved), (1 + 1 + 2) / 3 / np.sqrt(10))


def test_views():
    s, b = R.normal(size=(90, 5)) + np.repeat(np.eye(3, 5) * 4, 30, 0), np.repeat([0, 1, 2], 30)
    one = bundles.spread(s, b, b)
    middle = [s[b == k].mean(0) - s.mean(0) for k in range(3)]
    assert np.allclose(one, sum(30 * np.outer(m, m) for m in middle))
    found = bundles.views(one, 4)
    told = [np.trace(v.T @ one @ v) for v in found]
    assert 2 < len(found) <= 5 and told[1] >= max(told) - 1e-9 and all(np.allclose(v.T @ v, np.eye(3)) for v in found)
    assert all(bundles.apart(a, c) > 0.5 for i, a in enumerate(found[2:]) for c in found[: i + 2])
    steps = bundles.path(found, 6)
    assert len(steps) == 6 * len(found) + 1 and all(np.allclose(v.T @ v, np.eye(3)) for v in steps) and np.allclose(steps[0], steps[-1])
    assert np.allclose(steps[6], found[1])


def test_table(spark):
    rows = [(1, k, 12.0 * k, 100 + k, (LINE + k * np.array([0, 0, 1.0, 0, 0])).ravel().tolist(), 0.5) for k in range(3)]
    rows += [(2, k, 12.0 * k, 10, LINE.ravel().tolist(), None) for k in range(2)] + [(None, 0, 0.0, 1, LINE.ravel().tolist(), 0.1), (3, 0, 0.0, 1, [], 0.1)]
    t = spark.createDataFrame(rows, "gid int, chunk int, t double, n int, curve array<double>, bend double")
    got = tables.bundle_table(t, 5).collect()
    assert [r.id for r in got] == [1, 2] and got[0].n == 303 and got[0].nchunks == 3 and (got[0].t0, got[0].t1) == (0, 24) and got[0].mean_bend == 0.5 and got[1].mean_bend is None and got[0].mean_r_cv is None
    assert np.isclose(got[0].drift, 4 / 3 / np.sqrt(10)) and got[1].drift < 1e-9
    assert tables.bundle_table(t.where("false"), 5).count() == 0
