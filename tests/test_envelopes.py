"""Limits of change, shares along the curve and mixtures against plain loops and planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import envelopes, mixtures

R = np.random.default_rng(3)
WAVES = R.normal(size=(60, 8, 4)) * R.uniform(1, 6, 60)[:, None, None] + np.ones((60, 8, 4))
ROWS = [(k, k % 2, (WAVES[k] if k % 2 else WAVES[k][::-1] * 2).ravel().tolist()) for k in range(60)]
ODD = [(99, 7, WAVES[0].ravel().tolist()), (100, None, WAVES[0].ravel().tolist()), (101, 1, None), (102, 1, [0.0] * 32)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event bigint, cluster int, w array<double>")


def plain_pairs(w):
    flat = [np.ravel(x) for x in w]
    for i in range(len(flat)):
        for j in range(i + 1, len(flat)):
            n, m = np.linalg.norm(flat[i]), np.linalg.norm(flat[j])
            yield max(n, m) / min(n, m), 1 - flat[i] @ flat[j] / n / m


def plain_limits(r, d, quantile, bands, least=5):
    edges = np.unique([1.0, *np.geomspace(max(r.min(), 1 + 1e-6), max(r.max(), 1 + 1e-5), bands)])
    top, out = 0.0, []
    for k, low in enumerate(edges):
        inside = d[(r >= low) & (r < (edges[k + 1] if k + 1 < len(edges) else np.inf))]
        top = max(top, np.quantile(inside, quantile) if len(inside) >= least else 0.0)
        out.append(top)
    return edges, np.array(out)


def test_pairs_and_limits(spark):
    pairs = envelopes.changes(frame(spark, ROWS + ODD), None).persist()
    plain = np.array([p for c in (0, 1) for p in plain_pairs([r[2] for r in ROWS if r[1] == c])])
    assert np.allclose(sorted(map(tuple, pairs.select("ratio", "distance").collect())), sorted(map(tuple, plain)))
    for quantile, bands in ((0.9, 5), (0.99, 8), (0.5, 1)):
        got = envelopes.limits(pairs, quantile, bands).orderBy("k").collect()
        edges, most = plain_limits(*plain.T, quantile, bands)
        assert np.allclose([r.edge for r in got], edges) and np.allclose([r.distance for r in got], most) and sum(r.n for r in got) == len(plain)
    found = envelopes.limits(pairs, 0.9, 5)
    edges, most = plain_limits(*plain.T, 0.9, 5)
    judged = envelopes.admitted(pairs, found).collect()
    assert any(not r.admitted for r in judged) and all(r.admitted == (r.ratio <= edges[-1] and r.distance <= most[max(np.searchsorted(edges, r.ratio, "right") - 1, 0)]) for r in judged)
    pairs.unpersist()


def test_sampled_pairs(spark):
    n = envelopes.changes(frame(spark, ROWS), 10).groupBy("cluster").count().collect()
    assert all(0 < r["count"] < 29 * 30 / 2 for r in n)


def test_no_pairs(spark):
    none = envelopes.changes(frame(spark, []))
    assert none.count() == 0
    with pytest.raises(ValueError):
        envelopes.limits(none)
    with pytest.raises(ValueError):
        envelopes.limits(spark.createDataFrame([(1, float("nan"), 0.1), (1, 0.5, 0.1)], "cluster bigint, ratio double, distance double"))


def test_share_along_a_curve(spark):
    t = np.linspace(0, 1, 200)
    curve = (1 + 4 * t)[:, None] * np.stack([np.cos(t), np.sin(t)], 1)
    noise = R.normal(size=(200, 2))
    rows = [(k, c, x.tolist()) for c, part in enumerate((curve, noise, curve[:5])) for k, x in enumerate(part)]
    got = {r.cluster: r for r in envelopes.along_curve(frame(spark, rows)).collect()}
    assert got[0].share > 0.95 and got[1].share < 0.2 and got[2].share is None and got[2].scatter is None
    n, d = np.linalg.norm(curve, axis=1), curve / np.linalg.norm(curve, axis=1)[:, None]
    edges = np.quantile(n, [0.2, 0.4, 0.6, 0.8])
    groups = [d[[sum(x >= e for e in edges) == k for x in n]] for k in range(5)]
    between, scatter = sum(len(g) * ((g.mean(0) - d.mean(0)) ** 2).sum() for g in groups), ((d - d.mean(0)) ** 2).sum()
    assert np.isclose(got[0].share, between / scatter) and np.isclose(got[0].scatter, scatter)
    assert envelopes.along_curve(frame(spark, [])).count() == 0


def three(n=120, d=3):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 9, 4.0]])[:, :d]
    y = np.repeat([0, 1, 2], n)
    return centres[y] + rng.normal(size=(3 * n, d)) @ (np.eye(d) + 0.3 * rng.normal(size=(d, d))), y


def vectors(spark, x):
    return spark.createDataFrame([(k, v.tolist(), 0, 0.0) for k, v in enumerate(x)] + [(None, [0.0] * x.shape[1], 1, 1.0), (900, None, 1, 1.0)], "event bigint, x array<double>, part int, cost double").repartition(4)


def test_mixture_finds_planted_groups(spark):
    x, y = three()
    got = {r.event: r.part for r in mixtures.mixture(vectors(spark, x), 4).collect()}
    assert len(got) == len(x) and set(got.values()) == {0, 1, 2}
    assert np.mean([got[k] == y[k] for k in range(len(x))]) > 0.98
    one = {r.part for r in mixtures.mixture(vectors(spark, R.normal(size=(200, 3))), 3).collect()}
    assert one == {0}
    assert mixtures.mixture(vectors(spark, x).where("false"), 2).count() == 0


def test_turns_are_those_of_a_plain_version(spark):
    x, _ = three(40)
    rows = vectors(spark, x).where("event IS NOT NULL AND x IS NOT NULL")
    models = mixtures.seeds(rows, 3)
    assert all(np.allclose(c, np.cov(x.T, bias=True) + mixtures.RIDGE * np.eye(3)) for _, _, c in models) and all(any(np.allclose(m, v) for v in x) for _, m, _ in models)
    got, score = mixtures.fitted(rows, 3, rounds=4, settle=-1.0)
    for turn in range(4):
        cost = np.stack([np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1] + 3 * np.log(2 * np.pi) - 2 * np.log(w) for w, m, c in models], 1)
        part = cost.argmin(1)
        if turn < 3:
            models = [(np.mean(part == k), x[part == k].mean(0), np.cov(x[part == k].T, bias=True) + mixtures.RIDGE * np.eye(3)) for k in range(3) if (part == k).sum() >= 4]
    assert {r.event: r.part for r in got.collect()} == dict(enumerate(part.tolist()))
    assert np.isclose(score, cost.min(1).sum() + (len(set(part)) * 10 - 1) * np.log(len(x)))
    assert got.agg(F.count("*")).first()[0] == len(x)
