"""Loads, paths and complete linkage against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import adaptation, linkage, neighbours, paths


def plain_loads(events, taus):
    out = {}
    for e, u, t, _ in events:
        out[e] = [sum(math.exp(-(t - s) / tau) for f, v, s, _ in events if v == u and (s, f) < (t, e)) for tau in taus]
    return out


@pytest.mark.parametrize("full", [7, 20_000])
def test_loads_of_all_taus(spark, full):
    r = random.Random(1)
    events = [(k, k % 3, r.randint(0, 3000), r.uniform(1, 9)) for k in range(120)] + [(200 + k, 5, 1000, 1.0) for k in range(4)]
    odd = [(300, None, 5, 1.0), (301, 1, None, 1.0), (302, 1, 5, None)]
    df = spark.createDataFrame(events + odd, "event long, unit int, t long, amp double").repartition(5)
    taus = [10, 100, 5000]
    got = {x.event: list(x.load) for x in adaptation.loads(df, taus, full).collect()}
    want = plain_loads(events, taus)
    assert got.keys() == want.keys() and all(np.allclose(got[e], want[e], atol=1e-9) for e in want)


def test_planted_adaptation_is_found_and_taken_away(spark):
    rng = np.random.default_rng(2)
    taus = [5, 50, 500]
    rows = []
    for u in (1, 2):
        t = np.cumsum(rng.exponential(30, 400)).astype(int)
        load, at = 0.0, 0
        for k, x in enumerate(t):
            load = math.exp(-(x - at) / 50) * (load + 1) if k else 0.0
            at = x
            rows.append((u * 1000 + k, u, int(x), float((10 - 2 * load if u == 1 else 10) + 0.2 * rng.normal())))
    rows += [(9000 + k, 3, k, 1.0) for k in range(5)] + [(9100 + k, 4, k, 2.0) for k in range(20)]
    df = spark.createDataFrame(rows, "event long, unit int, t long, amp double")
    loaded = adaptation.loads(df, taus)
    law = {x.unit: x for x in adaptation.laws(loaded, taus).collect()}
    assert set(law) == {1, 2, 4} and law[1].tau == 50 and law[1].r > 0.9 and abs(law[1].b0 - 10) < 0.2 and abs(law[1].b1 + 2) < 0.1 and abs(law[2].r) < 0.2
    assert (law[4].r, law[4].tau, law[4].b0) == (0.0, 50, 2.0) or law[4].r != 0
    # the same by numpy
    a = np.array([x.load for x in loaded.where("unit = 1").orderBy("event").collect()])
    y = np.array([x[3] for x in rows if x[1] == 1])
    place = -np.argsort(np.argsort(y, kind="stable"))
    c = [np.corrcoef(a[:, k], place)[0, 1] for k in range(3)]
    assert np.isclose(law[1].r, max(c, key=abs)) and np.allclose([law[1].b1, law[1].b0], np.polyfit(a[:, 1], y, 1))
    got = adaptation.deadapted(df, taus).toPandas().sort_values("event")
    one = got[got.unit == 1]
    law_at = law[1].b0 + law[1].b1 * a[:, 1]
    scale = np.clip(law[1].b0 / np.maximum(law_at, 1e-6), 0.2, 5)
    off = y - law_at
    assert np.allclose(one.amp, y * scale) and np.allclose(one.z, off / (1.4826 * np.median(np.abs(off - np.median(off))) + 1e-9))
    assert one.amp.std() / one.amp.mean() < 0.5 * y.std() / y.mean() and (got[got.unit == 2].scale == 1).all() and set(got.unit) == {1, 2, 4}
    assert adaptation.deadapted(df.where("false"), taus).count() == 0


def plain_path(t, v, rounds):
    deg = 2 if len(t) >= 4 else 1 if len(t) >= 2 else 0
    deg = min(deg, len(set(t)) - 1)
    w = np.ones(len(t))
    x = (np.array(t, float) - np.mean(t)) / (np.std(t) or 1)
    for k in range(rounds + 1):
        r = v - np.polyval(np.polyfit(x, v, deg, w=w), x)
        if k < rounds:
            s = np.median(np.abs(r)) * 1.4826 + 1e-9
            w = 1 / (1 + (r / (3 * s)) ** 2)
    return r, w**2


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_paths_of_all_bundles(spark, rounds):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for b, n in enumerate([1, 2, 3, 4, 5, 30, 12, 6]):
        t = [7] * 6 if b == 7 else sorted(rng.choice(1000, n, replace=False).tolist()) if b != 6 else [10] * 6 + [20] * 6
        v = np.array([50 + 0.1 * x - 0.0001 * x * x for x in t]) + rng.normal(size=len(t))
        if n == 30:
            v[4] += 80
        rows += [(b, b * 100 + k, int(x), float(y)) for k, (x, y) in enumerate(zip(t, v, strict=True))]
        want.update({b * 100 + k: x for k, x in enumerate(zip(*plain_path(t, v, rounds), strict=True))})
    df = spark.createDataFrame([*rows, (None, 1, 1, 1.0), (0, 2, None, 1.0), (0, 3, 1, None)], "bundle int, member long, t long, depth double")
    got = {x.member: (x.residual, x.weight) for x in paths.paths(df, "depth", rounds).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[m], want[m], atol=1e-6) for m in want)
    if rounds == 3:
        assert abs(got[504][0]) > 70 and got[504][1] < 1e-3
    assert paths.paths(df.where("false"), "depth").count() == 0


def test_conflicts_keep_the_nearest(spark):
    placed = spark.createDataFrame([(1, 10, 0.5), (1, 11, -0.2), (1, 12, 3.0), (2, 13, 1.0), (2, 14, -1.0)], "bundle int, member long, residual double")
    chunks = spark.createDataFrame([(10, 0), (11, 0), (12, 1), (13, 4), (14, 4)], "member long, chunk int")
    assert sorted(map(tuple, paths.conflicts(placed, chunks).collect())) == [(1, 0, 10, False), (1, 0, 11, True), (2, 4, 13, True), (2, 4, 14, False)]


def plain_linkage(nodes, edges):
    groups = {n: [n] for n in nodes}
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    cross = [edges.get((min(x, y), max(x, y))) for x in groups[a] for y in groups[b]]
                    if None not in cross and (best is None or (max(cross), a, b) < best):
                        best = (max(cross), a, b)
        if best is None:
            return {x: g for g, xs in groups.items() for x in xs}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("seed", range(3))
def test_complete_linkage_one_by_one(spark, seed):
    r = random.Random(seed)
    n = 40
    at = [(r.random(), r.random()) for _ in range(n)]
    edges = {(a, b): round(math.dist(at[a], at[b]), 1 if seed == 2 else 6) for a in range(n) for b in range(a + 1, n) if math.dist(at[a], at[b]) < 0.35}
    rows = [((a, b) if r.random() < 0.5 else (b, a)) + (d,) for (a, b), d in edges.items()]
    df = spark.createDataFrame(rows + rows[:5] + [(3, 3, 0.0), (None, 1, 0.1), (1, 2, None)] + [(a, b, d + 1) for a, b, d in rows[:3]], "a long, b long, distance double")
    nodes = spark.createDataFrame([(k,) for k in range(n)] + [(0,), (None,), (99,)], "node long")
    got = {x.node: x.unit for x in linkage.complete_linkage(nodes, df).collect()}
    assert got == plain_linkage([*range(n), 99], edges) and 1 < len(set(got.values())) < n
    assert linkage.complete_linkage(nodes.where("false"), df.where("false")).count() == 0
    assert {x.unit for x in linkage.complete_linkage(nodes, df.where("false")).where(F.col("node") == 5).collect()} == {5}


def test_neighbours_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 6)) * 5
    x = centres[rng.integers(0, 8, 300)] + rng.normal(size=(300, 6))
    x[50:55] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (999, None)], "event long, x array<double>").repartition(4)
    queries = df.where("event % 7 = 0 OR event = 50")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(q, e): k + 1 for q in range(300) if q % 7 == 0 or q == 50 for k, e in enumerate(sorted((e for e in range(300) if e != q), key=lambda e: (round(d[q, e], 9), e))[:5])}
    for cells, probes in ((12, 2), (1, 1), (64, 8)):
        found, reached = neighbours.nearest(df, queries, 5, cells, probes)
        assert {(r.q, r.event): r.rank for r in found.collect()} == want
        told = reached.collect()
        assert len(told) == 44 and (cells == 1 or np.mean([r.compared for r in told]) < 150)
    few, _ = neighbours.nearest(df.where("event < 3"), queries, 5, 12)
    assert few.groupBy("q").count().where("count > 3").count() == 0 and few.where("q = 0").count() == 2
    assert neighbours.nearest(df.where("false"), queries, 5)[0].count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(df, queries, 5, 10_000)


def test_planted_strays_are_reclaimed(spark):
    rng = np.random.default_rng(8)
    rows = [(k, k // 50, (rng.normal(size=3) + 20 * (k // 50)).tolist()) for k in range(150)]
    rows += [(200 + k, 0, (rng.normal(size=3) + 20).tolist()) for k in range(3)]
    df = spark.createDataFrame(rows, "event long, label int, x array<double>")
    got = {r.event: (r.label, r.other, r.votes) for r in neighbours.reclaimed(df, df, 10, 0.8, 20, 6).collect()}
    assert {e: v for e, v in got.items() if e >= 200} == {200 + k: (0, 1, 10) for k in range(3)} and not {e for e in got if e < 200 and got[e][2] < 8}
    assert all(50 > e or e >= 200 or got[e][1] != got[e][0] for e in got)


def test_loads_of_a_batch_are_those_of_a_loop():
    rng = np.random.default_rng(9)
    tau, load = np.array([3.0, 40.0]), np.array([2.0, 5.0])
    for n, joined in ((1, True), (1, False), (200, True), (333, False)):
        same, gap, want = np.r_[joined, rng.random(n - 1) < 0.95], rng.integers(0, 9, n), []
        for s, g in zip(same, gap, strict=True):
            want.append(np.exp(-g / tau) * ((want[-1] if want else load) + 1) if s else np.zeros(2))
        assert np.allclose(adaptation.carried_on(same, gap, load, tau), want)


@pytest.mark.parametrize("full", [7, 20_000])
def test_no_unit_is_a_python_call_of_its_own(spark, full):
    df = spark.createDataFrame([(k, k % 9, k * 10, float(k % 5)) for k in range(300)], "event long, unit long, t long, amp double")
    plan = adaptation.loads(df, [10, 100], full)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("MapInArrow") == 1
