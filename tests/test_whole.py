"""Whole groups: over more rows than a sample or a task would take."""

import numpy as np
import pytest
from eventloom.functions import bundles as plain
from eventloom.operators import bundles, continuity, neighbours, places
from pyspark.sql import functions as F


def test_profiles_take_all_events(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(5001, 6))
    w = spark.createDataFrame([(k, 3, x[k].tolist()) for k in range(len(x))], "event long, cluster int, w array<double>")
    got = places.profiles(w, 3, 2).collect()
    assert len(got) == 1 and got[0].cluster == 3
    assert got[0].p == pytest.approx(np.median(np.ptp(x.reshape(-1, 3, 2), axis=1), 0).tolist(), abs=1e-12)


def test_sums_in_order_are_equal_for_equal_rows(spark):
    """Whatever task a row is in."""
    v = [0.1, 0.2, 0.3, 1e9, -1e9, 0.7]
    rows = [(g, k, v[k]) for k in range(6) for g in range(40)]
    df = spark.createDataFrame(rows, "g int, k int, v double").orderBy(F.rand(3)).repartition(7)
    got = {x.s for x in df.groupBy("g").agg(continuity.in_order("k", "v").alias("s")).collect()}
    total = 0.0
    for x in v:
        total += x
    assert got == {total}


@pytest.mark.parametrize("part", [3, 4096])
def test_drift_of_fibers_part_by_part(spark, monkeypatch, part):
    monkeypatch.setattr(bundles, "PART", part)
    r = np.random.default_rng(2)
    x = {g: r.normal(size=(n, 5, 4)) for g, n in ((1, 11), (2, 1), (3, 2))}
    rows = [(g, c, float(c), 1, x[g][c].ravel().tolist()) for g in x for c in range(len(x[g]))]
    df = spark.createDataFrame(rows, "gid int, chunk int, t double, n int, curve array<double>")
    got = {b.id: b.drift for b in bundles.bundle_table(df, 4).collect()}
    assert got == {g: pytest.approx(plain.drift(list(x[g])), abs=1e-9) for g in x}


@pytest.mark.parametrize("rows, held", [(7, 20), (50_000, 4_000_000)])
def test_nearest_leave_the_tasks_alone(spark, monkeypatch, rows, held):
    """Parts of a cell and blocks of any size; copies are ties; a query gets k rows of a part at most, however many it meets."""
    monkeypatch.setattr(neighbours, "MOST_ROWS", rows)
    monkeypatch.setattr(neighbours, "CELLS", held)
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(60, 3)), 1)
    x[40:] = x[:20]
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(60)], "event long, x array<double>")
    found, reached = neighbours.nearest(df, df.where("event % 5 = 0"), 4, cells=3)
    got = {(n.q, n.rank): n.event for n in found.collect()}
    for q in range(0, 60, 5):
        order = sorted((round(float(np.sqrt(((x[q] - x[e]) ** 2).sum())), 9), e) for e in range(60) if e != q)
        assert [got[q, k + 1] for k in range(4)] == [e for _, e in order[:4]]
    assert max(n.compared for n in reached.collect()) <= 59 and len(got) == 48
    asked = spark.createDataFrame([(0, x[0].tolist(), float("inf"), 0.0, 0)], "q long, v array<double>, bound double, d double, cell int")
    all_in = df.withColumn("cell", F.lit(0)).withColumn("r", F.lit(0.0))
    assert neighbours.met(asked, all_in, 4).groupBy("part").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("held", [10, 4_000_000])
def test_successors_by_all_pairs(spark, held):
    r = np.random.default_rng(5)
    rows = [(int(k), int(lo), int(lo + n), float(v)) for k, lo, n, v in zip(range(80), r.integers(0, 300, 80), r.integers(0, 20, 80), r.integers(0, 6, 80), strict=True)]
    pairs = [(abs(x[3] - y[3]), x, y) for x in rows for y in rows if x[0] != y[0] and 0 < y[1] - x[2] <= 25]
    best_a = {x[0]: min((d, y[0]) for d, w, y in pairs if w == x)[1] for _, x, _ in pairs}
    best_b = {y[0]: min((d, x[0]) for d, x, w in pairs if w == y)[1] for _, _, y in pairs}
    want = {(x[0], y[0], y[1] - x[2], d) for d, x, y in pairs if best_a[x[0]] == y[0] and best_b[y[0]] == x[0]}
    df = spark.createDataFrame(rows, "track long, lo long, hi long, level double")
    assert {tuple(x) for x in continuity.successors(df, 25, held=held).select("a", "b", "gap", "apart").collect()} == want
    assert continuity.successors(df.where("false"), 25).count() == 0
