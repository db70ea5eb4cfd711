import numpy as np
from pyspark.sql import functions as F

from eventloom import queries
from eventloom.operators import curves, graphs

SF = "/root/testdata/sf0.001"


def plain_curve(x):
    r = np.linalg.norm(x, axis=1)
    d = x / r[:, None]
    at = np.linspace(*np.percentile(r, [1, 99]), curves.GRID)
    out = []
    for g in at:
        for k in range(6):
            w = np.exp(-0.5 * ((r - g) / (0.1 * (at[-1] - at[0]) * 1.6**k)) ** 2)
            if w.sum() >= 12:
                break
        root = np.sqrt(w)[:, None]
        a = np.linalg.lstsq(root * np.c_[np.ones(len(r)), r - g], root * d, rcond=None)[0][0]
        out.append(a / np.linalg.norm(a))
    return at, np.array(out)


def test_curves_are_the_plain_regression(spark):
    w = queries.scaled(spark, SF)
    known = {}
    for row in w.collect():
        known.setdefault(row.cluster, []).append(row.w)
    got = {row.cluster: row for row in curves.fit(w.repartition(3)).collect()}
    want = {c: plain_curve(np.array(x)) for c, x in known.items()}
    assert got.keys() == want.keys()
    for c, (at, d) in want.items():
        assert np.allclose(got[c].at, at) and np.allclose(np.array(got[c].direction).reshape(d.shape), d, atol=1e-6)
    for row in curves.nearest(w, curves.fit(w)).join(w.select("event", "w"), "event").limit(50).collect():
        x = np.array(row.w)
        r = np.linalg.norm(x)
        res = {}
        for c, (at, d) in want.items():
            p = np.array([np.interp(r, at, d[:, j]) for j in range(d.shape[1])])
            res[c] = np.linalg.norm(x - r * p / np.linalg.norm(p))
        assert row.best == min(res, key=res.get) and abs(row.residual - min(res.values())) < 1e-6


def test_curve_of_equal_norms_nulls_and_no_rows(spark):
    w = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 5, [0.0, 1.0]), (3, 5, None), (4, None, [1.0, 1.0]), (5, 5, [0.0, 0.0])], "event long, cluster int, w array<double>")
    (row,) = curves.fit(w).collect()
    assert np.allclose(np.array(row.direction).reshape(-1, 2), np.sqrt(0.5))
    assert curves.fit(w.limit(0)).count() == 0 and curves.nearest(w, curves.fit(w.limit(0))).count() == 0


def test_components_of_a_long_path_a_hub_and_a_loop(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(300).select(F.lit(1000).cast("long").alias("a"), (F.col("id") + 2000).alias("b"))
    loop = spark.createDataFrame([(5000, 5000), (None, 7)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(path.union(hub).union(loop)).collect()}
    assert got == {n: 0 for n in range(201)} | {n: 1000 for n in [1000, *range(2000, 2300)]} | {5000: 5000}
    assert graphs.components(loop.limit(0)).count() == 0


def test_bundles_keep_to_one_node_a_chunk(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2), (9, 9)], "node long, chunk long")
    links = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (3, 4, 0.7), (2, 4, 0.6)], "a long, b long, strength double")
    assert {r.node: r.bundle for r in graphs.exclusive_bundles(nodes, links).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9}
    made = queries.exclusive_bundles(spark, SF).withColumn("chunk", F.floor(F.col("node") / 100))
    assert made.count() > 0 and made.groupBy("bundle", "chunk").count().where("count > 1").count() == 0
