"""All pairs square by square, and groups of them, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import continuity, envelopes, linkage
from test_paths_and_groups import plain_linkage


def test_near_pairs_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k % 2, w.tolist()) for k, w in enumerate(rng.normal(size=(60, 8)))]
    rows += [(60 + k, 0, rows[0][2]) for k in range(4)] + [(70, 1, [0.0] * 8)]
    df = spark.createDataFrame([*rows, (None, 1, rows[1][2]), (80, None, rows[1][2]), (81, 1, None)], "node long, chunk int, w array<double>")
    side = lambda c, v: df.select(F.col("node").alias(c), "chunk", F.col("w").alias(v))
    want = side("a", "u").join(side("b", "v"), "chunk").where("a < b").withColumn("distance", 1 - continuity.cosine("u", "v")).where("distance <= 0.85")
    want = {(r.a, r.b): r.distance for r in want.collect()}
    for part in (7, 1000):
        got = linkage.near_pairs(df, 0.85, part).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want
    assert len({want[0, 60 + k] for k in range(4)}) == 1
    assert linkage.near_pairs(df.where("false"), 0.85).count() == 0


def test_round_by_round_and_in_one_task_are_one_by_one(spark):
    for seed in range(2):
        r = random.Random(seed)
        edges = {(a, b): round(r.random(), 1 if seed else 6) for a in range(24) for b in range(a + 1, 24) if r.random() < 0.6}
        df = spark.createDataFrame([(*e, d) for e, d in edges.items()], "a long, b long, distance double")
        want = plain_linkage(range(24), edges)
        for left in (0, 40, 1000):
            assert {x.node: x.unit for x in linkage.complete_linkage(spark.range(24).withColumnRenamed("id", "node"), df, left).collect()} == want


def test_a_chain_of_merges_takes_no_round_each(spark, monkeypatch):
    """Copies merge one after another, each into the group of the smallest."""
    told, held = [], linkage.written
    monkeypatch.setattr(linkage, "written", lambda df, name: told.append(name) or held(df, name))
    df = spark.createDataFrame([(a, b, 0.0) for a in range(30) for b in range(a + 1, 30)], "a long, b long, distance double")
    got = linkage.complete_linkage(spark.range(30).withColumnRenamed("id", "node"), df).collect()
    assert {x.unit for x in got} == {0} and len(got) == 30 and len(told) < 8


def test_limits_of_all_are_those_of_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, k % 3, (x * s).tolist()) for k, (x, s) in enumerate(zip(rng.normal(size=(90, 6)), rng.uniform(1, 6, 90), strict=True))]
    rows += [(90 + k, 0, rows[0][2]) for k in range(12)] + [(5, 2, rows[7][2]), (5, 2, rows[8][2])]
    odd = [(200, 0, [0.0] * 6), (201, None, rows[0][2]), (202, 1, None), (203, 1, [float("nan")] * 6), (204, 1, [float("inf")] * 6), (None, 1, rows[1][2]), (205, 7, rows[1][2])]
    df = spark.createDataFrame(rows + odd, "event bigint, cluster int, w array<double>")
    pairs = envelopes.changes(df, None).persist()
    for held, part, quantile, bands in ((100_000, None, 0.99, 8), (0, 9, 0.9, 5), (40, 30, 0.5, 1), (100_000, 30, 0.0, 3)):
        monkeypatch.setattr(envelopes, "HELD", held)
        want, got = (x.orderBy("k").collect() for x in (envelopes.limits(pairs, quantile, bands), envelopes.limits_of_all(df, quantile, bands, part=part)))
        assert [(r.k, r.edge, r.n) for r in got] == [(r.k, r.edge, r.n) for r in want] and np.allclose([r.distance for r in got], [r.distance for r in want], atol=1e-14, rtol=0)
    pairs.unpersist()
    with pytest.raises(ValueError):
        envelopes.limits_of_all(df.where("event = 1"))
