import random

import numpy as np
from pyspark.sql import functions as F

from eventloom.functions import tokens
from eventloom.operators import joins, states, storage, trains
from eventloom.sources.binary import read_binary


def test_band_join_is_the_plain_join(spark):
    a, b = spark.range(40).select((F.col("id") * 7 % 101).alias("t")), spark.range(40).select((F.col("id") * 13 % 97).alias("u"))
    want = a.join(b, F.abs(F.col("t") - F.col("u")) <= 5).count()
    got = joins.band_join(a, b, 5)
    assert got.count() == want
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_last_before(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t long")
    b = spark.createDataFrame([(1, 4), (1, 5), (2, 10)], "k int, u long")
    assert sorted(map(tuple, joins.last_before(a, b, ["k"]).select("k", "t", "u").collect())) == [(1, 1, None), (1, 5, 5), (2, 9, None)]


def test_mutual_best_breaks_ties_by_id(spark):
    p = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5), (2, 10, 0.9)], "a int, b int, s double")
    assert [tuple(r)[:2] for r in joins.mutual_best(p, "a", "b", F.col("s")).collect()] == [(2, 10)]


def test_tokens(spark):
    t = spark.createDataFrame([("stderiv_C4",), ("D",), ("standard_S3_D12",)], "v string")
    got = t.select(tokens.family(F.col("v")), tokens.spatial(F.col("v")), tokens.spatial_order(F.col("v")), tokens.lag(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("stderiv", "C", 4, None), ("D", None, None, None), ("standard", "S", 3, 1)]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.res").write_bytes(np.arange(5, dtype="<i8").tobytes() + b"x")
    (tmp_path / "a.fet").write_bytes(np.array([3], "<i4").tobytes() + np.arange(6, dtype="<i8").tobytes())
    (tmp_path / "a.clu").write_bytes(np.array([2, 1, 0, 1], "<i4").tobytes())
    (tmp_path / "a.spk").write_bytes(np.arange(9, dtype="<i2").tobytes())
    take = lambda end, kind, width=0: sorted(tuple(r)[1:] for r in read_binary(spark, f"{tmp_path}/a.{end}", kind, width).collect())
    assert take("res", "times") == [(i, i) for i in range(5)]
    assert take("fet", "features") == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    assert take("clu", "labels") == [(0, 1), (1, 0), (2, 1)]
    assert take("spk", "waves", 4) == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7])]


def test_numbers_follow_the_order(spark):
    rows = [(i * 37 % 101,) for i in range(101)] + [(None,)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = storage.numbered(spark.createDataFrame(rows, "v int").repartition(6), "n", "v").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.n, r.v) for r in got) == [(0, None), *((i + 1, i) for i in range(101))]
    assert storage.numbered(spark.createDataFrame([], "v int"), "n", "v").count() == 0


def test_repeats_by_a_plain_loop(spark):
    r = random.Random(4)
    rows = [(i, r.randint(0, 3), r.randint(0, 400), r.choice([None, *range(6)])) for i in range(300)]
    df = spark.createDataFrame([(e, u, t, None if a is None else float(a)) for e, u, t, a in rows], "event long, unit int, t long, amp double").repartition(5)
    for floor in (1, 5, 40):
        want = set()
        for u in range(4):
            kept = []
            for e, _, t, a in sorted((x for x in rows if x[1] == u), key=lambda x: (x[2], x[0])):
                if not kept or t - kept[-1][1] >= floor:
                    kept.append((e, t, a))
                elif a is not None and kept[-1][2] is not None and a > kept[-1][2]:
                    kept[-1] = (e, t, a)
            want |= {e for e, *_ in kept}
        assert {x.event for x in states.without_repeats(df, floor).collect()} == want
    assert states.without_repeats(df.where("false"), 5).count() == 0


def test_drift_settles_on_what_was_planted(spark):
    r = random.Random(6)
    drift = [0, 3.0, 8.0, -2.0, 5.0]
    rows = [(u, c, u * 10.0 + d + r.gauss(0, 0.01)) for u in range(15) for c, d in enumerate(drift) if r.random() < 0.8]
    got = {x.chunk: x.drift for x in states.drift(spark.createDataFrame(rows, "unit int, chunk int, depth double"), 12).collect()}
    assert all(abs(got[c] - d) < 0.1 for c, d in enumerate(drift))
    assert states.drift(spark.createDataFrame([], "unit int, chunk int, depth double"), 3).count() == 0


def test_counts_of_pairs_by_all_pairs(spark):
    """In windows of any size and blocks of a few pairs."""
    r = random.Random(7)
    events = [(k % 7, r.choice([0, 100, 105]) if k % 9 == 0 else r.randint(0, 500)) for k in range(160)]
    df = spark.createDataFrame(events, "unit int, t long")
    bands = [(0, 9), (-1, 30), (9, 60)]
    count = lambda ok: {(a, b): n for a in range(7) for b in range(a + 1, 7) if any(n := [sum(lo < abs(t - s) <= hi for u, t in events if u == a for v, s in events if v == b and ok(a, b, t, s)) for lo, hi in bands])}
    span = {u: (min(t for v, t in events if v == u), max(t for v, t in events if v == u)) for u in range(7)}
    inside = lambda a, b, t, s: all(max(span[a][0], span[b][0]) <= x <= min(span[a][1], span[b][1]) for x in (t, s))
    joins_block, joins_held = joins.BLOCK, joins.HELD
    for window, block, held in ((None, joins_block, joins_held), (100, 7, 5), (1000, 50, 40)):
        joins.BLOCK, joins.HELD = block, held
        got = {(x.a, x.b): [x.n0, x.n1, x.n2] for x in joins.pair_counts(df, bands, window).collect()}
        assert {k: n for k, n in got.items() if any(n)} == count(lambda *_: True)
    joins.BLOCK, joins.HELD = joins_block, joins_held
    ends = df.groupBy("unit").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    got = {(x.a, x.b): [x.n0, x.n1, x.n2] for x in joins.pair_counts(df.join(ends, "unit"), bands, shared=True).collect()}
    assert {k: n for k, n in got.items() if any(n)} == count(inside)
    assert joins.pair_counts(df.where("false"), bands).count() == 0


def test_correlations_of_parts_are_those_of_all(spark):
    r = random.Random(8)
    events = [(u, r.randint(u * 3, 400 + u * 40)) for u in range(9) for _ in range(r.choice([1, 3, 20]))] + [(20, 0), (20, 100), (21, 0), (21, 100), (22, 5), (22, 5)]
    df = spark.createDataFrame(events, "unit int, t long")
    one, many = ({(x.a, x.b): x.r for x in trains.rate_correlation(df, 20, n).collect()} for n in (10_000, 6))
    assert one == many and len(one) == 12 * 11 / 2
    for (a, b), value in one.items():
        ta, tb = ([t for u, t in events if u == k] for k in (a, b))
        t0, k = min(ta + tb), -(-(max(ta + tb) - min(ta + tb)) // 20)
        x, y = (np.bincount(np.minimum((np.array(t) - t0) // 20, k - 1), minlength=k) if k >= 4 else np.zeros(1) for t in (ta, tb))
        want = round(float(np.corrcoef(x, y)[0, 1]), 6) if k >= 4 and x.std() > 0 and y.std() > 0 else None
        assert (value is None) == (want is None) and (want is None or abs(value - want) < 2e-6)
    assert trains.rate_correlation(df.where("false"), 20).count() == 0
