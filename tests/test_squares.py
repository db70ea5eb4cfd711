"""Pairs of units, square by square, against plain loops."""

import numpy as np
import pytest
from eventloom.operators import joins, trains


def test_slid_and_told_counts_by_all_pairs():
    r = np.random.default_rng(3)
    unit, t = r.integers(0, 9, 300), r.integers(0, 400, 300)
    one, two = joins.Side(unit[:150], t[:150]), joins.Side(unit[150:] + 20, t[150:])
    lags = [(-40, -11), (3, 25)]
    mine = np.flatnonzero(one.code >= 4)
    for shared in (False, True):
        want = np.zeros((len(one.ids) - 4, len(two.ids)), int)
        for i in mine:
            for j in range(len(two.t)):
                a, b = one.code[i], two.code[j]
                inside = two.first[b] <= one.t[i] <= two.last[b] and one.first[a] <= two.t[j] <= one.last[a]
                want[a - 4, b] += any(x <= two.t[j] - one.t[i] <= y for x, y in lags) and (inside or not shared)
        rows = np.zeros(want.shape, np.int32)
        joins.slid(rows, one, two, mine, 4, lags, shared)
        assert (rows == want).all()
        assert (joins.counted(one, two, (4, len(one.ids)), [lags], shared)[0] == want).all()


def test_a_pair_of_units_meets_in_one_task(spark):
    """Counts leave the tasks summed: the events are shuffled, and nothing after them."""
    df = spark.createDataFrame([(k % 50, k * 7 % 1000) for k in range(300)], "unit long, t long")
    plan = joins.pair_counts(df, [(0, 20)], 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert len(joins.pair_counts(df, [(0, 20)], 40, whole=True).collect()) == 50 * 49 / 2


def test_a_lag_of_the_last_edge_is_a_row_of_zeros(spark):
    df = spark.createDataFrame([(1, 0), (2, 12), (3, 100), (4, 88)], "unit long, t long")
    got = {(x.a, x.b): (x.band_0, x.band_1) for x in trains.lag_bands(df, ((0, 6), (6, 12)), 1).collect()}
    assert got == {(1, 2): (0.0, 0.0), (3, 4): (0.0, pytest.approx(1 / 12, abs=1e-6))}


def test_pieces_hold_every_event(monkeypatch):
    monkeypatch.setattr(joins, "UNITS", 3)
    side = joins.Side(np.array([5, 1, 9, 7, 5, 3, 2]), np.arange(7))
    got = joins.pieces(side)
    assert [p.ids.tolist() for p in got] == [[1], [2, 3], [5], [7, 9]] or sum(len(p.t) for p in got) == 7 and max(len(p.ids) for p in got) <= 3
