"""Amplitudes freed of what a unit's own recent events do to them, for many time constants in one pass.

A unit's load is the sum over its earlier events of exp(-age / tau). For all taus at once it is a vector that each event multiplies and adds 1 to. Time is cut into stretches of about ``FULL`` events of
a unit; each stretch starts from nothing, in a stream that holds one vector, and what the stretches before carry over is added after: it is their ends' loads, decayed. So the
events are read once, whatever the number of taus, and a unit with many events is spread over its stretches. Inside a batch loads are added up by doubling, for all its events at once. Fits are of sums of products by unit, and both
medians of a unit are windows over it, so its events are shuffled by unit once for the law and once for what it leaves.

Defined results: events with a null unit, time or amplitude are left out. Equal times are in the order of the event. Units of fewer than ``least`` events have no row. Of equal correlations the first tau
counts; a unit whose loads or amplitudes are all equal has correlation 0, the middle tau, and isn't changed. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import matrix
from .storage import written

#: Events of a unit in a stretch, about.
FULL = 20_000


def decayed(gap: float, taus: np.ndarray) -> np.ndarray:
    return np.exp(-gap / taus)


def loads(trains: DataFrame, taus: list[int], full: int = FULL) -> DataFrame:
    """event, unit, t, amp, load (one value for each tau) of ``trains``."""
    tau = np.array(taus, float)
    known = trains.where("unit IS NOT NULL AND t IS NOT NULL AND amp IS NOT NULL").select("event", F.col("unit").cast("bigint").alias("unit"), "t", F.col("amp").cast("double").alias("amp"))
    most, first, last = known.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0], *known.agg(F.min("t"), F.max("t")).first()
    if most is None:
        return known.select("*", F.array().cast("array<double>").alias("load"))
    # the busiest unit has so many stretches at its mean rate
    stretches = -(-most // full)
    length = max(1, (last - first) // stretches + 1)
    dealt = known.withColumn("stretch", F.floor((F.col("t") - F.lit(first)) / F.lit(length)))
    dealt = dealt.repartition("unit", "stretch").sortWithinPartitions("unit", "stretch", "t", "event")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, load = None, 0, np.zeros(len(tau))
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, t, stretch = (batch.column(k).to_numpy() for k in (1, 2, 4))
            same = np.r_[(int(unit[0]), int(stretch[0])) == key, (unit[1:] == unit[:-1]) & (stretch[1:] == stretch[:-1])]
            out = carried_on(same, np.diff(t, prepend=at), load, tau)
            key, at, load = (int(unit[-1]), int(stretch[-1])), int(t[-1]), out[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(tau)).cast(pa.list_(pa.float64()))], ["event", "unit", "t", "amp", "stretch", "load"])

    local = dealt.mapInArrow(run, "event bigint, unit bigint, t bigint, amp double, stretch bigint, load array<double>")
    if stretches == 1:
        return local.drop("stretch")
    local = written(local, "loads")

    # one row a stretch: the load just after its last event, carried on from stretch to stretch
    ends = local.groupBy("unit", "stretch").agg(F.max("t").alias("t"), F.max_by("load", F.struct("t", "event")).alias("load"), F.min("t").alias("from"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, at = None, np.zeros(len(tau)), 0
        for batch in batches:
            rows = []
            for unit, t, load, begin in zip(*(batch.column(c).to_pylist() for c in ("unit", "t", "load", "from")), strict=True):
                if unit != of:
                    of, held, at = unit, np.zeros(len(tau)), begin
                rows.append((held * decayed(begin - at, tau)).tolist())
                held, at = held * decayed(t - at, tau) + np.asarray(load) + 1, t
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("unit", "stretch", "from")), pa.array(rows, pa.list_(pa.float64()))], ["unit", "stretch", "from", "carry"])

    carried = ends.repartition("unit").sortWithinPartitions("unit", "stretch").mapInArrow(carry, "unit bigint, stretch bigint, from bigint, carry array<double>")
    age = F.col("t") - F.col("from")
    whole = F.array(*(F.col("load")[k] + F.col("carry")[k] * F.exp(-age / float(x)) for k, x in enumerate(taus)))
    return local.join(carried, ["unit", "stretch"]).select("event", "unit", "t", "amp", whole.alias("load"))


def carried_on(same: np.ndarray, gap: np.ndarray, load: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """The loads of events in a row: where ``same``, the one before (``load`` before the first) and 1, decayed over the gap, or else 0. In turns that double, each takes up what the events so far before it hand on."""
    share = np.where(same[:, None], np.exp(-np.where(same, gap, 0)[:, None] / tau), 0.0)
    out = share.copy()
    out[0] *= load + 1
    share[0] = 0
    runs = np.flatnonzero(np.r_[True, ~same[1:], True])
    step, longest = 1, int(np.diff(runs).max())
    while step < longest:
        out[step:] += share[step:] * out[:-step]
        share[step:] *= share[:-step].copy()
        step *= 2
    return out


def laws(loaded: DataFrame, taus: list[int], least: int = 10) -> DataFrame:
    """unit, n, tau, r, b0, b1: the tau whose load correlates best, by magnitude, with the rank of the amplitude from the top, the correlation, and the line of the amplitude by that load."""
    k = len(taus)
    place = F.row_number().over(Window.partitionBy("unit").orderBy("amp", "t", "event")) - 1
    rows = loaded.withColumn("_r", -place.cast("double"))
    each = [F.col("load")[j] for j in range(k)]
    sums = [F.sum(v) for v in (*each, *(x * x for x in each), *(F.col("_r") * x for x in each), *(F.col("amp") * x for x in each), F.col("_r"), F.col("_r") * F.col("_r"), F.col("amp"))]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, v = batch.column(1).to_numpy().astype(float)[:, None], matrix(batch.column(2))
            a, aa, ra, ya = (v[:, j * k : (j + 1) * k] for j in range(4))
            r, rr, y = (v[:, 4 * k + j, None] for j in range(3))
            spread, other = np.maximum(aa / n - (a / n) ** 2, 0), np.maximum(rr / n - (r / n) ** 2, 0)
            with np.errstate(all="ignore"):
                c = np.where((np.sqrt(spread) >= 1e-9) & (other > 0), (ra / n - a * r / n**2) / np.sqrt(spread * other), 0.0)
                best = np.where(np.abs(c).max(1) > 0, np.abs(c).argmax(1), k // 2)[:, None]
                own = lambda x: np.take_along_axis(x, best, 1)
                slope = np.where(own(spread) > 0, (own(ya) / n - own(a) * y / n**2) / own(spread), 0.0)
            out = (own(c), y / n - slope * own(a) / n, slope)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(taus, np.int64)[best.ravel()]), *(pa.array(x.ravel()) for x in out)], ["unit", "n", "tau", "r", "b0", "b1"])

    added = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("v")).where(F.col("n") >= least)
    return added.mapInArrow(fit, "unit bigint, n bigint, tau bigint, r double, b0 double, b1 double")


def deadapted(trains: DataFrame, taus: list[int], least: int = 10, strong: float = 0.2, low: float = 0.2, high: float = 5.0, full: int = FULL) -> DataFrame:
    """event, unit, tau, load, scale, amp, z of the events of units of ``least`` events or more. ``scale`` is what an amplitude is to be multiplied by to be as without a load (1 where the correlation is below ``strong``), within
    ``low`` and ``high``; ``amp`` is multiplied by it; ``z`` is how far the amplitude is from the law, by 1.4826 times the median absolute deviation of the unit (exact medians: a unit's distinct values are in one task)."""
    loaded = written(loads(trains, taus, full), "loaded")
    law = written(laws(loaded, taus, least), "laws")
    at = F.array_position(F.array(*(F.lit(int(x)) for x in taus)), F.col("tau"))
    e = loaded.join(law, "unit").select("event", "unit", "tau", "r", "b0", "b1", "amp", F.element_at("load", at.cast("int")).alias("load"))
    law_at = F.col("b0") + F.col("b1") * F.col("load")
    whole = Window.partitionBy("unit")
    e = e.withColumn("off", F.col("amp") - law_at).withColumn("_m", F.median("off").over(whole))
    e = e.withColumn("sigma", F.median(F.abs(F.col("off") - F.col("_m"))).over(whole) * 1.4826 + 1e-9)
    scale = F.when(F.abs("r") >= strong, F.least(F.lit(high), F.greatest(F.lit(low), F.col("b0") / F.greatest(law_at, F.lit(1e-6))))).otherwise(1.0)
    return e.withColumn("scale", scale).select("event", "unit", "tau", "load", "scale", (F.col("amp") * F.col("scale")).alias("amp"), (F.col("off") / F.col("sigma")).alias("z"))
