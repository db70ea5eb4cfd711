"""Slow states of trains (event, unit, t, kind, amp): decaying counts, parts of variance, places in episodes, near repeats."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .trains import DAY, HOUR, gaps

#: A block of ``decaying`` is so many tau long; what is more than REACH blocks old adds less than exp(-48) an event.
BLOCK, REACH = 16, 3


def decaying(trains: DataFrame, tau: int) -> DataFrame:
    """event, unit, load: the sum over the unit's earlier events of exp(-age / tau), which is a <- exp(-gap / tau) (a + 1) from 0.

    Time is cut into blocks. Sums inside a block are running sums, and each block's total is carried into the next ones, so a
    unit with many events is spread over its blocks and nothing runs event by event.
    """
    size = BLOCK * tau
    e = trains.select("event", "unit", "t", F.floor(F.col("t") / size).alias("block")).withColumn("x", (F.col("t") - F.col("block") * size) / tau)
    total = e.groupBy("unit", "block").agg(F.sum(F.exp(F.col("x") - BLOCK)).alias("s"))
    ahead = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-BLOCK * (k - 1))).alias("f")) for k in range(1, REACH + 1)))).alias("a")
    carry = total.select("unit", "block", "s", ahead).groupBy("unit", (F.col("block") + F.col("a.k")).alias("block")).agg(F.sum(F.col("s") * F.col("a.f")).alias("carry"))
    earlier = F.sum(F.exp("x")).over(Window.partitionBy("unit", "block").orderBy("t", "event").rowsBetween(Window.unboundedPreceding, -1))
    inside = e.withColumn("inside", F.coalesce(earlier, F.lit(0.0)))
    return inside.join(carry, ["unit", "block"], "left").select("event", "unit", ((F.col("inside") + F.coalesce("carry", F.lit(0.0))) * F.exp(-F.col("x"))).alias("load"))


def adaptation(trains: DataFrame, taus: tuple[int, ...], least: int = 10) -> DataFrame:
    """unit, tau, r: of ``taus`` the one whose load correlates best, by magnitude, with the rank of the amplitude from the top; ties go to the shortest."""
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("amp", "event")) - 1
    ranked = trains.withColumn("rank", rank).select("event", (F.col("rank") * -1.0).alias("rank"))
    loads = [decaying(trains, tau).withColumn("tau", F.lit(tau)) for tau in taus]
    every = loads[0]
    for more in loads[1:]:
        every = every.unionByName(more)
    r = every.join(ranked, "event").groupBy("unit", "tau").agg(F.round(F.corr("load", "rank"), 6).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    best = r.groupBy("unit").agg(F.max(F.struct(F.abs("r").alias("m"), (-F.col("tau")).alias("tau"), "r")).alias("b"))
    return best.select("unit", (-F.col("b.tau")).alias("tau"), F.col("b.r").alias("r"))


def gap_share(trains: DataFrame, edges: tuple[int, ...] = tuple(HOUR << k for k in range(7)), least: int = 10) -> DataFrame:
    """unit, n, share, radius, between: how much of the amplitude's variance lies between bins of the gap before; first events are in the last bin."""
    bin_ = sum((F.col("gap") >= e).cast("int") for e in edges)
    b = gaps(trains).where("amp is not null").groupBy("unit", F.coalesce(bin_, F.lit(len(edges))).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.sum("amp").alias("s"), F.sum(F.col("amp") * F.col("amp")).alias("q"))
    u = b.groupBy("unit").agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("g")).where(F.col("n") >= least)
    mean2 = F.pow(F.col("s") / F.col("n"), F.lit(2))
    u = u.select("unit", "n", F.greatest(F.col("q") / F.col("n") - mean2, F.lit(0.0)).alias("all"), F.greatest(F.col("g") / F.col("n") - mean2, F.lit(0.0)).alias("between"))
    return u.select("unit", "n", F.round(F.col("between") / F.greatest("all", F.lit(1e-30)), 6).alias("share"), F.round(F.sqrt("all"), 4).alias("radius"), F.round(F.sqrt("between"), 4).alias("between"))


def fast_slow(trains: DataFrame, near: int = DAY, blocks: int = 12, least: int = 10) -> DataFrame:
    """unit, n, v_total, v_fast (half the mean squared step over gaps under ``near``), v_slow (the rest), v_drift (between equal parts of the unit's span)."""
    w = Window.partitionBy("unit")
    step = F.col("amp") - F.lag("amp").over(w.orderBy("t", "event"))
    e = gaps(trains).withColumn("step", step).withColumn("t0", F.min("t").over(w)).withColumn("t1", F.max("t").over(w))
    part = F.least(F.floor((F.col("t") - F.col("t0")) * blocks / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))), F.lit(blocks - 1))
    fast = F.when(F.col("gap") < near, F.col("step") * F.col("step") / 2)
    b = e.groupBy("unit", part.alias("part")).agg(F.count("amp").alias("k"), F.sum("amp").alias("s"), F.sum(F.col("amp") * F.col("amp")).alias("q"), F.sum(fast).alias("f"), F.count(fast).alias("m"))
    u = b.groupBy("unit").agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.nullif("k", F.lit(0))).alias("g"), F.sum("f").alias("f"), F.sum("m").alias("m")).where(F.col("n") >= least)
    mean2 = F.pow(F.col("s") / F.col("n"), F.lit(2))
    total, fast = F.col("q") / F.col("n") - mean2, F.col("f") / F.nullif("m", F.lit(0))
    return u.select("unit", "n", F.round(total, 4).alias("v_total"), F.round(fast, 4).alias("v_fast"), F.round(total - fast, 4).alias("v_slow"), F.round(F.col("g") / F.col("n") - mean2, 4).alias("v_drift"))


def shared_state(trains: DataFrame, near: tuple[int, int] = (0, 6 * HOUR), far: tuple[int, int] = (12 * HOUR, 48 * HOUR), least: int = 200) -> DataFrame:
    """unit, n_near, n_far, variance: half the mean squared step over far gaps less that over near ones; null if either has fewer than ``least``."""
    w = Window.partitionBy("unit").orderBy("t", "event")
    half = F.pow(F.col("amp") - F.lag("amp").over(w), F.lit(2)) / 2
    g = gaps(trains).withColumn("half", half)
    of = lambda b: F.when((F.col("gap") >= b[0]) & (F.col("gap") < b[1]), F.col("half"))
    s = g.groupBy("unit").agg(F.count(of(near)).alias("n_near"), F.count(of(far)).alias("n_far"), F.avg(of(near)).alias("a"), F.avg(of(far)).alias("b"))
    return s.select("unit", "n_near", "n_far", F.when(F.least("n_near", "n_far") >= least, F.round(F.col("b") - F.col("a"), 4)).alias("variance"))


def episode_position(trains: DataFrame, half: int = DAY) -> DataFrame:
    """event, position: the unit's events within ``half`` after this one less those before; of equal times the smaller id is before."""
    w = Window.partitionBy("unit").orderBy("t")
    n = lambda lo, hi: F.count(F.lit(1)).over(w.rangeBetween(lo, hi))
    place = F.row_number().over(Window.partitionBy("unit", "t").orderBy("event"))
    return trains.select("event", (n(0, half) - n(-half, 0) + n(0, 0) - 2 * place + 1).alias("position"))


def without_repeats(trains: DataFrame, floor: int) -> DataFrame:
    """event, unit, t, amp of the events that stay: one nearer than ``floor`` to the last kept takes its place if its amplitude is larger, else goes. Of equal times the smaller event is first; a null amplitude isn't larger.

    One sorted pass that holds the last kept event of the unit at hand. Events are dealt by the unit and by a thousand of its islands, which gaps of ``floor`` part: what follows such a gap doesn't depend on what was before."""
    w = Window.partitionBy("unit").orderBy("t", "event")
    e = gaps(trains).withColumn("_island", F.sum((F.coalesce("gap", F.lit(floor)) >= floor).cast("long")).over(w)).select("event", "unit", "t", "amp", "_island")
    schema = e.drop("_island").schema

    def run(batches):
        key, last, kind = None, None, None
        for batch in batches:
            kind = kind or pa.schema([batch.schema.field(k) for k in range(4)])
            out = []
            for event, unit, t, amp, island in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (event, unit, t, amp)
                if last is None or (unit, island) != key or t - last[2] >= floor:
                    if last is not None:
                        out.append(last)
                    key, last = (unit, island), now
                elif amp is not None and last[3] is not None and amp > last[3]:
                    last = now
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind.field(k).type) for k in range(4)], schema=kind)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[k]], kind.field(k).type) for k in range(4)], schema=kind)

    return e.repartition("unit", F.floor(F.col("_island") / 1000)).sortWithinPartitions("unit", "_island", "t", "event").mapInArrow(run, schema)


def drift(depths: DataFrame, rounds: int = 1, settle: float = 1e-4) -> DataFrame:
    """chunk, drift of depth(unit, chunk) = base(unit) + drift(chunk), by medians in turn; the first chunk has drift 0. One row for each unit and chunk comes in. Turns end after ``rounds``, or when no drift changes by more than ``settle``; each is written."""
    now = depths.select("chunk").distinct().withColumn("drift", F.lit(0.0))
    for k in range(rounds):
        base = depths.join(now, "chunk").groupBy("unit").agg(F.percentile(F.col("depth") - F.col("drift"), F.lit(0.5)).alias("base"))
        d = depths.join(base, "unit").groupBy("chunk").agg(F.percentile(F.col("depth") - F.col("base"), F.lit(0.5)).alias("d"))
        first = d.agg(F.min_by("d", "chunk").alias("first"))
        after = d.crossJoin(F.broadcast(first)).select("chunk", (F.col("d") - F.col("first")).alias("drift"))
        if k < rounds - 1:
            after = written(after, "drift")
            change = after.join(now.withColumnRenamed("drift", "_o"), "chunk").agg(F.max(F.abs(F.col("drift") - F.col("_o")))).first()[0]
            if change is None or change <= settle:
                now = after
                break
        now = after
    return now.select("chunk", F.round("drift", 6).alias("drift"))
