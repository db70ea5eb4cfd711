"""Statistics of event trains (event, unit, t, kind, amp) and of pairs of trains."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import HELD, Side, batches_of, counted, groups, in_squares, lag_counts, lags_of, last_before, pair_counts, rounded, rounded_share

HOUR, MINUTE, DAY = 3_600_000_000, 60_000_000, 86_400_000_000


def gaps(trains: DataFrame) -> DataFrame:
    """Each event with ``gap``, the time since the unit's event before."""
    return trains.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("unit").orderBy("t", "event")))


def share(n: Column, of: Column) -> Column:
    return F.round(n / F.nullif(of, F.lit(0)), 6)


def violations(trains: DataFrame, refractory: int = HOUR, censor: int = MINUTE) -> DataFrame:
    """unit, n, n_violations, fraction: gaps in (censor, refractory] of n - 1."""
    bad = F.count(F.when((F.col("gap") > censor) & (F.col("gap") <= refractory), 1))
    g = gaps(trains).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), bad.alias("n_violations"))
    return g.withColumn("fraction", F.coalesce(share(F.col("n_violations"), F.col("n") - 1), F.lit(0.0)))


def band_percent(trains: DataFrame, floor: int = MINUTE, window: int = HOUR, least: int = 10) -> DataFrame:
    """unit, n, band_pct (gaps in [floor, window)), dup_pct (gaps below floor); null for units of fewer than ``least`` events."""
    g = gaps(trains).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("gap") >= floor) & (F.col("gap") < window), 1)).alias("b"), F.count(F.when(F.col("gap") < floor, 1)).alias("d"))
    pct = lambda c: F.when(F.col("n") >= least, F.round(F.col(c) * 100 / (F.col("n") - 1), 6))
    return g.select("unit", "n", pct("b").alias("band_pct"), pct("d").alias("dup_pct"))


def presence(trains: DataFrame, bins: int = 120) -> DataFrame:
    """unit, presence: the share of ``bins`` equal parts of the whole span in which the unit has an event; the last part is closed."""
    span = trains.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    part = F.least(F.floor((F.col("t") - F.col("t0")) * bins / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))), F.lit(bins - 1))
    return trains.crossJoin(F.broadcast(span)).select("unit", part.alias("part")).groupBy("unit").agg(F.round(F.count_distinct("part") / bins, 6).alias("presence"))


def quality(trains: DataFrame, refractory: int = HOUR, censor: int = MINUTE, bins: int = 120, max_violations: float = 0.01, least_presence: float = 0.5, least_snr: float = 4.0, least: int = 20, reserved: tuple[int, ...] = (0, 1), snr: DataFrame | None = None) -> DataFrame:
    """unit, n, fraction, presence, flags: which limits a unit misses, comma-separated (isi, snr, presence); snr (unit, snr) is checked if it is given. Reserved ids and units of fewer than ``least`` events
    are left out. One pass: gaps and occupied bins come from one aggregate."""
    span = trains.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    part = F.least(F.floor((F.col("t") - F.col("t0")) * bins / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))), F.lit(bins - 1))
    g = gaps(trains.where(~F.col("unit").isin(list(reserved)))).crossJoin(F.broadcast(span))
    bad = F.count(F.when((F.col("gap") > censor) & (F.col("gap") <= refractory), 1))
    q = g.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"), F.count_distinct(part).alias("parts")).where(F.col("n") >= least)
    q = q.select("unit", "n", F.coalesce(share(F.col("bad"), F.col("n") - 1), F.lit(0.0)).alias("fraction"), F.round(F.col("parts") / bins, 6).alias("presence"))
    q = q.withColumn("snr", F.lit(None).cast("double")) if snr is None else q.join(snr, "unit", "left")
    flags = F.concat_ws(",", F.when(F.col("fraction") > max_violations, "isi"), F.when(F.col("snr") < least_snr, "snr"), F.when(F.col("presence") < least_presence, "presence"))
    return q.select("unit", "n", "fraction", "presence", flags.alias("flags"))


def burst(trains: DataFrame, short: int = 3 * HOUR, refractory: int = HOUR, least: int = 10) -> DataFrame:
    """unit, n, burst (share of gaps under ``short``), cv (deviation of gaps by mean), hill_fp (false positives from gaps under ``refractory``, null if there are too many); null up to ``least`` events."""
    g = gaps(trains).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("gap") < short).cast("double")).alias("b"), F.avg(F.col("gap") / 1e6).alias("m"), F.stddev_pop(F.col("gap") / 1e6).alias("sd"),
        F.count(F.when(F.col("gap") < refractory, 1)).alias("rpv"), ((F.max("t") - F.min("t")) / 1e6).alias("dur"),
    )
    q = F.col("rpv") * F.col("dur") / (2 * F.col("n") * F.col("n") * (refractory / 1e6))
    on = F.col("n") > least
    return g.select("unit", "n", F.when(on, F.round("b", 6)).alias("burst"), F.when(on, F.round(F.col("sd") / (F.col("m") + 1e-9), 6)).alias("cv"), F.when(on & (q <= 0.25), F.round(0.5 * (1 - F.sqrt(1 - 4 * q)), 6)).alias("hill_fp"))


def coincidences(trains: DataFrame, refractory: int = HOUR, censor: int = MINUTE) -> DataFrame:
    """a, b (a < b), n: pairs of events of two units with censor < distance <= refractory."""
    return pair_counts(trains, [(censor, refractory)]).where("n0 > 0").select("a", "b", F.col("n0").alias("n"))


def judged(pairs: DataFrame, least: float, limit: float, names: tuple[str, str, str]) -> DataFrame:
    """``pairs`` (n, expected) with a verdict: too few expected, more than ``limit`` of what is expected, or a dip."""
    return pairs.withColumn("verdict", F.when(F.col("expected") < least, names[0]).when(F.col("n") > limit * F.col("expected"), names[1]).otherwise(names[2]))


def powered(trains: DataFrame, width: float, least: float, span: int) -> DataFrame:
    """The events of units that could have ``least`` coincidences in a band of this width with some unit; the others are in no pair that has."""
    n = trains.groupBy("unit").agg(F.count(F.lit(1)).alias("n_unit"))
    top = n.agg(F.max("n_unit").alias("top"))
    able = n.crossJoin(F.broadcast(top)).where(F.lit(width) * F.col("n_unit") * F.col("top") / F.lit(span) >= least - 1e-6)  # one row
    return trains.join(able.select("unit"), "unit", "left_semi")


def refractory_gate(trains: DataFrame, refractory: int = HOUR, censor: int = MINUTE, least: float = 5.0, limit: float = 0.3, names: tuple[str, str, str] = ("abstain", "veto", "allow")) -> DataFrame:
    """a, b, n, expected, verdict of all pairs of units of which ``least`` coincidences are expected, those without any too: veto above ``limit`` of that, else allow. The pairs that aren't listed abstain."""
    width = 2.0 * (refractory - censor)
    span = trains.agg(F.max("t") - F.min("t")).first()[0] or None

    def make(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        expected = rounded(width * c["size_a"] * c["size_b"] / span) if span else np.full(c["n0"].shape, np.nan)
        return {"n": c["n0"], "expected": expected}, expected >= least

    pairs = lag_counts(powered(trains, width, least, span), [lags_of((censor, refractory))], whole=True, make=make, schema="n bigint, expected double")
    return judged(pairs, least, limit, names).select("a", "b", "n", "expected", "verdict")


def split_gate(trains: DataFrame, refractory: int = HOUR, censor: int = MINUTE, least: float = 5.0, limit: float = 0.3) -> DataFrame:
    """The same for parts of what was one cluster: at chance the split is genuine, with a dip spurious."""
    return refractory_gate(trains, refractory, censor, least, limit, ("abstain", "genuine", "spurious"))


def counts_between(trains: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (unit, lo, hi and others) with ``n``, how many events the unit has from lo to hi: the events up to hi less those before lo, both told by one running count over the unit's events and bounds."""
    bounds = F.explode(F.array(F.struct(F.col("lo").alias("t"), F.lit(0).alias("_s")), F.struct(F.col("hi").alias("t"), F.lit(2).alias("_s"))))
    marks = asked.select(*asked.columns, bounds.alias("_m")).select(*asked.columns, F.col("_m.t").alias("t"), F.col("_m._s").alias("_s"))
    both = marks.unionByName(trains.select("unit", "t").withColumn("_s", F.lit(1)), allowMissingColumns=True)
    upto = F.count(F.when(F.col("_s") == 1, 1)).over(Window.partitionBy("unit").orderBy("t", "_s").rowsBetween(Window.unboundedPreceding, 0))
    told = both.withColumn("_n", upto).where("_s <> 1")
    return told.groupBy(*asked.columns).agg((F.max(F.when(F.col("_s") == 2, F.col("_n"))) - F.max(F.when(F.col("_s") == 0, F.col("_n")))).alias("n"))


def overlap_gate(trains: DataFrame, pairs: DataFrame | None = None, refractory: int = HOUR, censor: int = MINUTE, least: float = 5.0, limit: float = 0.3) -> DataFrame:
    """a, b, n_a, n_b, n, expected, verdict of pairs (a, b), all if none are given, on the time that both trains span; pairs apart in time abstain."""
    names = ("abstain", "veto", "allow")
    if pairs is None:

        def make(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], None]:
            length = c["hi"] - c["lo"]
            expected = rounded(np.where(length > 0, 2.0 * (refractory - censor) * c["n_a"] * c["n_b"] / np.maximum(length, 1), 0.0))
            return {"n_a": c["n_a"], "n_b": c["n_b"], "n": c["n0"], "expected": expected}, None

        made = lag_counts(trains, [lags_of((censor, refractory))], shared=True, whole=True, make=make, schema="n_a bigint, n_b bigint, n bigint, expected double")
        return judged(made, least, limit, names)
    else:
        ends = trains.groupBy("unit").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        side = lambda c: ends.select(F.col("unit").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"))
        spans = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", F.greatest("lo_a", "lo_b").alias("lo"), F.least("hi_a", "hi_b").alias("hi"))
        meet = spans.where("hi > lo")
        counts = lambda c: counts_between(trains, meet.withColumn("unit", F.col(c))).select("a", "b", F.col("n").alias(f"n_{c}"))
        n = pair_counts(trains, [(censor, refractory)], shared=True).select("a", "b", F.col("n0").alias("n"))
        rows = spans.join(counts("a"), ["a", "b"], "left").join(counts("b"), ["a", "b"], "left").join(n, ["a", "b"], "left").fillna(0, ["n", "n_a", "n_b"])
    expected = F.when(F.col("hi") > F.col("lo"), F.round(F.lit(2.0 * (refractory - censor)) * F.col("n_a") * F.col("n_b") / (F.col("hi") - F.col("lo")), 6)).otherwise(0.0)
    rows = rows.withColumn("n", F.when(F.col("hi") > F.col("lo"), F.col("n")).otherwise(0))
    return judged(rows.withColumn("expected", expected), least, limit, names).select("a", "b", "n_a", "n_b", "n", "expected", "verdict")


def lag_bands(trains: DataFrame, bands=((0, 1), (1, 2), (2, 6), (6, 12)), unit: int = HOUR) -> DataFrame:
    """a, b, band_0 ...: events of b at a lag of [lo, hi) after or [-hi, -lo) before those of a, by unit of time, of pairs with an event in a band or at the last hi exactly. Lags are whole microseconds.

    A distance of lo * unit counts after, one of hi * unit before."""
    make = lambda c: ({f"band_{k}": rounded_share(c[f"n{k}"], 2 * (hi - lo)) for k, (lo, hi) in enumerate(bands)}, None)
    return lag_counts(trains, [*lags_of_bands(bands, unit), [(bands[-1][1] * unit,) * 2]], make=make, schema=", ".join(f"band_{k} double" for k in range(len(bands))))


def lags_of_bands(bands, unit: int) -> list[list[tuple[int, int]]]:
    return [[(lo * unit, hi * unit - 1), (-hi * unit, -lo * unit - 1)] for lo, hi in bands]


def merge_verdict(trains: DataFrame, unit: int = HOUR, step: int = DAY, least: int = 30) -> DataFrame:
    """a, b, dip (events per unit of time at lags of 2 to 5, by those at 10 to 20), r (of binned counts), verdict of all pairs a < b: SAME? with a dip and rates that don't rise together, distinct? without a dip, else review. Units of
    fewer than ``least`` events are left out."""
    n = trains.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("unit")
    some = trains.join(n, "unit", "left_semi")
    bands = ((2, 5), (10, 20))
    lags = lags_of_bands(bands, unit)

    def run(one: Side, two: Side, alone: bool) -> Iterator[pa.RecordBatch]:
        r = correlations(one, two, alone, step)
        for low, high in groups(one, two, 1):
            found = counted(one, two, (low, high), lags)

            def of(i: int, j: int, low: int = low, found: list[np.ndarray] = found) -> tuple[dict[str, np.ndarray], None]:
                near, far = (rounded_share(n[i - low : j - low], 2 * (hi - lo)) for n, (lo, hi) in zip(found, bands, strict=True))
                return {"dip": rounded(near / (far + 1e-9)), "r": rounded(r[i:j])}, None

            yield from batches_of(one, two, (low, high), alone, of)

    rows = in_squares(some, run, "a bigint, b bigint, dip double, r double")
    verdict = F.when((F.col("dip") < 0.5) & (F.col("r") < 0.2), "SAME?").when(F.col("dip") > 0.8, "distinct?").otherwise("review")
    return rows.select("a", "b", "dip", "r", verdict.alias("verdict"))


def latency(trains: DataFrame, first: str, then: str, window: int = HOUR) -> DataFrame:
    """unit, n, n_after, observed, expected: of the events of kind ``then`` that have one of kind ``first`` strictly before them, how many come within ``window`` (exclusive) of the last; and how
    many would by the rate of ``first`` over its own span. Units with fewer than two of ``first`` are left out."""
    a, b = trains.where(F.col("kind") == then).select("unit", "t"), trains.where(F.col("kind") == first).select("unit", F.col("t").alias("u"))
    hit = last_before(a, b, ["unit"], strict=True).where("u is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("t") - F.col("u") < window, 1)).alias("n_after"))
    rate = b.groupBy("unit").agg(F.count(F.lit(1)).alias("n_first"), (F.max("u") - F.min("u")).alias("span")).where("n_first >= 2")
    expected = 1 - F.exp(-F.col("n_first") * F.lit(float(window)) / F.greatest(F.col("span"), F.lit(1)))
    return hit.join(rate, "unit").select("unit", "n", "n_after", F.round(F.col("n_after") / F.col("n"), 6).alias("observed"), F.round(expected, 6).alias("expected"))


def recovery(trains: DataFrame, edges: list[int], isolated: int, by: str = "kind", least: int = 20) -> DataFrame:
    """``by``, bin, n, ratio: the median amplitude of events whose gap to the one before is in [edge, next edge), by that of isolated ones (no event within ``isolated`` before); bins of fewer than ``least`` events are left
    out, and trains with fewer isolated ones. The last bin is open."""
    w = Window.partitionBy(by).orderBy("t", "event")
    g = trains.select(by, "amp", (F.col("t") - F.lag("t").over(w)).alias("gap"))
    base = g.where(F.col("gap").isNull() | (F.col("gap") > isolated)).groupBy(by).agg(F.median("amp").alias("base"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    part = reduce(lambda e, k: e.when(F.col("gap") >= edges[k], k), reversed(range(len(edges) - 1)), F.when(F.col("gap").isNull() | (F.col("gap") >= edges[-1]), len(edges) - 1))
    rows = g.withColumn("bin", part).where("bin is not null").groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"), F.median("amp").alias("m")).where(F.col("n") >= least)
    return rows.join(base, by).select(by, "bin", "n", F.round(F.col("m") / F.nullif("base", F.lit(0.0)), 6).alias("ratio"))


def union_violations(trains: DataFrame, groups: DataFrame, refractory: int = HOUR) -> DataFrame:
    """group, n, fraction: gaps under the refractory time in the trains of a group (group, unit) taken together."""
    w = Window.partitionBy("group").orderBy("t", "event")
    g = trains.join(groups, "unit").withColumn("gap", F.col("t") - F.lag("t").over(w))
    return g.groupBy("group").agg(F.count(F.lit(1)).alias("n"), share(F.count(F.when(F.col("gap") < refractory, 1)), F.count("gap")).alias("fraction"))


def half_rates(trains: DataFrame) -> DataFrame:
    """unit, n, ratio: of the events in the two halves of a unit's span, the fewer by the more."""
    ends = Window.partitionBy("unit")
    late = F.col("t") * 2 >= F.min("t").over(ends) + F.max("t").over(ends)
    g = trains.select("unit", late.alias("late")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("late"), 1)).alias("b"))
    return g.select("unit", "n", F.round(F.least(F.col("b"), F.col("n") - F.col("b")) / F.greatest(F.col("b"), F.col("n") - F.col("b")), 6).alias("ratio"))


def aligned_labels(found: DataFrame, truth: DataFrame) -> DataFrame:
    """t, found, truth: two labellings (t, label) of events, met by their times."""
    return found.select("t", F.col("label").alias("found")).join(truth.select("t", F.col("label").alias("truth")), "t")


def near_ratio(trains: DataFrame, near: int, far: int) -> DataFrame:
    """a, b, near, far, ratio: coincidences within ``near``, by those that the rate within ``far`` gives for it."""
    p = pair_counts(trains, [(-1, near), (-1, far)])
    return p.select("a", "b", F.col("n0").alias("near"), F.col("n1").alias("far"), F.round(F.col("n0") / F.nullif(F.col("n1") * (near / far), F.lit(0.0)), 6).alias("ratio"))


def episodes(trains: DataFrame, pause: int = DAY) -> DataFrame:
    """unit, episode, n, length: runs of events without a gap over ``pause``."""
    w = Window.partitionBy("unit").orderBy("t", "event")
    e = gaps(trains).withColumn("episode", F.sum((F.coalesce("gap", F.lit(0)) > pause).cast("long")).over(w))
    return e.groupBy("unit", "episode").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("length"))


def local_center(trains: DataFrame, half: int = DAY) -> DataFrame:
    """event, center: the amplitude less the unit's mean from ``half`` before the event to just under ``half`` after it."""
    w = Window.partitionBy("unit").orderBy("t").rangeBetween(-half, half - 1)
    return trains.select("event", F.round(F.col("amp") - F.avg("amp").over(w), 6).alias("center"))


def bimodality(trains: DataFrame, least: int = 12) -> DataFrame:
    """unit, n, coefficient: Sarle's, of the amplitude, with the term for the size of the sample; 0 for fewer than ``least`` events or equal amplitudes."""
    g = trains.groupBy("unit").agg(F.count("amp").alias("n"), F.skewness("amp").alias("g"), F.kurtosis("amp").alias("k"), F.stddev_pop("amp").alias("s"))
    n = F.col("n")
    c = (F.col("g") * F.col("g") + 1) / (F.col("k") + 3 * (n - 1) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))
    return g.select("unit", "n", F.when((n < least) | (F.col("s") < 1e-9), F.lit(0.0)).otherwise(F.round(c, 5)).alias("coefficient"))


def swept(mine: Side, others: Side, out: np.ndarray, alone: bool, turned: bool, step: int) -> bool:
    """``correlations`` of each unit of ``mine`` with all of ``others`` that begin later, where the bins of all ``others`` are few enough to be held; else false. A unit's bins begin at the phase of its first event, so units are taken in
    order of phase: from one to the next only events with a phase between change their bin, to the one before."""
    days = [side.t // step for side in (mine, others)]
    base = int(min(d[0] for d in days)) - 1
    wide, n = int(max(d[-1] for d in days)) - base + 1, len(others.ids)
    if wide * n > min(16 * len(others.t) + 1000, HELD):
        return False
    kind = np.float32 if int(max(mine.size.max(), others.size.max())) ** 2 < 1 << 24 else np.float64  # sums are exact in either
    day, phase = days[1] - base, others.t % step
    order = np.argsort(phase, kind="stable")
    at, code, phase = day[order], others.code[order], phase[order]
    y = np.bincount(day * n + others.code, minlength=wide * n).reshape(wide, n).astype(kind)
    square = (y * y).sum(0, dtype=float)
    last_day, last_phase = others.last // step - base, others.last % step
    sizes = others.size.astype(float)
    first_day, first_phase = mine.first // step - base, mine.first % step
    upto = 0
    for k in np.argsort(first_phase, kind="stable").tolist():
        begin, end, d, p = int(mine.first[k]), int(mine.last[k]), int(first_day[k]), int(first_phase[k])
        to = int(np.searchsorted(phase, p, "left"))
        if to > upto:
            a, c = at[upto:to], code[upto:to]
            np.subtract.at(y, (a, c), 1)
            np.add.at(y, (a - 1, c), 1)
            square[c] = np.einsum("ij,ij->j", some := y[:, c], some, dtype=float)
            upto = to
        later = others.first >= begin if alone or not turned else others.first > begin
        if alone:
            later[k] = False
        x = np.bincount((mine.times(k) - begin) // step + d, minlength=wide).astype(kind)
        product = (x @ y).astype(float)
        bins = np.maximum(last_day - d + (last_phase > p), -(-(end - begin) // step)).astype(float)
        mine_square, total = float((x * x).sum(dtype=float)), float(mine.size[k])
        theirs = square
        # an event at the very end is in the last bin
        full = later & np.where(others.last >= end, last_phase == p, (end - begin) % step == 0) & (bins > 0)
        if full.any():
            f = np.flatnonzero(full)
            place = bins[f].astype(np.int64) + d
            x1, x2, y1, y2 = x[place - 1].astype(float), x[place].astype(float), y[place - 1, f].astype(float), y[place, f].astype(float)
            product[f] += x1 * y2 + x2 * y1
            theirs, mine_square = square.copy(), np.full(n, mine_square)
            theirs[f] += 2 * y1 * y2
            mine_square[f] += 2 * x1 * x2
        vx, vy = mine_square * bins - total * total, theirs * bins - sizes * sizes
        ok = later & (bins >= 4) & (vx > 0) & (vy > 0)
        with np.errstate(all="ignore"):
            r = (product * bins - total * sizes) / np.sqrt(vx * vy)
        if alone:
            j = np.flatnonzero(ok)
            out[np.minimum(k, j), np.maximum(k, j)] = r[j]
        else:
            np.copyto(out[:, k] if turned else out[k], r, where=ok)
    return True


def correlations(one: Side, two: Side, alone: bool, step: int) -> np.ndarray:
    """Of each unit of ``one`` with each of ``two``, the correlation of their counts in bins from the first event of either to the last; nan for fewer than four bins, equal counts, and pairs that aren't a < b of one part.

    A pair's bins begin with the earlier train, so for each unit the bins of all that begin later are counted at once."""
    out = np.full((len(one.ids), len(two.ids)), np.nan)
    for mine, others, turned in ((one, two, False), (two, one, True))[: 1 if alone else 2]:
        if swept(mine, others, out, alone, turned, step):
            continue
        for k in range(len(mine.ids)):
            begin, end = mine.first[k], mine.last[k]
            later = others.first >= begin if alone or not turned else others.first > begin
            if alone:
                later[k] = False
            which = np.flatnonzero(later)
            if not len(which):
                continue
            length = np.maximum(others.last[which], end) - begin
            bins = -(-length // step)
            width = int(bins.max()) + 1
            index, own = np.unique((mine.times(k) - begin) // step, return_counts=True)
            place = np.full(len(others.ids), -1)
            place[which] = np.arange(len(which))
            if len(which) == len(others.ids):
                at, t = others.code, others.t
            else:
                some = later[others.code]
                at, t = place[others.code[some]], others.t[some]
            key = at * width + (t - begin) // step
            n = others.size[which]
            if len(which) * width <= 4 * len(t) + 1000:
                y = np.bincount(key, minlength=len(which) * width).reshape(len(which), width).astype(float)
                # an event at the very end is in the last bin
                full = np.flatnonzero((length % step == 0) & (bins > 0))
                y[full, bins[full] - 1] += y[full, bins[full]]
                y[full, bins[full]] = 0
                x = np.zeros(width)
                x[index] = own
                square, product = np.einsum("ij,ij->i", y, y), y @ x
                mine_square = np.full(len(which), float(x @ x))
                over, under = x[bins[full]], x[bins[full] - 1]
                product[full] += y[full, bins[full] - 1] * over
                mine_square[full] += 2 * under * over
            else:
                last = np.maximum(bins - 1, 0)
                found, count = np.unique(np.minimum(key, at * width + last[at]), return_counts=True)
                row, bin_ = found // width, found % width
                square = np.bincount(row, count.astype(float) ** 2, len(which))
                spot = np.minimum(np.searchsorted(index, bin_), len(index) - 1)
                product = np.bincount(row, np.where(index[spot] == bin_, count * own[spot], 0), len(which))
                mine_square = np.full(len(which), float((own.astype(float) ** 2).sum()))
                for j in np.flatnonzero((length % step == 0) & (bins > 0) & (index[-1] >= bins)):
                    over, under = float(own[-1]), float(own[index == bins[j] - 1].sum())
                    mine_square[j] += 2 * under * over
                    product[j] += float(count[found == j * width + bins[j] - 1].sum()) * over
            m, sx = bins.astype(float), float(own.sum())
            with np.errstate(all="ignore"):
                vx, vy = mine_square * m - sx * sx, square * m - n.astype(float) ** 2
                r = np.where((bins >= 4) & (vx > 0) & (vy > 0), (product * m - sx * n) / np.sqrt(vx * vy), np.nan)
            if alone:
                out[np.minimum(k, which), np.maximum(k, which)] = r
            elif turned:
                out[which, k] = r
            else:
                out[k, which] = r
    return out


def rate_correlation(trains: DataFrame, step: int = DAY, part_events: int | None = None) -> DataFrame:
    """a, b, r of all pairs a < b of units: the correlation of their counts in bins from the first event of either to the last; null for fewer than four bins or counts that are all equal. Units are compared part by part
    (``joins.in_squares``), of about ``part_events`` events."""

    def run(one: Side, two: Side, alone: bool) -> Iterator[pa.RecordBatch]:
        r = correlations(one, two, alone, step)
        yield from batches_of(one, two, (0, len(one.ids)), alone, lambda i, j: ({"r": rounded(r[i:j])}, None))

    return in_squares(trains, run, "a bigint, b bigint, r double", part_events)


def chunks(trains: DataFrame, length: int = DAY, overlap: int = 8 * HOUR) -> DataFrame:
    """event, chunk, core: the chunks whose extent holds each event; core is true for the one that owns it."""
    t0 = trains.agg(F.min("t").alias("t0"))
    k = F.floor((F.col("t") - F.col("t0")) / length)
    e = trains.crossJoin(F.broadcast(t0)).withColumn("k", k).withColumn("chunk", F.explode(F.array(k - 1, k, k + 1)))
    lo = F.col("t0") + F.col("chunk") * length
    return e.where((F.col("chunk") >= 0) & (F.col("t") >= lo - overlap) & (F.col("t") < lo + length + overlap)).select("event", "chunk", (F.col("chunk") == F.col("k")).alias("core"))
