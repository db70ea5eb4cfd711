"""Templates, and their likeness, of waveforms (event, cluster, w)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cosine, dot, norm, peak_to_peak, rms_difference
from .joins import mutual_best
from .moments import matrix
from .storage import written

#: Models that a task holds at a time.
BLOCK = 1024


def templates(waves: DataFrame) -> DataFrame:
    """cluster, n, w: the mean waveform. Means are taken by element, before the arrays are put together, so partial sums are small."""
    long = waves.select("cluster", F.posexplode("w").alias("k", "x"))
    mean = long.groupBy("cluster", "k").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("w"))


def likeness(templates: DataFrame) -> DataFrame:
    """a, b (a < b), cosine, rms of pairs of templates; there are as many templates as clusters."""
    a, b = templates.select(F.col("cluster").alias("a"), F.col("w").alias("v")), templates.select(F.col("cluster").alias("b"), "w")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("v"), F.col("w")), 6).alias("cosine"), F.round(rms_difference(F.col("v"), F.col("w")), 6).alias("rms"))


def mutual_pairs(templates: DataFrame) -> DataFrame:
    """a, b, cosine of templates that are each other's most alike."""
    pairs = likeness(templates).select("a", "b", "cosine")
    both = pairs.union(pairs.select("b", "a", "cosine")).toDF("x", "y", "cosine")
    return mutual_best(both, "x", "y", F.col("cosine")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "cosine")


def dispersion(waves: DataFrame) -> DataFrame:
    """cluster, n, dispersion: mean over elements of the variance about the template; ptp of the template."""
    v = waves.select("cluster", F.posexplode("w").alias("k", "x")).groupBy("cluster", "k").agg(F.var_pop("x").alias("v"), F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return v.groupBy("cluster").agg(F.max("n").alias("n"), F.round(F.avg("v"), 6).alias("dispersion"), F.round(F.max("m") - F.min("m"), 6).alias("ptp"))


def blocks(models: DataFrame, name: str = "cluster", block: int = BLOCK) -> Iterator[list]:
    """The rows of a table of models, ``block`` of them at a time, in the order of ``name``."""
    ids = [r[0] for r in models.where(F.col(name).isNotNull()).select(name).distinct().orderBy(name).toLocalIterator()]
    for i in range(0, len(ids), block):
        yield models.where(F.col(name).between(ids[i], ids[min(i + block, len(ids)) - 1])).orderBy(name).collect()


def against(waves: DataFrame, models: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, list], tuple], schema: str) -> DataFrame | None:
    """event, cluster and what ``kernel(waves, their clusters, models)`` tells of each row, for each block of models: few models are in a task at a time, waves are read once a block, and no pair of both is a row."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    arrow, found = {"bigint": pa.int64(), "double": pa.float64()}, None
    for some in blocks(models):

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    got = kernel(matrix(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False), some)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(g, arrow[k], from_pandas=True) for g, k in zip(got, kinds, strict=True))], ["event", "cluster", *names])

        part = waves.where("w IS NOT NULL").select("event", F.col("cluster").cast("bigint").alias("cluster"), F.col("w").cast("array<double>").alias("w")).mapInArrow(run, f"event bigint, cluster bigint, {schema}")
        found = part if found is None else found.unionByName(part)
    return found


def assigned(waves: DataFrame, templates: DataFrame) -> DataFrame:
    """event, cluster, best, cosine: the most alike template of each waveform, ties to the smaller. A zero waveform has the first template and no cosine; null waveforms and tables without a template give no row."""

    def best(x: np.ndarray, _: np.ndarray, some: list) -> tuple:
        t = np.array([m.w for m in some], float)
        with np.errstate(all="ignore"):
            c = np.round(x @ t.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(t, axis=1)), 6)
        k = np.where(np.isnan(c), -np.inf, c).argmax(1)
        return c[np.arange(len(x)), k], np.array([m.cluster for m in some], np.int64)[k]

    kind = waves.schema["cluster"].dataType
    found = against(waves, written(templates.select("cluster", "w").where("w IS NOT NULL"), "templates"), best, "cosine double, best bigint")
    if found is None:
        return waves.where(F.lit(False)).select("event", "cluster", F.col("cluster").alias("best"), F.lit(None).cast("double").alias("cosine"))
    s = found.groupBy("event", "cluster").agg(F.max(F.struct("cosine", -F.col("best"))).alias("s"))
    return s.select("event", F.col("cluster").cast(kind).alias("cluster"), (-F.col("s")["col2"]).cast(kind).alias("best"), F.col("s.cosine").alias("cosine"))


def shapes(waves: DataFrame) -> DataFrame:
    """event, ptp, peak_at (element of the largest magnitude, from 0)."""
    mag = F.transform("w", lambda x: F.abs(x))
    return waves.select("event", F.round(peak_to_peak(F.col("w")), 6).alias("ptp"), (F.array_position(mag, F.array_max(mag)) - 1).alias("peak_at"))


def by_element(waves: DataFrame, *more) -> DataFrame:
    return waves.select("event", "cluster", *more, F.posexplode("w").alias("k", "x"))


def radii(waves: DataFrame, under: float = 0.8, over: float = 1.25) -> DataFrame:
    """cluster, n, radius (root mean square distance to the template), energy (the template's), verdict: under, like or over, by the ratio to the median radius."""
    v = by_element(waves).groupBy("cluster", "k").agg(F.var_pop("x").alias("v"), F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    r = v.groupBy("cluster").agg(F.max("n").alias("n"), F.sqrt(F.sum("v")).alias("r"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("e"))
    q = r.crossJoin(F.broadcast(r.agg(F.percentile("r", F.lit(0.5)).alias("mid")))).withColumn("q", F.col("r") / F.nullif("mid", F.lit(0.0)))
    verdict = F.when(F.col("q") < under, "under").when(F.col("q") > over, "over").otherwise("like")
    return q.select("cluster", "n", F.round("r", 6).alias("radius"), F.round("e", 6).alias("energy"), verdict.alias("verdict"))


def constancy(radii: DataFrame, least: int = 4) -> DataFrame:
    """n, slope, r2 of the logarithm of the radius by that of the energy; null for fewer than ``least`` clusters."""
    x, y = F.log10("energy"), F.log10("radius")
    s = radii.where("radius > 0 and energy > 0").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"), F.corr(y, x).alias("c"))
    on = F.col("n") >= least
    return s.select("n", F.when(on, F.round("s", 5)).alias("slope"), F.when(on, F.round(F.col("c") * F.col("c"), 5)).alias("r2"))


def top_variance(waves: DataFrame, top: int = 3) -> DataFrame:
    """cluster, variance: the mean of the ``top`` largest variances of elements."""
    v = by_element(waves).groupBy("cluster", "k").agg(F.var_pop("x").alias("v")).groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list("v"), False), 1, top).alias("vs"))
    return v.select("cluster", F.round(F.aggregate("vs", F.lit(0.0), lambda s, x: s + x) / F.size("vs"), 8).alias("variance"))


def half_distance(waves: DataFrame) -> DataFrame:
    """cluster, distance: 1 less the correlation of the templates of the first and the second half of a cluster's events."""
    half = waves.withColumn("half", F.ntile(2).over(Window.partitionBy("cluster").orderBy("event")))
    of = lambda h: F.avg(F.when(F.col("half") == h, F.col("x"))).alias(f"m{h}")
    m = by_element(half, "half").groupBy("cluster", "k").agg(of(1), of(2))
    return m.groupBy("cluster").agg(F.round(1 - F.corr("m1", "m2"), 6).alias("distance"))


def rolled_likeness(templates: DataFrame) -> DataFrame:
    """a, b (a < b), cosine, shift: the best cosine over circular shifts of b to the left; ties go to the smaller shift. There are as many templates as clusters."""
    a, b = templates.select(F.col("cluster").alias("a"), F.col("w").alias("v")), templates.select(F.col("cluster").alias("b"), "w")
    roll = lambda s: F.concat(F.slice("w", s + 1, F.size("w")), F.slice("w", F.lit(1), s))
    score = lambda s: F.struct(F.round(dot(F.col("v"), roll(s)) / F.nullif(norm(F.col("v")) * norm(F.col("w")), F.lit(0.0)), 6).alias("c"), (-s).alias("s"))
    p = a.join(b, F.col("a") < F.col("b")).select("a", "b", F.array_max(F.transform(F.sequence(F.lit(0), F.size("w") - 1), score)).alias("x"))
    return p.select("a", "b", F.col("x.c").alias("cosine"), (-F.col("x.s")).alias("shift"))


def gated(waves: DataFrame, gate: float, floor: float = 1e-12, noise: int = 1) -> DataFrame:
    """event, cluster, d2, label: the squared distance to the own cluster's template by its variances; beyond ``gate`` the label is the nearest other cluster's inside it, else ``noise``. Models go to the tasks in blocks."""
    v = by_element(waves).groupBy("cluster", "k").agg(F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(floor)).alias("v"))
    model = v.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "m", "v"))).alias("p")).select(F.col("cluster").alias("other"), "p")
    def told(x: np.ndarray, own: np.ndarray, some: list) -> tuple:
        d = np.stack([np.round(((x - [q.m for q in m.p]) ** 2 / [q.v for q in m.p]).sum(1), 4) for m in some], 1)
        ids = np.array([m.other for m in some])
        mine = ids[None, :] == own[:, None]
        far = np.where(mine | (d > gate), np.inf, d)
        k = far.argmin(1)
        near = far[np.arange(len(x)), k]
        there = np.isfinite(near)
        return np.where(mine.any(1), np.where(mine, d, 0).sum(1), np.nan), np.where(there, near, np.nan), np.where(there, ids[k], -1)

    kind = waves.schema["cluster"].dataType
    found = against(waves, written(model.select(F.col("other").alias("cluster"), "other", "p"), "models"), told, "own double, near double, other bigint")
    if found is None:
        return waves.where(F.lit(False)).select("event", "cluster", F.lit(None).cast("double").alias("d2"), F.col("cluster").alias("label"))
    s = found.groupBy("event", "cluster").agg(F.max("own").alias("d2"), F.min(F.when(F.col("near").isNotNull(), F.struct("near", "other"))).alias("near"))
    out = s.select("event", F.col("cluster").cast(kind).alias("cluster"), "d2", F.when(F.col("d2") <= gate, F.col("cluster")).otherwise(F.coalesce("near.other", F.lit(noise))).alias("label"))
    return out.withColumn("label", F.col("label").cast(kind))
