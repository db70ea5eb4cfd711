"""Events that don't belong to their cluster, by distances that those events can't spoil.

A covariance of all rows is widened by the very outliers that it should show. The minimum covariance determinant takes the centre and covariance of a core of the rows,
those nearest to it, in concentration steps: distances by the model, the nearest share of each cluster as its core, the model of the core. A step is one pass over all clusters at once:
the core's limit is read off counts by bins of the logarithm of the distance (``BINS`` a factor of e, so it is a share to within a bin), and the model is
a sum of moments. No cluster is gathered. The first model is of medians. At the end, as usual, the covariance is set to scale by the median distance,
rows within the 97.5 % of the chi-square distribution make the last model, and it is shrunk towards its diagonal.

Defined results: rows with a null cluster or vector are left out. Clusters with fewer rows than ``least``, or than twice the dimensions, have no model; their rows are
kept as they are, with a null distance. A cluster of equal rows has no spread but the ridge, so nothing but those rows is within. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import chi2_quantile
from .moments import first_and_second, matrix, mean_and_covariance, summed
from .storage import written

BINS = 64
RIDGE = 1e-6
#: Models that are held in a task to find the nearest one.
BLOCK = 256
#: Bytes of models that go to the tasks with the plan.
SENT = 32_000_000
MODEL = "cluster bigint, n bigint, centre array<double>, precision array<double>, logdet double"


def distances(x: np.ndarray, centre: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Squared, of rows to one centre or each to its own."""
    d = x - centre
    return np.einsum("ij,ij->i", d @ precision if precision.ndim == 2 else np.einsum("ij,ijk->ik", d, precision), d)


def measured(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` (event, cluster, x) that have a model, with ``d2`` and its bin. Models of ``SENT`` bytes together are sent to the tasks; more are joined to the rows."""
    out = "event bigint, cluster bigint, x array<double>, d2 double, bin int"

    def told(batch: pa.RecordBatch, x: np.ndarray, d2: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(d2), pa.array(np.floor(np.log(np.maximum(d2, 1e-30)) * BINS).astype(np.int32))], ["event", "cluster", "x", "d2", "bin"])

    if (models.agg(F.sum(8 * (F.size("precision") + F.size("centre")))).first()[0] or 0) <= SENT:
        known = {m.cluster: (np.array(m.centre), np.array(m.precision).reshape(len(m.centre), -1)) for m in models.collect()}

        def by_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(1).to_numpy()
                batch = batch.filter(pa.array(np.isin(key, list(known))))
                if not len(batch):
                    continue
                x, key, d2 = matrix(batch.column(2)), batch.column(1).to_numpy(), np.empty(len(batch))
                for k in np.unique(key).tolist():
                    d2[key == k] = distances(x[key == k], *known[k])
                yield told(batch, x, d2)

        return rows.where("cluster IS NOT NULL").select("event", "cluster", "x").mapInArrow(by_known, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, centre = matrix(batch.column(2)), matrix(batch.column(3))
                yield told(batch, x, distances(x, centre, matrix(batch.column(4)).reshape(len(x), x.shape[1], -1)))

    return rows.join(models.select("cluster", "centre", "precision"), "cluster").select("event", "cluster", "x", "centre", "precision").mapInArrow(run, out)


def limits(told: DataFrame, share: float) -> DataFrame:
    """cluster, bin: the least bin that ``share`` of the cluster's rows don't go beyond."""
    n = told.groupBy("cluster", "bin").agg(F.count(F.lit(1)).alias("n"))
    run, whole = Window.partitionBy("cluster").orderBy("bin"), Window.partitionBy("cluster")
    return n.select("cluster", "bin", F.sum("n").over(run).alias("upto"), F.sum("n").over(whole).alias("all")).where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("cluster").agg(F.min("bin").alias("limit"))


def models_of(rows: DataFrame, shrink: float = 0.0, scale: DataFrame | None = None) -> DataFrame:
    """See MODEL: those of rows (cluster, x); covariances times ``scale`` (cluster, factor), if there is one."""
    sums = summed(rows.select(F.col("cluster").alias("key"), "x"), first_and_second)
    sums = sums.join(scale.withColumnRenamed("cluster", "key"), "key", "left") if scale is not None else sums.withColumn("factor", F.lit(1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, n, v, factor in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                mean, cov = mean_and_covariance(n, np.array(v))
                cov = cov * (factor or 1.0)
                cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + RIDGE * np.eye(len(cov))
                out.append((key, n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [f.split()[0] for f in MODEL.split(", ")])

    return sums.select("key", "n", "v", "factor").mapInArrow(run, MODEL)


def by_medians(rows: DataFrame) -> DataFrame:
    """See MODEL: medians, and 1.4826 times the median distances from them, squared, as variances."""
    each = rows.select("cluster", F.posexplode("x").alias("at", "v"))
    mid = each.groupBy("cluster", "at").agg(F.percentile_approx("v", 0.5, 10_000).alias("m"), F.count(F.lit(1)).alias("n"))
    off = each.join(mid, ["cluster", "at"]).groupBy("cluster", "at").agg(F.first("m").alias("m"), F.first("n").alias("n"), F.percentile_approx(F.abs(F.col("v") - F.col("m")), 0.5, 10_000).alias("s"))
    s = off.groupBy("cluster").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "m", "s"))).alias("s"))
    var = lambda x: (F.lit(1.4826) * x) ** 2 + RIDGE
    size = F.size("s")
    flat = F.flatten(F.transform("s", lambda p: F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.when(k == p["at"], 1 / var(p["s"])).otherwise(0.0))))
    return s.select("cluster", "n", F.col("s.m").alias("centre"), flat.alias("precision"), F.aggregate("s", F.lit(0.0), lambda a, p: a + F.log(var(p["s"]))).alias("logdet"))


def robust_models(rows: DataFrame, share: float = 0.75, shrink: float = 0.1, least: int = 50, steps: int = 20, settle: float = 1e-6) -> DataFrame:
    """See MODEL, for rows (event, cluster, x): the minimum covariance determinant of ``share`` of each cluster."""
    own = rows.where("cluster IS NOT NULL AND x IS NOT NULL").select("event", F.col("cluster").cast("bigint").alias("cluster"), F.col("x").cast("array<double>").alias("x"))
    enough = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).where((F.col("n") >= least) & (F.col("n") >= 2 * F.col("d")))
    own = written(own.join(enough.select("cluster", "d"), "cluster"), "vectors")
    size = own.agg(F.max("d")).first()[0]
    own = own.drop("d")
    models = written(by_medians(own), "models")
    if size is None:
        return models
    half = chi2_quantile(0.5, size)
    for _ in range(steps):
        told = written(measured(own, models), "distances")
        core = told.join(limits(told, share), "cluster").where("bin <= limit")
        now = written(models_of(core), "models")
        change = now.join(models.select("cluster", F.col("logdet").alias("_o")), "cluster").agg(F.max(F.abs(F.col("logdet") - F.col("_o")))).first()[0]
        models = now
        if change is None or change <= settle:
            break
    told = written(measured(own, models), "distances")
    # the core is tighter than the cluster: distances are set by their median
    scale = limits(told, 0.5).select("cluster", (F.exp((F.col("limit") + 0.5) / BINS) / half).alias("factor"))
    near = told.join(scale, "cluster").where(F.col("d2") / F.greatest("factor", F.lit(1e-12)) < chi2_quantile(0.975, size))
    return written(models_of(near.select("cluster", "x"), shrink), "models")


def nearest(rows: DataFrame, models: DataFrame, block: int = BLOCK) -> DataFrame:
    """event, other, other_d2: the nearest model of each of rows (event, x). Models come to the tasks ``block`` at a time, so rows are read once for each such set and no pair of row and model is a row."""
    ids = [r.cluster for r in models.select("cluster").orderBy("cluster").toLocalIterator()]
    found = None
    for i in range(0, len(ids), block):
        some = models.where(F.col("cluster").between(ids[i], ids[min(i + block, len(ids)) - 1])).orderBy("cluster").collect()
        centres, precisions = np.array([m.centre for m in some]), np.array([m.precision for m in some]).reshape(len(some), len(some[0].centre), -1)

        def run(batches: Iterator[pa.RecordBatch], centres=centres, precisions=precisions, names=tuple(m.cluster for m in some)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = matrix(batch.column(1))
                    d2 = np.stack([distances(x, c, p) for c, p in zip(centres, precisions, strict=True)])
                    best = d2.argmin(0)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(names, np.int64)[best]), pa.array(d2[best, np.arange(len(x))])], ["event", "other", "other_d2"])

        part = rows.select("event", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "event bigint, other bigint, other_d2 double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("event", F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("double").alias("other_d2")).where(F.lit(False))
    best = found.groupBy("event").agg(F.min(F.struct("other_d2", "other")).alias("m"))
    return best.select("event", F.col("m.other").alias("other"), F.col("m.other_d2").alias("other_d2"))


def rejected(rows: DataFrame, share: float = 0.75, p: float = 0.9999, shrink: float = 0.1, least: int = 50, noise: int = 1, reassign: bool = True, steps: int = 20) -> DataFrame:
    """event, cluster, d2, outlier, label for rows (event, cluster, x), an event id being a row's own. An outlier is beyond the chi-square quantile ``p`` of its cluster's model; its label is the cluster of
    the nearest model, if that is another one and holds it within the gate, else ``noise``. Clusters 0 and ``noise`` have no model, nor have small ones; their rows keep their label."""
    own = rows.where("cluster IS NOT NULL AND x IS NOT NULL").select("event", F.col("cluster").cast("bigint").alias("cluster"), "x")
    models = robust_models(own.where((F.col("cluster") > 1) & (F.col("cluster") != noise)), share, shrink, least, steps)
    told = written(measured(own, models), "distances")
    size = told.agg(F.max(F.size("x"))).first()[0]
    gate = chi2_quantile(p, size) if size else 0.0
    out = told.where(F.col("d2") > gate)
    to = nearest(out, models) if reassign else out.select("event", F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("double").alias("other_d2"))
    gone = out.join(to, "event", "left").select("event", F.when((F.col("other") != F.col("cluster")) & (F.col("other_d2") <= gate), F.col("other")).otherwise(F.lit(noise).cast("bigint")).alias("label"))
    rest = own.select("event", "cluster").join(told.select("event", "d2"), "event", "left").join(gone, "event", "left")
    return rest.select("event", "cluster", "d2", F.coalesce(F.col("d2") > gate, F.lit(False)).alias("outlier"), F.coalesce("label", "cluster").alias("label"))
