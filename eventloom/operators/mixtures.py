"""Groups of rows as Gaussians, each row in one of them, by turns of assignment and of moments.

A turn gives each row to the component under which it is likeliest, by its weight, centre and covariance, and sums up the moments of each component's rows in
partial sums. So rows stay where they are; only the few models come to the driver and go to the tasks. Components that lose their rows go. How many there are is chosen by the
information criterion of Bayes over a range of numbers to begin with.

Defined results: rows with a null vector are left out. Events are distinct. Ties go to the smaller part. Parts are numbered from 0 by their least event. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import first_and_second, matrix, mean_and_covariance, summed
from .robust import distances
from .storage import written

RIDGE = 1e-6
ROWS = "event bigint, x array<double>, part int, cost double"
Models = list[tuple[float, np.ndarray, np.ndarray]]


def seeds(rows: DataFrame, k: int, seed: int = 0) -> Models:
    """``k`` rows that a hash picks as centres, each with the covariance of all."""
    (whole,) = summed(rows.select(F.lit(0).alias("key"), "x"), first_and_second).collect() or [None]
    if whole is None:
        return []
    cov = mean_and_covariance(whole.n, np.array(whole.v))[1] + RIDGE * np.eye(len(rows.first().x))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "event"), "event").limit(k).collect()
    return [(1 / len(picked), np.array(r.x, float), cov) for r in picked]


def told(rows: DataFrame, models: Models) -> DataFrame:
    """See ROWS: the likeliest component of each row (event, x), and twice the negative logarithm of its likelihood there."""
    known = [(np.linalg.inv(c), m, np.linalg.slogdet(c)[1] + len(m) * log(2 * pi) - 2 * log(w)) for w, m, c in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1))
                cost = np.stack([distances(x, m, p) + c for p, m, c in known], 1)
                part = cost.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32)), pa.array(cost[np.arange(len(x)), part])], ["event", "x", "part", "cost"])

    return rows.select("event", "x").mapInArrow(run, ROWS)


def of_parts(assigned: DataFrame, n: int, least: int) -> Models:
    """The models of the parts of ``least`` rows or more, in their order."""
    sums = summed(assigned.select(F.col("part").alias("key"), "x"), first_and_second).where(F.col("n") >= least).orderBy("key").collect()
    return [(r.n / n, mean, cov + RIDGE * np.eye(len(mean))) for r in sums for mean, cov in [mean_and_covariance(r.n, np.array(r.v))]]


def fitted(rows: DataFrame, k: int, rounds: int = 30, settle: float = 1e-4, seed: int = 0) -> tuple[DataFrame | None, float]:
    """Rows as in ROWS, from ``k`` seeds on, and their criterion of Bayes. Turns end when the total cost falls by less than the share ``settle``."""
    models, last, assigned, n = seeds(rows, k, seed), None, None, rows.count()
    if not models:
        return None, float("inf")
    d = len(models[0][1])
    for _ in range(rounds):
        assigned = written(told(rows, models), "assigned")
        cost = assigned.agg(F.sum("cost")).first()[0]
        if last is not None and last - cost <= settle * abs(last):
            break
        last, models = cost, of_parts(assigned, n, d + 1) or models
    used = assigned.select("part").distinct().count()
    return assigned, cost + (used * (1 + d + d * (d + 1) / 2) - 1) * log(max(n, 2))


def mixture(rows: DataFrame, most: int, rounds: int = 30, seed: int = 0) -> DataFrame:
    """event, part of rows (event, x), for the number of components from 1 to ``most`` that has the least criterion; of equal ones the fewer."""
    own = written(rows.where("event IS NOT NULL AND x IS NOT NULL").select(F.col("event").cast("bigint").alias("event"), F.col("x").cast("array<double>").alias("x")), "vectors")
    best, least = None, float("inf")
    for k in range(1, most + 1):
        found, score = fitted(own, k, rounds, seed=seed)
        if score < least:
            best, least = found, score
    if best is None:
        return own.select("event", F.lit(0).alias("part"))
    names = [r.part for r in best.groupBy("part").agg(F.min("event").alias("first")).orderBy("first").collect()]
    return best.select("event", F.array_position(F.array(*map(F.lit, names)), F.col("part")).cast("int").alias("part")).withColumn("part", F.col("part") - 1)
