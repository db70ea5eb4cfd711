"""The direction of a cluster's waveforms as a curve over their norm, and events dealt to the nearest curve.

A curve is a local linear regression at GRID norms. It needs weighted sums alone, so each Arrow batch gives its sums and those are added up:
a cluster's waveforms never come together in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import norm

#: Points of a curve; bandwidth as a share of the range of norms, widened at most WIDER - 1 times by WIDEN until weights sum to SUPPORT.
GRID, BAND, WIDEN, WIDER, SUPPORT = 40, 0.10, 1.6, 6, 12.0
NARROW = 1e-6


def kernel(r: np.ndarray, at: np.ndarray, width: np.ndarray | float) -> np.ndarray:
    return np.exp(-0.5 * ((r[:, None] - at[None, :]) / width) ** 2)


def by_cluster(parts: Iterator[pd.DataFrame], known: dict) -> Iterator[tuple]:
    for part in parts:
        for cluster, rows in part.groupby("cluster", sort=False):
            if cluster in known:
                x = np.stack(rows["w"].to_list()).astype(float)
                r = np.linalg.norm(x, axis=1)
                yield cluster, r, x / r[:, None], known[cluster]


def fit(waves: DataFrame) -> DataFrame:
    """cluster, at (GRID norms), direction (a unit vector for each, one after another) of waveforms (event, cluster, w) of one length.

    Null and zero waveforms are left out. A cluster whose norms are all but equal has its mean direction everywhere. Clusters are few.
    """
    x = waves.where("cluster is not null and w is not null").select("cluster", "w").where(norm(F.col("w")) > 0)
    ends = {row.cluster: (row.p[0], row.p[1]) for row in x.groupBy("cluster").agg(F.percentile(norm(F.col("w")), [0.01, 0.99]).alias("p")).collect()}
    grid = {c: (np.linspace(lo, hi, GRID), max(hi - lo, NARROW)) for c, (lo, hi) in ends.items()}

    def support(parts):
        for cluster, r, _, (at, span) in by_cluster(parts, grid):
            for k in range(WIDER):
                yield pd.DataFrame({"cluster": cluster, "i": np.arange(GRID), "k": k, "s": kernel(r, at, BAND * span * WIDEN**k).sum(axis=0)})

    def merged(rows):
        """One frame for each batch's rows."""
        def run(parts):
            for part in parts:
                if found := list(rows(iter([part]))):
                    yield pd.concat(found)
        return run

    kind = x.schema["cluster"].dataType.simpleString()
    got = x.mapInPandas(merged(support), f"cluster {kind}, i int, k int, s double").groupBy("cluster", "i", "k").agg(F.sum("s").alias("s")).where((F.col("s") >= SUPPORT) | (F.col("k") == WIDER - 1))
    step = {(row.cluster, row.i): row.k for row in got.groupBy("cluster", "i").agg(F.min("k").alias("k")).collect()}
    chosen = {c: (at, span, np.array([BAND * span * WIDEN ** step[c, i] for i in range(GRID)])) for c, (at, span) in grid.items()}

    def sums(parts):
        for cluster, r, d, (at, span, width) in by_cluster(parts, chosen):
            w = np.ones((len(r), GRID)) if span <= NARROW else kernel(r, at, width)
            dr = r[:, None] - at[None, :]
            rows = np.c_[w.sum(0), (w * dr).sum(0), (w * dr * dr).sum(0), w.T @ d, (w * dr).T @ d]
            yield pd.DataFrame({"cluster": cluster, "i": np.repeat(np.arange(GRID), rows.shape[1]), "j": np.tile(np.arange(rows.shape[1]), GRID), "s": rows.ravel()})

    total = x.mapInPandas(merged(sums), f"cluster {kind}, i int, j int, s double").groupBy("cluster", "i", "j").agg(F.sum("s").alias("s"))
    packed = total.groupBy("cluster", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda v: v["s"]).alias("s"))

    def point(parts):
        for part in parts:
            out = []
            for cluster, i, s in part.itertuples(index=False):
                s, at, span = np.asarray(s), *grid[cluster]
                n = (len(s) - 3) // 2
                det, plain, slope = s[0] * s[2] - s[1] * s[1], s[3 : 3 + n], s[3 + n :]
                a = plain if abs(det) < 1e-9 or span <= NARROW else (s[2] * plain - s[1] * slope) / det
                size = np.linalg.norm(a)
                out.append((cluster, i, at[i], list(a / size if size > 1e-9 else plain / max(np.linalg.norm(plain), 1e-9))))
            yield pd.DataFrame(out, columns=["cluster", "i", "at", "d"])

    points = packed.select("cluster", "i", "s").mapInPandas(point, f"cluster {kind}, i int, at double, d array<double>")
    rows = points.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "at", "d"))).alias("p"))
    return rows.select("cluster", F.transform("p", lambda v: v["at"]).alias("at"), F.flatten(F.transform("p", lambda v: v["d"])).alias("direction"))


def predicted(at: np.ndarray, direction: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Unit directions at norms r: linear between points, the ends' beyond them."""
    i = np.clip(np.searchsorted(at, r) - 1, 0, len(at) - 2)
    f = np.clip((r - at[i]) / np.maximum(at[i + 1] - at[i], 1e-12), 0, 1)[:, None]
    d = (1 - f) * direction[i] + f * direction[i + 1]
    return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)


def nearest(waves: DataFrame, curves: DataFrame) -> DataFrame:
    """event, cluster, best, residual, posterior: the curve whose prediction at the waveform's norm is nearest; ties go to the smaller cluster. Curves are as few as clusters and are sent to all tasks."""
    known = [(row.cluster, np.array(row.at), np.array(row.direction).reshape(len(row.at), -1)) for row in curves.orderBy("cluster").collect()]
    kind = waves.schema["cluster"].dataType.simpleString()

    def run(parts):
        for part in parts:
            part = part[part["w"].notna()]
            if not len(part) or not known:
                continue
            x = np.stack(part["w"].to_list()).astype(float)
            r = np.linalg.norm(x, axis=1)
            res = np.stack([np.linalg.norm(x - r[:, None] * predicted(at, d, r), axis=1) for _, at, d in known], axis=1)
            low = res.min(axis=1)
            p = np.exp(-(res**2 - low[:, None] ** 2) / (2 * x.shape[1]))
            yield pd.DataFrame({"event": part["event"], "cluster": part["cluster"], "best": [known[k][0] for k in res.argmin(axis=1)], "residual": low, "posterior": p.max(axis=1) / p.sum(axis=1)})

    return waves.select("event", "cluster", "w").mapInPandas(run, f"event bigint, cluster {kind}, best {kind}, residual double, posterior double")
