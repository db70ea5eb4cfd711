"""Tables of bundles: see ``functions/bundles.py``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Curves of a fiber in a part, about.
PART = 4096


def drifts_of(curves: DataFrame, features: int) -> DataFrame:
    """gid, drift of curves (gid, chunk, curve), as ``functions.bundles.drift``: frames are of sums of products by fiber, and distances of last points are added up by pairs of parts of ``PART`` curves."""
    f = features
    curves = curves.select(F.col("gid").cast("bigint").alias("gid"), "chunk", F.col("curve").cast("array<double>").alias("curve"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for curve in b.column("curve").to_pylist():
                x = np.array(curve, float).reshape(-1, f)
                rows.append(np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
            ids, at = np.unique(b.column("gid").to_numpy(), return_inverse=True)
            if len(ids):
                v = np.zeros((len(ids), 1 + f + f * f))
                np.add.at(v, at, np.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, v.shape[1])), pa.array(np.tile(np.arange(v.shape[1]), len(ids)), pa.int32()), pa.array(v.ravel())], ["gid", "k", "v"])

    added = curves.select("gid", "curve").mapInArrow(sums, "gid bigint, k int, v double").groupBy("gid", "k").agg(F.sum("v").alias("v"))
    whole = added.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("m")).select("gid", F.col("m.v").alias("m"))
    n = curves.groupBy("gid").agg(F.count(F.lit(1)).alias("curves"))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            tips, length = [], []
            for gid, curve, m in zip(b.column("gid").to_pylist(), b.column("curve").to_pylist(), b.column("m"), strict=True):
                if gid not in frames:
                    if len(frames) >= 1024:
                        frames.clear()
                    v = np.array(m.as_py())
                    mean = v[1 : 1 + f] / v[0]
                    frames[gid] = mean, np.linalg.eigh(v[1 + f :].reshape(f, f) - v[0] * np.outer(mean, mean))[1][:, ::-1][:, :3]
                mean, directions = frames[gid]
                x = (np.array(curve, float).reshape(-1, f) - mean) @ directions
                tips.append(x[-1].tolist())
                length.append(float(np.linalg.norm(np.diff(x, axis=0), axis=1).sum()))
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("chunk"), b.column("curves"), pa.array(tips, pa.list_(pa.float64())), pa.array(length, pa.float64())], ["gid", "chunk", "curves", "tip", "length"])

    ends = written(curves.join(whole, "gid").join(n, "gid").select("gid", F.col("chunk").cast("string").alias("chunk"), "curves", "curve", "m").mapInArrow(shown, "gid bigint, chunk string, curves bigint, tip array<double>, length double"), "tips")
    parts = F.ceil(F.col("curves") / PART).cast("int")
    own = ends.withColumn("own", F.pmod(F.xxhash64("chunk", "tip"), parts).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = own.select("gid", "own", F.least("own", "k").alias("p"), F.greatest("own", "k").alias("q"), "tip")

    def square(part: pa.Table) -> pa.Table:
        x, mine = np.array(part.column("tip").to_pylist(), float), part.column("own").to_numpy()
        p, q = part.column("p")[0].as_py(), part.column("q")[0].as_py()
        one, two, total = x[mine == p], x[mine == q], 0.0
        for i in range(0, len(one), 256):
            total += float(np.linalg.norm(one[i : i + 256, None] - two[None], axis=2).sum())
        # of one part, each pair was met from both its ends
        return pa.table({"gid": part.column("gid").slice(0, 1), "total": [total / 2 if p == q else total]})

    totals = dealt.groupBy("gid", "p", "q").applyInArrow(square, "gid bigint, total double").groupBy("gid").agg(F.sum("total").alias("total"))
    means = ends.groupBy("gid").agg(F.avg("length").alias("length"), F.first("curves").alias("curves"))
    apart = F.col("total") / (F.col("curves") * (F.col("curves") - 1) / 2)
    return means.join(totals, "gid", "left").select("gid", F.when(F.col("curves") < 2, 0.0).otherwise(apart / (F.col("length") + 1e-12)).alias("drift"))


def bundle_table(curves: DataFrame, features: int) -> DataFrame:
    """id, n, nchunks, t0, t1, drift, mean_bend, mean_r_cv of each fiber, the one that drifts most first, from curves: gid, chunk, t, n, curve (points x features, flat), and if there, bend and r_cv.

    Counts and times are aggregated, and no fiber's curves come together in a task (``drifts_of``). Fibers without curves don't show."""
    more = [c if c in curves.columns else None for c in ("bend", "r_cv")]
    means = [(F.avg(c) if c else F.lit(None).cast("double")).alias(f"mean_{k}") for c, k in zip(more, ("bend", "r_cv"), strict=True)]
    kept = curves.where("gid is not null and size(curve) > 0")
    sums = kept.groupBy("gid").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("nchunks"), F.min("t").alias("t0"), F.max("t").alias("t1"), *means)

    drifts = drifts_of(kept, features)
    return sums.join(drifts, "gid").select(F.col("gid").alias("id"), "n", "nchunks", "t0", "t1", "drift", "mean_bend", "mean_r_cv").orderBy(F.desc("drift"), "id")
