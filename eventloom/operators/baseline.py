"""What the noise of a signal is like, from its stretches without events, and the transform that makes it white.

A signal is a table of blocks (chunk, t0, samples): samples is an array of arrays, one for each time, of a value for each channel. Windows are cut from each block; those that an event's guard
zone touches are left out by an anti-join on buckets of time. What is left is summed up to means and covariances chunk by chunk (``moments``), so neither a block
nor a chunk is gathered. The covariance is shrunk towards a multiple of the identity by as much as its own sampling error tells (Ledoit and Wolf).

Defined results: rows with a null chunk or t0 are left out; a window with a null value is too. Events with a null time guard nothing. A chunk without a free window has no row. Windows lie
inside a block: its last samples that fill no window are not used. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import mean_and_covariance, summed
from .storage import written

WINDOW, GUARD = 32, 24
WHITENER = "chunk bigint, n bigint, shrinkage double, mean array<double>, covariance array<double>, whitener array<double>"


def windows(signal: DataFrame, length: int = WINDOW, stride: int | None = None) -> DataFrame:
    """chunk, start, x: the windows of each block, ``stride`` apart (``length``, so that none overlap); x is sample by sample."""
    step = stride or length
    at = F.explode(F.sequence(F.lit(0), F.size("samples") - length, F.lit(step)))
    cut = signal.where((F.size("samples") >= length) & F.col("chunk").isNotNull() & F.col("t0").isNotNull()).select("chunk", "t0", "samples", at.alias("_at"))
    x = F.transform(F.flatten(F.slice("samples", F.col("_at") + 1, length)), lambda v: v.cast("double"))
    return cut.select("chunk", (F.col("t0") + F.col("_at")).alias("start"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull()))


def quiet(found: DataFrame, events: DataFrame, length: int = WINDOW, guard: int = GUARD) -> DataFrame:
    """The windows (chunk, start, x) without an event (chunk, t) from ``guard`` before them to ``guard`` after.

    A window and what may disturb it are in the same bucket of ``length + 2 * guard``, or in the next one: windows are told by two buckets and the event by one. Only starts take part in the join, not
    the samples."""
    wide = length + 2 * guard + 1
    low = F.col("start") - guard
    spots = found.select("chunk", "start").distinct().withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(low / wide), F.floor((F.col("start") + length + guard) / wide)))))
    hits = events.where("t IS NOT NULL").select("chunk", "t", F.floor(F.col("t") / wide).alias("_k"))
    disturbed = spots.join(hits, ["chunk", "_k"]).where((F.col("t") >= low) & (F.col("t") <= F.col("start") + length + guard)).select("chunk", "start").distinct()
    return found.join(disturbed, ["chunk", "start"], "left_anti")


def taken(found: DataFrame, share: float = 1.0, seed: int = 0) -> DataFrame:
    """About ``share`` of the windows, chosen by a hash of chunk and start; all unless it is less than 1."""
    return found if share >= 1 else found.where(F.pmod(F.xxhash64(F.lit(seed), "chunk", "start"), F.lit(1_000_000)) < int(share * 1_000_000))


def covariances(found: DataFrame) -> DataFrame:
    """chunk, n, mean, covariance, spread from windows (chunk, start, x): spread is the mean fourth power of a window's distance from the mean, which the shrinkage needs. Two passes, the second from the mean."""
    rows = written(found.select(F.col("chunk").cast("bigint").alias("key"), "x"), "quiet")
    means = summed(rows, lambda x, _: x.sum(0)).select("key", F.transform("v", lambda v: v / F.col("n")).alias("mean"))
    far = rows.join(means, "key")

    def sums(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        mean = np.asarray(batch.column(2).slice(0, 1).to_pylist()[0])
        d = x - mean
        return np.r_[d.sum(0), (d.T @ d).ravel(), ((d**2).sum(1) ** 2).sum()]

    second = summed(far, sums, "mean")
    return second.join(means, "key").select(F.col("key").alias("chunk"), "n", "mean", F.slice("v", F.lit(1), F.size("v") - 1).alias("v"), (F.element_at("v", -1) / F.col("n")).alias("spread"))


def shrunk(n: int, cov: np.ndarray, spread: float) -> tuple[float, np.ndarray]:
    """The share of the identity's multiple, and the mixture. ``spread``: see ``covariances``."""
    p = len(cov)
    mu = np.trace(cov) / p
    square = (cov**2).sum()
    apart = (square - 2 * mu * np.trace(cov) + p * mu * mu) / p
    error = min((spread - square) / (p * n), apart)
    share = 0.0 if error <= 0 or apart == 0 else error / apart
    return share, (1 - share) * cov + share * mu * np.eye(p)


def whiteners(found: DataFrame, floor: float = 1e-9) -> DataFrame:
    """See WHITENER, for windows (chunk, start, x): the symmetric inverse root of the shrunk covariance; matrices are row by row. Windows less the mean, times it, are white."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, n, mean, v, spread in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                share, cov = shrunk(n, mean_and_covariance(n, np.array(v))[1], spread)
                values, vectors = np.linalg.eigh(cov)
                root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, floor))) @ vectors.T
                out.append((chunk, n, share, mean, cov.ravel().tolist(), root.ravel().tolist()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [f.split()[0] for f in WHITENER.split(", ")])

    return covariances(found).select("chunk", "n", "mean", "v", "spread").mapInArrow(run, WHITENER)


def baseline(signal: DataFrame, events: DataFrame, length: int = WINDOW, guard: int = GUARD, stride: int | None = None, share: float = 1.0) -> DataFrame:
    """See WHITENER: the noise of each chunk of a signal with events (chunk, t)."""
    return whiteners(taken(quiet(windows(signal, length, stride), events, length, guard), share))


def whitened(waves: DataFrame, models: DataFrame) -> DataFrame:
    """``waves`` (chunk, event, x) with x less the chunk's mean, times its whitener. Chunks without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mean, root = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            got = []
            for chunk, x, m, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if chunk != last:
                    last, mean = chunk, np.array(m.as_py())
                    root = np.array(w.as_py()).reshape(len(mean), -1)
                got.append(((np.array(x) - mean) @ root).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.float64()))], ["chunk", "event", "x"])

    return waves.join(models.select("chunk", "mean", "whitener"), "chunk").select(F.col("chunk").cast("bigint").alias("chunk"), "event", F.col("x").cast("array<double>").alias("x"), "mean", "whitener").mapInArrow(run, "chunk bigint, event bigint, x array<double>")
