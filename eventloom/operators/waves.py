"""Kernels over waveforms as DataFrame operators: (event, cluster, w), w an array of samples x channels, sample by sample.

What needs one event at a time runs in Arrow batches. What needs a whole cluster (its median, curve, or split) takes the cluster's rows in one Arrow group: a cluster of one chunk of a
session, which the length of chunks bounds. Add the chunk to ``cluster`` or ``keys`` for longer sessions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clusters, shapes, transforms

NUMPY = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<smallint>": pa.list_(pa.int16()), "array<bigint>": pa.list_(pa.int64())}


def column(values, kind: str) -> pa.Array:
    """An Arrow column; rows of a matrix are lists, nan is null."""
    x = np.asarray(values) if not kind.startswith("array") else values
    if kind.startswith("array"):
        return pa.array([np.asarray(v).ravel().tolist() for v in x], NUMPY[kind])
    return pa.array(x.tolist(), NUMPY[kind], from_pandas=True)


def cube(col: pa.ChunkedArray | pa.Array, samples: int, channels: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), samples, channels)


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 1)) for x in schema.split(", ")]


def by_event(waves: DataFrame, samples: int, channels: int, kernel: Callable, schema: str) -> DataFrame:
    """event and the columns of ``kernel(waves of a batch)``, a mapping by name."""
    out = fields(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = kernel(cube(batch.column(1), samples, channels))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(column(got[n], t) for n, t in out)], ["event", *(n for n, _ in out)])

    return waves.select("event", "w").mapInArrow(run, f"event bigint, {schema}")


def by_cluster(waves: DataFrame, samples: int, channels: int, kernel: Callable, schema: str) -> DataFrame:
    """cluster and the one row of ``kernel(waves, events)`` for each cluster, events in order."""
    out = fields(schema)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("event")
        got = kernel(cube(part.column("w"), samples, channels), part.column("event").to_numpy())
        return pa.table({"cluster": part.column("cluster").slice(0, 1).cast(pa.int64()), **{n: column([got[n]], t) for n, t in out}})

    return waves.select(F.col("cluster").cast("bigint").alias("cluster"), "event", "w").groupBy("cluster").applyInArrow(run, f"cluster bigint, {schema}")


def relabelled(waves: DataFrame, samples: int, channels: int, kernel: Callable) -> DataFrame:
    """event, cluster, part: the label that ``kernel(waves)`` gives each event within its cluster."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("event")
        labels = kernel(cube(part.column("w"), samples, channels))
        return pa.table({"event": part.column("event"), "cluster": part.column("cluster"), "part": pa.array(np.asarray(labels, np.int64))})

    return waves.select("event", F.col("cluster").cast("bigint").alias("cluster"), "w").groupBy("cluster").applyInArrow(run, "event bigint, cluster bigint, part bigint")


def transformed(waves: DataFrame, samples: int, channels: int, kernel: Callable, kind: str = "array<double>") -> DataFrame:
    """event, cluster, w: each cluster's waves as ``kernel(waves)`` gives them."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("event")
        return pa.table({"event": part.column("event"), "cluster": part.column("cluster"), "w": column(kernel(cube(part.column("w"), samples, channels)), kind)})

    return waves.select("event", F.col("cluster").cast("bigint").alias("cluster"), "w").groupBy("cluster").applyInArrow(run, f"event bigint, cluster bigint, w {kind}")


# ---------------------------------------------------------------- events


def derivative(waves: DataFrame, samples: int, channels: int, partner=None, sets=None) -> DataFrame:
    """event, w (int16, one sample fewer)."""
    return by_event(waves, samples, channels, lambda w: {"w": transforms.derivative(w, partner, sets)}, "w array<smallint>")


def centred(waves: DataFrame, samples: int, channels: int, at: int = 16) -> DataFrame:
    return by_event(waves, samples, channels, lambda w: {"w": transforms.centred(w, at)}, "w array<double>")


def artifacts(waves: DataFrame, samples: int, channels: int, rough: float, steep: float | None = None, saturation: float = float("inf")) -> DataFrame:
    """event, hf, crest, peak, artifact: how rough the steepest channel is, how steep, how large; and whether limits are passed."""

    def kernel(w):
        hf, crest, peak = transforms.artifact_features(w)
        return {"hf": hf, "crest": crest, "peak": peak, "artifact": ((hf > rough) & (crest > steep if steep is not None else True)) | (peak >= saturation)}

    return by_event(waves, samples, channels, kernel, "hf double, crest double, peak double, artifact boolean")


def projections(waves: DataFrame, samples: int, channels: int, basis: transforms.Basis, shift: int = 0) -> DataFrame:
    """event, f: features on a basis, which is a few kilobytes and travels with the tasks."""
    return by_event(waves, samples, channels, lambda w: {"f": transforms.projected_waves(w, basis, shift)}, "f array<double>")


def fitted_basis(waves: DataFrame, samples: int, channels: int, start: int, length: int, parts: int = 3) -> transforms.Basis:
    """Each channel's principal directions, from sums that batches add up: a row of moments for each batch, then one."""
    width = channels * (1 + length + length * length)

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            x = np.moveaxis(transforms.window(cube(batch.column(0), samples, channels), start, length), 2, 0)
            total += np.concatenate([np.full(channels, batch.num_rows), x.sum(1).ravel(), (np.swapaxes(x, 1, 2) @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["k", "v"])

    sums = waves.select("w").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    v = np.array([r.v for r in sums]) if sums else np.zeros(width)
    n, s, q = max(v[0], 1), v[channels : channels * (1 + length)].reshape(channels, length), v[channels * (1 + length) :].reshape(channels, length, length)
    means = s / n
    vectors = np.linalg.eigh((q - n * means[:, :, None] * means[:, None, :]) / max(n - 1, 1))[1][:, :, ::-1][:, :, :parts]
    directions = np.swapaxes(vectors, 1, 2)
    largest = np.take_along_axis(directions, np.abs(directions).argmax(2)[:, :, None], 2)
    return transforms.Basis(means, directions * np.where(largest < 0, -1, 1), start)


def loops(waves: DataFrame, samples: int, channels: int) -> DataFrame:
    """event, shape, size, turn: what place, size and rotation of the channels' loop don't change, and what they are."""

    def kernel(w):
        _, shape, size, turn, _ = transforms.complex_shape(w, transforms.angles(channels))
        return {"shape": shape, "size": size, "turn": turn}

    return by_event(waves, samples, channels, kernel, "shape array<double>, size double, turn double")


def polynomials(waves: DataFrame, samples: int, channels: int, degree: int = 4) -> DataFrame:
    return by_event(waves, samples, channels, lambda w: {"f": transforms.polynomials(w, degree)}, "f array<double>")


def footprints(waves: DataFrame, samples: int, channels: int) -> DataFrame:
    """event, complexity, truncated, centre: measures of each wave as a template."""
    return by_event(waves, samples, channels, lambda w: {"complexity": shapes.complexity(w), "truncated": shapes.is_truncated(w), "centre": shapes.time_centre(w)}, "complexity double, truncated boolean, centre bigint")


# ---------------------------------------------------------------- pairs of templates


def pair_measures(pairs: DataFrame, samples: int, channels: int, most: int = 4) -> DataFrame:
    """a, b, and measures of the pair of templates (v, w): cosine after shifts, match, correlation of loudness, of delays, timing, distance of timing, centred distance."""
    schema = "shifted_cosine double, match double, loudness double, warp double, lag double, timing double, centred double"
    out = fields(schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (cube(batch.column(k), samples, channels) for k in (2, 3))
            timing = shapes.rms_offset(shapes.trough_times(a), shapes.trough_times(b))
            got = {
                "shifted_cosine": shapes.best_cosine(a, b, most), "match": shapes.best_match(a, b, most), "loudness": shapes.amplitude_correlation(a, b), "warp": shapes.warp_correlation(shapes.delays(a), shapes.delays(b)),
                "lag": shapes.time_offset(a, b, most=most), "timing": np.where(np.isfinite(timing), timing, np.nan), "centred": shapes.centred_distance(a, b),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(column(got[n], t) for n, t in out)], ["a", "b", *(n for n, _ in out)])

    return pairs.select("a", "b", "v", "w").mapInArrow(run, f"a bigint, b bigint, {schema}")


# ---------------------------------------------------------------- clusters


def aligned(waves: DataFrame, samples: int, channels: int, most: int = 4) -> DataFrame:
    """event, cluster, w: waves moved onto their cluster's median."""
    return transformed(waves, samples, channels, lambda w: transforms.aligned(w, most)[0])


def dispersions(waves: DataFrame, samples: int, channels: int, sigma: float = 1.0) -> DataFrame:
    """cluster, profile: the deviation of each sample and channel about aligned, smoothed, centred waves; null for one wave."""
    kernel = lambda w, _: {"profile": transforms.centred_events(transforms.smoothed(transforms.aligned(w)[0], sigma)).std(0) if len(w) > 1 else []}
    return by_cluster(waves, samples, channels, kernel, "profile array<double>")


def template_offsets(waves: DataFrame, samples: int, channels: int, most: int = 5, least: int = 20) -> DataFrame:
    """event, cluster, part: the whole shift of each wave to its cluster's template."""
    return relabelled(waves, samples, channels, lambda w: transforms.template_offsets(w, np.ones(len(w), int), most, least=least)[1])


def contamination(waves: DataFrame, samples: int, channels: int, peak: int, least: int = 100, **how) -> DataFrame:
    """cluster, n, bc, null95, excess, sub_cos, nature: whether a cluster is of two cells. Clusters of fewer than ``least`` events are left out."""

    def kernel(w, _):
        found = clusters.contamination(w, peak, **how)
        return {"n": len(w), **{k: found[k] for k in ("bc", "null95", "excess", "sub_cos", "nature")}}

    large = waves.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("cluster")
    return by_cluster(waves.join(F.broadcast(large), "cluster"), samples, channels, kernel, "n bigint, bc double, null95 double, excess double, sub_cos double, nature string")


def curve_statistics(waves: DataFrame, samples: int, channels: int) -> DataFrame:
    """cluster and the statistics of its rows about their direction curve."""
    names = ("r_mean", "r_cv", "cone_med", "cone_p95", "resid_med", "resid_mad", "traj_bend")
    kernel = lambda w, _: {"n": len(w), **{k: v for k, v in clusters.curve_statistics(w.reshape(len(w), -1)).items() if k in names}}
    return by_cluster(waves, samples, channels, kernel, "n bigint, " + ", ".join(f"{n} double" for n in names))


def mean_shift(waves: DataFrame, samples: int, channels: int, matrix=None, mean=0.0, least: int = 100, **how) -> DataFrame:
    """event, cluster (here the chunk), part: clusters of each chunk's whitened waves by direction."""

    def kernel(w):
        x = w.reshape(len(w), -1) - mean
        return clusters.mean_shift(x if matrix is None else x @ matrix, least, **how)

    return relabelled(waves, samples, channels, kernel)


def split_by_dip(waves: DataFrame, samples: int, channels: int, parts: int = 3, least: int = 40, alpha: float = 0.01) -> DataFrame:
    return relabelled(waves, samples, channels, lambda w: clusters.dip_tree_realigned(w, np.arange(samples), parts, least, alpha))


def split_by_mixture(waves: DataFrame, samples: int, channels: int, parts: int = 6, most: int = 8) -> DataFrame:
    return relabelled(waves, samples, channels, lambda w: clusters.mixture_split(w, parts, most))


def split_by_residual(waves: DataFrame, samples: int, channels: int, least: int = 150, margin: float = 0.02) -> DataFrame:
    return relabelled(waves, samples, channels, lambda w: clusters.residual_tree(w.reshape(len(w), -1), least, margin=margin))


def noise(waves: DataFrame, channels: int, least: int = 2) -> DataFrame:
    """cluster, n, amplitude (the mean's peak-to-peak on its loudest channel), snr (by twice the scaled median deviation of that channel's residual). Means and medians are aggregates by element."""
    k = waves.select("cluster", "event", F.posexplode("w").alias("k", "x")).withColumn("c", F.col("k") % channels)
    mean = k.groupBy("cluster", "k", "c").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    loud = mean.groupBy("cluster", "c").agg((F.max("m") - F.min("m")).alias("p"), F.max("n").alias("n"))
    best = loud.groupBy("cluster").agg(F.max_by(F.struct("p", "c", "n"), F.struct("p", -F.col("c"))).alias("s")).select("cluster", F.col("s.p").alias("amplitude"), F.col("s.c").alias("c"), F.col("s.n").alias("n"))
    left = k.join(F.broadcast(best.select("cluster", "c")), ["cluster", "c"]).join(mean.select("cluster", "k", "m"), ["cluster", "k"]).select("cluster", (F.col("x") - F.col("m")).alias("r"))
    mid = left.groupBy("cluster").agg(F.median("r").alias("mid"))
    mad = left.join(F.broadcast(mid), "cluster").groupBy("cluster").agg(F.median(F.abs(F.col("r") - F.col("mid"))).alias("mad"))
    rows = best.join(mad, "cluster").where(F.col("n") >= least)
    return rows.select("cluster", "n", "amplitude", (F.col("amplitude") / F.nullif(2 * 1.4826 * F.col("mad"), F.lit(0.0))).alias("snr"))


def time_blocks(waves: DataFrame, times: DataFrame, blocks: int = 6, least: int = 8) -> DataFrame:
    """cluster, a, b, distance: 1 less the cosine of a cluster's templates in blocks of equally many events (event, t); clusters of fewer than ``least`` events a block are left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    rows = waves.join(times.select("event", "t"), "event").withColumn("_n", n).where(F.col("_n") >= blocks * least)
    block = rows.withColumn("block", F.ntile(blocks).over(Window.partitionBy("cluster").orderBy("t", "event")) - 1)
    m = block.select("cluster", "block", F.posexplode("w").alias("k", "x")).groupBy("cluster", "block", "k").agg(F.avg("x").alias("m"))
    p, q = m.select("cluster", F.col("block").alias("a"), "k", F.col("m").alias("x")), m.select("cluster", F.col("block").alias("b"), "k", F.col("m").alias("y"))
    dots = p.join(q, ["cluster", "k"]).where("a < b").groupBy("cluster", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return dots.select("cluster", "a", "b", (1 - F.col("d") / F.sqrt(F.col("xx") * F.col("yy"))).alias("distance"))


def tails(features: DataFrame) -> DataFrame:
    """cluster, index: the 99.9th percentile of squared residuals by their mean, of feature rows (cluster, event, w)."""
    k = features.select("cluster", "event", F.posexplode("w").alias("k", "x"))
    mean = k.groupBy("cluster", "k").agg(F.avg("x").alias("m"))
    r = k.join(mean, ["cluster", "k"]).groupBy("cluster", "event").agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("r"))
    return r.groupBy("cluster").agg((F.percentile("r", F.lit(0.999)) / F.greatest(F.avg("r"), F.lit(1e-30))).alias("index"))
