"""Places of units beside their probe, as tables: see ``functions/places.py``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places, transforms
from ..sources.session import POSITION_COLUMNS
from .waves import by_cluster, by_event, cube, transformed

PLACE = "x0 double, y0 double, z0 double, A double, dist double, dipoleB double, resid double, sig_y double, z_lo double, z_hi double, y_lo double, y_hi double, depth_shift double, one_flank bigint, edge_fit bigint, at_bound bigint"
REPORT = ["unit", "nspk", "x0", "y0", "z0", "dist", "z_lo", "z_hi", "y_lo", "y_hi", "dipoleB", "depth_shift", "resid", "one_flank", "edge_fit", "at_bound", "low_n", "high_resid", "reliable"]


def sampled(waves: DataFrame, most: int, least: int = 1) -> DataFrame:
    """About ``most`` events of each cluster, chosen by hashes of their ids, of clusters of ``least`` events or more, and n, how many the cluster has.

    One count a cluster is joined to the waves, so no cluster is gathered before it is small: one that holds a third of all events costs as much afterwards as any other."""
    n = waves.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    place = F.pmod(F.xxhash64("event", F.lit(7)), F.lit(1 << 40)) / (1 << 40)
    return waves.join(n, "cluster").where(place < F.lit(float(most)) / F.col("n"))


def common_basis(waves: DataFrame, samples: int, channels: int, parts: int = 12, clusters: int = 400, each: int = 120, least: int = 40) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and principal directions of aligned waves of many clusters: of ``clusters`` clusters, chosen by hash, about ``each`` events. None if no cluster has ``least`` events.

    Tasks send sums of products, of which there are (samples x channels)^2 however many events there are."""
    width = samples * channels
    chosen = waves.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least).orderBy(F.xxhash64("cluster"), "cluster").limit(clusters).select("cluster")
    events = transformed(sampled(waves.join(chosen, "cluster", "left_semi"), each), samples, channels, lambda w: transforms.aligned(w)[0])

    def run(batches):
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = cube(batch.column(0), samples, channels).reshape(batch.num_rows, width)
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

    sums = events.select("w").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    if not sums.num_rows:
        return None
    v = sums.column("v").to_numpy()[np.argsort(sums.column("k").to_numpy())]
    return places.principal(v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width), parts)


def profiles(waves: DataFrame, samples: int, channels: int, kind: str = "ptp", basis=None, most: int = 2000) -> DataFrame:
    """cluster, p: the amplitude on each channel. Medians of peaks to peaks (``ptp`` without a basis) are exact over all events: a cluster's distinct values of a channel are in one task; other kinds are of about ``most`` events of a cluster."""
    if kind == "ptp" and basis is None:
        each = by_event(waves.where("w IS NOT NULL").select("w", F.col("cluster").cast("bigint").alias("event")), samples, channels, lambda w: {"p": places.amplitudes(w)}, "p array<double>")
        middle = each.select("event", F.posexplode("p").alias("c", "v")).groupBy("event", "c").agg(F.median("v").alias("v"))
        return middle.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("p")).select(F.col("event").alias("cluster"), F.col("p.v").alias("p"))
    return by_cluster(sampled(waves, most), samples, channels, lambda w, _: {"p": places.profile(w, kind, basis)}, "p array<double>")


def located(waves: DataFrame, samples: int, channels: int, sites, dipole: bool = True, least: int = 15, draws: int = 0, kind: str = "pc1", basis=None, most: int = 2000) -> DataFrame:
    """cluster, the columns of its place, template (the median wave), snr and n, for each cluster of ``least`` events or more, none of label null or below 0.

    Places come from about ``most`` events of a cluster, n counts all. A table without such a cluster gives no row."""
    sites = np.asarray(sites, float)

    def kernel(w, _):
        t, snr = places.template(w)
        return places.placed(w, sites, dipole, draws, kind=kind, basis=basis) | {"template": t, "snr": snr}

    few = sampled(waves.where("cluster >= 0"), most, least)
    n = waves.groupBy(F.col("cluster").cast("bigint").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return by_cluster(few, samples, channels, kernel, f"{PLACE}, snr double, template array<double>").join(n, "cluster")


def report(found: DataFrame, least: int = 50, most_residual: float = 0.10) -> DataFrame:
    """Places as a table to print, units above 0 in order of their events; reliable ones are within the box, have ``least`` events, and leave ``most_residual`` of the loudest channel at most."""
    low, high = (F.col("n") < least).cast("int"), (F.col("resid") > most_residual).cast("int")
    kept = found.where("cluster > 0").withColumn("unit", F.col("cluster")).withColumn("nspk", F.col("n")).withColumn("low_n", low).withColumn("high_resid", high)
    return kept.withColumn("reliable", ((F.col("at_bound") == 0) & (low == 0) & (high == 0)).cast("int")).select(REPORT).orderBy(F.desc("nspk"), "unit")


def event_places(labels: DataFrame, found: DataFrame) -> DataFrame:
    """spike_idx and its cluster's place, for each row of labels (spike_idx, label); without a place they are nan, and one_flank 1."""
    nan = F.lit(float("nan")).cast("float")
    its = found.select(F.col("cluster").alias("label"), *POSITION_COLUMNS)
    return labels.select("spike_idx", F.col("label").cast("bigint").alias("label")).join(its, "label", "left").select(
        "spike_idx", *(F.coalesce(F.col(c).cast("float"), F.lit(1.0).cast("float") if c == "one_flank" else nan).alias(c) for c in POSITION_COLUMNS)
    )
