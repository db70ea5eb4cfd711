"""Windows, deduplication and decaying counts of streamed events (event, unit, ts, amp)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """unit, start, n, amp: count and mean by unit and window; with ``slide`` windows overlap."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withWatermark("ts", late).groupBy("unit", w).agg(F.count(F.lit(1)).alias("n"), F.avg("amp").alias("amp"))
    return g.select("unit", F.col("window.start").alias("start"), "n", "amp")


def sessions(events: DataFrame, pause: str = "1 day", late: str = "1 hour") -> DataFrame:
    """unit, start, end, n: runs of events of a unit without a longer pause."""
    g = events.withWatermark("ts", late).groupBy("unit", F.session_window("ts", pause).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("unit", "w.start", "w.end", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, as long as its copies come within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event"])


def decaying(events: DataFrame, tau: float) -> DataFrame:
    """unit, event, load: a decaying count of the unit's earlier events, a <- exp(-gap / tau) (a + 1), from 0, in seconds.

    Events of a unit are taken in the order of their time within a trigger; state is one number and one time a unit.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, load = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event"])
        out = []
        for event, t in zip(rows["event"], rows["ts"].map(pd.Timestamp.timestamp), strict=True):
            load = 0.0 if last is None else math.exp(-max(0.0, t - last) / tau) * (load + 1)
            last = t if last is None else max(last, t)
            out.append((key[0], event, load))
        state.update((last, load))
        yield pd.DataFrame(out, columns=["unit", "event", "load"])

    return events.groupBy("unit").applyInPandasWithState(run, "unit bigint, event bigint, load double", "last double, load double", "append", GroupStateTimeout.NoTimeout)
