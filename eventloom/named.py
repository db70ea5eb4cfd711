"""What the modules of named queries share: the register, and SQL for the tables as event trains, labellings and waveforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

E = "e AS (SELECT event_id AS event, user_id AS unit, epoch_us(ts) AS t, event_type AS kind, value AS amp FROM events)"
G = E + ", g AS (SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event) AS gap FROM e)"
L = "l AS (SELECT event_id AS event, user_id % 10 AS truth, CASE WHEN event_id % 5 = 0 THEN event_id % 7 ELSE user_id % 10 END AS found FROM events), c AS (SELECT truth, found, count(*) AS n FROM l GROUP BY 1, 2)"
W = "x AS (SELECT vec_id AS event, label AS cluster, unnest(range(1, 65)) - 1 AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings), t AS (SELECT cluster, k, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM x GROUP BY 1, 2)"
H, D, M = 3_600_000_000, 86_400_000_000, 60_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
