"""Named queries over the driver's tables, with equivalent SQL.

``events`` stands for event trains (a unit is a user), ``embeddings`` for waveforms of clusters. The labelling that is scored
is the unit modulo 10 with one event in five dealt elsewhere.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .named import D, E, G, H, L, M, ORACLES, QUERIES, W, query
from .operators import curves, graphs, hierarchy, scoring, states, templates, trains
from .sources.tables import table, trains as event_trains, waves

def labels(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("event"), (F.col("user_id") % 10).alias("truth"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 7).otherwise(F.col("user_id") % 10).alias("found"))


@query(f"WITH {G} SELECT unit, count(*) AS n, count(*) FILTER (gap > {M} AND gap <= {H}) AS n_violations, coalesce(round(count(*) FILTER (gap > {M} AND gap <= {H}) / nullif(count(*) - 1, 0), 6), 0) AS fraction FROM g GROUP BY unit")
def isi_violation(spark, d):
    return trains.violations(event_trains(spark, d))


@query(f"WITH {G}, s AS (SELECT unit, count(*) AS n, count(*) FILTER (gap >= {M} AND gap < {H}) AS b, count(*) FILTER (gap < {M}) AS d FROM g GROUP BY unit) SELECT unit, n, CASE WHEN n >= 10 THEN round(b * 100 / (n - 1), 6) END AS band_pct, CASE WHEN n >= 10 THEN round(d * 100 / (n - 1), 6) END AS dup_pct FROM s")
def band_and_dup_pct(spark, d):
    return trains.band_percent(event_trains(spark, d))


PRESENCE = "p AS (SELECT unit, round(count(DISTINCT least(floor((t - t0) * 120 / greatest(t1 - t0, 1)), 119)) / 120, 6) AS presence FROM e, (SELECT min(t) AS t0, max(t) AS t1 FROM e) GROUP BY unit)"


@query(f"WITH {E}, {PRESENCE} SELECT unit, presence FROM p")
def presence_ratio(spark, d):
    return trains.presence(event_trains(spark, d))


@query(f"""WITH {G}, {PRESENCE}, v AS (SELECT unit, count(*) AS n, coalesce(round(count(*) FILTER (gap > {M} AND gap <= {H}) / nullif(count(*) - 1, 0), 6), 0) AS fraction FROM g WHERE unit NOT IN (0, 1) GROUP BY unit HAVING count(*) >= 20)
SELECT unit, n, fraction, presence, concat_ws(',', CASE WHEN fraction > 0.01 THEN 'isi' END, CASE WHEN presence < 0.5 THEN 'presence' END) AS flags FROM v JOIN p USING (unit)""")
def qc_flags(spark, d):
    return trains.quality(event_trains(spark, d))


@query(f"""WITH {G}, s AS (SELECT unit, count(*) AS n, avg((gap < {3 * H})::INT) AS b, avg(gap / 1e6) AS m, stddev_pop(gap / 1e6) AS sd, count(*) FILTER (gap < {H}) AS rpv, (max(t) - min(t)) / 1e6 AS dur FROM g GROUP BY unit), q AS (SELECT *, rpv * dur / (2 * n * n * 3600.0) AS q FROM s)
SELECT unit, n, CASE WHEN n > 10 THEN round(b, 6) END AS burst, CASE WHEN n > 10 THEN round(sd / (m + 1e-9), 6) END AS cv, CASE WHEN n > 10 AND q <= 0.25 THEN round(0.5 * (1 - sqrt(1 - 4 * q)), 6) END AS hill_fp FROM q""")
def burst_cv(spark, d):
    return trains.burst(event_trains(spark, d))


COINCIDE = f"p AS (SELECT a.unit AS a, b.unit AS b, count(*) AS n FROM e a JOIN e b ON a.unit < b.unit AND b.t BETWEEN a.t - {H} AND a.t + {H} WHERE abs(a.t - b.t) > {M} GROUP BY 1, 2)"


@query(f"WITH {E}, {COINCIDE} SELECT a, b, n FROM p")
def coincidences(spark, d):
    return trains.coincidences(event_trains(spark, d))


GATE = f"""{COINCIDE}, u AS (SELECT unit, count(*) AS k FROM e GROUP BY 1), x AS (SELECT a.unit AS a, b.unit AS b, round({2.0 * (H - M)} * a.k * b.k / (SELECT max(t) - min(t) FROM e), 6) AS expected FROM u a JOIN u b ON a.unit < b.unit),
y AS (SELECT a, b, coalesce(n, 0) AS n, expected FROM x LEFT JOIN p USING (a, b) WHERE expected >= 5)"""


@query(f"WITH {E}, {GATE} SELECT a, b, n, expected, CASE WHEN n > 0.3 * expected THEN 'veto' ELSE 'allow' END AS verdict FROM y")
def refractory_gate(spark, d):
    return trains.refractory_gate(event_trains(spark, d))


@query(f"WITH {E}, {GATE} SELECT a, b, n, expected, CASE WHEN n > 0.3 * expected THEN 'genuine' ELSE 'spurious' END AS verdict FROM y")
def split_gate(spark, d):
    return trains.split_gate(event_trains(spark, d))


NEXT = "np AS (SELECT a.unit AS a, b.unit AS b FROM (SELECT DISTINCT unit FROM e) a JOIN (SELECT DISTINCT unit FROM e) b ON a.unit < b.unit)"


@query(f"""WITH {E}, {NEXT}, s AS (SELECT unit, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), o AS (SELECT a, b, greatest(x.lo, y.lo) AS lo, least(x.hi, y.hi) AS hi FROM np JOIN s x ON x.unit = a JOIN s y ON y.unit = b),
x AS (SELECT a, b, t FROM o JOIN e ON unit = a AND t BETWEEN lo AND hi WHERE hi > lo), y AS (SELECT a, b, t FROM o JOIN e ON unit = b AND t BETWEEN lo AND hi WHERE hi > lo),
n AS (SELECT x.a, x.b, count(*) AS n FROM x JOIN y ON x.a = y.a AND x.b = y.b AND abs(x.t - y.t) > {M} AND abs(x.t - y.t) <= {H} GROUP BY 1, 2),
z AS (SELECT o.a, o.b, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n, 0) AS n, CASE WHEN hi > lo THEN round({2.0 * (H - M)} * coalesce(n_a, 0) * coalesce(n_b, 0) / (hi - lo), 6) ELSE 0 END AS expected FROM o LEFT JOIN (SELECT a, b, count(*) AS n_a FROM x GROUP BY 1, 2) USING (a, b) LEFT JOIN (SELECT a, b, count(*) AS n_b FROM y GROUP BY 1, 2) USING (a, b) LEFT JOIN n USING (a, b))
SELECT *, CASE WHEN expected < 5 THEN 'abstain' WHEN n > 0.3 * expected THEN 'veto' ELSE 'allow' END AS verdict FROM z""")
def overlap_gate(spark, d):
    return trains.overlap_gate(event_trains(spark, d))


@query(f"WITH {E}, p AS (SELECT a.unit AS a, b.unit AS b, b.t - a.t AS lag FROM e a JOIN e b ON a.unit < b.unit AND b.t BETWEEN a.t - {12 * H} AND a.t + {12 * H}) SELECT a, b, " + ", ".join(f"round(count(*) FILTER ((lag >= {lo * H} AND lag < {hi * H}) OR (lag >= {-hi * H} AND lag < {-lo * H})) / {2 * (hi - lo)}, 6) AS band_{k}" for k, (lo, hi) in enumerate(((0, 1), (1, 2), (2, 6), (6, 12)))) + " FROM p GROUP BY 1, 2")
def ccg_bands(spark, d):
    return trains.lag_bands(event_trains(spark, d))


@query(f"""WITH {E}, f AS (SELECT unit, t AS u FROM e WHERE kind = 'click'), h AS (SELECT e.unit, e.t, f.u FROM (SELECT * FROM e WHERE kind = 'purchase') e ASOF JOIN f ON e.unit = f.unit AND e.t > f.u), r AS (SELECT unit, count(*) AS k, max(u) - min(u) AS span FROM f GROUP BY 1 HAVING count(*) >= 2)
SELECT unit, n, n_after, round(n_after / n, 6) AS observed, round(1 - exp(-k * {float(H)} / greatest(span, 1)), 6) AS expected FROM (SELECT unit, count(*) AS n, count(*) FILTER (t - u < {H}) AS n_after FROM h GROUP BY 1) JOIN r USING (unit)""")
def latency_enrichment(spark, d):
    return trains.latency(event_trains(spark, d), "click", "purchase")


EDGES = [0, 5 * M, 10 * M, 20 * M, 40 * M]


@query(f"""WITH {E}, g AS (SELECT kind, amp, t - lag(t) OVER (PARTITION BY kind ORDER BY t, event) AS gap FROM e), i AS (SELECT kind, median(amp) AS base FROM g WHERE gap IS NULL OR gap > {40 * M} GROUP BY 1 HAVING count(*) >= 20),
b AS (SELECT kind, CASE WHEN gap IS NULL THEN 4 ELSE {" + ".join(f"(gap >= {x})::INT" for x in EDGES[1:])} END AS bin, amp FROM g) SELECT kind, bin, count(*) AS n, round(median(amp) / any_value(base), 6) AS ratio FROM b JOIN i USING (kind) GROUP BY 1, 2 HAVING count(*) >= 20""")
def recovery_curve(spark, d):
    return trains.recovery(event_trains(spark, d), EDGES, 40 * M)


@query(f"WITH {G}, s AS (SELECT *, sum((coalesce(gap, 0) > {D})::INT) OVER (PARTITION BY unit ORDER BY t, event) AS episode FROM g) SELECT unit, episode::BIGINT AS episode, count(*) AS n, max(t) - min(t) AS length FROM s GROUP BY 1, 2")
def episodes(spark, d):
    return trains.episodes(event_trains(spark, d))


@query(f"WITH {E} SELECT event, round(amp - avg(amp) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN {D} PRECEDING AND {D - 1} FOLLOWING), 6) + 0.0 AS center FROM e")
def local_center(spark, d):
    return trains.local_center(event_trains(spark, d)).withColumn("center", F.col("center") + 0.0)


@query(f"""WITH {E}, c AS (SELECT unit, amp - avg(amp) OVER (PARTITION BY unit) AS x FROM e), m AS (SELECT unit, count(x) AS n, avg(x ** 2) AS b, avg(x ** 3) AS c, avg(x ** 4) AS d FROM c GROUP BY 1)
SELECT unit, n, CASE WHEN n < 12 OR sqrt(b) < 1e-9 THEN 0 ELSE round((c ** 2 / b ** 3 + 1) / (d / b ** 2 - 3 + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 5) END AS coefficient FROM m""")
def bimodality(spark, d):
    return trains.bimodality(event_trains(spark, d))


RATE = f"""{NEXT}, pt AS (SELECT a, b, t, 1 AS x, 0 AS y FROM np JOIN e ON unit = a UNION ALL SELECT a, b, t, 0, 1 FROM np JOIN e ON unit = b), pe AS (SELECT a, b, min(t) AS t0, ceil((max(t) - min(t)) / {D})::BIGINT AS k FROM pt GROUP BY 1, 2),
pg AS (SELECT a, b, k, unnest(range(k)) AS bin FROM pe), pc AS (SELECT a, b, least((t - t0) // {D}, k - 1) AS bin, sum(x) AS x, sum(y) AS y FROM pt JOIN pe USING (a, b) GROUP BY 1, 2, 3),
pr AS (SELECT a, b, CASE WHEN any_value(k) >= 4 AND var_pop(coalesce(x, 0)) > 0 AND var_pop(coalesce(y, 0)) > 0 THEN round(corr(coalesce(x, 0), coalesce(y, 0)), 6) + 0.0 END AS r FROM pg LEFT JOIN pc USING (a, b, bin) GROUP BY 1, 2)"""


@query(f"WITH {E}, {RATE} SELECT a, b, r FROM pr")
def rate_corr(spark, d):
    return trains.rate_correlation(event_trains(spark, d)).withColumn("r", F.col("r") + 0.0)


@query(f"""WITH {E}, {RATE}, s AS (SELECT unit FROM e GROUP BY 1 HAVING count(*) >= 30), l AS (SELECT np.a, np.b, y.t - x.t AS lag FROM np JOIN e x ON x.unit = np.a JOIN e y ON y.unit = np.b WHERE np.a IN (FROM s) AND np.b IN (FROM s) AND abs(y.t - x.t) <= {20 * H}),
c AS (SELECT a, b, round(count(*) FILTER ((lag >= {2 * H} AND lag < {5 * H}) OR (lag >= {-5 * H} AND lag < {-2 * H})) / 6, 6) AS near, round(count(*) FILTER ((lag >= {10 * H} AND lag < {20 * H}) OR (lag >= {-20 * H} AND lag < {-10 * H})) / 20, 6) AS far FROM l GROUP BY 1, 2),
v AS (SELECT np.a, np.b, round(coalesce(near, 0) / (coalesce(far, 0) + 1e-9), 6) AS dip, r FROM np LEFT JOIN c USING (a, b) JOIN pr USING (a, b) WHERE np.a IN (FROM s) AND np.b IN (FROM s))
SELECT a, b, dip, r, CASE WHEN dip < 0.5 AND r < 0.2 THEN 'SAME?' WHEN dip > 0.8 THEN 'distinct?' ELSE 'review' END AS verdict FROM v""")
def merge_verdict(spark, d):
    return trains.merge_verdict(event_trains(spark, d)).withColumn("r", F.col("r") + 0.0)


@query(f"WITH {E}, g AS (SELECT unit % 10 AS grp, t - lag(t) OVER (PARTITION BY unit % 10 ORDER BY t, event) AS gap FROM e) SELECT grp AS \"group\", count(*) AS n, round(count(*) FILTER (gap < {H}) / nullif(count(gap), 0), 6) AS fraction FROM g GROUP BY 1")
def union_violations(spark, d):
    e = event_trains(spark, d)
    return trains.union_violations(e, e.select("unit").distinct().withColumn("group", F.col("unit") % 10))


@query(f"WITH {E}, h AS (SELECT unit, t * 2 >= min(t) OVER (PARTITION BY unit) + max(t) OVER (PARTITION BY unit) AS late FROM e), c AS (SELECT unit, count(*) AS n, count(*) FILTER (late) AS b FROM h GROUP BY 1) SELECT unit, n, round(least(b, n - b) / greatest(b, n - b), 6) AS ratio FROM c")
def half_rates(spark, d):
    return trains.half_rates(event_trains(spark, d))


@query(f"WITH {E}, c AS (SELECT x.unit AS a, y.unit AS b, count(*) FILTER (abs(x.t - y.t) <= {H}) AS near, count(*) AS far FROM e x JOIN e y ON x.unit < y.unit AND y.t BETWEEN x.t - {6 * H} AND x.t + {6 * H} GROUP BY 1, 2) SELECT a, b, near, far, round(near / nullif(far * ({H} / {6 * H}), 0), 6) AS ratio FROM c")
def near_ratio(spark, d):
    return trains.near_ratio(event_trains(spark, d), H, 6 * H)


@query(f"WITH {E} SELECT a.t, a.unit % 10 AS found, b.unit % 7 AS truth FROM e a JOIN e b ON a.t = b.t AND b.event % 3 <> 0 WHERE a.event % 2 = 0")
def aligned_labels(spark, d):
    e = event_trains(spark, d)
    return trains.aligned_labels(e.where("event % 2 = 0").select("t", (F.col("unit") % 10).alias("label")), e.where("event % 3 <> 0").select("t", (F.col("unit") % 7).alias("label")))


@query(f"""WITH {E}, k AS (SELECT event, t, t0, (t - t0) // {D} AS k FROM e, (SELECT min(t) AS t0 FROM e)), x AS (SELECT *, unnest([k - 1, k, k + 1]) AS chunk FROM k)
SELECT event, chunk, chunk = k AS core FROM x WHERE chunk >= 0 AND t >= t0 + chunk * {D} - {8 * H} AND t < t0 + (chunk + 1) * {D} + {8 * H}""")
def chunk_core_ext(spark, d):
    return trains.chunks(event_trains(spark, d))


@query(f"WITH {L} SELECT truth, found, n FROM c")
def contingency(spark, d):
    return scoring.contingency(labels(spark, d))


@query(f"""WITH {L}, x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n) FROM c) AS total, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY truth)) AS st, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY found)) AS sf),
y AS (SELECT *, st * sf / (total * (total - 1) / 2) AS expected, (st + sf) / 2 AS top FROM x) SELECT round(s / sf, 6) AS precision, round(s / st, 6) AS recall, round(2 * s / (st + sf), 6) AS f1, round((s - expected) / (top - expected), 6) AS ari FROM y""")
def pairwise_prf(spark, d):
    return scoring.pairwise(labels(spark, d))


@query(f"""WITH {L}, x AS (SELECT n, sum(n) OVER (PARTITION BY truth) AS nt, sum(n) OVER (PARTITION BY found) AS nf, sum(n) OVER () AS total FROM c), y AS (SELECT 1 - sum(-n / total * ln(n / nf)) / sum(-n / total * ln(nt / total)) AS h, 1 - sum(-n / total * ln(n / nt)) / sum(-n / total * ln(nf / total)) AS k FROM x)
SELECT round(h, 6) AS homogeneity, round(k, 6) AS completeness, round(2 * h * k / (h + k), 6) AS v FROM y""")
def v_measure(spark, d):
    return scoring.v_measure(labels(spark, d))


@query(f"""WITH {L}, x AS (SELECT *, sum(n) OVER (PARTITION BY truth) AS nt, sum(n) OVER (PARTITION BY found) AS nf, row_number() OVER (PARTITION BY truth ORDER BY n DESC, found) AS k FROM c)
SELECT truth, found AS best, n, round(n / nt, 6) AS recall, round(n / nf, 6) AS precision, n / nt < 0.8 AS split FROM x WHERE k = 1""")
def unit_match(spark, d):
    return scoring.unit_match(labels(spark, d))


@query("WITH c AS (SELECT user_id % 10 AS truth, user_id % 5 AS found, count(*) AS n FROM events GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY found) AS nf FROM c) SELECT found, count(*) AS n_truths FROM x WHERE n >= 0.2 * nf GROUP BY 1 HAVING count(*) >= 2")
def merged_candidates(spark, d):
    e = table(spark, d, "events")
    return scoring.merged(e.select(F.col("event_id").alias("event"), (F.col("user_id") % 10).alias("truth"), (F.col("user_id") % 5).alias("found")))


@query(f"WITH {W}, n AS (SELECT cluster, sqrt(sum(m * m)) AS norm FROM t GROUP BY 1) SELECT a.cluster AS a, b.cluster AS b, round(sum(a.m * b.m) / (x.norm * y.norm), 6) AS cosine, round(sqrt(sum((a.m - b.m) ** 2) / 64), 6) AS rms FROM t a JOIN t b ON a.k = b.k AND a.cluster < b.cluster JOIN n x ON x.cluster = a.cluster JOIN n y ON y.cluster = b.cluster GROUP BY 1, 2, x.norm, y.norm")
def template_cosine(spark, d):
    return templates.likeness(templates.templates(waves(spark, d)))


@query(f"""WITH {W}, n AS (SELECT cluster, sqrt(sum(m * m)) AS norm FROM t GROUP BY 1), p AS (SELECT a.cluster AS a, b.cluster AS b, round(sum(a.m * b.m) / (x.norm * y.norm), 6) AS cosine FROM t a JOIN t b ON a.k = b.k AND a.cluster <> b.cluster JOIN n x ON x.cluster = a.cluster JOIN n y ON y.cluster = b.cluster GROUP BY 1, 2, x.norm, y.norm),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS i, row_number() OVER (PARTITION BY b ORDER BY cosine DESC, a) AS j FROM p) SELECT a, b, cosine FROM r WHERE i = 1 AND j = 1 AND a < b""")
def mutual_nn(spark, d):
    return templates.mutual_pairs(templates.templates(waves(spark, d)))


@query(f"WITH {W} SELECT cluster, max(n) AS n, round(avg(v), 6) AS dispersion, round(max(m) - min(m), 6) AS ptp FROM t GROUP BY 1")
def dispersion(spark, d):
    return templates.dispersion(waves(spark, d))


@query(f"""WITH {W}, n AS (SELECT cluster, sqrt(sum(m * m)) AS norm FROM t GROUP BY 1), p AS (SELECT x.event, x.cluster, t.cluster AS best, round(sum(x.x * t.m) / (sqrt(sum(x.x * x.x)) * n.norm), 6) AS cosine FROM x JOIN t USING (k) JOIN n ON n.cluster = t.cluster GROUP BY 1, 2, 3, n.norm)
SELECT event, cluster, best, cosine FROM p QUALIFY row_number() OVER (PARTITION BY event ORDER BY cosine DESC, best) = 1""")
def template_match(spark, d):
    w = waves(spark, d)
    return templates.assigned(w, templates.templates(w))


@query("SELECT vec_id AS event, round(list_max(e) - list_min(e), 6) AS ptp, (list_position(m, list_max(m)) - 1)::BIGINT AS peak_at FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS m FROM embeddings)")
def wave_shape(spark, d):
    return templates.shapes(waves(spark, d))


@query("WITH r AS (SELECT label, row_number() OVER (ORDER BY label) + 1 AS new FROM (SELECT DISTINCT label FROM embeddings WHERE label <> 0)) SELECT vec_id AS event, e.label, coalesce(new, 0)::INT AS new FROM embeddings e LEFT JOIN r ON r.label = e.label")
def relabel_compact(spark, d):
    return hierarchy.compact(waves(spark, d).select("event", F.col("cluster").alias("label")))


@query("SELECT vec_id AS event, CASE WHEN label = 0 OR label % 4 = 3 THEN 0 ELSE label // 2 END AS label FROM embeddings")
def hierarchy_reparent(spark, d):
    parents = spark.range(10).where("id % 4 <> 3").select(F.col("id").cast("int").alias("child"), F.floor(F.col("id") / 2).cast("int").alias("parent"))
    return hierarchy.reparent(waves(spark, d).select("event", F.col("cluster").alias("label")), parents)


@query("""WITH l AS (SELECT user_id AS grp, event_id AS event, event_id % 3 AS label FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY event) - row_number() OVER (PARTITION BY grp, label ORDER BY event) AS island FROM l)
SELECT grp, label, min(event) AS first, max(event) AS last, count(*) AS n FROM i GROUP BY grp, label, island""")
def atom_islands(spark, d):
    e = table(spark, d, "events")
    return hierarchy.islands(e.select(F.col("user_id").alias("grp"), F.col("event_id").alias("event"), (F.col("event_id") % 3).alias("label")))


@query("""SELECT coalesce(event_type, '*') AS kind, coalesce((user_id % 4)::VARCHAR, '*') AS part, count(*) AS n, round(sum(value), 4) AS total, round(median(value), 6) AS mid FROM events GROUP BY CUBE (event_type, user_id % 4)""")
def kind_cube(spark, d):
    e = table(spark, d, "events").withColumn("part", (F.col("user_id") % 4).cast("string"))
    return e.cube("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.percentile("value", 0.5), 6).alias("mid")).select(F.coalesce("event_type", F.lit("*")).alias("kind"), F.coalesce("part", F.lit("*")).alias("part"), "n", "total", "mid")


LOAD = "SELECT a.event, a.unit, coalesce(sum(exp((b.t - a.t) / {tau}::DOUBLE)), 0) AS load FROM e a LEFT JOIN e b ON a.unit = b.unit AND (b.t < a.t OR (b.t = a.t AND b.event < a.event)) GROUP BY 1, 2"


@query(f"WITH {E}, l AS ({LOAD.format(tau=12 * H)}) SELECT event, round(load, 6) AS load FROM l")
def decaying_load(spark, d):
    return states.decaying(event_trains(spark, d), 12 * H).select("event", F.round("load", 6).alias("load"))


@query(f"""WITH {E}, l AS ({" UNION ALL ".join(f"SELECT *, {tau} AS tau FROM ({LOAD.format(tau=tau)})" for tau in (6 * H, D, 4 * D))}), k AS (SELECT event, 1 - row_number() OVER (PARTITION BY unit ORDER BY amp, event) AS rank FROM e),
r AS (SELECT unit, tau, round(corr(load, rank), 6) + 0.0 AS r FROM l JOIN k USING (event) GROUP BY 1, 2 HAVING count(*) >= 10) SELECT unit, tau, r FROM r QUALIFY row_number() OVER (PARTITION BY unit ORDER BY abs(r) DESC, tau) = 1""")
def adaptation(spark, d):
    return states.adaptation(event_trains(spark, d), (6 * H, D, 4 * D))


@query(f"""WITH {G}, b AS (SELECT unit, amp, CASE WHEN gap IS NULL THEN 7 ELSE {" + ".join(f"(gap >= {H << k})::INT" for k in range(7))} END AS bin FROM g), u AS (SELECT unit, count(*) AS n, avg(amp) AS m, var_pop(amp) AS v FROM b GROUP BY 1),
k AS (SELECT unit, bin, count(*) AS k, avg(amp) AS mk FROM b GROUP BY 1, 2), x AS (SELECT unit, n, v, sum(k * (mk - m) ** 2) / n AS w FROM k JOIN u USING (unit) WHERE n >= 10 GROUP BY 1, 2, 3) SELECT unit, n, round(w / v, 6) AS share, round(sqrt(v), 4) AS radius, round(sqrt(w), 4) AS "between" FROM x""")
def isi_share(spark, d):
    return states.gap_share(event_trains(spark, d))


@query(f"""WITH {E}, g AS (SELECT *, t - lag(t) OVER w AS gap, amp - lag(amp) OVER w AS step, min(t) OVER (PARTITION BY unit) AS t0, max(t) OVER (PARTITION BY unit) AS t1 FROM e WINDOW w AS (PARTITION BY unit ORDER BY t, event)),
p AS (SELECT *, least((t - t0) * 12 // greatest(t1 - t0, 1), 11) AS part FROM g), u AS (SELECT unit, count(*) AS n, avg(amp) AS m, var_pop(amp) AS v, avg(step * step / 2) FILTER (gap < {D}) AS f FROM p GROUP BY 1 HAVING count(*) >= 10), b AS (SELECT unit, count(*) AS k, avg(amp) AS mk FROM p GROUP BY unit, part)
SELECT unit, n, round(v, 4) AS v_total, round(f, 4) AS v_fast, round(v - f, 4) AS v_slow, round(sum(k * (mk - m) ** 2) / n, 4) AS v_drift FROM u JOIN b USING (unit) GROUP BY unit, n, v, f""")
def fast_slow(spark, d):
    return states.fast_slow(event_trains(spark, d))


@query(f"""WITH {E}, g AS (SELECT unit, t - lag(t) OVER w AS gap, (amp - lag(amp) OVER w) ** 2 / 2 AS half FROM e WINDOW w AS (PARTITION BY unit ORDER BY t, event)), s AS (SELECT unit, count(half) FILTER (gap >= 0 AND gap < {6 * H}) AS n_near, count(half) FILTER (gap >= {12 * H} AND gap < {48 * H}) AS n_far,
avg(half) FILTER (gap >= 0 AND gap < {6 * H}) AS a, avg(half) FILTER (gap >= {12 * H} AND gap < {48 * H}) AS b FROM g GROUP BY 1) SELECT unit, n_near, n_far, CASE WHEN n_near >= 3 AND n_far >= 3 THEN round(b - a, 4) END AS variance FROM s""")
def shared_state_variance(spark, d):
    return states.shared_state(event_trains(spark, d), least=3)


@query(f"""WITH {E} SELECT a.event, count(b.event) FILTER ((b.t, b.event) > (a.t, a.event)) - count(b.event) FILTER ((b.t, b.event) < (a.t, a.event)) AS position FROM e a JOIN e b ON a.unit = b.unit AND b.t BETWEEN a.t - {D} AND a.t + {D} GROUP BY 1""")
def episode_position(spark, d):
    return states.episode_position(event_trains(spark, d))


@query(f"""WITH RECURSIVE {E}, o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t, event) AS i FROM e), s AS (SELECT unit, i, event, t, amp, NULL::BIGINT AS done FROM o WHERE i = 1 UNION ALL
SELECT o.unit, o.i, CASE WHEN o.t - s.t >= {D} OR o.amp > s.amp THEN o.event ELSE s.event END, CASE WHEN o.t - s.t >= {D} OR o.amp > s.amp THEN o.t ELSE s.t END, CASE WHEN o.t - s.t >= {D} OR o.amp > s.amp THEN o.amp ELSE s.amp END, CASE WHEN o.t - s.t >= {D} THEN s.event END FROM s JOIN o ON o.unit = s.unit AND o.i = s.i + 1)
SELECT done AS event FROM s WHERE done IS NOT NULL UNION ALL (SELECT event FROM s QUALIFY row_number() OVER (PARTITION BY unit ORDER BY i DESC) = 1)""")
def dedup_keep(spark, d):
    return states.without_repeats(event_trains(spark, d), D).select("event")


@query(f"""WITH {E}, x AS (SELECT unit % 20 AS unit, (t - (SELECT min(t) FROM e)) // {3 * D} AS chunk, avg(amp) AS depth FROM e GROUP BY 1, 2), b AS (SELECT unit, median(depth) AS base FROM x GROUP BY 1), m AS (SELECT chunk, median(depth - base) AS d FROM x JOIN b USING (unit) GROUP BY 1)
SELECT chunk, round(d - (SELECT arg_min(d, chunk) FROM m), 6) + 0.0 AS drift FROM m""")
def drift_alternation(spark, d):
    e = event_trains(spark, d)
    chunk = F.floor((F.col("t") - F.col("t0")) / (3 * D)).alias("chunk")
    return states.drift(e.crossJoin(F.broadcast(e.agg(F.min("t").alias("t0")))).groupBy((F.col("unit") % 20).alias("unit"), chunk).agg(F.avg("amp").alias("depth")))


ANCHOR = f"""k AS (SELECT event, unit, t, t0, (t - t0) // {D} AS k FROM e, (SELECT min(t) AS t0 FROM e)), x AS (SELECT *, unnest([k - 1, k, k + 1]) AS chunk FROM k),
l AS (SELECT event, chunk, CASE WHEN (event + chunk) % 5 = 0 THEN event % 5 ELSE (unit + chunk) % 5 END AS label FROM x WHERE chunk >= 0 AND t >= t0 + chunk * {D} - {8 * H} AND t < t0 + (chunk + 1) * {D} + {8 * H}),
c AS (SELECT a.chunk, a.label AS f, b.label AS g, count(*) AS n FROM l a JOIN l b ON a.event = b.event AND b.chunk = a.chunk + 1 GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY chunk, f) AS nf, sum(n) OVER (PARTITION BY chunk, g) AS ng, row_number() OVER (PARTITION BY chunk, f ORDER BY n DESC, g) AS rf, row_number() OVER (PARTITION BY chunk, g ORDER BY n DESC, f) AS rg FROM c),
h AS (SELECT chunk, f, g, n FROM w WHERE rf = 1 AND rg = 1 AND n >= 2 AND n >= 0.5 * nf AND n >= 0.5 * ng)"""


def chunk_anchors(spark, d):
    e = event_trains(spark, d)
    label = F.when((F.col("event") + F.col("chunk")) % 5 == 0, F.col("event") % 5).otherwise((F.col("unit") + F.col("chunk")) % 5)
    return graphs.anchors(trains.chunks(e).join(e.select("event", "unit"), "event").select("event", "chunk", label.alias("label")), least=2)


@query(f"WITH {E}, {ANCHOR} SELECT chunk, f, g, n FROM h")
def overlap_anchor(spark, d):
    return chunk_anchors(spark, d)


@query(f"""WITH RECURSIVE {E}, {ANCHOR}, q AS (SELECT chunk * 100 + f AS u, (chunk + 1) * 100 + g AS v FROM h), z AS (SELECT u, v FROM q UNION ALL SELECT v, u FROM q), r AS (SELECT u AS node, u AS c FROM z UNION SELECT z.v, r.c FROM r JOIN z ON z.u = r.node)
SELECT node, min(c) AS component FROM r GROUP BY 1""")
def gid_components(spark, d):
    return graphs.components(chunk_anchors(spark, d).select((F.col("chunk") * 100 + F.col("f")).alias("a"), ((F.col("chunk") + 1) * 100 + F.col("g")).alias("b")))


R = W + ", r AS (SELECT cluster, max(n) AS n, sqrt(sum(v)) AS radius, sqrt(sum(m * m)) AS energy FROM t GROUP BY 1)"


@query(f"WITH {R}, q AS (SELECT *, radius / (SELECT median(radius) FROM r) AS q FROM r) SELECT cluster, n, round(radius, 6) AS radius, round(energy, 6) AS energy, CASE WHEN q < 0.8 THEN 'under' WHEN q > 1.25 THEN 'over' ELSE 'like' END AS verdict FROM q")
def feature_radius(spark, d):
    return templates.radii(waves(spark, d))


@query(f"WITH {R}, l AS (SELECT log10(round(energy, 6)) AS x, log10(round(radius, 6)) AS y FROM r) SELECT count(*) AS n, round(regr_slope(y, x), 5) AS slope, round(corr(y, x) ** 2, 5) AS r2 FROM l")
def constancy(spark, d):
    return templates.constancy(templates.radii(waves(spark, d)))


@query(f"WITH {W} SELECT cluster, round(avg(v), 8) AS variance FROM (SELECT cluster, v FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY v DESC, k) <= 3) GROUP BY 1")
def top_variance(spark, d):
    return templates.top_variance(waves(spark, d))


@query("""WITH h AS (SELECT label AS cluster, ntile(2) OVER (PARTITION BY label ORDER BY vec_id) AS half, embedding::DOUBLE[] AS w FROM embeddings), x AS (SELECT cluster, half, unnest(range(1, 65)) AS k, unnest(w) AS x FROM h),
m AS (SELECT cluster, k, avg(x) FILTER (half = 1) AS a, avg(x) FILTER (half = 2) AS b FROM x GROUP BY 1, 2) SELECT cluster, round(1 - corr(a, b), 6) AS distance FROM m GROUP BY 1""")
def split_half_noise(spark, d):
    return templates.half_distance(waves(spark, d))


@query(f"""WITH {W}, n AS (SELECT cluster, sqrt(sum(m * m)) AS norm FROM t GROUP BY 1), p AS (SELECT a.cluster AS a, b.cluster AS b, s.s AS shift, round(sum(a.m * b.m) / (x.norm * y.norm), 6) AS cosine FROM t a CROSS JOIN (SELECT unnest(range(64)) AS s) s JOIN t b ON b.k = (a.k + s.s) % 64 AND a.cluster < b.cluster
JOIN n x ON x.cluster = a.cluster JOIN n y ON y.cluster = b.cluster GROUP BY 1, 2, 3, x.norm, y.norm) SELECT a, b, cosine, shift::INT AS shift FROM p QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY cosine DESC, shift) = 1""")
def rolled_cosine(spark, d):
    return templates.rolled_likeness(templates.templates(waves(spark, d)))


@query("""WITH c AS (SELECT user_id AS atom, event_id % 3 AS fiber, count(*) AS n FROM events WHERE user_id <> 0 GROUP BY 1, 2) SELECT atom, arg_max(fiber, (n, -fiber)) AS parent, sum(n)::BIGINT AS n, count(*) > 1 AS straddles FROM c GROUP BY 1""")
def lift_atoms(spark, d):
    e = table(spark, d, "events")
    return hierarchy.lifted(e.select(F.col("user_id").alias("atom"), (F.col("event_id") % 3).alias("fiber")))


@query(f"""WITH {W}, p AS (SELECT x.event, x.cluster, t.cluster AS other, round(sum((x.x - t.m) ** 2 / greatest(t.v, 1e-12)), 4) AS d FROM x JOIN t USING (k) GROUP BY 1, 2, 3),
s AS (SELECT event, cluster, max(d) FILTER (other = cluster) AS d2, arg_min(other, (d, other)) FILTER (other <> cluster AND d <= 70) AS near FROM p GROUP BY 1, 2) SELECT event, cluster, d2, CASE WHEN d2 <= 70 THEN cluster ELSE coalesce(near, 1) END AS label FROM s""")
def mahalanobis_gate(spark, d):
    return templates.gated(waves(spark, d), 70.0)


def scaled(spark, d):
    """Waveforms of many norms, as those of the table all have norm 1."""
    return waves(spark, d).withColumn("w", F.transform("w", lambda x: x * (1 + F.col("event") % 97 / 97.0)))


@query()
def curve_assignment(spark, d):
    w = scaled(spark, d)
    return curves.nearest(w, curves.fit(w)).select("event", "cluster", "best", F.round("residual", 6).alias("residual"), F.round("posterior", 6).alias("posterior"))


@query()
def exclusive_bundles(spark, d):
    """Labels of chunks, linked to those of the next two chunks by the events' order; two of a chunk never share a bundle."""
    a = chunk_anchors(spark, d).select((F.col("chunk") * 100 + F.col("f")).alias("a"), ((F.col("chunk") + 1) * 100 + F.col("g")).alias("b"), F.col("n").cast("double").alias("strength"))
    more = a.select("a", (F.col("b") - F.col("b") % 100 + (F.col("b") + 1) % 5).alias("b"), (F.col("strength") / 2).alias("strength"))
    links = a.union(more)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("chunk", F.floor(F.col("node") / 100))
    return graphs.exclusive_bundles(nodes, links)
