"""Named queries of waveforms: an embedding stands for 16 samples of 4 channels, sample by sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from .named import query
from .operators import bundles, envelopes, mixtures, places, templates
from .operators import waves as kernels
from .sources.tables import waves

S, C = 16, 4
X = "x AS (SELECT vec_id AS event, label AS cluster, unnest(range(64)) // 4 AS s, unnest(range(64)) % 4 AS c, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"
T = X + ", t AS (SELECT cluster, s, c, avg(x) AS m FROM x GROUP BY 1, 2, 3), pp AS (SELECT cluster, c, max(m) - min(m) AS p FROM t GROUP BY 1, 2)"


def counts(spark, d):
    """Waves in whole steps of a converter, some beyond its range."""
    return waves(spark, d).withColumn("w", F.transform("w", lambda x: F.round(x * 20_000)))


@query(f"""WITH {X}, r AS (SELECT event, s, c, round(x * 20000) AS r FROM x), d AS (SELECT event, s, c, greatest(-32768, least(32767, 4 * r - sum(r) OVER (PARTITION BY event, s))) AS d FROM r),
e AS (SELECT event, s, c, greatest(-32768, least(32767, d - lag(d) OVER (PARTITION BY event, c ORDER BY s)))::INT AS v FROM d) SELECT event, string_agg(v::VARCHAR, ',' ORDER BY s, c) AS w FROM e WHERE s > 0 GROUP BY 1""")
def stderiv_transform(spark, d):
    return kernels.derivative(counts(spark, d), S, C).withColumn("w", F.array_join("w", ","))


@query(f"""WITH {X}, r AS (SELECT event, s, c, round(x * 20000) AS r FROM x), d AS (SELECT a.event, a.s, a.c, greatest(-32768, least(32767, a.r - b.r)) AS d FROM r a JOIN r b ON a.event = b.event AND a.s = b.s AND b.c = least(a.c + 1, 3)),
e AS (SELECT event, s, c, greatest(-32768, least(32767, d - lag(d) OVER (PARTITION BY event, c ORDER BY s)))::INT AS v FROM d) SELECT event, string_agg(v::VARCHAR, ',' ORDER BY s, c) AS w FROM e WHERE s > 0 GROUP BY 1""")
def stderiv_partners(spark, d):
    return kernels.derivative(counts(spark, d), S, C, partner=[1, 2, 3, 3]).withColumn("w", F.array_join("w", ","))


@query(f"""WITH {X}, p AS (SELECT event, c, max(x) - min(x) AS p, arg_min(s, (x, s)) AS low FROM x GROUP BY 1, 2), b AS (SELECT event, arg_max(low, (p, -c)) AS low FROM p GROUP BY 1)
SELECT event, round(sum(x * (((s - low + 8 + 64) % 16) * 4 + c + 1)), 5) AS digest FROM x JOIN b USING (event) GROUP BY 1""")
def mutual_center(spark, d):
    """Told by the sum of values by their places."""
    w = kernels.centred(waves(spark, d), S, C, 8)
    return w.select("event", F.round(F.aggregate(F.transform("w", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("digest"))


@query(f"""WITH {X}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY event, c ORDER BY s) AS d FROM x), k AS (SELECT *, d - avg(d) OVER (PARTITION BY event, c) AS dc, x - avg(x) OVER (PARTITION BY event, c) AS a FROM d),
ch AS (SELECT event, c, max(abs(dc)) AS pk, sqrt(avg(dc ** 2)) AS dr, sqrt(avg(a ** 2)) AS rms, max(abs(a)) AS top FROM k GROUP BY 1, 2), z AS (SELECT event, arg_max((dr / greatest(rms, 1e-6)), (pk, -c)) AS hf, arg_max((pk / greatest(dr, 1e-6)), (pk, -c)) AS crest, max(top) AS peak FROM ch GROUP BY 1)
SELECT event, round(hf, 6) AS hf, round(crest, 6) AS crest, round(peak, 6) AS peak, (hf > 1.4 AND crest > 1.8) OR peak >= 0.4 AS artifact FROM z""")
def artifact_flags(spark, d):
    a = kernels.artifacts(waves(spark, d), S, C, 1.4, 1.8, 0.4)
    return a.select("event", *(F.round(k, 6).alias(k) for k in ("hf", "crest", "peak")), "artifact")


@query(f"""WITH {X}, k AS (SELECT event, s, c, x - avg(x) OVER (PARTITION BY event, c) AS x FROM x), r AS (SELECT event, s, c, x, lag(x, 1, NULL) OVER (PARTITION BY event, c ORDER BY s) AS l, last_value(x) OVER (PARTITION BY event, c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM k)
SELECT event, round(1 - sum(x * coalesce(l, z)) / sum(x * x), 6) AS complexity FROM r GROUP BY 1""")
def waveform_complexity(spark, d):
    return kernels.footprints(waves(spark, d), S, C).select("event", F.round("complexity", 6).alias("complexity"))


@query(f"""WITH {X}, p AS (SELECT event, c, max(x) - min(x) AS p FROM x GROUP BY 1, 2), m AS (SELECT event, max(p) + 1e-12 AS m FROM p GROUP BY 1), e AS (SELECT event, s, sqrt(avg(x * x)) AS e FROM x GROUP BY 1, 2), k AS (SELECT event, round_even(sum(s * e) / sum(e), 0)::BIGINT AS centre FROM e GROUP BY 1)
SELECT event, bool_or(c IN (0, 3) AND p >= 0.5 * m) AS truncated, any_value(centre) AS centre FROM p JOIN m USING (event) JOIN k USING (event) GROUP BY 1""")
def truncation(spark, d):
    return kernels.footprints(waves(spark, d), S, C).select("event", "truncated", "centre")


@query(f"WITH {T} SELECT cluster, round(sum(p * c * 20) / sum(p), 6) AS depth FROM pp GROUP BY 1")
def depth_centroid(spark, d):
    t = templates.templates(waves(spark, d))
    p = t.select("cluster", F.posexplode("w").alias("k", "x")).groupBy("cluster", (F.col("k") % C).alias("c")).agg((F.max("x") - F.min("x")).alias("p"))
    return p.groupBy("cluster").agg(F.round(F.sum(F.col("p") * F.col("c") * 20) / F.sum("p"), 6).alias("depth"))


@query(f"""WITH {T}, b AS (SELECT cluster, arg_max(c, (p, -c)) AS c, max(p) AS a FROM pp GROUP BY 1), r AS (SELECT x.cluster, x.event, a, x.x - m AS r FROM x JOIN b USING (cluster, c) JOIN t USING (cluster, s, c)), q AS (SELECT cluster, median(r) AS q FROM r GROUP BY 1)
SELECT cluster, count(DISTINCT event) AS n, round(any_value(a), 6) AS amplitude, round(any_value(a) / (2 * 1.4826 * median(abs(r - q))), 5) AS snr FROM r JOIN q USING (cluster) GROUP BY 1""")
def unit_snr(spark, d):
    return kernels.noise(waves(spark, d), C).select("cluster", "n", F.round("amplitude", 6).alias("amplitude"), F.round("snr", 5).alias("snr"))


@query(f"""WITH {X}, b AS (SELECT event, cluster, ntile(4) OVER (PARTITION BY cluster ORDER BY (event * 7919) % 10007, event) - 1 AS block FROM (SELECT DISTINCT event, cluster FROM x) QUALIFY count(*) OVER (PARTITION BY cluster) >= 32), m AS (SELECT x.cluster, block, s, c, avg(x) AS m FROM x JOIN b USING (event) GROUP BY 1, 2, 3, 4)
SELECT p.cluster, p.block AS a, q.block AS b, round(1 - sum(p.m * q.m) / sqrt(sum(p.m ** 2) * sum(q.m ** 2)), 6) AS distance FROM m p JOIN m q ON p.cluster = q.cluster AND p.s = q.s AND p.c = q.c AND p.block < q.block GROUP BY 1, 2, 3""")
def time_budget(spark, d):
    w = waves(spark, d)
    t = w.select("event", (F.col("event") * 7919 % 10007).alias("t"))
    return kernels.time_blocks(w, t, 4).withColumn("distance", F.round("distance", 6))


@query(f"WITH {T}, r AS (SELECT x.cluster, x.event, sum((x - m) ** 2) AS r FROM x JOIN t USING (cluster, s, c) GROUP BY 1, 2) SELECT cluster, round(quantile_cont(r, 0.999) / greatest(avg(r), 1e-30), 6) AS index FROM r GROUP BY 1")
def tail_index(spark, d):
    return kernels.tails(waves(spark, d)).withColumn("index", F.round("index", 6))


@query(f"""WITH {T}, l AS (SELECT unnest(range(-4, 5)) AS l), d AS (SELECT a.cluster AS a, b.cluster AS b, l, sum(a.m * b.m) AS d FROM t a CROSS JOIN l JOIN t b ON b.s = (a.s - l + 16) % 16 AND a.c = b.c AND a.cluster < b.cluster GROUP BY 1, 2, 3), n AS (SELECT cluster, sum(m * m) AS n FROM t GROUP BY 1),
g AS (SELECT cluster, avg(m) AS g FROM t GROUP BY 1), z AS (SELECT a.cluster AS a, b.cluster AS b, 1 - sum((a.m - x.g) * (b.m - y.g)) / sqrt(sum((a.m - x.g) ** 2) * sum((b.m - y.g) ** 2)) AS centred FROM t a JOIN t b ON a.s = b.s AND a.c = b.c AND a.cluster < b.cluster JOIN g x ON x.cluster = a.cluster JOIN g y ON y.cluster = b.cluster GROUP BY 1, 2),
k AS (SELECT a.cluster AS a, b.cluster AS b, corr(a.p, b.p) AS loudness FROM pp a JOIN pp b ON a.c = b.c AND a.cluster < b.cluster GROUP BY 1, 2)
SELECT a, b, round(max(d) / sqrt(x.n * y.n), 5) AS shifted_cosine, round(greatest(0, max(least(d / x.n, d / y.n))), 5) AS match, round(any_value(loudness), 5) AS loudness, round(any_value(centred), 5) AS centred FROM d JOIN n x ON x.cluster = a JOIN n y ON y.cluster = b JOIN k USING (a, b) JOIN z USING (a, b) GROUP BY a, b, x.n, y.n""")
def pair_measures(spark, d):
    t = templates.templates(waves(spark, d))
    pairs = t.select(F.col("cluster").alias("a"), F.col("w").alias("v")).join(t.select(F.col("cluster").alias("b"), "w"), F.col("a") < F.col("b"))
    return kernels.pair_measures(pairs.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "v", "w"), S, C).select("a", "b", *(F.round(k, 5).alias(k) for k in ("shifted_cosine", "match", "loudness", "centred")))


@query()
def aligned_waves(spark, d):
    return kernels.aligned(waves(spark, d), S, C).withColumn("w", F.transform("w", lambda x: F.round(x, 6)))


@query()
def contamination_scan(spark, d):
    w = kernels.contamination(waves(spark, d), S, C, 8, least=20)
    return w.select("cluster", "n", *(F.round(k, 6).alias(k) for k in ("bc", "null95", "excess", "sub_cos")), "nature")


@query()
def curve_statistics(spark, d):
    return kernels.curve_statistics(waves(spark, d).withColumn("w", F.transform("w", lambda x: x * (1 + F.col("event") % 97 / 97.0))), S, C)


@query()
def directional_mean_shift(spark, d):
    """A chunk is a hundred waves."""
    return kernels.mean_shift(waves(spark, d).withColumn("w", F.transform("w", lambda x: x * (1 + F.col("event") % 97 / 97.0))).withColumn("cluster", F.floor(F.col("event") / 100)), S, C, least=20, band=1.0, near_radius=9.0)


@query()
def classification_mixture(spark, d):
    """The first four values of a waveform, moved for each third of the clusters."""
    x = waves(spark, d).select("event", F.transform(F.slice("w", 1, 4), lambda v, k: v + F.when(k == F.col("cluster") % 3, 2.0).otherwise(0.0)).alias("x"))
    return mixtures.mixture(x, 4, rounds=8)


@query()
def dip_split(spark, d):
    return kernels.split_by_dip(waves(spark, d), S, C, least=20)


@query()
def mixture_split(spark, d):
    return kernels.split_by_mixture(waves(spark, d), S, C, 3, 4)


@query()
def residual_split(spark, d):
    return kernels.split_by_residual(waves(spark, d).withColumn("w", F.transform("w", lambda x: x * (1 + F.col("event") % 97 / 97.0))), S, C, least=20)


@query()
def basis_projection(spark, d):
    w = waves(spark, d)
    f = kernels.projections(w, S, C, kernels.fitted_basis(w, S, C, 2, 12, 2))
    return f.withColumn("f", F.transform("f", lambda x: F.round(x, 6)))


@query()
def loop_shapes(spark, d):
    return kernels.loops(waves(spark, d), S, C).select("event", F.transform("shape", lambda x: F.round(x, 6)).alias("shape"), F.round("size", 6).alias("size"), F.round("turn", 6).alias("turn"))


SITES = [(0.0, 0.0), (16.0, 20.0), (0.0, 40.0), (16.0, 60.0)]


@query(f"""WITH {X}, p AS (SELECT event, cluster, c, max(x) - min(x) AS p FROM x GROUP BY 1, 2, 3), m AS (SELECT cluster, c, median(p) AS p FROM p GROUP BY 1, 2)
SELECT cluster, round(max(p) FILTER (c = 0), 6) AS p0, round(max(p) FILTER (c = 1), 6) AS p1, round(max(p) FILTER (c = 2), 6) AS p2, round(max(p) FILTER (c = 3), 6) AS p3, arg_max(c, (p, -c)) IN (0, 3) AS one_flank FROM m GROUP BY 1""")
def amplitude_profile(spark, d):
    p = places.profiles(waves(spark, d), S, C)
    loudest = F.array_position("p", F.array_max("p"))
    return p.select("cluster", *(F.round(F.col("p")[k], 6).alias(f"p{k}") for k in range(C)), loudest.isin(1, C).alias("one_flank"))


@query()
def unit_positions(spark, d):
    w = waves(spark, d)
    return places.located(w, S, C, SITES, basis=places.common_basis(w, S, C)).drop("template")


@query()
def event_positions(spark, d):
    w = waves(spark, d)
    return places.event_places(w.select(F.col("event").alias("spike_idx"), F.col("cluster").alias("label")), places.located(w, S, C, SITES, kind="ptp"))


def louder(spark, d):
    """Waves of many amplitudes."""
    return waves(spark, d).withColumn("w", F.transform("w", lambda x: x * (F.col("event") * 7919 % 1000 / 250 + 1)))


@query(f"""WITH {X}, v AS (SELECT vec_id AS event, label AS cluster, embedding::DOUBLE[] AS w, vec_id * 7919 % 1000 / 250 + 1 AS g FROM embeddings), p AS (SELECT a.cluster, sqrt(list_dot_product(a.w, a.w)) * a.g AS m, sqrt(list_dot_product(b.w, b.w)) * b.g AS n,
greatest(-1, least(1, list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)))) AS c FROM v a JOIN v b ON a.cluster = b.cluster AND a.event < b.event), r AS (SELECT greatest(m, n) / least(m, n) AS ratio, 1 - c AS distance FROM p),
lim AS (SELECT greatest(min(ratio), 1 + 1e-6) AS lo, greatest(max(ratio), 1 + 1e-5) AS hi FROM r), e AS (SELECT 0 AS k, 1.0 AS edge UNION ALL SELECT i + 1, CASE i WHEN 0 THEN lo WHEN 7 THEN hi ELSE lo * (hi / lo) ** (i / 7.0) END FROM lim, unnest(range(8)) t(i)),
b AS (SELECT *, coalesce(lead(edge) OVER (ORDER BY k), 'inf'::DOUBLE) AS up FROM e), q AS (SELECT k, any_value(edge) AS edge, CASE WHEN count(distance) >= 5 THEN quantile_cont(distance, 0.99) ELSE 0 END AS q FROM b LEFT JOIN r ON ratio >= edge AND ratio < up GROUP BY 1)
SELECT k, round(edge, 6) AS edge, round(greatest(0, max(q) OVER (ORDER BY k)), 6) AS most FROM q""")
def envelope_bands(spark, d):
    return envelopes.limits_of_all(louder(spark, d)).select(F.col("k").cast("bigint").alias("k"), F.round("edge", 6).alias("edge"), F.round("distance", 6).alias("most"))


@query("""WITH v AS (SELECT vec_id AS event, label AS cluster, embedding::DOUBLE[] AS w, vec_id * 7919 % 1000 / 250 + 1 AS g FROM embeddings), n AS (SELECT event, cluster, sqrt(list_dot_product(w, w)) * g AS size, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u FROM v),
q AS (SELECT cluster, quantile_cont(size, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM n GROUP BY 1), b AS (SELECT cluster, len(list_filter(cuts, lambda c: c <= size)) AS band, unnest(range(64)) AS k, unnest(u) AS u FROM n JOIN q USING (cluster)),
m AS (SELECT cluster, k, avg(u) AS m, sum(u * u) AS uu, count(*) AS n FROM b GROUP BY 1, 2), g AS (SELECT cluster, band, k, avg(u) AS g, count(*) AS c FROM b GROUP BY 1, 2, 3), t AS (SELECT cluster, sum(uu - n * m * m) AS scatter FROM m GROUP BY 1)
SELECT cluster::BIGINT AS cluster, round(sum(c * (g - m) ** 2) / any_value(scatter), 6) AS share, round(any_value(scatter), 6) AS scatter FROM g JOIN m USING (cluster, k) JOIN t USING (cluster) GROUP BY 1""")
def along_curve(spark, d):
    return envelopes.along_curve(louder(spark, d)).select("cluster", F.round("share", 6).alias("share"), F.round("scatter", 6).alias("scatter"))


@query()
def bundle_drift(spark, d):
    w = waves(spark, d)
    return bundles.bundle_table(w.select(F.col("cluster").alias("gid"), F.col("event").alias("chunk"), F.col("event").cast("double").alias("t"), F.lit(1).alias("n"), F.col("w").alias("curve")), C).drop("mean_bend", "mean_r_cv")
