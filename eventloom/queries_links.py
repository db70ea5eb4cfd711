"""Named queries of tracks over time and of waveforms among noise: chunks found from spans, what follows what, drift, links, labels of many draws, outliers, baselines, collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .named import D, E, G, H, query
from .operators import adaptation, baseline, collisions, consensus, continuity, linkage, neighbours, paths, robust, templates, trains
from .sources.tables import table, trains as event_trains, waves

#: Tracks: a unit between two pauses of six hours, numbered by the unit and the pauses before.
PAUSE = 6 * H
TRACKS = f"{G}, r AS (SELECT *, sum((coalesce(gap, 0) > {PAUSE})::INT) OVER (PARTITION BY unit ORDER BY t, event) AS k FROM g), tr AS (SELECT unit * 100000 + k::BIGINT AS track, count(*) AS n, min(t) AS lo, max(t) AS hi, avg(amp) AS level FROM r GROUP BY 1)"


def tracks(spark, d) -> DataFrame:
    g = trains.gaps(event_trains(spark, d))
    k = F.sum((F.coalesce("gap", F.lit(0)) > PAUSE).cast("long")).over(Window.partitionBy("unit").orderBy("t", "event"))
    return continuity.spans(g.withColumn("track", F.col("unit") * 100000 + k), "track")


#: Labels made day by day: a unit's events of a day.
DAYS = f"{E}, dy AS (SELECT (t // {D}) * 100000 + unit AS track, count(*) AS n, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1)"


def days(spark, d) -> DataFrame:
    return continuity.spans(event_trains(spark, d).withColumn("track", F.floor(F.col("t") / D) * 100000 + F.col("unit")), "track")


@query(f"""WITH {DAYS}, b AS (SELECT *, (lo > max(hi) OVER (ORDER BY lo, track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS begins FROM dy), c AS (SELECT track, n, lo, hi, sum(coalesce(begins, 0)) OVER (ORDER BY lo, track)::BIGINT AS chunk FROM b),
w AS (SELECT chunk, sum(n) AS n, min(lo) AS lo, max(hi) AS hi FROM c GROUP BY 1) SELECT track, chunk, round((c.n / nullif(c.hi - c.lo, 0)) / (w.n / nullif(w.hi - w.lo, 0)), 5) AS rate FROM c JOIN w USING (chunk)""")
def span_chunks(spark, d):
    return continuity.relative_rates(continuity.span_chunks(days(spark, d))).withColumn("rate", F.round("rate", 5))


@query(f"""WITH {TRACKS}, p AS (SELECT a.track AS a, b.track AS b, b.lo - a.hi AS gap, abs(a.level - b.level) AS s FROM tr a JOIN tr b ON b.lo > a.hi AND b.lo - a.hi <= {PAUSE} AND a.track <> b.track),
q AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s, a) AS rb FROM p) SELECT a, b, gap, round(s, 6) AS apart FROM q WHERE ra = 1 AND rb = 1""")
def track_successors(spark, d):
    return continuity.successors(tracks(spark, d), PAUSE).select("a", "b", "gap", F.round("apart", 6).alias("apart"))


#: Atoms: a unit's events of a day; a label is a run of days without a day between. Depth is the mean amplitude, the signature counts of the five kinds.
KINDS = ("click", "error", "purchase", "signup", "view")
ATOMS = f"""{E}, ad AS (SELECT unit AS local, t // {D} AS chunk, avg(amp) AS depth, [{", ".join(f"count(*) FILTER (kind = '{k}')::DOUBLE" for k in KINDS)}] AS sig FROM e GROUP BY 1, 2),
ar AS (SELECT *, chunk - row_number() OVER (PARTITION BY local ORDER BY chunk) AS run FROM ad), am AS (SELECT local * 1000000 + min(chunk) OVER (PARTITION BY local, run) AS gid, chunk, local, depth, sig FROM ar)"""


def atoms(spark, d) -> DataFrame:
    e = event_trains(spark, d).withColumn("chunk", F.floor(F.col("t") / D))
    a = e.groupBy(F.col("unit").alias("local"), "chunk").agg(continuity.in_order("event", "amp", mean=True).alias("depth"), F.array(*(F.count(F.when(F.col("kind") == k, 1)).cast("double") for k in KINDS)).alias("sig"))
    run = F.col("chunk") - F.row_number().over(Window.partitionBy("local").orderBy("chunk"))
    a = a.withColumn("run", run)
    return a.withColumn("gid", F.col("local") * 1000000 + F.min("chunk").over(Window.partitionBy("local", "run"))).select("gid", "chunk", "local", "depth", "sig")


BRIDGES = f"""{ATOMS}, st AS (SELECT b.chunk, median(b.depth - a.depth) AS step FROM am a JOIN am b ON a.gid = b.gid AND b.chunk = a.chunk + 1 GROUP BY 1), us AS (SELECT coalesce(median(step), 0) AS usual FROM st),
ed AS (SELECT gid, min(chunk) AS c0, arg_min(depth, chunk) AS z0, arg_min(sig, chunk) AS s0, max(chunk) AS c1, arg_max(depth, chunk) AS z1, arg_max(sig, chunk) AS s1 FROM am GROUP BY 1),
wy AS (SELECT gid, c1, z1, s1, k, unnest(range(c1 + 1, c1 + k + 1)) AS c FROM ed, unnest(range(1, 4)) u(k)), pd AS (SELECT gid, any_value(c1) + k AS c, k, any_value(z1) + sum(coalesce(step, usual)) AS pred, any_value(s1) AS s1 FROM wy LEFT JOIN st ON st.chunk = wy.c CROSS JOIN us GROUP BY gid, k),
cd AS (SELECT pd.gid AS a, ed.gid AS b, abs(pred - z0) AS er, list_dot_product(pd.s1, s0) / (sqrt(list_dot_product(pd.s1, pd.s1)) * sqrt(list_dot_product(s0, s0)) + 1e-12) AS cs FROM pd JOIN ed ON ed.c0 = pd.c AND abs(pred - z0) <= 2.0 * k AND pd.gid <> ed.gid),
br AS (SELECT b AS gid, arg_min(a, (er - 5 * cs, a)) AS onto, min(er - 5 * cs) AS score FROM cd WHERE cs >= 0.8 GROUP BY 1)"""


@query(f"WITH {BRIDGES} SELECT gid, onto, round(score, 5) AS score FROM br")
def label_bridges(spark, d):
    return continuity.bridges(atoms(spark, d), gate=2.0, least=0.8, gap=3).withColumn("score", F.round("score", 5))


@query(f"""WITH RECURSIVE {BRIDGES}, up AS (SELECT gid, gid AS top FROM am GROUP BY 1 UNION SELECT up.gid, br.onto FROM up JOIN br ON br.gid = up.top), hd AS (SELECT up.gid, top AS head FROM up LEFT JOIN br ON br.gid = up.top WHERE br.gid IS NULL)
SELECT gid, min(gid) OVER (PARTITION BY head) AS root FROM hd""")
def continued_labels(spark, d):
    a = atoms(spark, d)
    return continuity.continued(a, continuity.bridges(a, gate=2.0, least=0.8, gap=3))


#: Units: a waveform in one of six chunks, its depth (of peaks to peaks of four channels, 20 apart) sinking by 3 a chunk.
UNITS = """x AS (SELECT vec_id AS unit, vec_id % 6 AS chunk, unnest(range(64)) % 4 AS c, unnest(embedding::DOUBLE[]) AS v FROM embeddings), pp AS (SELECT unit, chunk, c, max(v) - min(v) AS p FROM x GROUP BY 1, 2, 3),
un AS (SELECT unit, chunk, sum(p * (c % 2)) / sum(p) AS x, sum(p * c * 20) / sum(p) + 3 * chunk AS y, max(p) AS z, ln(sum(p)) AS loga, any_value(e.embedding::DOUBLE[]) AS w FROM pp JOIN embeddings e ON e.vec_id = unit GROUP BY 1, 2),
sd AS (SELECT stddev_pop(x) + 1e-9 AS sx, stddev_pop(y) + 1e-9 AS sy, stddev_pop(z) + 1e-9 AS sz, stddev_pop(loga) + 1e-9 AS sa FROM un), s0 AS (SELECT DISTINCT chunk, 0.0::DOUBLE AS step FROM un)"""


def turn(k: int) -> str:
    return f"""n{k} AS (SELECT a.unit AS a, b.unit AS b, b.chunk, sqrt(((a.y - b.y + step) / sy) ** 2 + ((a.x - b.x) / sx) ** 2 + ((a.z - b.z) / sz) ** 2 + ((a.loga - b.loga) / sa) ** 2) AS d, b.y - a.y AS rise, list_dot_product(a.w, b.w) / (sqrt(list_dot_product(a.w, a.w)) * sqrt(list_dot_product(b.w, b.w)) + 1e-12) AS cs
FROM un a JOIN un b ON b.chunk = a.chunk + 1 JOIN s{k - 1} s ON s.chunk = b.chunk, sd), m{k} AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM n{k}),
l{k} AS (SELECT * FROM m{k} WHERE ra = 1 AND rb = 1 AND d <= 1.5 AND cs >= 0.1), s{k} AS (SELECT s.chunk, coalesce(m, step) AS step FROM s{k - 1} s LEFT JOIN (SELECT chunk, median(rise) AS m FROM l{k} GROUP BY 1) USING (chunk))"""


def units(spark, d) -> DataFrame:
    w = waves(spark, d).select(F.col("event").alias("unit"), (F.col("event") % 6).alias("chunk"), "w")
    pp = w.select("unit", "chunk", F.posexplode("w").alias("i", "v")).groupBy("unit", "chunk", (F.col("i") % 4).alias("c")).agg((F.max("v") - F.min("v")).alias("p"))
    at = pp.groupBy("unit", "chunk").agg((F.sum(F.col("p") * (F.col("c") % 2)) / F.sum("p")).alias("x"), (F.sum(F.col("p") * F.col("c") * 20) / F.sum("p") + 3 * F.col("chunk")).alias("y"), F.max("p").alias("z"), F.log(F.sum("p")).alias("loga"))
    return at.join(w.drop("chunk"), "unit")


@query(f"WITH {UNITS}, {turn(1)}, {turn(2)}, {turn(3)} SELECT a, b, chunk, round(d, 5) AS distance, round(cs, 5) AS cos FROM l3")
def drifting_links(spark, d):
    links, _ = continuity.session_links(units(spark, d), rounds=3, least=0.1, settle=-1.0)
    return links.select("a", "b", "chunk", F.round("distance", 5).alias("distance"), F.round("cos", 5).alias("cos"))


@query(f"WITH {UNITS}, {turn(1)}, {turn(2)}, {turn(3)} SELECT chunk, round(step, 5) + 0.0 AS step FROM s3")
def drifting_steps(spark, d):
    return continuity.session_links(units(spark, d), rounds=3, least=0.1, settle=-1.0)[1].withColumn("step", F.round("step", 5) + 0.0)


#: Five labellings of the events, each with about an eighth of them labelled otherwise.
DRAWS = tuple((k, 7919 + 104 * k, 13 * k + 5) for k in range(5))
DRAWN = "dr AS (" + " UNION ALL ".join(f"SELECT event_id AS event, {k} AS draw, CASE WHEN (event_id * {m} + {c}) % 97 < 12 THEN (user_id + 1 + {k}) % 10 ELSE user_id % 10 END AS label FROM events" for k, m, c in DRAWS) + ")"


def draws(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    off = lambda k, m, c: F.when((F.col("event_id") * m + c) % 97 < 12, (F.col("user_id") + 1 + k) % 10).otherwise(F.col("user_id") % 10)
    return e.select(F.col("event_id").alias("event"), F.explode(F.array(*(F.struct(F.lit(k).alias("draw"), off(k, m, c).alias("label")) for k, m, c in DRAWS))).alias("l")).select("event", "l.draw", "l.label")


@query(f"""WITH RECURSIVE {DRAWN}, si AS (SELECT event, list(label ORDER BY draw) AS s FROM dr GROUP BY 1), gr AS (SELECT s, min(event) AS first, count(*) AS n FROM si GROUP BY 1),
ln AS (SELECT a.first AS a, b.first AS b FROM gr a JOIN gr b ON len(list_filter(range(1, 6), lambda i: a.s[i] = b.s[i])) >= 4), rc AS (SELECT a AS node, a AS low FROM ln UNION SELECT ln.b, rc.low FROM rc JOIN ln ON ln.a = rc.node WHERE rc.low <= ln.b),
cp AS (SELECT node, min(low) AS c FROM rc GROUP BY 1), ev AS (SELECT si.event, cp.c FROM si JOIN gr USING (s) JOIN cp ON cp.node = gr.first), vt AS (SELECT c, count(*) AS size FROM ev GROUP BY 1)
SELECT event, c AS consensus, size FROM ev JOIN vt USING (c)""")
def consensus_labels(spark, d):
    return consensus.consensus(draws(spark, d), 5, 4)


@query(f"""WITH {DRAWN}, vo AS (SELECT event, label, count(*) AS n, min(draw) AS first FROM dr GROUP BY 1, 2) SELECT event, arg_max(label, (n, -label)) AS label, round(max(n) / 5, 6) AS share FROM vo GROUP BY 1""")
def majority_labels(spark, d):
    return consensus.majority(draws(spark, d)).withColumn("share", F.round("share", 6))


@query()
def robust_outliers(spark, d):
    """The first six values of a waveform, five times as far out for one in nine; clusters are numbered from 2."""
    x = waves(spark, d).select("event", (F.col("cluster") + 2).alias("cluster"), F.transform(F.slice("w", 1, 6), lambda v: v * F.when(F.col("event") % 9 == 0, 5.0).otherwise(1.0)).alias("x"))
    return robust.rejected(x, least=20).withColumn("d2", F.round("d2", 4))


#: A signal of four channels: each waveform is a block of 16 samples; chunks are thirds of it, and one block in seven has an event at its fifth sample.
BLOCKS = """bw AS (SELECT vec_id % 3 AS chunk, vec_id * 16 + 4 * s AS start, [embedding[16 * s + k + 1]::DOUBLE for k in range(16)] AS x FROM embeddings, unnest(range(4)) u(s)), be AS (SELECT vec_id % 3 AS chunk, vec_id * 16 + 4 AS t FROM embeddings WHERE vec_id % 7 = 0),
bq AS (SELECT * FROM bw WHERE NOT EXISTS (SELECT 1 FROM be WHERE be.chunk = bw.chunk AND be.t BETWEEN bw.start - 3 AND bw.start + 4 + 3))"""


def noise(spark, d):
    w = waves(spark, d).select((F.col("event") % 3).alias("chunk"), (F.col("event") * 16).alias("t0"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: F.slice("w", 4 * s + 1, F.lit(4))).alias("samples"))
    events = w.where(F.col("t0") / 16 % 7 == 0).select("chunk", (F.col("t0") + 4).alias("t"))
    return w, events


@query(f"""WITH {BLOCKS}, m AS (SELECT chunk, count(*) AS n, [{", ".join(f"avg(x[{k}])" for k in range(1, 17))}] AS m FROM bq GROUP BY 1), c AS (SELECT chunk, [x[k + 1] - m[k + 1] for k in range(16)] AS d FROM bq JOIN m USING (chunk)),
f AS (SELECT chunk, avg(list_dot_product(d, d) ** 2) AS spread FROM c GROUP BY 1), v AS (SELECT chunk, i, j, avg(d[i + 1] * d[j + 1]) AS v FROM c, unnest(range(16)) a(i), unnest(range(16)) b(j) GROUP BY 1, 2, 3),
q AS (SELECT chunk, sum(v * v) AS sq, sum(v) FILTER (i = j) / 16 AS mu FROM v GROUP BY 1), s AS (SELECT chunk, n, mu, (sq - 16 * mu * mu) / 16 AS apart, (spread - sq) / (16 * n) AS error FROM q JOIN f USING (chunk) JOIN m USING (chunk)),
h AS (SELECT chunk, n, mu, CASE WHEN least(error, apart) <= 0 THEN 0 ELSE least(error, apart) / apart END AS share FROM s)
SELECT v.chunk, n, round(share, 5) AS shrinkage, i, j, round((1 - share) * v + CASE WHEN i = j THEN share * mu ELSE 0 END, 6) + 0.0 AS covariance FROM v JOIN h USING (chunk)""")
def baseline_covariance(spark, d):
    signal, events = noise(spark, d)
    b = baseline.baseline(signal, events, 4, 3)
    return b.select("chunk", "n", F.round("shrinkage", 5).alias("shrinkage"), F.posexplode("covariance").alias("at", "v")).select("chunk", "n", "shrinkage", F.floor(F.col("at") / 16).alias("i"), (F.col("at") % 16).cast("bigint").alias("j"), (F.round("v", 6) + 0.0).alias("covariance"))


#: Templates of the ten clusters, rolled by up to two of sixteen samples.
COLLIDE = """x AS (SELECT vec_id AS event, label AS cluster, embedding::DOUBLE[] AS w FROM embeddings), tk AS (SELECT cluster, k, avg(w[k + 1]) AS m FROM x, unnest(range(64)) u(k) GROUP BY 1, 2),
tb AS (SELECT cluster, s, list(m ORDER BY k) AS w FROM (SELECT cluster, s, (k + 4 * s + 64) % 64 AS k, m FROM tk, unnest(range(-2, 3)) u(s)) GROUP BY 1, 2), nb AS (SELECT *, list_dot_product(w, w) + 1e-12 AS g FROM tb),
f1 AS (SELECT event, x.w, nb.cluster AS k1, nb.w AS u, nb.g, list_dot_product(x.w, nb.w) AS p FROM x, nb WHERE s = 0 QUALIFY row_number() OVER (PARTITION BY event ORDER BY p * p / g DESC, k1) = 1),
l1 AS (SELECT event, k1, p / g AS a1, [w[k + 1] - p / g * u[k + 1] for k in range(64)] AS r FROM f1), f2 AS (SELECT event, k1, a1, r, nb.cluster AS k2, s, nb.g, list_dot_product(r, nb.w) AS p FROM l1, nb WHERE nb.cluster <> k1 QUALIFY row_number() OVER (PARTITION BY event ORDER BY p * p / g DESC, k2, s) = 1)"""


@query(f"WITH {COLLIDE} SELECT event, k1::BIGINT AS k1, round(a1, 5) AS a1, k2::BIGINT AS k2, s::BIGINT AS shift2, round(p / g, 5) AS a2, round(sqrt(list_dot_product(r, r)), 5) AS r1, round(p * p / g / (list_dot_product(r, r) + 1e-12), 5) AS gain FROM f2")
def collision_pairs(spark, d):
    w = waves(spark, d)
    held = collisions.bank(templates.templates(w), 4, range(-2, 3))
    return collisions.decomposed(w, held).select("event", "k1", F.round("a1", 5).alias("a1"), "k2", F.col("shift2").cast("bigint").alias("shift2"), F.round("a2", 5).alias("a2"), F.round("r1", 5).alias("r1"), F.round("gain", 5).alias("gain"))


TAUS = (2 * H, 8 * H, D)


@query(f"""WITH {E}, ld AS (SELECT x.event, x.unit, x.amp, x.t, k.tau, coalesce(sum(exp(-(x.t - y.t) / k.tau::DOUBLE)), 0) AS a FROM e x CROSS JOIN (SELECT unnest([{", ".join(map(str, TAUS))}]) AS tau) k LEFT JOIN e y ON y.unit = x.unit AND (y.t, y.event) < (x.t, x.event) GROUP BY ALL),
rk AS (SELECT event, row_number() OVER (PARTITION BY unit ORDER BY amp, t, event) AS r FROM e), cr AS (SELECT unit, tau, count(*) AS n, corr(a, -r) AS c, regr_slope(amp, a) AS b1, regr_intercept(amp, a) AS b0 FROM ld JOIN rk USING (event) GROUP BY 1, 2 HAVING count(*) >= 10),
bs AS (SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY unit ORDER BY abs(c) DESC, tau) = 1), ev AS (SELECT ld.event, ld.unit, ld.tau, a, amp, c, b0, b0 + b1 * a AS law FROM ld JOIN bs USING (unit, tau)),
md AS (SELECT unit, median(amp - law) AS m FROM ev GROUP BY 1), sg AS (SELECT unit, median(abs(amp - law - m)) * 1.4826 + 1e-9 AS s FROM ev JOIN md USING (unit) GROUP BY 1)
SELECT event, unit, tau::BIGINT AS tau, round(a, 5) AS load, round(amp * CASE WHEN abs(c) >= 0.2 THEN least(5, greatest(0.2, b0 / greatest(law, 1e-6))) ELSE 1 END, 4) AS amp, round((amp - law) / s, 4) AS z FROM ev JOIN sg USING (unit)""")
def deadapted_amplitudes(spark, d):
    e = adaptation.deadapted(event_trains(spark, d), list(TAUS))
    return e.select("event", "unit", "tau", F.round("load", 5).alias("load"), F.round("amp", 4).alias("amp"), F.round("z", 4).alias("z"))


def cramer(k: int) -> str:
    """The sums of round k, and the path by them."""
    sums = ", ".join(f"sum(w * x ** {j}) AS s{j}" for j in range(5)) + ", " + ", ".join(f"sum(w * x ** {j} * v) AS y{j}" for j in range(3))
    d3 = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"
    a, b, c = "y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)", "s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s3 * s2) + s2 * (s1 * y2 - y1 * s2)", "s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)"
    line = "(y0 * s2 - y1 * s1) / (s0 * s2 - s1 * s1) + x * (s0 * y1 - s1 * y0) / (s0 * s2 - s1 * s1)"
    return f"""f{k} AS (SELECT bundle, {sums} FROM w{k} GROUP BY 1), p{k} AS (SELECT w.*, v - CASE WHEN n >= 4 AND {d3} > 1e-9 * s0 ** 3 THEN ({a} + x * ({b}) + x * x * ({c})) / {d3}
WHEN n >= 2 AND s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 THEN {line} ELSE y0 / s0 END AS r FROM w{k} w JOIN f{k} USING (bundle)), q{k} AS (SELECT bundle, median(abs(r)) * 1.4826 + 1e-9 AS s FROM p{k} GROUP BY 1),
w{k + 1} AS (SELECT bundle, member, n, x, v, (1 / (1 + (r / (3 * s)) ** 2)) ** 2 AS w FROM p{k} JOIN q{k} USING (bundle))"""


@query(f"""WITH {ATOMS}, m AS (SELECT local AS bundle, chunk AS member, chunk AS t, depth AS v FROM am), b AS (SELECT bundle, count(*) AS n, avg(t) AS mid, coalesce(nullif(stddev_pop(t), 0), 1) AS wide FROM m GROUP BY 1),
w0 AS (SELECT bundle, member, n, (t - mid) / wide AS x, v, 1.0 AS w FROM m JOIN b USING (bundle)), {cramer(0)}, {cramer(1)}, {cramer(2)} SELECT bundle, member, n, round(r, 5) + 0.0 AS residual, round(w, 5) AS weight FROM p2""")
def robust_paths(spark, d):
    m = atoms(spark, d).select(F.col("local").alias("bundle"), F.col("chunk").alias("member"), F.col("chunk").alias("t"), "depth")
    return paths.paths(m, "depth", rounds=2).select("bundle", "member", "n", (F.round("residual", 5) + 0.0).alias("residual"), F.round("weight", 5).alias("weight"))


@query()
def linked_cliques(spark, d):
    """Waveforms of one chunk in six with cosines of 0.15 or more."""
    w = waves(spark, d).select(F.col("event").alias("node"), (F.col("event") % 6).alias("chunk"), "w")
    return linkage.complete_linkage(w, linkage.near_pairs(w, 0.85))


NEAR = """pr AS (SELECT a.vec_id AS q, b.vec_id AS event, b.label, a.label AS own, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), event) AS rank FROM pr)"""


def vectors(spark, d):
    rows = waves(spark, d).select("event", F.col("cluster").alias("label"), F.col("w").alias("x"))
    return rows, rows.where("event % 20 = 0")


@query(f"WITH {NEAR} SELECT q, event, rank, round(d, 6) AS distance FROM rk WHERE rank <= 10")
def exact_neighbours(spark, d):
    """Of every row whose id is divisible by 20, among all rows."""
    return neighbours.nearest(*vectors(spark, d), 10)[0].select("q", "event", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"""WITH {NEAR}, fo AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS place FROM rk WHERE rank <= 24 AND label <> own), vt AS (SELECT q, own, label, count(*) AS n FROM fo WHERE place <= 6 GROUP BY 1, 2, 3)
SELECT q AS event, own::BIGINT AS label, arg_max(label, (n, -label))::BIGINT AS other, max(n) AS votes FROM vt GROUP BY 1, 2 HAVING sum(n) = 6 AND max(n) >= 2""")
def reclaimed_by_neighbours(spark, d):
    got = neighbours.reclaimed(*vectors(spark, d), 6, 0.3, 10)
    return got.select("event", F.col("label").cast("bigint").alias("label"), F.col("other").cast("bigint").alias("other"), "votes")
