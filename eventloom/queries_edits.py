"""Named queries of edits and relabellings: the atoms are users, a fiber is an atom modulo 7, and one atom in eleven has none."""

from __future__ import annotations

from pyspark.sql import functions as F

from .named import ORACLES, QUERIES, query
from .operators import edits
from .sources.tables import table

A = "a AS (SELECT event_id AS event, user_id AS child FROM events), p AS (SELECT DISTINCT user_id AS child, user_id % 7 + 2 AS parent FROM events WHERE user_id > 0 AND user_id % 11 <> 10)"


def atoms(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("event"), F.col("user_id").alias("child"))


def parents(spark, d):
    return atoms(spark, d).where("child > 0 and child % 11 <> 10").select("child", (F.col("child") % 7 + 2).alias("parent")).distinct()


@query(f"WITH {A} SELECT child, CASE WHEN parent IN (3, 4) THEN 2 ELSE parent END AS parent FROM p")
def edit_merge_parents(spark, d):
    return edits.merge_parents(parents(spark, d), 2, 3, 4)


@query(f"WITH {A} SELECT child, CASE WHEN child = 5 THEN 9 ELSE parent END AS parent FROM p")
def edit_promote_child(spark, d):
    return edits.promote_child(parents(spark, d), 5)


@query(f"WITH {A} SELECT child, CASE WHEN child = 5 THEN 3 ELSE parent END AS parent FROM p")
def edit_move_child(spark, d):
    return edits.move_child(parents(spark, d), 5, 3)


@query(f"WITH {A} SELECT child, CASE WHEN child IN (2, 9) THEN 9 ELSE parent END AS parent FROM p")
def edit_split_parent(spark, d):
    return edits.split_parent(parents(spark, d), 4, [2, 9])


@query(f"WITH {A}, n AS (SELECT child, row_number() OVER (ORDER BY child) + 8 AS new FROM p WHERE parent = 4) SELECT p.child, coalesce(new, parent) AS parent FROM p LEFT JOIN n USING (child)")
def edit_dissolve_parent(spark, d):
    return edits.dissolve_parent(parents(spark, d), 4)


@query(f"WITH {A} SELECT event, CASE WHEN child = 9 THEN 2 ELSE child END AS child FROM a")
def edit_merge_children(spark, d):
    return edits.merge_children(atoms(spark, d), parents(spark, d), 2, 9)[0]


@query(f"WITH {A}, r AS (SELECT event, a.child, CASE WHEN a.child <= 0 THEN 0 ELSE coalesce(parent * 10, 0) END AS f FROM a LEFT JOIN p USING (child)), n AS (SELECT f, row_number() OVER (ORDER BY f) + 1 AS new FROM (SELECT DISTINCT f FROM r WHERE f NOT IN (0, 1))) SELECT event, child, coalesce(new, f) AS fiber FROM r LEFT JOIN n USING (f)")
def refiberize(spark, d):
    return edits.fibers(atoms(spark, d), parents(spark, d).withColumn("parent", F.col("parent") * 10))[0]


@query("SELECT user_id AS child, string_agg(DISTINCT f::VARCHAR, ',' ORDER BY f::VARCHAR) AS fibers FROM (SELECT user_id, CASE WHEN event_id % 50 = 0 THEN 1 ELSE user_id % 3 END AS f FROM events WHERE user_id > 0) GROUP BY 1 HAVING count(DISTINCT f) > 1")
def hierarchy_problems(spark, d):
    rows = atoms(spark, d).withColumn("fiber", F.when(F.col("event") % 50 == 0, 1).otherwise(F.col("child") % 3))
    return edits.problems(rows).withColumn("fibers", F.array_join("fibers", ","))


@query(f"WITH {A} SELECT DISTINCT child FROM a WHERE child > 0 AND child NOT IN (SELECT child FROM p)")
def hierarchy_orphans(spark, d):
    return edits.orphans(atoms(spark, d), parents(spark, d))


SCRIPT = ["merge_parents 2 3  # all of 3", "", "promote_child 5", "split_parent 4 2 into 30", "merge_children 7 14", "move_child 8 30"]


@query(f"""WITH {A}, a2 AS (SELECT event, CASE WHEN child = 14 THEN 7 ELSE child END AS child FROM a), p2 AS (SELECT child, CASE WHEN child = 8 THEN 30 WHEN child = 2 THEN 30 WHEN child = 5 THEN 9 WHEN parent = 3 THEN 2 ELSE parent END AS parent FROM p WHERE child <> 14)
SELECT event, a2.child, CASE WHEN a2.child <= 0 THEN 0 ELSE coalesce(parent, 0) END AS fiber FROM a2 LEFT JOIN p2 USING (child)""")
def hierarchy_script(spark, d):
    a, p, _ = edits.run_script(atoms(spark, d), parents(spark, d), SCRIPT)
    return edits.fibers(a, p, renumber=False)[0]


@query(f"WITH {A} SELECT DISTINCT child, child AS parent FROM a WHERE child > 0")
def lift_identity(spark, d):
    return edits.identity(atoms(spark, d).withColumnRenamed("child", "label"))[1]


@query(f"WITH {A}, f AS (SELECT event, CASE WHEN a.child <= 0 THEN 0 ELSE coalesce(parent, 0) END AS f FROM a LEFT JOIN p USING (child)) SELECT child, parent * 3 + 1 AS parent FROM p WHERE parent IN (SELECT f FROM f)")
def carry_hierarchy(spark, d):
    a, p = atoms(spark, d), parents(spark, d)
    before = edits.fibers(a, p, renumber=False)[0].select("event", F.col("fiber").alias("label"))
    return edits.carried(a, p, before, before.withColumn("label", F.col("label") * 3 + 1))


@query("""WITH i AS (SELECT DISTINCT user_id AS child FROM events), g AS (SELECT child % 40 AS grp, child FROM i WHERE child % 3 = 0), s AS (SELECT grp, count(*) AS n, min(child) AS first FROM g GROUP BY 1 HAVING count(*) > 1),
x AS (SELECT i.child, coalesce(-n, 0) AS k, coalesce(first, i.child) AS first FROM i LEFT JOIN g USING (child) LEFT JOIN s ON s.grp = g.grp) SELECT child, dense_rank() OVER (ORDER BY k, first) + 1 AS parent FROM x""")
def groups_to_parent(spark, d):
    ids = atoms(spark, d).select("child").distinct()
    return edits.parents_of_groups(ids, ids.where("child % 3 = 0").select((F.col("child") % 40).alias("group"), "child"))


BUNDLES = "b AS (SELECT DISTINCT user_id % 5 AS bundle, user_id AS label FROM events WHERE user_id > 1 AND user_id % 4 = 0), n AS (SELECT bundle, row_number() OVER (ORDER BY bundle) + 1 AS new FROM (SELECT DISTINCT bundle FROM b)), m AS (SELECT label, new FROM b JOIN n USING (bundle))"
REST = "r AS (SELECT user_id AS label, (SELECT count(*) FROM n) + 1 + row_number() OVER (ORDER BY min(event_id)) AS new FROM events WHERE user_id NOT IN (0, 1) AND user_id NOT IN (SELECT label FROM m) GROUP BY 1), z AS (FROM m UNION ALL FROM r)"


def fragments(spark, d):
    return atoms(spark, d).withColumnRenamed("child", "label")


def bundles(spark, d):
    return fragments(spark, d).where("label > 1 and label % 4 = 0").select((F.col("label") % 5).alias("bundle"), "label").distinct()


@query(f"WITH {BUNDLES}, {REST} SELECT event_id AS event, coalesce(new, user_id)::BIGINT AS label FROM events LEFT JOIN z ON z.label = user_id")
def global_clu_map(spark, d):
    return edits.bundle_labels(fragments(spark, d), bundles(spark, d))


@query(f"WITH {BUNDLES}, {REST} SELECT event_id AS event, coalesce(new, user_id)::BIGINT AS label FROM events LEFT JOIN z ON z.label = user_id")
def global_clu_map_units(spark, d):
    b = bundles(spark, d)
    return edits.unit_bundle_labels(fragments(spark, d), b.select((F.col("label") + 1000).alias("unit"), "label"), b.select("bundle", (F.col("label") + 1000).alias("unit")))


UNITS = "u AS (SELECT DISTINCT user_id AS label, user_id % 9 + 2 AS unit FROM events WHERE user_id > 1 AND user_id % 4 <> 0)"


def units(spark, d):
    return fragments(spark, d).where("label > 1 and label % 4 <> 0").select("label", (F.col("label") % 9 + 2).alias("unit")).distinct()


@query(f"WITH {UNITS}, r AS (SELECT label, (SELECT max(unit) FROM u) + row_number() OVER (ORDER BY label) AS unit FROM (SELECT DISTINCT user_id AS label FROM events WHERE user_id > 1 AND user_id % 4 = 0)), z AS (FROM u UNION ALL FROM r) SELECT event_id AS event, coalesce(unit, user_id)::BIGINT AS label FROM events LEFT JOIN z ON z.label = user_id")
def intrachunk_clu(spark, d):
    return edits.chunk_unit_labels(fragments(spark, d), units(spark, d))


@query(f"WITH {UNITS} SELECT unit, event_id AS event FROM events JOIN u ON u.label = user_id")
def member_events(spark, d):
    return edits.unit_events(fragments(spark, d), units(spark, d))


@query("WITH n AS (SELECT user_id AS label FROM events GROUP BY 1 HAVING count(*) >= 66), r AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS new FROM n) SELECT event_id AS event, coalesce(new, -1)::BIGINT AS label FROM events LEFT JOIN r ON r.label = user_id")
def drop_tiny(spark, d):
    return edits.without_small(fragments(spark, d), 66)


@query(f"WITH {UNITS}, f AS (SELECT unit, row_number() OVER (ORDER BY min(event_id)) AS new FROM events JOIN u ON u.label = user_id GROUP BY 1) SELECT event_id AS event, coalesce(new, 0)::BIGINT AS label FROM events LEFT JOIN u ON u.label = user_id LEFT JOIN f USING (unit)")
def rewrite_clu(spark, d):
    return edits.by_first_event(fragments(spark, d), units(spark, d))


@query("SELECT user_id AS label FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5")
def picked_labels(spark, d):
    return edits.picked(fragments(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "top:5")


@query("""WITH v AS (SELECT event_id // 10 AS event, user_id % 6 AS label FROM events), n AS (SELECT event, label, count(*) AS n FROM v GROUP BY 1, 2), t AS (SELECT event, arg_min(label, (-n, label)) AS label FROM n GROUP BY 1), s AS (SELECT label FROM t GROUP BY 1 HAVING count(*) >= 20)
SELECT event, CASE WHEN label IN (FROM s) THEN label ELSE 0 END AS label FROM t""")
def voted_labels(spark, d):
    return edits.voted(atoms(spark, d).select(F.floor(F.col("event") / 10).alias("event"), (F.col("child") % 6).alias("label")), 20)
