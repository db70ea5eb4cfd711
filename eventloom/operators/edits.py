"""Edits of a hierarchy: atoms (event, child), which stay, and their parents (child, parent), which are few and change.

An edit takes and gives tables, so a script of edits is one plan. What an edit refuses, it refuses when it is made: the parents are as few as atoms, and a
look at those that are named is a small query.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import numbered


def fresh(parents: DataFrame) -> int:
    """The least fiber id beyond all there are."""
    return int(parents.agg(F.coalesce(F.max("parent"), F.lit(1)) + 1).first()[0])


def known(parents: DataFrame, child: int) -> None:
    if parents.where(F.col("child") == child).isEmpty():
        raise KeyError(f"atom {child} isn't in the hierarchy")


def merge_parents(parents: DataFrame, keep: int, *absorb: int) -> DataFrame:
    """The children of all fibers under one."""
    return parents.withColumn("parent", F.when(F.col("parent").isin([a for a in absorb if a != keep]), F.lit(keep)).otherwise(F.col("parent")))


def move_child(parents: DataFrame, child: int, fiber: int) -> DataFrame:
    known(parents, child)
    return parents.withColumn("parent", F.when(F.col("child") == child, F.lit(fiber)).otherwise(F.col("parent")))


def promote_child(parents: DataFrame, child: int, fiber: int | None = None) -> DataFrame:
    """The child as a fiber of its own."""
    return move_child(parents, child, fresh(parents) if fiber is None else fiber)


def split_parent(parents: DataFrame, fiber: int, children: Iterable[int], into: int | None = None) -> DataFrame:
    """Some children of a fiber in another one, which is new if it isn't named."""
    children = list(children)
    theirs = {r.child for r in parents.where((F.col("parent") == fiber) & F.col("child").isin(children)).collect()}
    if missing := sorted(set(children) - theirs):
        raise ValueError(f"not under fiber {fiber}: {missing}")
    target = fresh(parents) if into is None else into
    return parents.withColumn("parent", F.when(F.col("child").isin(children), F.lit(target)).otherwise(F.col("parent")))


def dissolve_parent(parents: DataFrame, fiber: int) -> DataFrame:
    """Every child of a fiber as a fiber of its own, numbered in their order."""
    new = numbered(parents.where(F.col("parent") == fiber).select("child"), "_new", "child").withColumn("_new", F.col("_new") + fresh(parents))
    return parents.join(new, "child", "left").withColumn("parent", F.coalesce("_new", "parent")).drop("_new")


def merge_children(atoms: DataFrame, parents: DataFrame, keep: int, *absorb: int) -> tuple[DataFrame, DataFrame]:
    """Atoms as one atom, if they have one parent; the absorbed leave the hierarchy."""
    gone = [a for a in absorb if a != keep]
    of = {r.child: r.parent for r in parents.where(F.col("child").isin([keep, *gone])).collect()}
    if unlike := [a for a in gone if of.get(a) != of.get(keep)]:
        raise ValueError(f"atoms {unlike} aren't in the fiber of {keep}")
    return atoms.withColumn("child", F.when(F.col("child").isin(gone), F.lit(keep)).otherwise(F.col("child"))), parents.where(~F.col("child").isin(gone))


def fibers(atoms: DataFrame, parents: DataFrame, renumber: bool = True) -> tuple[DataFrame, DataFrame]:
    """(event, child, fiber), and the parents in the same numbers. Child 0 and atoms without a parent are in fiber 0. Fibers that have events are numbered from 2 in their order; 0 and 1 stay, and
    so do parents without an event."""
    own = parents.select("child", F.col("parent").alias("fiber"))
    rows = atoms.join(own, "child", "left").select("event", "child", F.when(F.col("child") <= 0, F.lit(0)).otherwise(F.coalesce("fiber", F.lit(0))).alias("fiber"))
    if not renumber:
        return rows, parents
    kept = rows.where("fiber not in (0, 1)").select("fiber").distinct()
    new = numbered(kept, "_new", "fiber").withColumn("_new", F.col("_new") + 2)
    again = lambda df, c: df.join(new.withColumnRenamed("fiber", c), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return again(rows, "fiber").select("event", "child", "fiber"), again(parents, "parent").select("child", "parent")


def problems(labels: DataFrame) -> DataFrame:
    """child, fibers: atoms whose events (event, child, fiber) are in several fibers."""
    return labels.where("child > 0").groupBy("child").agg(F.array_sort(F.collect_set("fiber")).alias("fibers")).where(F.size("fibers") > 1)


def orphans(atoms: DataFrame, parents: DataFrame) -> DataFrame:
    """child: atoms without a parent."""
    return atoms.where("child > 0").select("child").distinct().join(parents, "child", "left_anti")


def run_script(atoms: DataFrame, parents: DataFrame, lines: Iterable[str]) -> tuple[DataFrame, DataFrame, int]:
    """Edits a line: ``merge_parents <keep> <absorb...>``, ``promote_child <child> [fiber]``, ``move_child <child> <fiber>``, ``split_parent <fiber> <child...> [into <fiber>]``,
    ``dissolve_parent <fiber>``, ``merge_children <keep> <absorb...>``; # begins a comment. Atoms, parents, and the number of edits."""
    n = 0
    for row, line in enumerate(lines, 1):
        words = line.partition("#")[0].split()
        if not words:
            continue
        name, into = words[0], None
        if "into" in words:
            into = int(words[words.index("into") + 1])
            words = words[: words.index("into")]
        ids = [int(x) for x in words[1:]]
        if name == "merge_parents":
            parents = merge_parents(parents, *ids)
        elif name == "promote_child":
            parents = promote_child(parents, *ids)
        elif name == "move_child":
            parents = move_child(parents, *ids)
        elif name == "split_parent":
            parents = split_parent(parents, ids[0], ids[1:], into)
        elif name == "dissolve_parent":
            parents = dissolve_parent(parents, *ids)
        elif name == "merge_children":
            atoms, parents = merge_children(atoms, parents, *ids)
        else:
            raise ValueError(f"line {row}: no edit {name!r}")
        n += 1
    return atoms, parents, n


def identity(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A hierarchy whose atoms are the labels (event, label) themselves."""
    return labels.select("event", F.col("label").alias("child")), labels.where("label > 0").select(F.col("label").alias("child"), F.col("label").alias("parent")).distinct()


def carried(atoms: DataFrame, parents: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """child, parent: the parents of the same atoms after whole fibers were relabelled; ``before`` and ``after`` are labels (event, label) of the same events."""
    new = before.withColumnRenamed("label", "parent").join(after.withColumnRenamed("label", "_new"), "event").groupBy("parent").agg(F.min("_new").alias("_new"), F.max("_new").alias("_most"))
    torn = F.when(F.col("_new") != F.col("_most"), F.raise_error(F.concat(F.lit("a fiber went to several: "), F.col("parent")))).otherwise(F.col("_new"))
    return parents.join(new.select("parent", torn.alias("_new")), "parent", "left").select("child", F.coalesce("_new", "parent").alias("parent")).join(atoms.select("child").distinct(), "child", "left_semi")


def parents_of_groups(ids: DataFrame, groups: DataFrame) -> DataFrame:
    """child, parent from groups (group, child) of all ids (child): groups of several atoms first, the largest first, then single ones in order; from 2."""
    sized = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("first")).where("n > 1")
    many = groups.join(sized, "group").select("child", (-F.col("n")).alias("k"), "first")
    rest = ids.join(many, "child", "left_anti").select("child", F.lit(0).cast("bigint").alias("k"), F.col("child").alias("first"))
    all_ = many.unionByName(rest)
    new = numbered(all_.select("k", "first").distinct(), "_new", "k", "first")
    return all_.join(new, ["k", "first"]).select("child", (F.col("_new") + 2).alias("parent"))


def bundle_labels(labels: DataFrame, bundles: DataFrame, reserved: tuple[int, ...] = (0, 1)) -> DataFrame:
    """event, label: the fragments (event, label) of a bundle (bundle, label) share an id from beyond the reserved ones, bundles in their order; other ids follow, by their first event; reserved ids stay."""
    base = max(reserved) + 1
    number = numbered(bundles.select("bundle").distinct(), "new", "bundle").withColumn("new", F.col("new") + base)
    mapped = bundles.join(number, "bundle").select("label", "new")
    n = number.agg(F.count(F.lit(1)).alias("_n"))
    rest = labels.where(~F.col("label").isin(list(reserved))).join(mapped, "label", "left_anti").groupBy("label").agg(F.min("event").alias("first"))
    rest = numbered(rest, "new", "first").crossJoin(F.broadcast(n)).select("label", (F.col("new") + F.col("_n") + base).alias("new"))  # one row
    return labels.join(mapped.unionByName(rest), "label", "left").select("event", F.coalesce("new", "label").cast("bigint").alias("label"))


def unit_bundle_labels(labels: DataFrame, units: DataFrame, bundles: DataFrame, reserved: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The same where bundles (bundle, unit) are of units, whose members (unit, label) are fragments."""
    return bundle_labels(labels, bundles.join(units, "unit").select("bundle", "label").distinct(), reserved)


def chunk_unit_labels(labels: DataFrame, units: DataFrame, reserved: tuple[int, ...] = (0, 1)) -> DataFrame:
    """event, label: the unit (label, unit) of each fragment; reserved ids stay, and fragments of no unit get new ids in their order."""
    base = units.agg(F.coalesce(F.max("unit"), F.lit(max(reserved))).alias("_m"))
    rest = labels.where(~F.col("label").isin(list(reserved))).select("label").distinct().join(units, "label", "left_anti")
    rest = numbered(rest, "_new", "label").crossJoin(F.broadcast(base)).select("label", (F.col("_m") + F.col("_new") + 1).alias("unit"))  # one row
    return labels.join(units.unionByName(rest), "label", "left").select("event", F.coalesce("unit", "label").cast("bigint").alias("label"))


def unit_events(labels: DataFrame, units: DataFrame) -> DataFrame:
    """unit, event: the events of a unit's members (unit, label)."""
    return labels.join(units, "label").select("unit", "event")


def without_small(labels: DataFrame, least: int) -> DataFrame:
    """event, label: labels of fewer events become -1, the others are numbered from 0 in their order."""
    n = labels.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    new = numbered(n.select("label"), "new", "label")
    return labels.join(new, "label", "left").select("event", F.coalesce("new", F.lit(-1)).cast("bigint").alias("label"))


def by_first_event(labels: DataFrame, units: DataFrame) -> DataFrame:
    """event, label: fragments (event, label) as their units (label, unit), numbered from 1 by their first event; 0 and fragments without a unit stay 0."""
    rows = labels.join(units, "label", "left")
    new = rows.where("unit is not null and label <> 0").groupBy("unit").agg(F.min("event").alias("first"))
    new = numbered(new, "new", "first").select("unit", (F.col("new") + 1).alias("new"))
    return rows.join(new, "unit", "left").select("event", F.when(F.col("label") == 0, F.lit(0)).otherwise(F.coalesce("new", F.lit(0))).cast("bigint").alias("label"))


def picked(sizes: DataFrame, spec: str) -> DataFrame:
    """Labels (label, n) named by ``all``, ``top:N`` (the largest, ties to the smaller id) or a list."""
    if spec == "all":
        return sizes.select("label")
    if spec.startswith("top:"):
        return sizes.orderBy(F.desc("n"), "label").limit(int(spec[4:])).select("label")
    return sizes.where(F.col("label").isin([int(x) for x in spec.split(",")])).select("label")


def voted(votes: DataFrame, least: int = 1) -> DataFrame:
    """event, label: the commonest vote (event, label) of each event, ties to the smaller; labels of fewer than ``least`` events become 0."""
    n = votes.groupBy("event", "label").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("event").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    size = top.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return top.join(size.select("label", F.col("label").alias("kept")), "label", "left").select("event", F.coalesce("kept", F.lit(0)).alias("label"))
