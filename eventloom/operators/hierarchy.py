"""Edits of labels and of the hierarchy of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import numbered


def compact(labels: DataFrame, first: int = 2) -> DataFrame:
    """event, label, new: labels renumbered without holes from ``first``; 0 stays 0."""
    kept = labels.where("label <> 0").select("label").distinct()
    ranked = numbered(kept, "new", "label").withColumn("new", F.col("new") + first)
    return labels.join(ranked, "label", "left").select("event", "label", F.coalesce("new", F.lit(0)).alias("new"))


def reparent(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """event, label: each child's parent; child 0 and children without one go to 0."""
    p = parents.select(F.col("child").alias("label"), "parent")
    return labels.join(p, "label", "left").select("event", F.when(F.col("label") == 0, 0).otherwise(F.coalesce("parent", F.lit(0))).alias("label"))


def islands(labels: DataFrame) -> DataFrame:
    """label, island, first, last, n: runs of neighbouring events of one label."""
    a = F.row_number().over(Window.partitionBy("grp").orderBy("event")) - F.row_number().over(Window.partitionBy("grp", "label").orderBy("event"))
    return labels.withColumn("island", a).groupBy("grp", "label", "island").agg(F.min("event").alias("first"), F.max("event").alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def lifted(labels: DataFrame) -> DataFrame:
    """atom, parent, n, straddles: the fiber with most of an atom's events (atom, fiber), ties to the smaller; straddles if it has others. Atom 0 is left out."""
    c = labels.where("atom <> 0").groupBy("atom", "fiber").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("atom").agg(F.max(F.struct("n", (-F.col("fiber")).alias("f"))).alias("b"), F.count(F.lit(1)).alias("fibers"), F.sum("n").alias("n"))
    return best.select("atom", (-F.col("b.f")).alias("parent"), "n", (F.col("fibers") > 1).alias("straddles"))
