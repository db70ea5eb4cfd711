"""A labelling (event, truth, found) scored against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(labels: DataFrame) -> DataFrame:
    """truth, found, n."""
    return labels.groupBy("truth", "found").agg(F.count(F.lit(1)).alias("n"))


def pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def pairwise(labels: DataFrame) -> DataFrame:
    """precision, recall, f1, ari over pairs of events. ari is 1 if there are fewer than two events or the largest index equals the expected."""
    c = contingency(labels)
    both = c.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    t = c.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("st"))
    f = c.groupBy("found").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sf"))
    x = both.crossJoin(t).crossJoin(f)
    s, st, sf = F.col("s"), F.col("st"), F.col("sf")
    expected = st * sf / F.nullif(pairs(F.col("total")), F.lit(0))
    top = (st + sf) / 2
    ari = F.when((F.col("total") < 2) | (top == expected), 1.0).otherwise((s - expected) / (top - expected))
    return x.select(F.round(s / sf, 6).alias("precision"), F.round(s / st, 6).alias("recall"), F.round(2 * s / (st + sf), 6).alias("f1"), F.round(ari, 6).alias("ari"))


def v_measure(labels: DataFrame) -> DataFrame:
    """homogeneity, completeness, v from conditional entropies."""
    c = contingency(labels)
    c = c.withColumn("nt", F.sum("n").over(Window.partitionBy("truth"))).withColumn("nf", F.sum("n").over(Window.partitionBy("found")))
    x = c.crossJoin(F.broadcast(labels.agg(F.count(F.lit(1)).alias("total"))))  # one row
    e = x.agg(
        F.sum(-F.col("n") / F.col("total") * F.log(F.col("n") / F.col("nf"))).alias("htf"), F.sum(-F.col("n") / F.col("total") * F.log(F.col("n") / F.col("nt"))).alias("hft"),
        F.sum(-F.col("n") / F.col("total") * F.log(F.col("nt") / F.col("total"))).alias("ht"), F.sum(-F.col("n") / F.col("total") * F.log(F.col("nf") / F.col("total"))).alias("hf"),
    )
    h, k = F.when(F.col("ht") == 0, 1.0).otherwise(1 - F.col("htf") / F.col("ht")), F.when(F.col("hf") == 0, 1.0).otherwise(1 - F.col("hft") / F.col("hf"))
    return e.select(F.round(h, 6).alias("homogeneity"), F.round(k, 6).alias("completeness"), F.round(2 * h * k / (h + k), 6).alias("v"))


def unit_match(labels: DataFrame, split_below: float = 0.8) -> DataFrame:
    """truth, best (the found label with most of its events), n, recall, precision, split."""
    c = contingency(labels).withColumn("nt", F.sum("n").over(Window.partitionBy("truth"))).withColumn("nf", F.sum("n").over(Window.partitionBy("found")))
    best = c.withColumn("k", F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("n"), "found"))).where("k = 1")
    recall = F.round(F.col("n") / F.col("nt"), 6)
    return best.select("truth", F.col("found").alias("best"), "n", recall.alias("recall"), F.round(F.col("n") / F.col("nf"), 6).alias("precision"), (F.col("n") / F.col("nt") < split_below).alias("split"))


def merged(labels: DataFrame, least_share: float = 0.2) -> DataFrame:
    """found, n_truths of found labels of which two or more true ones have ``least_share`` each."""
    c = contingency(labels).withColumn("nf", F.sum("n").over(Window.partitionBy("found")))
    return c.where(F.col("n") >= least_share * F.col("nf")).groupBy("found").agg(F.count(F.lit(1)).alias("n_truths")).where("n_truths >= 2")
