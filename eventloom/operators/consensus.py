"""One labelling from many draws: events that enough draws label alike belong together.

Events with the same labels in all draws are one signature, so what is compared is signatures. Two signatures agree in ``need`` draws if and only if they have
the same labels in some set of ``need`` draws. So each signature is listed under its labels in every such set, and all that are in a list are linked to
the list's smallest: a star in place of its pairs. Lists are partial minima, so a list that most signatures are in costs no more than another. What is joined through others is joined too (single linkage).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .storage import written

#: The most sets of draws that a signature is listed under.
LISTS = 5000


def signatures(draws: DataFrame, n_draws: int) -> DataFrame:
    """event, labels: the label of an event in each draw 0 to ``n_draws`` - 1, null where the draw didn't have it. Of several labels in one draw the smallest counts."""
    one = [F.min(F.when(F.col("draw") == k, F.col("label"))) for k in range(n_draws)]
    return draws.where("event IS NOT NULL").groupBy("event").agg(F.array(*one).alias("labels"))


def consensus(draws: DataFrame, n_draws: int, need: int) -> DataFrame:
    """event, consensus (the smallest event that it belongs with), size, from (event, draw, label): events belong together where ``need`` of the draws label both and alike, or through others.

    A draw without an event agrees with nothing, so an event in fewer than ``need`` draws is alone with those of the same labels."""
    if not 0 < need <= n_draws:
        raise ValueError("need must be from 1 to the number of draws")
    if comb(n_draws, need) > LISTS:
        raise ValueError(f"{comb(n_draws, need)} sets of draws are more than {LISTS}: take fewer draws, or a need nearer to their number")
    own = signatures(draws, n_draws)
    groups = written(own.groupBy("labels").agg(F.min("event").alias("first"), F.count(F.lit(1)).alias("n")), "signatures")
    lists = F.array(*(F.struct(F.lit(k).alias("set"), F.array(*(F.col("labels")[i] for i in some)).alias("of")) for k, some in enumerate(combinations(range(n_draws), need))))
    listed = groups.select("first", F.explode(lists).alias("l")).where(~F.exists("l.of", lambda x: x.isNull()))
    listed = written(listed.select("first", F.xxhash64("l").alias("h"), F.col("l.set").alias("set"), F.col("l.of").alias("of")), "lists")
    low = listed.groupBy("h", "set", "of").agg(F.min("first").alias("low"))
    links = listed.join(low, ["h", "set", "of"]).select(F.col("first").alias("a"), F.col("low").alias("b"))
    joined = groups.join(components(links).withColumnRenamed("node", "first"), "first", "left").select("labels", "n", F.coalesce("component", "first").alias("consensus"))
    sizes = joined.groupBy("consensus").agg(F.sum("n").alias("size"))
    placed = joined.join(sizes, "consensus").select("labels", "consensus", "size")
    return own.join(placed, "labels").select("event", "consensus", "size")


def majority(draws: DataFrame) -> DataFrame:
    """event, label, share: the label that most draws give an event, the smaller of equals, and the share of the event's draws that give it."""
    votes = draws.where("event IS NOT NULL AND label IS NOT NULL").groupBy("event", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("event").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), (F.max("n") / F.sum("n")).alias("share"))
