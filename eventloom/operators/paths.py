"""Smooth paths through a bundle's values over time that a few wrong members don't bend: weighted polynomials, for all bundles at once.

A path is a polynomial of degree 2 for bundles of four members or more, 1 for two or three, else a constant. Its coefficients solve normal equations whose sums are aggregates by bundle; residuals then weigh each
member by Cauchy's rule, 1 / (1 + (r / 3 s)^2), s being 1.4826 times the median absolute residual, and the sums are taken again. Times are counted from the bundle's mean in its deviations,
so the equations are sound at any time of a recording. Everything is sums and one median a bundle; nothing is gathered.

Defined results: members with a null bundle, time or value are left out. Where times are too few for the degree (equal times), the path is the highest degree that they determine. Members at one time count one by one. An
empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written


def solved(s: list[Column], y: list[Column]) -> list[Column]:
    """The coefficients of degrees 0 to 2 by Cramer's rule, from the sums s[k] of w x^k and y[k] of w x^k v; ``deg`` says how many count. A determinant of nothing lowers the degree."""
    d3 = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    d2 = s[0] * s[2] - s[1] * s[1]
    a = y[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (y[1] * s[4] - s[3] * y[2]) + s[2] * (y[1] * s[3] - s[2] * y[2])
    b = s[0] * (y[1] * s[4] - y[2] * s[3]) - y[0] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * y[2] - y[1] * s[2])
    c = s[0] * (s[2] * y[2] - s[3] * y[1]) - s[1] * (s[1] * y[2] - s[2] * y[1]) + y[0] * (s[1] * s[3] - s[2] * s[2])
    two = (F.col("deg") >= 2) & (d3 > 1e-9 * F.pow(s[0], F.lit(3)))
    one = (F.col("deg") >= 1) & (d2 > 1e-9 * s[0] * s[0])
    flat = y[0] / s[0]
    return [
        F.when(two, a / d3).when(one, (y[0] * s[2] - y[1] * s[1]) / d2).otherwise(flat),
        F.when(two, b / d3).when(one, (s[0] * y[1] - s[1] * y[0]) / d2).otherwise(0.0),
        F.when(two, c / d3).otherwise(0.0),
    ]


def fits(members: DataFrame) -> DataFrame:
    """bundle, c0, c1, c2 of members (bundle, x, v, w, deg): w weighs squares."""
    x, w = F.col("x"), F.col("w")
    power = lambda k: F.pow(x, F.lit(k)) if k else F.lit(1.0)
    sums = members.groupBy("bundle").agg(F.first("deg").alias("deg"), *(F.sum(w * power(k)).alias(f"s{k}") for k in range(5)), *(F.sum(w * power(k) * F.col("v")).alias(f"y{k}") for k in range(3)))
    c = solved([F.col(f"s{k}") for k in range(5)], [F.col(f"y{k}") for k in range(3)])
    return sums.select("bundle", *(e.alias(f"c{k}") for k, e in enumerate(c)))


def paths(members: DataFrame, value: str, rounds: int = 1, t: str = "t") -> DataFrame:
    """bundle, member, n, path, residual, weight of members (bundle, member, ``t``, ``value``): the path's value at the member's time after ``rounds`` of weighing, and how the member was weighed for it (squared, as the sums have it)."""
    own = members.where(F.col("bundle").isNotNull() & F.col(t).isNotNull() & F.col(value).isNotNull()).select("bundle", "member", F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    about = own.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mid"), F.coalesce(F.nullif(F.stddev_pop("t"), F.lit(0.0)), F.lit(1.0)).alias("wide"))
    deg = F.when(F.col("n") >= 4, 2).when(F.col("n") >= 2, 1).otherwise(0)
    now = own.join(about, "bundle").select("bundle", "member", "n", ((F.col("t") - F.col("mid")) / F.col("wide")).alias("x"), "v", F.lit(1.0).alias("w"), deg.alias("deg"))
    for k in range(rounds + 1):
        now = written(now, "members")
        at = F.col("c0") + F.col("x") * (F.col("c1") + F.col("x") * F.col("c2"))
        now = now.join(fits(now), "bundle").withColumn("path", at).withColumn("residual", F.col("v") - F.col("path")).drop("c0", "c1", "c2")
        if k < rounds:
            now = written(now, "residuals")
            s = now.groupBy("bundle").agg((F.median(F.abs("residual")) * 1.4826 + 1e-9).alias("s"))
            cauchy = 1 / (1 + F.pow(F.col("residual") / (3 * F.col("s")), F.lit(2)))
            now = now.join(s, "bundle").withColumn("w", cauchy * cauchy).select("bundle", "member", "n", "x", "v", "w", "deg")
    return now.select("bundle", "member", "n", "path", "residual", F.col("w").alias("weight"))


def conflicts(placed: DataFrame, chunks: DataFrame) -> DataFrame:
    """bundle, chunk, member, stays: where a bundle has several members (member, chunk) in one chunk, the one nearest to its path stays; ties go to the smaller member. Chunks without a conflict have no row."""
    rows = placed.join(chunks, "member")
    n = rows.groupBy("bundle", "chunk").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.abs("residual").alias("r"), "member"))["member"].alias("best")).where("k > 1")
    return rows.join(n, ["bundle", "chunk"]).select("bundle", "chunk", "member", (F.col("member") == F.col("best")).alias("stays"))
