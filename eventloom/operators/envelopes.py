"""What one unit's waveforms may look like: how far their directions may part as their amplitudes do, and how much of their scatter goes along the amplitude.

Defined results: waves with a null cluster, a null or zero waveform are left out. An empty table gives no pair and no row; limits of no pairs are an error, as nothing could be admitted by them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, norm
from .places import sampled
from .squares import blocks, in_squares, vectors
from .storage import written

#: Bits of a distance that a pass over all pairs tells apart, and different distances that come to the driver, at most.
BITS, HELD = 12, 100_000
#: Bits of a distance from 0 to 2, in steps of 2^-53.
TOP = 54


def directions(waves: DataFrame) -> DataFrame:
    """cluster, event, size (the norm), u (the waveform by its norm)."""
    x = waves.where("cluster IS NOT NULL AND w IS NOT NULL").select(F.col("cluster").cast("bigint").alias("cluster"), "event", "w", norm(F.col("w")).alias("size")).where("size > 0")
    return x.select("cluster", "event", "size", F.transform("w", lambda v: v / F.col("size")).alias("u"))


def changes(waves: DataFrame, most: int | None = 200) -> DataFrame:
    """cluster, ratio, distance: of the norms, the larger by the smaller, and one less the cosine, for the pairs of a cluster's events. Of larger clusters about ``most`` events take part (None: all), so a cluster has
    about most * most / 2 rows."""
    few = directions(waves if most is None else sampled(waves.where("cluster IS NOT NULL"), most))
    side = lambda c: few.select("cluster", *(F.col(k).alias(f"{k}_{c}") for k in ("event", "size", "u")))
    far = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("u_a"), F.col("u_b"))))
    return side("a").join(side("b"), "cluster").where("event_a < event_b").select("cluster", (F.greatest("size_a", "size_b") / F.least("size_a", "size_b")).alias("ratio"), far.alias("distance"))


def band(ratio: Column, edges: list[float]) -> Column:
    """The last edge at or below a ratio, as its number."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= ratio)) - 1


def limits(pairs: DataFrame, quantile: float = 0.99, bands: int = 8, most: float | None = None, least: int = 5) -> DataFrame:
    """k, edge, n, distance: the bands of the ratio, from 1 and then by equal factors from the least to the most (``most``, if it is given), and the distance that each allows: the quantile of its pairs, and no less than
    a band before. Bands with fewer than ``least`` pairs allow what the band before does, the first of them none. One row comes to the driver, for the range; exact quantiles keep a band's different distances in one task."""
    good = pairs.where(~F.isnan("ratio") & ~F.isnan("distance") & (F.col("ratio") >= 1) & (F.col("ratio") < float("inf")) & (F.abs("distance") < float("inf")))
    edges = edges_of(*good.agg(F.min("ratio"), F.max("ratio")).first(), bands, most)
    told = good.groupBy(band(F.col("ratio"), edges).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.percentile("distance", F.lit(quantile)).alias("q"))
    return allowed_by(pairs.sparkSession.createDataFrame(list(enumerate(edges)), "k int, edge double").join(told, "k", "left"), least)


def edges_of(low: float | None, high: float | None, bands: int, most: float | None) -> list[float]:
    if low is None:
        raise ValueError("no pairs to make limits of")
    first, last = max(low, 1 + 1e-6), max(float(high if most is None else most), 1 + 1e-5)
    return sorted({1.0, *np.geomspace(first, last, bands).tolist()})


def allowed_by(table: DataFrame, least: int) -> DataFrame:
    own = F.when(F.col("n") >= least, F.greatest("q", F.lit(0.0))).otherwise(0.0)
    return table.select("k", "edge", F.coalesce("n", F.lit(0)).alias("n"), F.max(own).over(Window.orderBy("k")).alias("distance"))  # bands + 1 rows


def limits_of_all(waves: DataFrame, quantile: float = 0.99, bands: int = 8, most: float | None = None, least: int = 5, part: int | None = None) -> DataFrame:
    """``limits`` of ``changes`` of all events, without a row for a pair: a cluster's events meet square by square, for the range of the ratio, and then to count the distances by their leading bits, the next bits of those that share
    them with a quantile, and so on until few are left, which are told apart in full. A distance is a multiple of 2^-53, so this is exact. Waveforms of a cluster are to have one length. Work grows with the square of a
    cluster's events, memory with ``part`` alone."""
    known = directions(waves).where((F.col("size") < float("inf")) & F.col("event").isNotNull())
    d = written(known.select("cluster", F.col("event").cast("bigint").alias("event"), "size", "u"), "directions")
    more = [part] if part else []

    def met(one: pa.Table, two: pa.Table, alone: bool):
        """Places, ratios and which are pairs, block by block; in the order of the size, so that a square is met in the same way each time."""
        one, two = (t.sort_by([("size", "ascending"), ("event", "ascending")]) for t in (one, two))
        (s, a), (t, b) = ((x.column("size").to_numpy(), x.column("event").to_numpy()) for x in (one, two))
        whole = not alone and len(a) and len(b)
        repeated = alone and len(np.unique(a)) < len(a)

        def each():
            for i, j in blocks(len(a), len(b), alone):
                x, y = s[i, None], t[j]
                with np.errstate(over="ignore"):
                    ratio = np.maximum(x, y) / np.minimum(x, y)
                ok = ratio < np.inf
                if not whole:
                    ok &= np.arange(i.start, i.stop)[:, None] < np.arange(j.start, j.stop)
                if repeated:
                    ok &= a[i, None] != b[j]
                yield i, j, ratio, ok

        return one, two, each()

    def ranges(one: pa.Table, two: pa.Table, alone: bool) -> pa.Table:
        got = [(r[ok].min(), r[ok].max()) for _, _, r, ok in met(one, two, alone)[2] if ok.any()]
        return pa.table({"low": np.array([g[0] for g in got], float), "high": np.array([g[1] for g in got], float)})

    extent = in_squares(d.select("cluster", "event", "size"), "cluster", "event", ranges, "low double, high double", *more)
    edges = edges_of(*extent.agg(F.min("low"), F.max("high")).first(), bands, most)

    def counted(wanted: list[tuple[int, int]], at: int, to: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """For each (band, leading bits above ``at``) that is wanted, the next bits, from ``to`` on, and how many pairs have them."""
        size = (1 << (at - to)) + 1
        by_bits = at - to <= BITS

        def run(one: pa.Table, two: pa.Table, alone: bool) -> pa.Table:
            one, two, pairs = met(one, two, alone)
            u, v = vectors(one, "u"), vectors(two, "u")
            sums, rows = np.zeros(len(wanted) * size if by_bits else 0, np.int64), []
            for i, j, ratio, ok in pairs:
                bits = ((1 - np.clip(u[i] @ v[j].T, -1.0, 1.0)) * 2.0**53).astype(np.int64)
                k = np.zeros(ratio.shape, np.int8)
                for e in edges[1:]:
                    k += ratio >= e
                for w, (of, lead) in enumerate(wanted):
                    mine = bits[ok & (k == of) if at >= TOP else ok & (bits >> at == lead) & (k == of)]
                    if len(mine):
                        rest = (mine - (lead << at)) >> to
                        if by_bits:
                            found = np.bincount(rest)
                            sums[w * size : w * size + len(found)] += found
                        else:
                            rows.append(np.stack([np.full(len(rest), w), rest]))
            if by_bits:
                some = np.flatnonzero(sums)
                return pa.table({"w": some // size, "bits": some % size, "n": sums[some]})
            (w, rest), n = np.unique(np.concatenate(rows, 1), axis=1, return_counts=True) if rows else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            return pa.table({"w": w, "bits": rest, "n": n})

        sums = in_squares(d, "cluster", "event", run, "w bigint, bits bigint, n bigint", *more).groupBy("w", "bits").agg(F.sum("n").alias("n"))
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in sums.orderBy("w", "bits").collect():
            out.setdefault(wanted[r.w], []).append((r.bits, r.n))
        return out

    found = counted([(k, 0) for k in range(len(edges))], TOP, TOP - BITS)
    n = {k: sum(m for _, m in found.get((k, 0), [])) for k in range(len(edges))}
    place = {k: quantile * (n[k] - 1) for k in n if n[k]}
    # both ranks that a quantile lies between: how many are before the leading bits, and these
    ranks = {(k, r): (r, 0) for k, p in place.items() for r in {int(np.floor(p)), int(np.ceil(p))}}
    above, at = TOP, TOP - BITS
    while True:
        held = {}
        for (k, r), (left, lead) in ranks.items():
            among = found[k, lead]
            for bits, m in among:
                if left < m or bits == among[-1][0]:
                    break
                left -= m
            ranks[k, r] = min(left, m - 1), (lead << (above - at)) + bits
            held[k, ranks[k, r][1]] = m
        if at == 0:
            break
        above, at = at, 0 if sum(held.values()) <= HELD else max(0, at - BITS)
        found = counted(list(held), above, at)
    value = {kr: lead / 2.0**53 for kr, (_, lead) in ranks.items()}
    q = [(k, e, n[k], None if k not in place else float(np.interp(place[k], *zip(*sorted((r, v) for (b, r), v in value.items() if b == k))))) for k, e in enumerate(edges)]
    return allowed_by(d.sparkSession.createDataFrame(q, "k int, edge double, n bigint, q double"), least)


def admitted(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (ratio, distance) with ``allowed`` and ``admitted``: whether one unit can have both, by ``limits``. Ratios beyond the last edge are not admitted."""
    rows = found.orderBy("k").collect()
    edges, most = [r.edge for r in rows], [r.distance for r in rows]
    allowed = F.array(*map(F.lit, most))[F.greatest(band(F.col("ratio"), edges), F.lit(0))]
    return pairs.withColumn("allowed", allowed).withColumn("admitted", (F.col("ratio") <= edges[-1]) & (F.col("distance") <= allowed))


def along_curve(waves: DataFrame, bands: int = 5) -> DataFrame:
    """cluster, share, scatter: the scatter of directions about their mean, and what share of it the mean directions of bands of the norm account for; null for clusters of ``bands`` events or fewer.

    Bands part the norms at their exact quantiles. Scatter is of sums by cluster, band and element, so no cluster is gathered."""
    d = directions(waves)
    cuts = d.groupBy("cluster").agg(F.percentile("size", F.array(*(F.lit(k / bands) for k in range(1, bands)))).alias("cuts"))
    inside = d.join(cuts, "cluster").withColumn("band", F.size(F.filter("cuts", lambda c: c <= F.col("size"))))
    sums = inside.select("cluster", "band", F.posexplode("u").alias("at", "v")).groupBy("cluster", "band", "at").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("cluster", "at")
    each = sums.select("cluster", "at", (F.col("s") * F.col("s") / F.col("n")).alias("own"), F.sum("s").over(whole).alias("all"), F.sum("n").over(whole).alias("total"), F.row_number().over(whole.orderBy("band")).alias("k"))
    one = each.groupBy("cluster").agg(F.sum("own").alias("own"), F.sum(F.when(F.col("k") == 1, F.col("all") * F.col("all") / F.col("total"))).alias("middle"), F.max("total").alias("total"))
    scatter, enough = F.col("total") - F.col("middle"), F.col("total") > bands
    return one.select("cluster", F.when(enough, (F.col("own") - F.col("middle")) / F.greatest(scatter, F.lit(1e-30))).alias("share"), F.when(enough, scatter).alias("scatter"))
