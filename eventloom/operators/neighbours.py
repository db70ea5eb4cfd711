"""The k nearest rows of each query row, exactly, through coarse cells; and rows whose neighbours mostly bear another label.

Every row is in the cell of its nearest centre and keeps its distance to it. A query first meets the rows of its ``probes`` nearest cells, whose k-th distance bounds what can be nearer. By the triangle
inequality a row is then only worth measuring if its distance to its centre differs from the query's by no more than that bound; queries meet a cell's rows in tasks, from which only the nearest come back (``met``), and
cells wholly beyond are not joined at all. So the result is that of comparing all with all, and ``reached`` tells how much was compared. Centres are rows picked by a hash; they number ``cells`` and go to the tasks, so their
number is what bounds them.

Defined results: rows with a null id or vector are left out; vectors are of one length. Of equal distances (to 1e-9) the smaller id is nearer. A row isn't its own neighbour. Queries with fewer than k rows to
find get those there are. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import matrix
from .storage import written

#: Distances are compared with so much leeway, so that rounding loses nothing.
SLACK = 1e-9
MOST_CELLS = 4096
#: Rows of a cell in a part, about; and distances that a task holds at once.
MOST_ROWS, CELLS = 50_000, 4_000_000


def lengths(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row to each centre."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0))


def centres_of(rows: DataFrame, cells: int, seed: int = 0) -> np.ndarray:
    """So many rows (event, x), picked by a hash."""
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"1 to {MOST_CELLS} cells")
    return np.array([r.x for r in rows.orderBy(F.xxhash64(F.lit(seed), "event"), "event").limit(cells).select("x").collect()], float)


def celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """event, x, cell, r: the nearest centre of each row, and how far it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = lengths(matrix(batch.column(1)), centres)
                best = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(d)), best])], ["event", "x", "cell", "r"])

    return rows.select("event", "x").mapInArrow(run, "event bigint, x array<double>, cell int, r double")


def ways(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """q, v, to: each query and its distance to all centres, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = lengths(matrix(batch.column(1)), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))], ["q", "v", "to"])

    return queries.select(F.col("event").alias("q"), F.col("x").alias("v")).mapInArrow(run, "q bigint, v array<double>, to array<double>")


def met(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """q, event, cell, part, distance, compared: of each query (q, v, bound, d, cell) the k nearest rows of each part of a cell (event, x, cell, r), and how many it was compared with there: those whose r is within ``bound`` of its d.

    A cell's rows are dealt into parts of ``MOST_ROWS`` by a hash, and each part meets its queries in one task, block by block; so only the nearest leave it, and no pair that is compared becomes a row."""
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MOST_ROWS).cast("int").alias("parts"))
    left = asked.join(F.broadcast(parts), "cell").select("q", "v", "bound", "d", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))  # a row a cell
    right = placed.join(F.broadcast(parts), "cell").select("event", "x", "r", "cell", F.pmod(F.xxhash64("event"), F.col("parts")).cast("int").alias("part"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(a) and len(b):
            q, bound, d = (a.column(c).to_numpy() for c in ("q", "bound", "d"))
            event, r = b.column("event").to_numpy(), b.column("r").to_numpy()
            v, x = matrix(a.column("v").combine_chunks()), matrix(b.column("x").combine_chunks())
            size = (x * x).sum(1)
            step = max(1, CELLS // len(x))
            for i in range(0, len(q), step):
                some = slice(i, i + step)
                ok = (np.abs(d[some, None] - r) <= bound[some, None]) & (q[some, None] != event)
                square = np.where(ok, (v[some] * v[some]).sum(1)[:, None] + size - 2 * v[some] @ x.T, np.inf)
                n = ok.sum(1)
                # beyond rounding of products all that may be among the nearest
                kth = np.partition(square, k - 1, 1)[:, k - 1] if square.shape[1] > k else np.full(len(square), np.inf)
                leeway = 1e-9 * (1 + np.abs(size).max() + (v[some] * v[some]).sum(1)) + 4 * SLACK * np.sqrt(np.maximum(kth, 0))
                for row in np.flatnonzero(n):
                    at = np.flatnonzero(ok[row] & (square[row] <= kth[row] + leeway[row]))
                    far = np.sqrt(((x[at] - v[i + row]) ** 2).sum(1))
                    best = np.lexsort((event[at], np.round(far, 9)))[:k]
                    out.append((np.full(len(best), q[i + row]), event[at[best]], far[best], np.full(len(best), n[row])))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        one = a if len(a) else b
        cell, part = (np.full(len(cols[0]), one.column(c)[0].as_py(), np.int32) for c in ("cell", "part"))
        return pa.table({"q": cols[0], "event": cols[1], "cell": cell, "part": part, "distance": cols[2], "compared": cols[3]})

    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(run, "q bigint, event bigint, cell int, part int, distance double, compared bigint")


def closest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, with their rank."""
    w = Window.partitionBy("q").orderBy(F.round("distance", 9), "event")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int, cells: int = 32, probes: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Neighbours (q, event, rank, distance) of the queries (event, x) among rows (event, x); and reached (q, cells, compared): how many cells and rows each query met."""
    good = lambda df: df.where("event IS NOT NULL AND x IS NOT NULL").select(F.col("event").cast("bigint").alias("event"), F.col("x").cast("array<double>").alias("x"))
    own = written(good(rows), "vectors")
    if own.isEmpty():
        none = own.sparkSession.createDataFrame([], "q bigint, event bigint, rank int, distance double")
        return none, none.select("q", F.col("event").alias("cells"), F.col("event").alias("compared"))
    centres = centres_of(own, cells, seed)
    placed = written(celled(own, centres), "cells")
    asked = written(ways(good(queries), centres), "ways")
    each = F.transform("to", lambda d, c: F.struct(d.alias("d"), c.alias("cell")))
    first = asked.select("q", "v", F.explode(F.slice(F.array_sort(each), 1, probes)).alias("c")).select("q", "v", F.lit(float("inf")).alias("bound"), "c.d", F.col("c.cell").cast("int").alias("cell"))
    near = written(closest(met(first, placed, k), k).groupBy("q").agg(F.max("distance").alias("most"), F.count(F.lit(1)).alias("n")), "bounds")
    # without k rows yet, anything may be near
    bound = F.when(F.col("n") == k, F.col("most") + SLACK).otherwise(float("inf"))
    wide = placed.groupBy("cell").agg(F.min("r").alias("inner"), F.max("r").alias("outer"))
    left = asked.join(near, "q", "left").select("q", "v", F.coalesce(bound, F.lit(float("inf"))).alias("bound"), F.explode(each).alias("c"))
    # the cells with a row that can be near: few rows of cells, joined on the cell
    open_ = left.select("q", "v", "bound", F.col("c.cell").alias("cell"), F.col("c.d").alias("d")).join(wide, "cell").where((F.col("d") - F.col("outer") <= F.col("bound")) & (F.col("inner") - F.col("d") <= F.col("bound")))
    found = written(met(open_.withColumn("cell", F.col("cell").cast("int")), placed, k), "found")
    each_part = found.groupBy("q", "cell", "part").agg(F.max("compared").alias("compared"))
    reached = each_part.groupBy("q").agg(F.count_distinct("cell").alias("cells"), F.sum("compared").alias("compared"))
    return closest(found, k).select("q", "event", "rank", "distance"), reached


def reclaimed(rows: DataFrame, queries: DataFrame, k: int, share: float = 0.8, least: int = 1, cells: int = 32) -> DataFrame:
    """event, label, other, votes: queries (event, label, x) whose k nearest rows of other labels (of the 4 k nearest rows; labels of ``least`` rows or more) are of one label for a share of ``share`` at least. Ties go to the smaller
    label. Queries with fewer than k such neighbours have no row."""
    big = rows.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("label")
    pool = rows.join(big, "label", "left_semi")
    found, _ = nearest(pool, queries, 4 * k, cells)
    of = rows.select(F.col("event").alias("q"), F.col("label").alias("own")), rows.select("event", "label")
    foreign = found.join(of[0], "q").join(of[1], "event").where("label <> own")
    kth = foreign.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("place") <= k)
    votes = kth.groupBy("q", "own", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("q", "own").agg(F.max(F.struct("votes", -F.col("label"))).alias("b"), F.sum("votes").alias("all")).where(F.col("all") == k)
    return best.where(F.col("b.votes") >= F.lit(-(-share * k // 1))).select(F.col("q").alias("event"), F.col("own").alias("label"), (-F.col("b.col2")).alias("other"), F.col("b.votes").alias("votes"))
