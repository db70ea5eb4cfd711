"""Documents into shards of nearly equal bytes, by longest processing time first.

Documents with equal texts are a group and stay together. Groups, sorted by their bytes, the largest first, go one by one to the shard that has the fewest
bytes, taken from a heap. Groups of equal size come after one another, so a run of them is dealt in turns: the shards that are less than one group
above the emptiest take one each, in the order in which the heap would give them, for as many rounds as no other shard falls behind them. What the one task that
deals reads is therefore a row for each different size of a group, not for each group; n sizes sum to n * n / 2 bytes at least, so there are sqrt(2 * bytes) at most
(14 million for 100 TB), and it holds nothing but the heap.

Texts aren't shuffled: a row is the document's id, size, checksum and digest. Groups and rows are each sorted once over all tasks and written; a row's place in
the order then follows from its file and its place there, so neither a large group nor a shard is gathered in a task. The few groups that have more than a
thousandth of the rows are broadcast, the others joined.

Defined results: a null text has no bytes and is equal to an empty one. Sizes are bytes plus 16. Groups of equal size are in the order of their texts' SHA-256; of shards with equal loads the
smallest number is next. Slots follow the doc_id, nulls first, then the row's place in its file; repeated rows have slots of their own. An empty table gives no row.
Other columns, whatever their names, are ignored. A group larger than a shard's fair share makes that shard larger than the others, as it can't be split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 40
#: Added to the bytes of each document.
OVERHEAD = 16
#: Groups with more than the rows / HOT rows are broadcast: HOT of them at most.
HOT = 1000
#: Places in the order are joined with the plan in blocks of so many.
BLOCK = 1024
PLAN = "first bigint, until bigint, turns array<int>"


class Heap:
    """The shards by load; ``deal`` gives out a run of groups of equal size."""

    def __init__(self, shards: int):
        self.loads = [(0, s) for s in range(shards)]

    def deal(self, size: int, count: int) -> Iterator[tuple[int, list[int]]]:
        """(groups, shards): so many groups go to these shards in turn."""
        while count:
            turn = [heapq.heappop(self.loads)]
            while self.loads and len(turn) < count and self.loads[0][0] < turn[0][0] + size:
                turn.append(heapq.heappop(self.loads))
            rounds = count // len(turn)
            if self.loads:
                rounds = min(rounds, max(1, (self.loads[0][0] - turn[0][0]) // size))
            for load, shard in turn:
                heapq.heappush(self.loads, (load + rounds * size, shard))
            yield rounds * len(turn), [s for _, s in turn]
            count -= rounds * len(turn)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` sorted over all tasks and written, with each row's place in the order, from 0, as ``place``."""
    rows = written(df.orderBy(*order), name).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # one row a file: files are numbered by the task that wrote them
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    starts = files.select("_file", (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").withColumn("place", F.col("_start") + F.col("_row")).drop("_file", "_row", "_n", "_start")


def dealt(groups: DataFrame, shards: int) -> DataFrame:
    """See PLAN: the groups at places ``first`` to ``until`` of the order go to the shards ``turns`` in turn. ``groups``: weight, in any order."""
    runs = groups.groupBy("weight").agg(F.count("*").alias("n")).orderBy(F.desc("weight")).coalesce(1)

    def run(batches):
        heap, place = Heap(shards), 0
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for weight, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for count, turns in heap.deal(weight, n):
                    for into, x in zip(found, (place, place + count, turns), strict=True):
                        into.append(x)
                    place += count
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.list_(pa.int32()))], ["first", "until", "turns"])

    return runs.mapInArrow(run, PLAN)


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    facts = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("key")), "facts")

    counted = facts.groupBy("key").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    groups = ranked(counted.select("key", "n", (F.col("n") * F.col("size")).alias("weight")), [F.desc("weight"), F.col("key")], "groups")
    # a place in the order and the turn that it belongs to meet in the blocks that the turn reaches into
    plan = dealt(groups, shards).withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("until") - 1) / BLOCK))))
    mine = groups.withColumn("block", F.floor(F.col("place") / BLOCK)).join(plan, "block").where("place >= first AND place < until")
    placed = written(mine.select("key", "n", F.expr("turns[cast((place - first) % size(turns) AS int)]").alias("shard")), "placed")

    least = F.lit(facts.count() / HOT)
    hot = F.broadcast(placed.where(F.col("n") > least).select("key", "shard"))
    both = facts.select("*", F.col("_metadata.file_name").alias("_from"), F.col("_metadata.row_index").alias("_at")).join(hot, "key", "left")
    cold = both.where("shard IS NULL").drop("shard").join(placed.where(F.col("n") <= least).select("key", "shard"), "key")
    rows = both.where("shard IS NOT NULL").unionByName(cold).select("doc_id", "size", "text_crc32", "shard", "_from", "_at")

    numbered = ranked(rows, [F.col("shard"), F.asc_nulls_first("doc_id"), F.col("_from"), F.col("_at")], "rows").drop("_from", "_at")
    before = numbered.groupBy("shard").agg(F.min("place").alias("_before"))
    return numbered.join(F.broadcast(before), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("_before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def crc32_sql(raw: str) -> str:
    """SQL for the CRC-32 of the bytes of ``raw``, half a byte at a time, as DuckDB has no such function."""
    turns = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        turns.append(c)
    codes = f"flatten(list_transform(regexp_extract_all(hex(encode({raw})), '..'), lambda x: [strpos('0123456789ABCDEF', x[2]) - 1, strpos('0123456789ABCDEF', x[1]) - 1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: xor(c >> 4, ({turns}::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295)"


#: One group after another, each to the first of the least loads.
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size FROM documents),
g AS (
  SELECT row_number() OVER (ORDER BY sum(size) DESC, sha256(t)) AS k, t, sum(size)::BIGINT AS w, {crc32_sql("t")} AS crc FROM d GROUP BY t),
p AS (
  SELECT 0::BIGINT AS k, NULL::INT AS shard, list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS loads
  UNION ALL
  SELECT s.k, s.at - 1, list_transform(s.loads, lambda x, i: x + CASE WHEN i = s.at THEN s.w ELSE 0 END)
  FROM (SELECT g.k, g.w, p.loads, list_position(p.loads, list_min(p.loads))::INT AS at FROM p JOIN g ON g.k = p.k + 1) AS s)
SELECT d.doc_id, d.size::BIGINT AS size, g.crc::BIGINT AS text_crc32, 'bytes' AS law, p.shard, row_number() OVER (PARTITION BY p.shard ORDER BY d.doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN g USING (t) JOIN p USING (k)
"""
