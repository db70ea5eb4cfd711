"""The trie of conversations' prefixes: which turns conversations share from the start.

A turn's digest is that of its role and text; a prefix's digest is that of the prefix before and its last turn, so it names the node. One sorted pass gives each
conversation's prefix digests, the textless root first, in chunks of ``CHUNK`` at most. A node belongs to its smallest member. Going down a conversation the smallest member can only
grow, so the nodes that a conversation owns are the end of its path: its chain. How many of a chunk's prefixes belong to others is found by binary search, all
chunks together: each round joins one digest of each open chunk with the smallest members of the prefixes that more than one conversation has. The last probe that belongs to another
tells where the chain hangs. So the chains form a tree, each hanging below a node of another chain.

Chains are then added up bottom-up: in round k each chain gives what it has gathered to its ancestor 2^k above, so a tree of chains of height h
takes log2(h) rounds, and each round's rows are one a chain. A node's subtree is its own chain from there down, by a running sum, and what hangs below that.

Defined results: turns are sorted by turn, nulls first, then by the digest of role and text, so ties and repeated rows have one order. A null role or text is empty. Rows with a null
conv_id belong to no conversation and are left out. A conversation without rows isn't there. An empty table gives no node. Other columns, whatever their names, are ignored. Very long texts leave
their task as digests; very long conversations are in chunks. A remainder has the sign of the id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .sharding import crc32_sql

#: Prefixes in a row.
CHUNK = 1024
#: Conversations that share a stem: conv_id - conv_id % STEM.
STEM, HEADS = 20, 4
ROOT = hashlib.sha256(b"").digest()[:16]
#: Bytes of ids joined in one row before they are hashed.
IDS = 60_000
CHUNKS = "conv_id bigint, start bigint, digests array<binary>, words array<bigint>, last boolean"
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, digest, words: what is left of each turn."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)
    words = F.regexp_count(text_, F.lit(WORD))
    return conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), words.cast("long").alias("words")).where("conv_id IS NOT NULL")


def chunks(turns: DataFrame, stem: int = STEM, heads: int = HEADS, size: int = CHUNK) -> DataFrame:
    """See CHUNKS. Conversations of a stem are in one task, the stem itself first, so its first turns are at hand for those that begin with them."""
    base = F.col("conv_id") - F.col("conv_id") % stem
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("head")
    dealt = turns.select(base.alias("base"), (base != F.col("conv_id")).alias("later"), "conv_id", head, "turn", "digest", "words")
    ordered = dealt.repartition("base").sortWithinPartitions("base", "later", "conv_id", F.asc_nulls_first("turn"), "digest")

    def paths(batches) -> Iterator[tuple]:
        """(conv_id, digest of the prefix, words of its last turn, whether a conversation begins)"""
        stem_id, stem_turns, conv, at, digest = None, [], None, 0, ROOT
        for batch in batches:
            for base_, later, conv_id, head_, _, turn, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if base_ != stem_id:
                    stem_id, stem_turns = base_, []
                if conv_id != conv:
                    conv, at, digest = conv_id, 0, ROOT
                    yield conv_id, ROOT, 0, True
                    for d, n in stem_turns[:head_] if later else []:
                        digest = hashlib.sha256(digest + d).digest()[:16]
                        yield conv_id, digest, n, False
                if not later and at < heads - 1:
                    stem_turns.append((turn, words))
                if not later or at >= head_:
                    digest = hashlib.sha256(digest + turn).digest()[:16]
                    yield conv_id, digest, words, False
                at += 1

    def run(batches):
        rows: list[tuple] = []
        conv, start, digests, words = None, 0, [], []

        def batch():
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.bool_()), strict=True)], ["conv_id", "start", "digests", "words", "last"])
            rows.clear()
            return got

        for conv_id, digest, n, new in paths(batches):
            if digests and (new or len(digests) == size):
                rows.append((conv, start, digests, words, new))
                start, digests, words = start + len(digests), [], []
            if new:
                conv, start = conv_id, 0
            digests.append(digest)
            words.append(n)
            if len(rows) >= 1000:
                yield batch()
        if digests:
            rows.append((conv, start, digests, words, True))
        if rows:
            yield batch()

    return ordered.mapInArrow(run, CHUNKS)


def nodes_of(chunked: DataFrame) -> DataFrame:
    """digest, conv_id (the smallest member), depth, n_convs, words: the trie's nodes."""
    each = chunked.select("conv_id", "start", F.posexplode(F.arrays_zip("digests", "words")).alias("i", "p"))
    return each.groupBy(F.col("p.digests").alias("digest")).agg(F.min("conv_id").alias("conv_id"), F.first(F.col("start") + F.col("i")).alias("depth"), F.count("*").alias("n_convs"), F.first("p.words").alias("words"))


def first_owned(chunked: DataFrame, shared: DataFrame) -> DataFrame:
    """conv_id, first, above: a conversation's first owned depth, and who owns the node before it (null at the root). ``shared``: digest, owner of the nodes with more than one member."""
    open_ = chunked.select("conv_id", "start", "digests", F.lit(0).alias("lo"), F.size("digests").alias("hi"), F.lit(None).cast("long").alias("above"))
    done: list[DataFrame] = []
    left = True
    while left:
        # only what lies between lo and hi goes on
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        probe = open_.withColumn("mid", mid).withColumn("digest", F.element_at("digests", F.col("mid") - F.col("lo") + 1))
        told = probe.join(shared, "digest", "left")
        mine = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        lo, hi = F.when(mine, F.col("lo")).otherwise(F.col("mid") + 1), F.when(mine, F.col("mid")).otherwise(F.col("hi"))
        after = told.select("conv_id", "start", F.slice("digests", lo - F.col("lo") + 1, hi - lo).alias("digests"), lo.alias("lo"), hi.alias("hi"), F.when(mine, F.col("above")).otherwise(F.col("owner")).alias("above"))
        now = written(after, "probes")
        done.append(now.where("lo = hi").select("conv_id", "start", F.col("lo").alias("n"), "above"))
        open_ = now.where("lo < hi")
        left = not open_.isEmpty()
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # the last chunk with prefixes of others has the one before the chain
    return found.groupBy("conv_id").agg(F.sum("n").alias("first"), F.max_by("above", F.when(F.col("n") > 0, F.col("start"))).alias("above"))


def gathered(chains: DataFrame) -> DataFrame:
    """``chains`` (conv_id, above, saved, leaves) with ``saved`` and ``leaves`` summed over each chain and all that hang below it."""
    now = written(chains, "chains")
    while not (up := now.where("above IS NOT NULL")).isEmpty():
        given = up.groupBy(F.col("above").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        higher = now.where("above IS NOT NULL").select(F.col("conv_id").alias("above"), F.col("above").alias("higher"))
        now = written(
            now.join(given, "conv_id", "left")
            .join(higher, "above", "left")
            .select("conv_id", F.col("higher").alias("above"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")),
            "chains",
        )
    return now.drop("above")


def end_digests(ends: DataFrame) -> DataFrame:
    """digest, ends_sha256 from (digest, conv_id): ids are sorted over all tasks, joined in rows of bounded size, and hashed in a stream."""

    def joined(batches):
        digest, first, ids, held = None, None, [], 0
        for batch in batches:
            rows: list[tuple] = []
            for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (d != digest or held > IDS):
                    rows.append((digest, first, ",".join(ids)))
                    ids, held = [], 0
                if not ids:
                    digest, first = d, i
                ids.append(str(i))
                held += len(ids[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["digest", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["digest", "first", "ids"])

    def hashed(batches):
        digest, h = None, None
        for batch in batches:
            rows: list[tuple] = []
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if d != digest:
                    if h:
                        rows.append((digest, h.hexdigest()))
                    digest, h = d, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["digest", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([h.hexdigest()])], ["digest", "ends_sha256"])

    pieces = ends.orderBy("digest", "conv_id").mapInArrow(joined, "digest binary, first bigint, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stem: int = STEM, heads: int = HEADS, size: int = CHUNK) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    chunked = written(chunks(turns_of(conversations, conv_id, turn, role, text), stem, heads, size), "prefixes")
    nodes = written(nodes_of(chunked), "nodes")
    found = written(first_owned(chunked, nodes.where("n_convs > 1").select("digest", F.col("conv_id").alias("owner"))), "first-owned")

    own = nodes.groupBy("conv_id").agg(F.max("depth").alias("end"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    # those that own no prefix have no chain
    chains = written(own.join(found, "conv_id"), "owned")
    hangs = chains.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n_hang"))
    tips = chains.join(hangs.withColumnRenamed("depth", "end"), ["conv_id", "end"], "left")
    totals = gathered(tips.select("conv_id", "above", "saved", F.when(F.col("n_hang").isNull(), 1).otherwise(0).cast("long").alias("leaves")))

    below = chains.where("above IS NOT NULL").select("conv_id", "above", "first").join(totals, "conv_id")
    below = below.groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n_hang"), F.sum("saved").alias("hang_saved"), F.sum("leaves").alias("hang_leaves"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    none = F.lit(0).cast("long")
    placed = nodes.join(below, ["conv_id", "depth"], "left").join(chains.select("conv_id", "first", "above", "end"), "conv_id")
    tip = F.col("depth") == F.col("end")
    values = placed.select(
        "digest",
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("first"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("n_hang", none) + F.when(tip, 0).otherwise(1)).alias("n_children"),
        F.sum(F.coalesce("hang_leaves", none) + F.when(tip & F.col("n_hang").isNull(), 1).otherwise(0)).over(down).alias("n_leaves"),
        F.sum(F.coalesce("hang_saved", none) + (F.col("n_convs") - 1) * F.col("words")).over(down).alias("saved_tokens"),
    )
    ends = end_digests(chunked.where("last").select(F.element_at("digests", -1).alias("digest"), "conv_id"))
    return values.join(ends, "digest", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: A node's subtree: the nodes whose smallest member's path goes through it.
OP12_SQL = f"""
WITH s AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT c, sha256(concat(strlen(r), ':', r, x)) AS dg, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(concat(strlen(r), ':', r, x))) - 1 AS i FROM s),
n AS (
  SELECT c, {crc32_sql("c::VARCHAR")} % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT n.c, t.i, t.dg, t.w FROM n JOIN t ON t.c = n.c - n.c % {STEM} WHERE t.i < n.h
  UNION ALL SELECT n.c, t.i, t.dg, t.w FROM n JOIN t USING (c) WHERE t.i >= n.h),
p AS (
  SELECT c, 0 AS d, '' AS k, 0 AS w FROM n
  UNION ALL SELECT c, row_number() OVER (PARTITION BY c ORDER BY i), sha256(string_agg(dg, '') OVER (PARTITION BY c ORDER BY i)), w FROM r),
v AS (
  SELECT k, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(w) AS w FROM p GROUP BY k),
q AS (
  SELECT v.*, p.k AS up, u.conv_id AS parent FROM v LEFT JOIN p ON p.c = v.conv_id AND p.d = v.depth - 1 LEFT JOIN v AS u ON u.k = p.k),
f AS (
  SELECT q.*, coalesce(b.n, 0) AS n_children FROM q LEFT JOIN (SELECT up, count(*) AS n FROM q WHERE up IS NOT NULL GROUP BY up) AS b ON b.up = q.k),
y AS (
  SELECT p.k, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.w) AS saved FROM f JOIN p ON p.c = f.conv_id AND p.d <= f.depth GROUP BY p.k),
e AS (
  SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(k, d) AS k FROM p GROUP BY c) GROUP BY k)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, y.n_leaves, y.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM f JOIN y USING (k) LEFT JOIN e USING (k)
"""
