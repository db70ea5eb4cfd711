"""Jaccard self-join of documents on word shingles: rare-first prefix filtering, and components of what links.

A document is its set of distinct shingles of five words, as 64-bit hashes; documents link when 100 x common >= 80 x all.

1. Sizes, a 128-bit digest and a histogram of each set, of 64 to 4096 parts. Equal digests are one class, whose least id stands for it. Shingle
   frequencies over all documents are added up, ``FAN`` tasks at a time, in a table of 2^22 counters, which is broadcast.
2. Prefixes: each set is ordered by frequency, rarest first; two sets that link share one of the first n - ceil(0.8 n) + 1.
   Postings are rows, dealt by shingle and sorted; a copy within a task is posted once. This is the only large shuffle.
3. Lists: shingles that one document has are dropped. Each other list pairs all its documents with its
   first, so a list of m gives m - 1 pairs, and a task holds that one alone. Lists far longer than most are dealt in parts. Pairs pass the length and the
   positional filter, for the first shingle that they share; then, each pair once, the suffix
   filter on the histograms (unlike counts bound the symmetric difference from below); then they are verified on whole sets.
   Ids in lists and pairs become those of their classes' representatives.
4. Lists whose documents lie in different components after that are unresolved; of lists with the same documents one is enough. While their open pairs are many, and get fewer, each pairs its
   documents with another of its members. At last all pairs of different components that may still link are verified; for large components
   the triangle inequality of Jaccard distance tells which (see ``crossing``). So a large group of near copies never
   becomes all its pairs, and no link between components is missed.

Components come from rounds of the least label with pointer jumping on written tables.

Defined results: null and wordless texts have no shingle and link with nothing; a text of fewer than five words is one shingle.
A null id is a component of its own, null. Rows that repeat an id are answered one by one, each with its own size and all with that id's component: an id
links with whatever any of its rows links with. An empty table gives no row. Other columns are ignored, whatever their names, and kept by ``one_of_each``,
which keeps one row of each component. Very long texts are sets in memory, one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, settings, slices, table, written

SHINGLE, PERCENT = 5, 80
COUNTER_BITS, BLOCKS, FAN = 22, 64, 64
#: Prefix shingles of a task, about; ids or shingles that are broadcast at most (beyond, the same join shuffles them).
TASK_ROWS, BROADCAST_IDS = 1_000_000, 1_000_000
#: Bytes of text that a task holds at a time; digests that it remembers, so as not to post copies (the result is the same without).
SLICE, SEEN = 300_000, 1_000_000
#: Documents in a part of a list that is dealt by document too; pairs of a document in a part of its comparisons.
HOT, HOT_PAIRS = 20_000, 1_000
POSTINGS = "sh bigint, salt int, id bigint, pos int, n int"
#: Batches between the JVM and Python are small, as long texts and whole sets pass.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Open pairs, for each row of the unresolved lists, up to which no more turns are taken.
OPEN_PAIRS = 4
#: Documents of a component that gets a pivot; how much nearer to it a document may be than one that it links with.
LARGE, REACH, BLOCK = 16, 0.2 + 1e-9, 200
COLUMNS = ("id", "pos", "n", "c", "odd")
MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The multiplier's inverse modulo 2^64.
BACK = np.uint64(pow(int(MULT), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006
    """base^0 ... base^(n - 1), kept for the next call."""
    if len(held.get(base, ())) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        held[base] = np.multiply.accumulate(p)
    return held[base][:n]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "replace").lower() + b" " for t in texts]
    b = np.frombuffer(b" " + b"".join(raw), np.uint8)
    ends = np.cumsum([1, *map(len, raw)])
    space = SPACE[b]
    edge = np.diff(space.astype(np.int8))
    starts, stops = np.nonzero(edge == -1)[0] + 1, np.nonzero(edge == 1)[0] + 1
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(MULT, len(b)))])
    words = mixed((total[stops] - total[starts]) * powers(BACK, len(b))[starts] + (stops - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, ends)
    p = powers(MULT, SHINGLE + 1)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled += words[k : k + len(rolled)] * p[k]
    rolled = mixed(rolled + p[SHINGLE])
    out = []
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if i == j:
            out.append(np.zeros(0, np.uint64))
        elif j - i < SHINGLE:
            out.append(mixed((words[i:j] * p[: j - i]).sum(keepdims=True, dtype=np.uint64) + np.uint64(j - i)))
        else:
            s = np.sort(rolled[i : j - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    if not len(s):
        return 0, 0
    return tuple(int(x) for x in np.array([mixed(s * MULT).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).view(np.int64))


def least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The fewest common elements with which sets of n and m link."""
    return -(-PERCENT * (n.astype(np.int64) + m) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def ints(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def histogram(s: np.ndarray) -> bytes:
    """How many hashes begin with each pattern of 6, 8, 10 or 12 bits, more bits for larger sets."""
    bits = 6 + 2 * sum(len(s) >= k for k in (512, 2048, 8192))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 65535).astype(np.uint16).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """At most the number of elements that two sets with these histograms don't share."""
    p, q = (np.frombuffer(h, np.uint16).astype(np.int64) for h in (x, y))
    if len(p) != len(q):
        k = min(len(p), len(q))
        p, q = p.reshape(k, -1).sum(axis=1), q.reshape(k, -1).sum(axis=1)
    return int(np.abs(p - q).sum())


SUMMARY = "doc_id bigint, n bigint, c1 bigint, c2 bigint, parts binary, part int, block int, counts binary"


def summaries(rows: DataFrame) -> DataFrame:
    """Of each row (_id, _text) its set's size, digest and histogram; and, with block and counts alone, each task's counters."""
    names = [x.split()[0] for x in SUMMARY.split(", ")]

    def run(batches):
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch, texts in slices(batches, "_text", SLICE):
            sets = shingle_sets(texts)
            at, times = np.unique(np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS), return_counts=True)
            counters[at.astype(np.int64)] += times.astype(np.uint32)
            parts = [histogram(s) for s in sets]
            d = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            none = pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ints([len(s) for s in sets]), ints(d[:, 0]), ints(d[:, 1]), pa.array(parts, pa.binary()), *none], names)
        if counters.any():
            packed = [zstandard.compress(x.tobytes(), 1) for x in counters.reshape(BLOCKS, -1)]
            empty = [pa.nulls(BLOCKS, t) for t in (pa.int64(),) * 4 + (pa.binary(),)]
            task = pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int32())
            yield pa.RecordBatch.from_arrays([*empty, task, pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(packed, pa.binary())], names)

    return rows.mapInArrow(run, SUMMARY)


def frequencies(summary: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, ``FAN`` of a block's at a time: 2^22 numbers, whatever the input is."""

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros((1 << COUNTER_BITS) // BLOCKS, np.uint64)
        for x in part.column("counts"):
            total += np.frombuffer(zstandard.decompress(x.as_py()), np.uint32)
        packed = zstandard.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pa.table({"block": part.column("block").slice(0, 1), "part": part.column("part").slice(0, 1), "counts": pa.array([packed], pa.binary())})

    spark, schema = summary.sparkSession, "block int, part int, counts binary"
    parts = summary.where("block is not null").select("block", "part", "counts")
    n, before = (parts.agg(F.max("part")).first()[0] or 0) + 1, None
    while n > FAN:
        parts = written(parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInArrow(add, schema), "counters")
        if before is not None:
            delete(spark, before)
        n, before = -(-n // FAN), parts
    out = np.zeros((BLOCKS, (1 << COUNTER_BITS) // BLOCKS), np.uint32)
    for block, _, counts in parts.groupBy("block").applyInArrow(add, schema).collect():
        out[block] = np.frombuffer(zstandard.decompress(counts), np.uint32)
    return out.ravel()


def prefixes(rows: DataFrame, shared) -> DataFrame:
    """sh, salt, id, pos, n: the shingles of the prefix of each row (_id, _text), their places, and the set's size. A set that its task had before is left out.

    The lists of shingles that far more documents have than most are dealt by the document too, in parts of about ``HOT``; their salt isn't -1."""

    def run(batches):
        seen, usual = set(), 2 * float(shared.value.mean())
        for batch, texts in slices(batches, "_text", SLICE):
            held = []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(texts), strict=True):
                if doc is None or not len(s) or (d := digest(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(d)
                k = prefix_length(len(s))
                f = shared.value[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                at = np.lexsort((s, f))[:k]
                times = f[at].astype(np.int64)
                salt = np.where(times > usual + HOT, int(mixed(np.array([doc], np.int64).view(np.uint64))[0] >> np.uint64(1)) % (times // HOT + 1), -1)
                held.append((s[at].view(np.int64), salt.astype(np.int32), np.full(k, doc, np.int64), np.arange(k, dtype=np.int32), np.full(k, len(s), np.int32)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["sh", "salt", "id", "pos", "n"])

    return rows.mapInArrow(run, POSTINGS)


def may_link(pos_a, n_a, pos_b, n_b) -> np.ndarray:
    """Length filter, and positional filter for the first shingle that two ordered sets share, at these places: all they share comes from there on."""
    n_a, n_b, pos_a, pos_b = (x.astype(np.int64) for x in (n_a, n_b, pos_a, pos_b))
    length = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    most = np.minimum(n_a - pos_a, n_b - pos_b)
    return length & (most >= least_common(n_a, n_b))


def lists(postings: DataFrame, parts: int) -> DataFrame:
    """Pairs (x < y, pos and n null) to test, and the rows (x shingle, y id, pos, n) of lists of two documents or more.

    Each task reads its postings sorted, and holds the first of the list that it is in. A salted part of a list may be of one document."""
    dealt = postings.repartition(parts, "sh", "salt").sortWithinPartitions("sh", "salt", "id")

    def run(batches):
        lead, told = None, False
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(cols[0]):
                continue
            if lead is not None:
                cols = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(lead, cols, strict=True)]
            sh, salt, doc, pos, n = cols
            first = np.concatenate([[True], (sh[1:] != sh[:-1]) | (salt[1:] != salt[:-1])])
            at = np.cumsum(first) - 1
            leads = np.flatnonzero(first)[at]
            many = (np.bincount(at)[at] > 1) | (salt >= 0)
            ok = many & ~first & (doc != doc[leads]) & may_link(pos[leads], n[leads], pos, n)
            again = lead is not None and told
            j = leads[-1]
            told = bool(many[-1]) or again and j == 0
            lead = [c[j] for c in cols]
            if again:
                many[0] = False
            x, y = doc[leads[ok]], doc[ok]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            fresh = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
            x, y = x[fresh], y[fresh]
            none = pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ints(np.concatenate([x, sh[many]])), ints(np.concatenate([y, doc[many]])), pa.concat_arrays([none, pa.array(pos[many])]), pa.concat_arrays([none, pa.array(n[many])])],
                ["x", "y", "pos", "n"],
            )

    return dealt.mapInArrow(run, "x bigint, y bigint, pos int, n int")


def plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """a, b: the pairs (x, y) as representatives, each once, that pass the suffix filter. facts: doc_id, rep, n, parts; one row an id."""
    side = lambda k: facts.select(*(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "rep", "n", "parts")))
    both = pairs.distinct().join(side("x"), F.col("x") == F.col("doc_id_x")).join(side("y"), F.col("y") == F.col("doc_id_y")).where("rep_x <> rep_y")

    def run(batches):
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            unlike = np.array([apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = unlike <= n + m - 2 * least_common(n, m)
            yield pa.RecordBatch.from_arrays([ints(np.minimum(a, b)[ok]), ints(np.maximum(a, b)[ok])], ["a", "b"])

    return both.select("rep_x", "rep_y", "n_x", "n_y", "parts_x", "parts_y").mapInArrow(run, "a bigint, b bigint").distinct()


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if it has ``BROADCAST_IDS`` rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def compared(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, common, whole: the sizes of intersection and union of the whole sets of each pair (a, b). Only rows of ids in a pair are looked at.

    A set goes to its pairs first, a part of them at a time where they are many, and with them to the other set, so that no task gets all sets that one document is compared with."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "ids")

    def run(batches):
        for batch, texts in slices(batches, "_text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["id", "s"])

    sets = written(rows.join(bounded(ids), "_id", "left_semi").mapInArrow(run, "id bigint, s binary"), "sets")

    def test(batches):
        for batch in batches:
            common, whole = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                common.append(int((both[1:] == both[:-1]).sum()))
                whole.append(len(both) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ints(common), ints(whole)], ["a", "b", "common", "whole"])

    given = sets.select(F.col("id").alias("a"), "s")
    if pairs.count() < HOT_PAIRS:
        with_a = pairs.join(given, "a")
    else:
        many = written(pairs.groupBy("a").agg(F.floor(F.count(F.lit(1)) / HOT_PAIRS).alias("k")).where("k > 0"), "hot")
        hot = bounded(many)
        dealt = pairs.join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(0)) + 1)).drop("k")
        given = given.join(hot, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("k", F.lit(0))))).drop("k")
        with_a = dealt.join(given, ["a", "salt"]).select("a", "b", "s")
    out = with_a.join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b").select("a", "b", "s", "t").mapInArrow(test, "a bigint, b bigint, common bigint, whole bigint")
    out = written(out, "compared")
    delete(rows.sparkSession, ids, sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """id, component for each end of the edges (a, b): the least id that can be reached."""
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("l")).select("id", F.least("id", "l").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = written(lower.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        done = new.where("old <> component").isEmpty()
        delete(spark, labels)
        labels = new
        if done:
            delete(spark, both)
            return labels.select("id", "component")


def star(postings: DataFrame, turn: int) -> DataFrame:
    """x, y: the documents of each list (sh, id, pos, n, c) with one of them, another in each turn."""
    key = F.xxhash64("id", F.lit(turn))
    lead = postings.groupBy("sh").agg(F.min(F.struct(key, *COLUMNS)).alias("s")).select("sh", *(F.col(f"s.{c}").alias(f"{c}2") for c in COLUMNS))
    lead = bounded(written(lead, "leads"))
    return filtered(postings.join(lead, "sh").where("c <> c2"))


def filtered(cross: DataFrame) -> DataFrame:
    length = "100 * least(n, n2) >= 80 * greatest(n, n2)"
    place = "180 * least(n - pos, n2 - pos2) >= 80 * (n + n2)"
    return cross.where(length).where(place).select(F.least("id", "id2").alias("x"), F.greatest("id", "id2").alias("y")).distinct()


def distances(pairs: DataFrame, rows: DataFrame, facts: DataFrame) -> DataFrame:
    """id, p, common, whole, d (the Jaccard distance) of pairs (id, p); a pair of one document has distance 0."""
    ends = pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).where("a < b").distinct()
    found = compared(written(ends, "pivots"), rows)
    both = found.select(F.col("a").alias("id"), F.col("b").alias("p"), "common", "whole").union(found.select("b", "a", "common", "whole"))
    return pairs.join(both, ["id", "p"], "left").withColumn("d", F.coalesce(1 - F.col("common") / F.col("whole"), F.lit(0.0)))


def crossing(postings: DataFrame, parts: DataFrame, links: DataFrame, rows: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) that cover all that may still link components, and links (a, b) found on the way.

    Jaccard distance is a metric. Each component of ``LARGE`` documents has a pivot, that with most links. A document of
    another component that shares a list with it is compared with the pivot once. If it is more than 0.2 farther away than any member, it links with
    none; else it is tested against the members in blocks, and only pairs that pass the filters leave a block.
    """
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LARGE)
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    pivot = parts.join(sizes, "component").join(degree, "id").groupBy("component", "size").agg(F.min(F.struct(-F.col("links"), "id")).alias("s"))
    pivot = written(pivot.select(F.col("component").alias("c"), "size", F.col("s.id").alias("p")), "pivots")
    known = written(postings.join(pivot, "c", "left").withColumn("size", F.coalesce("size", F.lit(0))), "postings")
    small = known.where("p is null")
    other = small.select("sh", *(F.col(c).alias(f"{c}2") for c in COLUMNS))
    plain = filtered(small.join(other, "sh").where("c < c2"))

    members = known.where("p is not null").select("sh", *COLUMNS, "p", "size")
    inside = distances(members.select("id", "p").distinct(), rows, facts).select(F.col("id").alias("id2"), "p", F.col("d").alias("d2"))
    inside = written(inside, "distances")
    near = members.select("sh", F.col("c").alias("c2"), "p", F.col("size").alias("size2")).distinct()
    outside = written(known.drop("p").join(near, "sh").where("c <> c2 and (size2 > size or size2 = size and c2 > c)"), "outside")
    far = written(distances(outside.select("id", "p").distinct(), rows, facts), "distances")
    radius = inside.groupBy("p").agg(F.max("d2").alias("r"))
    shell = blocked(far.join(radius, "p").where(F.col("d") <= F.col("r") + REACH).select("id", "p", "d"), inside, facts)
    linked = far.where(f"100 * common >= {PERCENT} * whole").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    return plain.union(shell).distinct(), linked


def blocked(outside: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """x, y: pairs of outside (id, p, d) and members (id2, p, d2) of one pivot that pass length, triangle and suffix filters, tested in blocks of BLOCK rows of either."""
    n_out = outside.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("ko"))
    n_in = members.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("ki"))
    blocks = written(n_out.join(n_in, "p"), "blocks")
    known = facts.where("doc_id = rep").select(F.col("doc_id").alias("id"), "n", "parts").distinct()  # an id may have several sets
    spread = lambda df, own, other: written(df.join(known, "id").join(blocks, "p").select("p", "id", "n", "parts", "d", F.pmod(F.xxhash64("id"), own).alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)), "blocks")

    def test(out: pa.Table, inside: pa.Table) -> pa.Table:
        a, n, d = (out.column(c).to_numpy() for c in ("id", "n", "d"))
        b, m, e = (inside.column(c).to_numpy() for c in ("id", "n", "d"))
        p, q = (t.column("parts").to_pylist() for t in (out, inside))
        x, y = [], []
        for i in range(len(a)):
            ok = (100 * np.minimum(n[i], m) >= PERCENT * np.maximum(n[i], m)) & (np.abs(d[i] - e) <= REACH)
            most = n[i] + m - 2 * least_common(np.full(len(m), n[i]), m)
            ok[ok] = [apart(p[i], q[j]) <= most[j] for j in np.nonzero(ok)[0]]
            x.append(np.minimum(a[i], b[ok]))
            y.append(np.maximum(a[i], b[ok]))
        return pa.table({"x": ints(np.concatenate([np.zeros(0, np.int64), *x])), "y": ints(np.concatenate([np.zeros(0, np.int64), *y]))})

    left = spread(outside, "ko", "ki").groupBy("p", "ko", "ki")
    right = spread(members.select(F.col("id2").alias("id"), "p", F.col("d2").alias("d")), "ki", "ko").groupBy("p", "ko", "ki")
    return left.cogroup(right).applyInArrow(test, "x bigint, y bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``. All Python stages have run when this returns."""
    with settings(docs.sparkSession, ARROW):
        return joined(docs, id_col, text)


def joined(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    summary = written(summaries(rows), "summary")
    shared = spark.sparkContext.broadcast(frequencies(summary))
    sets = summary.where("block is null").drop("part", "block", "counts")
    classes = written(sets.where("n > 0 and doc_id is not null").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "classes")
    facts = written(sets.join(classes, ["c1", "c2", "n"], "left").select("doc_id", "n", "parts", F.coalesce("rep", "doc_id").alias("rep")), "facts")
    delete(spark, summary, classes)
    total = facts.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * (100 - PERCENT) // 100 // TASK_ROWS))
    found = written(lists(prefixes(rows, shared), tasks), "lists")

    one = facts.where("doc_id is not null and n > 0")
    linking = lambda pairs: compared(pairs, rows).where(f"100 * common >= {PERCENT} * whole").select("a", "b")
    tested = written(plausible(found.where("pos is null").select("x", "y"), one), "pairs")
    # an id of rows with unlike texts links with the class of each
    several = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("r1"), F.max("rep").alias("r2")).where("r1 < r2").select("doc_id")
    own = facts.join(several, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = written(linking(tested).union(own).distinct(), "links")
    parts = components(links)
    # a task posts the copy that it reads first; from here on ids are those of representatives
    reps = one.groupBy(F.col("doc_id").alias("y")).agg(F.collect_set("rep").alias("ids")).select("y", F.explode("ids").alias("id"), (F.size("ids") > 1).alias("odd"))
    postings = found.where("pos is not null").join(reps, "y").select(F.col("x").alias("sh"), "id", "pos", "n", "odd").distinct()
    turn, before, last = 0, None, False
    while not last:
        labelled = written(postings.join(parts.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id")), "labelled")
        if not turn:
            delete(spark, found)
        # of lists of the same documents that with the first shingle is enough, as all pairs share that first; members are told by sums of hashes and their number
        low = lambda h: h.bitwiseAND(F.lit((1 << 32) - 1))
        marks = [F.sum(low(F.xxhash64("id", "n"))).alias("m1"), F.sum(low(F.xxhash64("n", "id", F.lit(7)))).alias("m2"), F.sum(low(F.xxhash64(F.lit(3), "id", "n"))).alias("m3")]
        lists_open = labelled.groupBy("sh").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.min(F.struct("id", "pos"))["pos"].alias("first"), F.max("odd").alias("odd"), *marks).where("c1 < c2")
        size = written(lists_open.groupBy("k", "m1", "m2", "m3", F.when(F.col("odd"), F.col("sh"))).agg(F.min_by("sh", F.struct("first", "sh")).alias("sh")).select("sh", "k"), "open")
        # as an open list has at least one document of each component, its pairs are estimated by the square of its size
        rows_open, pairs_open = size.agg(F.sum("k"), F.sum(F.col("k") * F.col("k") / 2)).first()
        if not rows_open:
            break
        last = pairs_open <= OPEN_PAIRS * rows_open or before is not None and pairs_open > 0.8 * before
        before, turn = pairs_open, turn + 1
        postings = written(labelled.join(bounded(size.select("sh")), "sh", "left_semi").select("sh", *COLUMNS), "postings")
        delete(spark, labelled, size)
        if last:
            pairs, more = crossing(postings, parts, links, rows, one)
        else:
            pairs, more = star(postings, turn), None
        fresh = written(plausible(pairs, one).join(tested, ["a", "b"], "left_anti"), "pairs")
        more = written(linking(fresh) if more is None else linking(fresh).union(more), "links")
        if not more.isEmpty():
            links = written(links.union(more), "links")
            parts = components(links)
        tested, postings = tested.union(fresh), postings.drop("c")
    return facts.join(parts, facts["rep"] == parts["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of the least id, nulls last. Each row is a document of its own here, so repeated rows, copies without an id, and rows of one id
    with unlike texts are told apart, or found to be copies, by their texts alone. Rows without words are all kept."""
    name = "_row"
    while {name, f"{name}_several"} & set(docs.columns):
        name += "_"
    # ids stand for rows where they can, as the least id of a group of copies is often what the others were made from; rows without an id, or of an id that repeats, get numbers beyond all ids
    mark = f"{name}_several"
    several = written(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(mark)).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(mark), "several")
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    far = F.monotonically_increasing_id()
    number = far + F.lit(max(high or 0, -1) + 1) if (high or 0) < 1 << 62 else F.lit(min(low, 0) - 1) - far
    told = docs.join(bounded(several), docs[id_col] == several[mark], "left")
    own = written(told.withColumn(name, F.when(F.col(mark).isNull() & F.col(id_col).isNotNull(), F.col(id_col)).otherwise(number)).drop(mark), "rows")
    found = near_copies(own.select(name, "text"), name).select(F.col("doc_id").alias(name), "component_id")
    both = written(found.join(own.select(name, F.col(id_col).alias("_id")), name), "found")
    best = both.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", name))[name].alias("_best")).select("_best")
    # joined on rows, not on components, one of which may hold most rows
    gone = written(both.join(best, both[name] == best["_best"], "left_anti").select(F.col(name).alias("_gone")), "gone")
    return own.join(bounded(gone), own[name] == gone["_gone"], "left_anti").drop(name)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, md5_number(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, doc_id, count(*) AS n FROM s JOIN d USING (rid) GROUP BY 1, 2),
i AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM i JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""
