"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to their words: A-Z lower-cased, runs of ASCII letters, digits and other code points from U+0080. A document word is hit if it is
inside an occurrence of ``WINDOW`` consecutive words of an item, or of a whole shorter item. The automaton runs over words, as numbers: it
holds, of each item, the ``ANCHOR`` words from every ``ANCHOR``th word on (any window has one of these whole), and shorter items whole; so it
holds a node for each item word or less, not all windows. A document is scanned once; the few windows that an anchor can be part of are looked up in a table of the
items' windows, by number and then word by word, however many items share the anchor: time is in proportion to text and items. ``original_spans`` maps hit words back to code points of the text.

The items are broadcast only if they have ``LIMIT_WORDS`` words at most, which take about 250 MB in a Python worker. More are dealt by a hash of
the item into blocks of about that size; each block scans the documents in turn, and what it finds is written before the next begins, so that one
automaton lives at a time. An item is in one block, however long.

Defined results: null texts and texts without words have no word and no hit; items without words match nothing. Items with
a null id count as hits but are not named. Repeated items or documents are answered one by one, an item id once; equal passages of several items
name them all. Empty tables give no row, or no hit. Other columns are ignored, whatever their names, and kept by ``without_leaks``.
Very long texts are scanned whole, one at a time.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, delete, slices, table, written

WINDOW, ANCHOR = 10, 5
LIMIT_WORDS = 2_000_000
#: Letters of either alphabet; their square is more than the distinct words that a block can have.
LETTERS = 1500
KEEP = re.compile(rb"[0-9a-z\x80-\xff]")
NORMAL = bytes(b if KEEP.match(bytes([b])) else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    """The text in UTF-8, byte for byte, with all that is outside words as spaces."""
    return (text or "").encode("utf-8", "replace").translate(NORMAL)


def lettered(words: np.ndarray) -> str:
    """Two letters for each word's number, of alphabets that don't meet, so that an automaton's nodes have few children and matches begin at words."""
    letters = np.stack([(words // LETTERS) % LETTERS + 0x100, words % LETTERS + 0x800], axis=1)
    return letters.astype("<u2").tobytes().decode("utf-16-le")


class Windows:
    """The words of items (id, text) and, once it is needed, what finds their windows: the automaton of anchors, and a table of windows."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int = WINDOW):
        self.size, self.step = size, max(1, size // 2)
        self.number: dict[bytes, int] = {}
        self.items = []
        for item, text in items:
            if words := normal(text).split():
                self.items.append((item, np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int32)))
        self.automaton = None

    def __getstate__(self):
        return {"size": self.size, "step": self.step, "number": self.number, "items": self.items, "automaton": None}

    def built(self):
        import ahocorasick

        short: dict[str, list] = {}
        for k, (_, words) in enumerate(self.items):
            if len(words) < self.size:
                short.setdefault(lettered(words), []).append(k)
        self.lists: list[np.ndarray] = [np.array(x) for x in short.values()]
        self.tabled()
        automaton = ahocorasick.Automaton()
        for _, words in self.items:
            if len(words) >= self.size:
                text = lettered(words)
                for s in range(0, len(words) - self.step + 1, self.step):
                    automaton.add_word(text[2 * s : 2 * (s + self.step)], (self.step, -1))
        for at, key in enumerate(short):
            # a short item's words may be an anchor too
            automaton.add_word(key, (len(key) // 2, at, key in automaton))
        automaton.make_automaton()
        return automaton

    def hashed(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for each window that begins at one of these places."""
        out = np.zeros(len(at), np.uint64)
        for k, factor in enumerate(self.factors):
            out += words[at + k].astype(np.uint64) * factor
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)

    def same(self, a: np.ndarray, at: np.ndarray, b: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the windows of a at ``at`` are those of b at ``other``, word by word."""
        ok = np.ones(len(at), bool)
        for k in range(self.size):
            ok &= a[at + k] == b[other + k]
        return ok

    def tabled(self) -> None:
        """The items' windows by their numbers, each with a place to compare with and the list of items that it is in; windows of the same items have one list."""
        long = [(k, words) for k, (_, words) in enumerate(self.items) if len(words) >= self.size]
        self.words = np.concatenate([words for _, words in long]) if long else np.zeros(0, np.int32)
        sizes = np.array([len(words) for _, words in long], np.int32)
        counts = sizes - self.size + 1
        at = np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes - np.cumsum(counts, dtype=np.int32) + counts, counts) + np.arange(counts.sum(), dtype=np.int32)
        owner = np.repeat(np.array([k for k, _ in long], np.int32), counts)
        for seed in range(100):
            self.factors = np.random.default_rng(seed).integers(1, 2**63, self.size, np.uint64) * np.uint64(2) + np.uint64(1)
            numbers = self.hashed(self.words, at)
            order = np.lexsort((owner, numbers))
            numbers, place, item = numbers[order], at[order], owner[order]
            first = np.r_[True, numbers[1:] != numbers[:-1]] if len(numbers) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            if self.same(self.words, place, self.words, place[first][group] if len(place) else place).all():
                break
        self.windows, self.place = numbers[first], place[first]
        # one row for each window and item, then one list for each set of items
        new = first | np.r_[True, item[1:] != item[:-1]] if len(item) else first
        group, item = group[new], item[new]
        size = np.bincount(group, minlength=len(self.windows))
        start = np.cumsum(size) - size
        mixed = (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        sign = np.add.reduceat(mixed * np.uint64(0x94D049BB133111EB), start) if len(start) else np.zeros(0, np.uint64)
        _, rep, which = np.unique(sign, return_index=True, return_inverse=True)
        alike = np.array_equal(size[rep[which]], size)
        if not alike or not np.array_equal(item[np.repeat(start[rep[which]] - start, size) + np.arange(size.sum())], item):
            rep, which = np.arange(len(size)), np.arange(len(size))
        self.list = which + len(self.lists)
        self.lists += [item[start[r] : start[r] + size[r]] for r in rep]

    def found(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where items occur in a document: first word, end word and list of items, for each window and each whole shorter item.

        The text is scanned once. An anchor tells of ``size - step + 1`` windows that may be there, whatever the number of items that have it, and each is looked up once."""
        none = np.zeros(0, np.int64)
        if not self.items or not words:
            return none, none, none
        if self.automaton is None:
            self.automaton = self.built()
        known = self.number.get
        seen = np.fromiter((known(w, 0) for w in words), np.int32, len(words))
        anchors, short = [], []
        for letter, (k, which, *both) in self.automaton.iter(lettered(seen)):
            at = letter // 2 - k + 1
            if which >= 0:
                short.append((at, at + k, which))
            if which < 0 or both[0]:
                anchors.append(at)
        begins, whole = none, np.array(short, np.int64).reshape(-1, 3)
        if anchors and len(seen) >= self.size:
            may = (np.array(anchors)[:, None] - np.arange(self.size - self.step + 1)).ravel()
            begins = np.unique(may[(may >= 0) & (may <= len(seen) - self.size)])
            numbers = self.hashed(seen, begins)
            row = np.minimum(np.searchsorted(self.windows, numbers), len(self.windows) - 1)
            ok = self.windows[row] == numbers
            begins, row = begins[ok], row[ok]
            ok = self.same(seen, begins, self.words, self.place[row])
            begins, row = begins[ok], row[ok]
            whole = np.concatenate([whole, np.stack([begins, begins + self.size, self.list[row]], 1)])
        return whole[:, 0], whole[:, 1], whole[:, 2]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The passages of a document that are items' windows, joined where they overlap or touch, and the ids of those items."""
        start, end, lists = self.found(words)
        return joined(start, end), {self.items[k][0] for x in np.unique(lists).tolist() for k in self.lists[x].tolist()}

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int | None]]:
        """(first word, end word, item) of each window, and each shorter item, in a document."""
        return [(a, b, self.items[k][0]) for a, b, x in zip(*(c.tolist() for c in self.found(words)), strict=True) for k in self.lists[x].tolist()]


def joined(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """``covered``, of arrays."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return list(zip(start[new].tolist(), reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]].tolist(), strict=True))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans with those that overlap or touch joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def original_spans(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points, end exclusive, of spans of words, which are in order."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    out, at, points = [], 0, 0
    for a, b in words:
        ends = []
        for byte in (places[a][0], places[b - 1][1]):
            points += len(raw[at:byte].decode("utf-8", "replace"))
            at = byte
            ends.append(points)
        out.append(tuple(ends))
    return out


def blocks(items: DataFrame, id_col: str, text: str, limit: int = LIMIT_WORDS) -> list[DataFrame]:
    """The items in parts of about ``limit`` words at most."""
    rows = items.select(F.col(id_col).cast("long").alias("_item"), F.col(text).cast("string").alias("_text"))
    words = F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    n = -(-(rows.agg(F.sum(words)).first()[0] or 0) // limit) or 1
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == k) for k in range(n)]


def shared_windows(part: DataFrame):
    """The items of a block, whose size ``blocks`` bounds, as a broadcast."""
    return part.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()]))


def scanned(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", limit: int = LIMIT_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (code points of hit passages) for each row of ``docs``."""
    out = docs.select(F.col(id_col).cast("long").alias("_doc"), F.lit(None).cast("binary").alias("_found"), F.col(text).cast("string").alias("_text"))
    parts, before = blocks(items, item_col, "text", limit), None
    for k, part in enumerate(parts):
        out = part_scanned(out, shared_windows(part), k == len(parts) - 1)
        if k < len(parts) - 1:
            out = written(out, "scanned")
            if before is not None:
                delete(docs.sparkSession, before)
            before = out
    return out


def part_scanned(rows: DataFrame, shared, last: bool) -> DataFrame:
    """Adds a block's matches to ``_found``, or, at the last block, gives the results."""

    def matches(batch, texts):
        for before, t in zip(batch.column(1).to_pylist(), texts, strict=True):
            words = normal(t).split()
            found, items = shared.value.hits(words)
            old_spans, old_items = pickle.loads(before) if before else ([], set())
            yield words, covered(old_spans + found), old_items | items

    def more(batch, texts):
        return [batch.column(0), pa.array([pickle.dumps((s, i)) for _, s, i in matches(batch, texts)], pa.binary()), pa.array(texts, pa.string())]

    def result(batch, texts):
        rows = []
        for t, (words, spans, found) in zip(texts, matches(batch, texts), strict=True):
            hit = sum(b - a for a, b in spans)
            names = sorted(str(x) for x in found if x is not None)
            rows.append((len(words), hit, len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, [{"start": a, "end": b} for a, b in original_spans(t, spans)] if spans else []))
        n, hit, count, sha, bad, spans = zip(*rows, strict=True)
        return [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    keep = [F.col("_doc"), F.col("_found")]
    if last:
        return by_text(rows, keep, "_text", result, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>")
    return by_text(rows, keep, "_text", more, "_doc bigint, _found binary, _text string")


def without_leaks(docs: DataFrame, items: DataFrame, limit: int = LIMIT_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no window of an item occurs in."""
    parts, before = blocks(items, "item_id", "text", limit), None
    for k, part in enumerate(parts):
        shared = shared_windows(part)

        def run(batches, shared=shared):
            for batch, texts in slices(batches, "text"):
                yield batch.filter(pa.array([not len(shared.value.found(normal(t).split())[0]) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if k < len(parts) - 1:
            docs = written(docs, "clean")
            if before is not None:
                delete(docs.sparkSession, before)
            before = docs
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM
  (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, iw.item_id, dw.k, dw.i FROM dw JOIN iw USING (k, s)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m),
h AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1),
piece AS (SELECT doc_id, generate_subscripts(g, 1) AS p, length(unnest(g)) AS gap, length(unnest(w)) AS word FROM
  (SELECT doc_id, w, string_split_regex(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')[1:len(w)] AS g FROM d JOIN h USING (doc_id))),
place AS (SELECT doc_id, p, sum(gap + word) OVER (PARTITION BY doc_id ORDER BY p) AS stop, word FROM piece),
island AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit),
span AS (SELECT doc_id, min(stop - word) AS a, max(stop) AS z FROM island JOIN place USING (doc_id, p) GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a) AS spans FROM span GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
