"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut the bytes of space + text. Inside ``mapInPandas`` the cumulative ends of the two token sequences are merged: an end that
both have closes a group; each interval between neighbouring ends of the merged sequence lies in one token of either side, and so is one link. Spark then
counts the links of each id pair over the corpus, takes the maximum of each B id, and joins both back.

No token of either vocabulary goes past a place where a space follows another character than white space, so texts fall into segments there,
mostly words. A segment's tokens, groups and links are found once and kept (``SEEN`` segments a task, then they are found anew), and a
document's are those of its segments one after another. What is joined is not a row for each link, but one for each pair of a slice of
documents (``SLICE`` characters, or one document): it is added up in the slice first, and what comes back is the slice's own pairs.

Defined results: a text that is null or empty, or that either tokenizer doesn't give back byte for byte (one with U+2581), has no tokens: zeros and ''.
Special tokens' strings are plain text. A null id stays null; repeated rows are counted and returned one by one. An id pair counts as best if no pair of its B id has
a larger count, so ties are all best. An empty table gives no row. Other columns, whatever their names, are ignored. A very long text is a slice by itself, its tokens
in one task (about 20 bytes a character).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settings, table, written

SLICE = 2_000_000
SEEN = 150_000
#: Rows of long arrays, and texts, go to Python few at a time.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Slices of a row group. A slice takes about 10 MB when read, and a reader holds a row group's rows at once: without this, as many as an input split has slices.
GROUPED = {"parquet.block.row.count.limit": "4", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
SPACED = regex.compile(r"\s ")
CUT = regex.compile(r"(?<=\S)(?= )")
#: B's sign for a space.
SPACE = "▁"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SLICES = (
    "slice bigint, docs array<bigint>, " + ", ".join(f"{n} array<bigint>" for n in COUNTS) + ", digests array<string>, sizes array<bigint>, segments array<int>, seg_sizes array<bigint>, seg_links array<int>, pairs array<bigint>, times array<bigint>"
)
SCHEMA = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in COUNTS) + ", n_best bigint, count_sum bigint, groups_sha256 string"


def byte_tokenizer(name: str):
    """The function from text to ids, and the bytes of each id."""
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    entries = np.full(max(ranks.values()) + 1, b"", object)
    for entry, i in ranks.items():
        entries[i] = entry
    return coder.encode_ordinary, entries


def piece_tokenizer(name: str):
    """Like ``byte_tokenizer``; the tokenizer adds the first space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
    entries = np.full(model.get_piece_size(), b"", object)
    for i in range(len(entries)):
        piece = model.id_to_piece(i)
        entries[i] = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode()
    return lambda text: model.encode(text[1:]), entries


class Side:
    """One tokenizer, with what its ids weigh and how they are written."""

    def __init__(self, encode, entries: np.ndarray, between: str, last: str):
        self.encode, self.entries = encode, entries
        self.bytes = np.array([len(x) for x in entries], np.int64)
        self.inner, self.outer = (np.array([f"{i}{sign}".encode() for i in range(len(entries))], object) for sign in (between, last))
        self.first = len(self.ids(" a"))

    def ids(self, text: str) -> np.ndarray:
        ids = np.array(self.encode(text), np.int64)
        if b"".join(self.entries[ids]) != text.encode():
            raise ValueError("a tokenizer doesn't give back the bytes of its text")
        return ids


def per(ends: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the sorted ``ends`` are in each interval that ``edges`` close."""
    return np.diff(np.searchsorted(ends, edges, "right"), prepend=0)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of the ranges (start, size), one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


class Aligner:
    """Groups and links of segments; those of segments seen before are kept."""

    def __init__(self, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", seen: int = SEEN):
        self.a, self.b, self.seen = Side(*byte_tokenizer(a), ",", "|"), Side(*piece_tokenizer(b), ",", ";"), seen
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.text: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.links = np.zeros(0, np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of both sides to the groups' text and the counts of each segment, and the links. ``edges``: where segments end, in bytes."""
        end_a, end_b = np.cumsum(self.a.bytes[a]), np.cumsum(self.b.bytes[b])
        ends, shared = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        links = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
        # a group is written as its A ids, then its B ids
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        flat = np.empty(len(a) + len(b), object)
        flat[np.arange(len(a)) + np.searchsorted(end_b, np.r_[0, shared][group_a], "right")] = np.where(shared[group_a] == end_a, self.a.outer[a], self.a.inner[a])
        flat[np.arange(len(b)) + np.searchsorted(end_a, shared[group_b], "right")] = np.where(shared[group_b] == end_b, self.b.outer[b], self.b.inner[b])
        counts = np.stack([per(x, edges) for x in (end_a, end_b, shared, ends)], 1)
        if len(edges) and not np.isin(edges, shared, assume_unique=True).all():
            raise ValueError("a token goes past the end of a segment")
        cut = np.r_[0, np.cumsum(counts[:, 0] + counts[:, 1])].tolist()
        return [b"".join(flat[i:j]) for i, j in zip(cut, cut[1:], strict=False)], counts, links

    def learn(self, new: list[str]) -> None:
        """Segments without their leading space."""
        # one that ends in white space, as a text may, is encoded as the end of a text of its own, the others all together
        odd = [x for x in new if not x or x[-1].isspace()]
        new = [x for x in new if x and not x[-1].isspace()]
        a, b = (np.concatenate([side.ids(" ".join(["", *new])), *(side.ids(f" a {x}")[side.first :] for x in odd)]) for side in (self.a, self.b))
        new += odd
        said, counts, links = self.merge(a, b, np.cumsum([len(x.encode()) + 1 for x in new]))
        self.at.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
        self.text += said
        self.counts, self.links = np.concatenate([self.counts, counts]), np.concatenate([self.links, links])

    def segments(self, text: str | None) -> list[str]:
        """Without their leading spaces; of a text without tokens none."""
        if not text or SPACE in text:
            return []
        return [x[1:] for x in CUT.split(f" {text}")] if SPACED.search(f" {text}") else text.split(" ")

    def slice(self, texts: list[str | None]) -> dict:
        """The columns of SLICES from ``n_a`` on."""
        if len(self.at) > self.seen:
            self.clear()
        words = [self.segments(t) for t in texts]
        if new := list(dict.fromkeys(w for w in chain.from_iterable(words) if w not in self.at)):
            self.learn(new)
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        known, local, times = np.unique(codes, return_inverse=True, return_counts=True)
        # links of the slice's segments: which of its pairs each is, and how often the slice has each pair
        seg_sizes = self.counts[known, 3]
        links = self.links[ragged((np.cumsum(self.counts[:, 3]) - self.counts[:, 3])[known], seg_sizes)]
        pairs, seg_links = np.unique(links, return_inverse=True)
        said = map(self.text.__getitem__, codes.tolist())
        digests = [hashlib.sha256(b"".join(next(said) for _ in range(n))[:-1]).hexdigest() if n else "" for n in sizes.tolist()]
        totals = sums(self.counts[codes], sizes)
        return {
            **{n: totals[:, k] for k, n in enumerate(COUNTS)},
            "digests": digests,
            "sizes": sizes,
            "segments": local.astype(np.int32),
            "seg_sizes": seg_sizes,
            "seg_links": seg_links.astype(np.int32),
            "pairs": pairs,
            "times": np.bincount(seg_links, np.repeat(times, seg_sizes), len(pairs)).astype(np.int64),
        }


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, of the given sizes."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, 0)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def cut(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have ``limit`` characters together, or are one text."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def aligned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", limit: int = SLICE) -> DataFrame:
    """A row for each slice of documents; see SLICES. ``slice`` holds the task, so a task that runs again gives the same."""

    def run(frames):
        aligner, first, rest = Aligner(a, b), TaskContext.get().partitionId() << 32, None
        name = 0
        for frame in chain(frames, [None]):
            # batches are smaller than slices; what is left of one goes into the next
            held = pd.concat([rest, frame]) if rest is not None and frame is not None else frame if frame is not None else rest
            if held is None or frame is not None and sum(map(len, filter(None, held["_text"]))) < limit:
                rest = held
                continue
            texts, ids = held["_text"].tolist(), [None if pd.isna(x) else int(x) for x in held["_id"]]
            for i, j in cut(texts, limit):
                row = aligner.slice(texts[i:j])
                yield pd.DataFrame({"slice": [first + name], "docs": [ids[i:j]], **{k: [v] for k, v in row.items()}})
                name += 1
            rest = None

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInPandas(run, SLICES)


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold it. A pair is its A id times 2^32 plus its B id."""
    return slices.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """``pair_counts`` with ``best``: whether no pair of the same B id has a larger count."""
    keyed = counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = keyed.groupBy("b").agg(F.max("n").alias("most"))
    return keyed.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(slices: DataFrame, stats: DataFrame) -> DataFrame:
    """A row for each document; see SCHEMA. The counts of a slice's pairs come back to it as two arrays in the order of ``pairs``."""
    own = slices.select("slice", F.posexplode("pairs").alias("at", "pair")).join(stats, "pair")
    back = own.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("s")).select("slice", F.col("s.n").alias("n"), F.col("s.best").cast("array<int>").alias("best"))

    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                size = len(r.docs)
                value = np.zeros((len(r.seg_sizes), 2), np.int64)
                if size and r.n is not None:
                    value = sums(np.stack([r.best, r.n], 1).astype(np.int64)[r.seg_links], r.seg_sizes)
                best, total = sums(value[r.segments], r.sizes).T
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in r.docs], "Int64"), **{n: getattr(r, n) for n in COUNTS}, "n_best": best, "count_sum": total, "groups_sha256": r.digests})

    return slices.drop("pairs", "times").join(back, "slice", "left").mapInPandas(run, SCHEMA)


def alignment(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a: str = "byte_bpe_50k", b: str = "piece_bpe_32k", limit: int = SLICE) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    with settings(docs.sparkSession, ARROW):
        slices = written(aligned(docs, id_col, text, a, b, limit), "slices", **GROUPED)
        counts = written(pair_counts(slices), "pair-counts")
        return written(scored(slices, with_best(counts)), "alignment")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
