"""Packing documents into windows of 2048 tokens by the sum-of-squares rule, online.

A document is its token ids and the end id 1. Each task takes the documents of its input split as they come. Full windows are
cut off a document; the rest is placed whole into the open window whose fill level, raised by it, leaves the smallest sum
over all levels of the squared number of windows there. The level array holds those numbers. When the split ends, or
``MAX_OPEN`` windows are open (the bound on a task's memory), the fullest open windows stay as the rule made them and are filled with the tokens of
the emptiest; the last tokens go into windows whose lengths are powers of two. So nothing is padded, only the emptiest windows'
documents are cut, and no token moves between tasks: nothing is shuffled.

Ids are those of ``tokenizers`` for byte_bpe_50k.json. Its ranks are run by ``tiktoken``, which gives the same ids in a
quarter of the time; a text that names a special token goes to ``tokenizers`` itself. Long texts are encoded in pieces that
end before a space between two words, where no token can span.

Defined results: null and empty texts have the end id alone. A null id stays null. Repeated rows are packed one by one. An empty table gives no
row. Equal sums of squares go to the fullest level. Other columns, whatever their names, are ignored. Very long texts are encoded piece by piece.
sequence_id holds the split in its upper bits, so it is the same when a lost task runs again.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

LENGTH = 2048
END = 1
MAX_OPEN = 4096
SPECIAL = "<|endoftext|>"
#: A text is encoded in pieces of about so many characters.
PIECE_CHARS = 50_000
CUT = re.compile(r"(?<=\w)(?= \w)")
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Token ids of texts; ``name`` is the vocabulary's file without its ending."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.name, self.exact = name, None

    def ids(self, text: str | None) -> np.ndarray:
        if text and SPECIAL in text:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
            got = self.exact.encode(text, add_special_tokens=False).ids
        else:
            got = [x for piece in pieces(text or "") for x in self.fast.encode_ordinary(piece)]
        return np.array([*got, END], np.uint32)


def pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE_CHARS and (m := CUT.search(text, start + PIECE_CHARS)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


class Packer:
    """Online: ``add`` and, at the end, ``flush`` give rows (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN):
        self.length, self.max_open = length, max_open
        self.levels = np.zeros(length + 1, np.int64)
        self.at: list[list] = [[] for _ in range(length)]
        self.sequences = self.open = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, full = len(ids), len(ids) // self.length * self.length
        for start in range(0, full, self.length):
            yield from self.close([(doc, start, ids[start : start + self.length], total)])
        if full < total:
            yield from self.place((doc, full, ids[full:], total))

    def best_level(self, size: int) -> int:
        """The fill level, 0 for a new window, that leaves the smallest sum of squares; of several the fullest."""
        now, then = self.levels[: self.length - size + 1], self.levels[size:]
        change = 2 * then + 1 + 1 - 2 * now
        change[0] -= 1
        change[-1] = 1 - 2 * now[-1] if len(now) > 1 else 0
        change[1:][now[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def place(self, piece: tuple) -> Iterator[tuple]:
        level = self.best_level(len(piece[2]))
        window = self.at[level].pop() if level else []
        window.append(piece)
        if level:
            self.levels[level] -= 1
        else:
            self.open += 1
        if (after := level + len(piece[2])) == self.length:
            self.open -= 1
            yield from self.close(window)
        else:
            self.levels[after] += 1
            self.at[after].append(window)
        if self.open >= self.max_open:
            yield from self.flush()

    def close(self, window: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in window:
            yield doc, start, ids, total, self.sequences, at
            at += len(ids)
        self.sequences += 1

    def flush(self) -> Iterator[tuple]:
        """Fills the fullest open windows with the tokens of the emptiest, so that none needs padding.

        Of n tokens in open windows, n // length windows stay; the others' pieces, the emptiest window's first, fill the room of the
        kept ones, fullest first, and what is left goes into windows whose lengths are powers of two."""
        windows = [w for level in reversed(self.at) for w in level]
        left = sum(len(p[2]) for w in windows for p in w)
        self.levels[:], self.at, self.open = 0, [[] for _ in range(self.length)], 0
        kept, rest = windows[: left // self.length], [p for w in reversed(windows[left // self.length :]) for p in w]
        taken = iter(rest)
        doc, start, ids, total = next(taken, (None, 0, (), 0))
        small = left % self.length
        sizes = [1 << k for k in range(small.bit_length() - 1, -1, -1) if small >> k & 1]
        for window, size in [*((w, self.length) for w in kept), *(([], n) for n in sizes)]:
            room = size - sum(len(p[2]) for p in window)
            while room:
                if not len(ids):
                    doc, start, ids, total = next(taken)
                n = min(room, len(ids))
                window.append((doc, start, ids[:n], total))
                start, ids, room = start + n, ids[n:], room - n
            yield from self.close(window)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document; see SCHEMA."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        encoder, packer, first = Encoder(vocabulary), Packer(length), TaskContext.get().partitionId() << 32

        def rows(pieces):
            got = [(d, s, len(x), zlib.crc32(x.astype("<u4").tobytes()), n, first + q, o) for d, s, x, n, q, o in pieces]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)] if got else [pa.array([], pa.int64())] * 7, names)

        for batch, texts in slices(batches, "_text"):
            yield rows(p for doc, t in zip(batch.column(0).to_pylist(), texts, strict=True) for p in packer.add(doc, encoder.ids(t)))
        yield rows(packer.flush())

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
