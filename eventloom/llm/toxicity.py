"""Toxicity by compression distance.

zstandard's trainer makes two dictionaries: one of ordinary text, and one of toxic text, which is put before the ordinary one. A text is
cut into windows of ``WINDOW`` words, each is compressed with either, and the difference of the two lengths is compared with
``THRESHOLDS``. How many windows pass each, calibrated by logistic regression on labelled rows that neither dictionary was trained on, gives
the score.

The trainer ranks segments by how often they recur, and what recurs most in toxic text is what recurs in all text. So it gets the parts of the toxic
texts that ordinary text lacks: runs of n-grams of ``GRAM`` bytes in ``RATIO`` times as large a share of the toxic texts as of the
ordinary ones, beyond chance (``ALPHA``). A part counts once for each pair of neighbours, so that copies of a text don't rule.

Defined results: null and empty texts have one window of no gain, and the score that follows from it. If the sample lacks
one of the two labels, all scores are 0 (no toxic example) or 1 (no other); with empty tables there is no row. Equal labels of one id count once;
null labels are left out, and unlike labels of one id are both learnt from. Rows with equal texts and labels are learnt from once and scored one by one.
A score of 0.5 is toxic. Very long texts are taken window by window. Other columns are ignored, whatever their names, and kept by ``without_toxic``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, held_out, slices, table

WINDOW = 6
#: Labelled rows learnt from, about, and characters of all their texts, about; taken by a hash of id and text. Only these come to the driver.
TRAIN_ROWS, TRAIN_CHARS = 8_000, 60_000_000
#: One of so many sampled rows calibrates, the others train the dictionaries.
CALIBRATING = 3
#: An n-gram is of toxic text if it is in so many toxic texts, so many times as frequent, and so many n-grams at most would be by chance.
GRAM, LEAST, RATIO, ALPHA = 8, 3, 8, 1.0
#: The dictionaries' sizes, the trainer's segment and match lengths, and the ordinary windows trained on at most, evenly spaced over the sample.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, MATCH, ORDINARY_WINDOWS = 3072, 32_768, 20, 8, 40_000
THRESHOLDS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None


def plain(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    w = (text or "").lower().encode("utf-8", "replace").split()
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)]


def compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
        strategy=zs.STRATEGY_BTLAZY2, min_match=5, window_log=17, chain_log=17, hash_log=17, search_log=7, target_length=64,
    )
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params)


def features(texts: list[str], ordinary: zs.ZstdCompressor, toxic: zs.ZstdCompressor) -> np.ndarray:
    out = np.zeros((len(texts), 2 * len(THRESHOLDS) + 1))
    for i, t in enumerate(texts):
        gain = np.array([len(ordinary.compress(x)) - len(toxic.compress(x)) for x in windows(t)] or [0])
        passed = np.array([(gain >= q).sum() for q in THRESHOLDS])
        out[i] = [*np.log1p(passed), *(passed / len(gain)), np.log(len(gain))]
    return out


def grams(text: bytes) -> np.ndarray:
    """The n-gram that begins at each byte, as a number."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(b) - GRAM + 1)
    return sum((b[k : k + n] << np.uint64(8 * (GRAM - 1 - k)) for k in range(GRAM)), np.zeros(n, np.uint64))


def document_counts(texts: list[str], flush: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts, in order, and in how many texts each is; merged every ``flush`` n-grams, so little is held twice."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(np.unique(grams(plain(t))))
        size += len(held[-1])
        if size > flush or i == len(texts) - 1:
            new, times = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(keys, new)
            old = keys[np.minimum(at, len(keys) - 1)] == new if len(keys) else np.zeros(len(new), bool)
            counts[at[old]] += times[old].astype(np.int32)
            keys, counts = np.insert(keys, at[~old], new[~old]), np.insert(counts, at[~old], times[~old])
            held, size = [], 0
    return keys, counts


def toxic_grams(toxic: list[str], ordinary: list[str]) -> np.ndarray:
    """The n-grams, in order, that toxic texts have beyond chance and ``RATIO`` times as often as ordinary ones."""
    (known, times), (keys, t) = document_counts(ordinary), document_counts(toxic)
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    o = np.where(known[at] == keys, times[at], 0) if len(known) else np.zeros(len(keys), np.int64)
    # Chernoff's bound: the chance that so many of an n-gram's texts are toxic is e^-far at most
    part, q = t / np.maximum(t + o, 1), len(toxic) / (len(toxic) + len(ordinary))
    far = t * np.log(np.maximum(part, 1e-300) / q) + o * np.log(np.maximum(1 - part, 1e-300) / (1 - q))
    return keys[(t >= LEAST) & (t / len(toxic) >= RATIO * (o + 0.5) / len(ordinary)) & (far >= np.log(max(len(keys), 1) / ALPHA))]


def toxic_parts(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """What toxic texts have and ordinary ones lack, each part once for each pair of neighbours, in an order that the texts' order doesn't change."""
    known, found = toxic_grams(toxic, ordinary), set()
    for t in toxic if len(known) else []:
        text = plain(t)
        g = grams(text)
        is_in = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
        edges = np.flatnonzero(np.diff(np.concatenate([[0], is_in.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2] + GRAM - 1, strict=True):
            found.add((text[max(0, a - 8) : a], text[a:b], text[b : b + 8]))
    return [x[1] for x in sorted(found, key=lambda x: (zlib.crc32(b"".join(x)), x))]


def trained(size: int, samples: list[bytes], **how) -> bytes:
    """A dictionary by zstandard's trainer; of samples too few for it, the samples themselves, as far as they fit."""
    try:
        return zs.train_dictionary(size, samples, **how).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    return w


def spaced(found: list, most: int) -> list:
    """``most`` of these at most, evenly spaced from the first to the last."""
    return found if len(found) <= most else [found[k * (len(found) - 1) // max(most - 1, 1)] for k in range(most)]


def dictionaries(toxic: list[str], ordinary: list[str], ordinary_windows: int = ORDINARY_WINDOWS) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the toxic one that goes before it."""
    base = trained(ORDINARY_BYTES, spaced([w for t in ordinary for w in windows(t, 16)], ordinary_windows)) or b" " * 8
    parts = toxic_parts(toxic, ordinary)
    return base, trained(TOXIC_BYTES, [b"".join(parts[i : i + 4]) for i in range(0, len(parts), 4)], k=SEGMENT, d=MATCH) if parts else b""


def fit(texts: list[str], labels: list[int], ordinary_windows: int = ORDINARY_WINDOWS) -> Model:
    """A model of labelled texts. If the rows that calibrate, or the others, lack a label, all rows do both."""
    known = [(t, int(y == 1)) for t, y in zip(texts, labels, strict=True) if t]
    if len({y for _, y in known}) < 2:
        return Model(b"", b"", *(np.zeros(1),) * 3, constant=float(any(y for _, y in known)))
    held, rest = known[CALIBRATING - 1 :: CALIBRATING], [x for i, x in enumerate(known) if i % CALIBRATING != CALIBRATING - 1]
    if any(len({y for _, y in some}) < 2 for some in (held, rest)):
        held = rest = known
    base, more = dictionaries([t for t, y in rest if y], [t for t, y in rest if not y], ordinary_windows)
    x = features([t for t, _ in held], compressor(base), compressor(more + base))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(base, more + base, mean, scale, logistic((x - mean) / scale, np.array([y for _, y in held]) == 1))


def score(texts: list[str], model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = (features(texts, compressor(model.ordinary), compressor(model.toxic)) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model.weights, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    """A model of labelled rows that are not held out: about ``train_rows`` of them, with about ``train_chars`` characters together."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic is not null").where(~held_out(F.col("_id"))).distinct()
    n = known.agg(F.count(F.lit(1))).first()[0]
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").alias("_doc"), text.alias("_text")).where(text.isNotNull())
    taken = lambda df, share, *by: df if share >= 1 else df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 20)) < int((1 << 20) * share))
    some = taken(known, train_rows / max(n, 1), "_id")
    got = rows.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("_doc", "_text", "_toxic")
    chars = got.agg(F.sum(F.length("_text"))).first()[0] or 0
    got = taken(got, train_chars / max(chars, 1), "_doc", "_text").groupBy("_toxic", F.md5(F.col("_text").cast("binary")).alias("_md5")).agg(F.min_by("_text", "_doc").alias("_text"), F.min("_doc").alias("_doc"))
    found = sorted((r[0], r[1], r[2]) for r in got.select("_doc", "_text", "_toxic").collect())
    return fit([r[1] for r in found], [r[2] for r in found])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch, texts):
        p = score(texts, shared.value)
        return [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return by_text(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")], "text", run, "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches, "text"):
            yield batch.filter(pa.array(score(texts, shared.value) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
