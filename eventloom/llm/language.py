"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; n-grams of 1 to 4 code points, those at the end filled up with zeros, are hashed into ``BUCKETS`` columns. Counting is a
distributed sum, the matrix of log probabilities (BUCKETS x languages, 4 bytes each) is broadcast, and each batch of texts is
scored in numpy as a sparse product: rows of the matrix are gathered by n-gram and summed by document. A language's share of the learnt documents is its prior.

Defined results: a null text and a text without a letter give ``und`` with score 0; without a labelled text to learn from all
rows give that. Ties go to the language first in alphabetical order. A null id is in the learnt fold. Repeated rows are
answered one by one, and learnt from one by one; other columns, whatever their names, are ignored. An empty table gives no row. Very long texts are scored whole, one at a time. More
than ``MOST_LANGS`` languages are an error, as the matrix would be too large to send to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, held_out, slices, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
GAP = "\0" * max(ORDERS)
MOST_LANGS = 500
#: Labelled rows learnt from, at most about so many (taken by a hash of the id).
TRAIN_ROWS = 20_000
SMOOTHING = 0.05
LETTER = regex.compile(r"\p{L}")


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashed n-grams that begin in each text, for each order, and where in them each text begins."""
    own = [(t or "").lower() for t in texts]
    c = np.frombuffer("".join(t + GAP for t in own).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in own], np.int64)
    starts = np.cumsum(sizes) - sizes
    # none begins in the gap, so that no text tells on the next
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(own)) * len(GAP), sizes)
    out, h = [], np.zeros(len(at), np.uint32)
    for n in ORDERS:
        h = h * np.uint32(0x01000193) + c[at + n - 1] + np.uint32(1)
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(16))
    return out, starts


def counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, bucket, n: how often each n-gram bucket occurs in the texts of each language."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, "_text"):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                total = held.setdefault(name, np.zeros(BUCKETS, np.int64))
                for h in grams(own)[0]:
                    total += np.bincount(h, minlength=BUCKETS)
        for name, total in held.items():
            (at,) = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text")).where("_lang is not null and _text is not null")
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities, whose last row is the priors'. At most about ``train_rows`` rows are learnt from; what comes to the driver has BUCKETS rows a language at most."""
    usable = labelled.where(F.col(lang).isNotNull())
    n = usable.agg(F.count(F.lit(1))).first()[0]
    if n > train_rows:
        usable = usable.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < int((1 << 20) * train_rows / n))
    shares = dict(usable.where(F.col(text).isNotNull()).groupBy(F.col(lang).cast("string").alias("l")).agg(F.count(F.lit(1))).limit(MOST_LANGS + 1).collect())
    if len(shares) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: the matrix of log probabilities would be too large")
    got = counts(usable, text, lang).toPandas()
    langs = sorted(got["lang"].unique())
    m = np.full((BUCKETS, len(langs)), SMOOTHING)
    if langs:
        m[got["bucket"].to_numpy(), [langs.index(x) for x in got["lang"]]] += got["n"].to_numpy()
    prior = np.array([[shares[x] for x in langs]], float)
    return langs, np.concatenate([np.log(m / m.sum(axis=0)), np.log(prior / max(prior.sum(), 1))]).astype(np.float32)


def score(texts: list[str], langs: list[str], m: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its share of the probability."""
    out, sure = ["und"] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if langs else []
    if some:
        orders, starts = grams([texts[i] for i in some])
        total = np.zeros((len(some), len(langs))) + m[BUCKETS:].sum(axis=0)
        for h in orders:
            total += np.add.reduceat(m[h], starts, axis=0, dtype=np.float64)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        sure[some] = 1 / p.sum(axis=1)
        for i, k in zip(some, best, strict=True):
            out[i] = langs[k]
    return out, sure


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch, texts):
        names, sure = score(texts, *shared.value)
        return [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(sure)]

    return by_text(docs, [F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out")], text, run, "doc_id bigint, held_out boolean, lang_pred string, score double", 400_000)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out(F.col("doc_id")))))
