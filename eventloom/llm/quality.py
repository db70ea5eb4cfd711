"""Quality rules as a short-circuit cascade.

Each rule rejects a text or lets it pass. On a bounded sample the cost (seconds) and the share of rejections of each rule are
estimated, and rules are ordered by rejections per cost. A text meets the rules in that order and leaves at the first
that rejects it. The verdict doesn't depend on the order, so results are the same whatever the timings are.

Words are split at ASCII white space. The base statistics are computed for every text; the rules work on what those leave open.

Defined results: a null text has no words, and is rejected as too short. Repeated rows are answered one by one. An empty
table gives no row. Very long texts are judged whole, one at a time, but take no part in the estimate of costs. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, table

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128)
#: Rows that costs and selectivities are estimated on, at most about so many, and the longest of them.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 50_000


class Text:
    """A text and its base statistics."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "replace")
        self.words = self.raw.split()
        self.n = len(self.words)
        # code points: bytes that continue none
        body = self.raw.translate(None, SPACES)
        self.word_chars = len(body.translate(None, bytes(range(0x80, 0xC0))))
        self.symbols = len(body) - len(body.translate(None, SYMBOLS))
        lines = self.lines = [x for x in self.raw.split(b"\n") if x.strip(SPACES)]
        self.dup_lines = len(lines) - len(set(lines))
        self.repeat_words = repeated(self.words)
        self.base_failed = self.n < 50 or 100 * self.repeat_words > 50 * self.n


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three words that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, total, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


#: Each rule is true for texts to reject.
RULES: dict[str, Callable[[Text], bool]] = {
    "word_length": lambda t: not 2 <= share(t.word_chars, t.n) <= 14,
    "symbols": lambda t: share(t.symbols, t.n) > 0.6,
    "dup_lines": lambda t: share(t.dup_lines, len(t.lines)) > 0.5,
    "letters": lambda t: share(sum(1 for w in t.words if w.translate(None, LETTERS) != w), t.n) < 0.6,
    "bullets": lambda t: share(sum(1 for x in t.lines if x.lstrip(SPACES).startswith((b"-", b"*", "•".encode()))), len(t.lines)) > 0.9,
    "ellipses": lambda t: share(sum(1 for x in t.lines if x.rstrip(SPACES).endswith((b"...", "…".encode()))), len(t.lines)) > 0.5,
    "top_word": lambda t: share(Counter(t.words).most_common(1)[0][1] if t.n else 0, t.n) > 0.3,
}


def order(texts: list[str | None], rules: dict[str, Callable[[Text], bool]] = RULES) -> list[str]:
    """The rules by estimated rejections per cost, the best first."""
    made = [x for t in texts if not (x := Text(t)).base_failed]
    gain = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = sum(map(rule, made))
        gain[name] = (rejected + 0.01) / (time.perf_counter() - began + 1e-9)
    return sorted(gain, key=lambda name: -gain[name])


def cascade(text: Text, names: list[str], rules: dict[str, Callable[[Text], bool]] = RULES) -> str | None:
    """The first rule, in the order of ``names``, that rejects the text."""
    return next((name for name in names if rules[name](text)), None)


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    n = docs.select(F.lit(1)).count()
    some = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * min(1, sample_rows / max(n, 1))))
    return order([r[0] for r in some.where(F.length("_text") <= SAMPLE_CHARS).select("_text").collect()])


def rated(docs: DataFrame, names: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for each row of ``docs``."""

    def run(batch, texts):
        rows = []
        for t in map(Text, texts):
            rows.append((t.n, t.word_chars, t.symbols, t.dup_lines, t.repeat_words, t.base_failed, not t.base_failed and cascade(t, names) is None))
        cols = list(zip(*rows, strict=True))
        return [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.bool_())]

    return by_text(docs, [F.col(id_col).cast("long").alias("doc_id")], text, run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rated(docs, plan(docs))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY 1),
top AS (SELECT doc_id, max(k) AS top FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT w.doc_id, len(w) AS n_words, len(l) AS n_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(top, 0) AS top, l,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letters,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN top USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_symbols::DOUBLE / n_words > 0.6 OR n_dup_lines::DOUBLE / greatest(n_lines, 1) > 0.5
    OR n_letters::DOUBLE / n_words < 0.6 OR n_bullets::DOUBLE / greatest(n_lines, 1) > 0.9 OR n_ellipses::DOUBLE / greatest(n_lines, 1) > 0.5 OR top::DOUBLE / n_words > 0.3) AS kept
FROM f
"""
