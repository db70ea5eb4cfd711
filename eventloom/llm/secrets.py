"""Secret scan: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs of characters that are neither white space nor quotes, brackets, commas or semicolons; ``EDGES`` at their ends don't belong to them. A chain is the tokens of a line. The
field tags each token with B (a secret begins), I (it goes on) or O, from its shape, the words beside it and features of the whole text and line, and is decoded by Viterbi. Any
token can be tagged, of whatever length. Whole batches of texts are taken apart and scored in arrays. A line is decoded only if some token's B or I comes
within reach of O (``slack``): in other lines O throughout is provably the best.

The field is trained by gradient ascent on the conditional likelihood, on a bounded sample of lines of the corpus (``TRAIN_LINES``), labelled by the
fixed patterns, and on lines made by rule: secrets of other forms, and look-alikes (numbers, addresses, versions, dates, long words, words after key words). Long
texts give lines like others; a line of more than ``PIECE`` characters is learnt in pieces.

Defined results: a null text is empty and has no span. Spans that the field finds are left out where all but
their punctuation lies in patterns' spans, and else are kept whole, so they may overlap those. Equal scores go to O, then B. Repeated rows are answered one by one. An empty table gives no row, and a field learnt from
one knows the made lines alone. Very long texts are scored whole. Other columns, whatever their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, slices, table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
EDGES = "\"'`<>()[]{},;:."
#: What parts tokens, besides white space.
PARTS = "\"'`<>()[]{},;"
KEYS = ("pass", "secret", "token", "key", "auth", "cred", "pwd", "bearer", "login")
SIGNS = "@=/._-:+&%#$!*~^|\\?"
REPLACEMENT = "[SECRET]"
#: Rows sampled to learn from, about; of their lines so many at most, a third of them with spans; and a line's characters.
TRAIN_ROWS, TRAIN_LINES, PIECE = 2_000, 2_400, 200
STEPS, RATE, DECAY = 80, 0.1, 2e-5
#: Tokens that a line is learnt in at a time.
SPAN = 32

# what a code point is; those from TOP on are like the last
TOP = 0x10000
PART, LOWER, UPPER, DIGIT, HEXED, EDGE, VOWEL, QUOTE = (1 << k for k in range(8))


def classes() -> np.ndarray:
    out = np.zeros(TOP, np.uint8)
    for i in range(TOP):
        c = chr(i)
        out[i] = PART * (c.isspace() or c in PARTS) | LOWER * c.islower() | UPPER * c.isupper() | DIGIT * c.isdigit() | HEXED * (c in string.hexdigits) | EDGE * (c in EDGES) | VOWEL * (c in "aeiouyAEIOUY") | QUOTE * (c in "\"'`")
    return out


CLASS = classes()
SIGN = np.full(TOP, -1, np.int16)
SIGN[[ord(c) for c in SIGNS]] = np.arange(len(SIGNS))
NUMERIC = np.zeros(TOP, bool)
NUMERIC[[ord(c) for c in ".-/:"]] = True
#: Counts of characters of several kinds are added up together, in so many bits each: lower, upper, digits; and vowels, hex digits, digits and number's signs.
BITS = 21
ONE = np.zeros((2, TOP), np.int64)
for _row, _kinds in enumerate(((LOWER, UPPER, DIGIT), (VOWEL, HEXED))):
    for _k, _bit in enumerate(_kinds):
        ONE[_row] += ((CLASS & _bit) > 0).astype(np.int64) << (BITS * _k)
ONE[1] += (((CLASS & DIGIT) > 0) | NUMERIC).astype(np.int64) << (2 * BITS)
SORT = np.where(CLASS & LOWER, 0, np.where(CLASS & UPPER, 1, np.where(CLASS & DIGIT, 2, 3))).astype(np.int8)

#: The features of a token, by name: how many values each has.
GROUPS = {"bias": 1, "length": 25, "lower": 9, "upper": 9, "digit": 9, "vowel": 10, "turns": 50, "alike": 4, "prefix": 2048, "kind": 80, "own key": 32, "before": 4096, "before that": 2048, "context": 640, "beside": 8, "file": 8, "line": 15}
AT = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()]).tolist(), strict=False))
FEATURES = sum(GROUPS.values())
#: Features that are looked up together, in a table of their sums, as one number.
TOGETHER = (("context", "own key"), ("lower", "upper", "digit", "vowel"), ("length", "alike", "beside"), ("turns", "line", "file"), ("prefix",), ("before",), ("before that",))
#: A finite stand-in for what is ruled out: O to I, and I at the start.
NEVER = -1e4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns. Matches of an access or hex pattern are whole runs, so their least lengths are part of the pattern."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def counted(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The three counts packed in ``values``, of runs of ``n`` that begin at ``at``."""
    low = (1 << BITS) - 1
    if int(n.max(initial=0)) <= low:
        total = np.add.reduceat(values, at) if len(at) else np.zeros(0, np.int64)
        return [total >> (BITS * k) & low for k in range(3)]
    return [np.add.reduceat(values >> (BITS * k) & low, at) for k in range(3)]


class Tokens:
    """The tokens of some texts: where they are, in which text and line, and their features."""

    def __init__(self, texts: list[str], sizes: list[int] | None = None):
        """``sizes``: the lengths of the files that the texts are parts of."""
        whole = "\n".join(texts) + "\n"
        c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(c, TOP - 1)
        k = CLASS[code]
        inside = (k & PART) == 0
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # without the edges; what has nothing else is no token
        solid = np.flatnonzero(inside & ((k & EDGE) == 0))
        first = np.searchsorted(solid, start)
        ok = np.append(solid, len(c))[first] < end
        first, end = first[ok], end[ok]
        self.start, self.end = solid[first], solid[np.searchsorted(solid, end) - 1] + 1
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(begins, self.start, "right") - 1
        self.begins = begins
        lines = np.cumsum(c == 10)
        self.line = lines[self.start] if len(self.start) else np.zeros(0, np.int64)
        self.size = np.array(sizes if sizes is not None else [len(t) for t in texts], np.int64)
        self.described(c, code, k, whole)

    def described(self, c: np.ndarray, code: np.ndarray, k: np.ndarray, whole: str) -> None:
        a, b, count = self.start, self.end, len(self.start)
        n = b - a
        at = np.cumsum(n) - n
        flat = np.repeat(a - at, n) + np.arange(n.sum())
        some = code[flat]
        small = c[flat]
        small += np.where((small >= 65) & (small <= 90), np.uint32(32), np.uint32(0))
        lower, upper, digit = counted(ONE[0][some], at, n)
        vowel, hexed, numeric = counted(ONE[1][some], at, n)
        sort = SORT[some]
        turn = np.concatenate([[0], sort[1:] != sort[:-1]]).astype(np.int32) if len(sort) else np.zeros(0, np.int32)
        turn[at] = 0
        turns, letters = np.add.reduceat(turn, at) if count else turn, lower + upper
        other = n - letters - digit
        power = np.cumprod(np.concatenate([[1], np.full(max(int(n.max(initial=1)) - 1, 0), 1_000_003)]).astype(np.uint64))
        word = np.add.reduceat(small * power[flat - np.repeat(a, n)], at) if count else np.zeros(0, np.uint64)
        word ^= word >> np.uint64(31)

        eighth = lambda x, of: np.minimum(8, 8 * x // np.maximum(of, 1))
        long = np.digitize(n, (6, 8, 12, 20))
        mask = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (other > 0)
        third = lambda j: small[np.minimum(at + j, at + n - 1)].astype(np.uint64)
        prefix = (third(0) * np.uint64(961) + third(1) * np.uint64(31) + third(2)) * np.uint64(0x9E3779B1) >> np.uint64(7)
        key = self.with_keys(c)
        same = np.concatenate([[False], self.line[1:] == self.line[:-1]]) if count else np.zeros(0, bool)
        twice = same & np.concatenate([[False], same[:-1]]) if count else same
        back = lambda x, j, ok: np.where(ok, np.concatenate([np.zeros(j, x.dtype), x[:-j]])[:count], 0)
        signs = np.concatenate([[0], np.cumsum((c == 58) | (c == 61))])
        parted = same & ((signs[a] - signs[np.maximum(back(b, 1, same), 1) - 1]) > 0) if count else same
        follows = np.concatenate([same[1:], [False]]) if count else same
        after = np.where(follows, np.concatenate([sort[at][1:], [0]]) if count else 0, -1)
        ahead = np.where(after < 0, 0, np.where(after < 2, 1, np.where(after == 2, 2, 3)))
        quoted = (k[np.maximum(a - 1, 0)] & QUOTE) > 0
        new = np.flatnonzero(~same)
        length = np.diff(np.append(new, count))
        place = np.arange(count) - np.repeat(new, length)
        self.first, self.length = new, length

        self.values = {
            "bias": np.zeros(count, np.int64),
            "length": np.where(n < 12, n, 12 + np.minimum((n - 12) // 4, 12)),
            "lower": eighth(lower, n), "upper": eighth(upper, n), "digit": eighth(digit, n),
            "vowel": np.where(letters > 0, eighth(vowel, letters), 9),
            "turns": np.minimum(9, 10 * turns // n) * 5 + long,
            "alike": np.where((n >= 16) & (hexed == n), 2, 0) + (numeric == n),
            "prefix": (prefix % np.uint64(2048)).astype(np.int64),
            "kind": mask * 5 + long,
            "own key": key * 16 + mask,
            "before": np.where(same, 1 + (back(word, 1, same) % np.uint64(4095)).astype(np.int64), 0),
            "before that": np.where(twice, 1 + (back(word, 2, twice) % np.uint64(2047)).astype(np.int64), 0),
            "context": ((back(key, 1, same) * 2 + parted) * 2 + back(key, 2, twice)) * 80 + mask * 5 + long,
            "beside": ahead * 2 + quoted,
            "file": np.minimum(7, np.log2(1 + self.size[self.text] // 64).astype(np.int64)),
            "line": np.digitize(np.repeat(length, length), (2, 3, 6, 13)) * 3 + np.minimum(place, 2),
        }
        # which of the signs each token has
        found = SIGN[some]
        spots = np.flatnonzero(found >= 0)
        self.signs = np.unique((np.searchsorted(at, spots, "right") - 1) * len(SIGNS) + found[spots]) if len(spots) else np.zeros(0, np.int64)

    def index(self) -> np.ndarray:
        """The features of each token as rows of the weights."""
        return np.stack([self.values[g] + AT[g] for g in GROUPS], 1).astype(np.int32)

    def with_keys(self, c: np.ndarray) -> np.ndarray:
        """Whether each token has a key word in it."""
        out = np.zeros(len(self.start), np.int64)
        low = np.where((c >= 65) & (c <= 90), c + 32, c).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        spots = []
        for key in KEYS:
            at = low.find(key)
            while at >= 0:
                spots.append(at)
                at = low.find(key, at + len(key))
        if spots and len(out):
            where = np.searchsorted(self.start, np.array(spots), "right") - 1
            out[where[(where >= 0) & (np.array(spots) < self.end[where])]] = 1
        return out


def viterbi(unary: np.ndarray, pair: np.ndarray) -> list[int]:
    best, back = unary[0] + np.array([0, 0, -np.inf]), []
    for u in unary[1:]:
        step = best[:, None] + pair
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + u
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of features for B and I (those for O are 0), and of neighbouring tags."""

    def __init__(self):
        self.w, self.sign = np.zeros((FEATURES, 2), np.float32), np.zeros((len(SIGNS), 2), np.float32)
        self.pair = np.array([[0, 0, NEVER], [0, 0, 0], [0, 0, 0]], float)

    def tables(self) -> list[np.ndarray]:
        """The weights of ``TOGETHER``, summed; the bias and what the context knows of the kind are in the first."""
        part = lambda g: self.w[AT[g] : AT[g] + GROUPS[g]]
        out = []
        for names in TOGETHER:
            total = np.zeros((1, 2), np.float32)
            for g in names:
                total = (total[:, None, :] + part(g)[None, :, :]).reshape(-1, 2)
            out.append(total)
        context = np.arange(GROUPS["context"]) % GROUPS["kind"]
        out[0] = out[0] + np.repeat(part("kind")[context], GROUPS["own key"], 0) + part("bias")
        return out

    def scores(self, tokens: Tokens) -> np.ndarray:
        """Of B and I for each token."""
        out = np.zeros((len(tokens.start), 2), np.float32)
        for names, sums in zip(TOGETHER, self.tables(), strict=True):
            row = tokens.values[names[0]]
            for g in names[1:]:
                row = row * GROUPS[g] + tokens.values[g]
            out += sums.take(row, 0)
        at, which = np.divmod(tokens.signs, len(SIGNS))
        for tag in range(2):
            out[:, tag] += np.bincount(at, self.sign[which, tag], len(out))
        return out

    def slack(self) -> float:
        """What neighbouring tags can add to a token at most, by not being O and O: each token of a run that isn't O has a share in two pairs at most."""
        return 2 * max(0.0, float((self.pair[self.pair > NEVER / 2] - self.pair[0, 0]).max()))

    def many(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The spans of secrets in each text."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        tokens = Tokens(texts)
        u = self.scores(tokens)
        near = np.flatnonzero(u.max(1) + self.slack() >= 0)
        for line in np.unique(np.searchsorted(tokens.first, near, "right") - 1).tolist():
            i, n = int(tokens.first[line]), int(tokens.length[line])
            tags = viterbi(np.c_[np.zeros(n), u[i : i + n]], self.pair)
            spans = out[tokens.text[i]]
            at = int(tokens.begins[tokens.text[i]])
            for j, tag in enumerate(tags):
                if tag == 1:
                    spans.append((int(tokens.start[i + j]) - at, int(tokens.end[i + j]) - at))
                elif tag == 2:
                    spans[-1] = (spans[-1][0], int(tokens.end[i + j]) - at)
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.many([text])[0]


class Chains:
    """Labelled tokens as chains of ``SPAN`` at most, side by side."""

    def __init__(self, examples: list[tuple[str, list[tuple[int, int]], int]]):
        """Texts, their secrets and the sizes of their files."""
        self.tokens = t = Tokens([x[0] for x in examples], [x[2] for x in examples])
        self.tags = np.zeros(len(t.start), np.int64)
        for k, (_, spans, _) in enumerate(examples):
            if spans:
                lo, hi = np.searchsorted(t.text, [k, k + 1])
                for a, b in spans:
                    hit = lo + np.flatnonzero((t.start[lo:hi] - t.begins[k] < b) & (t.end[lo:hi] - t.begins[k] > a))
                    self.tags[hit] = np.where(np.arange(len(hit)) == 0, 1, np.where(self.tags[hit] == 0, 2, self.tags[hit]))
        # an I can't follow an O, as where a span goes over a line's end
        cuts = [i + j for i, n in zip(t.first.tolist(), t.length.tolist(), strict=True) for j in range(0, n, SPAN)]
        self.first = np.array(cuts, np.int64)
        self.n = np.diff(np.append(self.first, len(t.start)))
        lone = np.concatenate([[True], self.tags[:-1] == 0]) if len(self.tags) else np.zeros(0, bool)
        lone[self.first] = True
        self.tags[lone & (self.tags == 2)] = 1
        self.slot = np.repeat(np.arange(len(self.n)), self.n), np.arange(len(t.start)) - np.repeat(self.first, self.n)

    def gradient(self, field: Field) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log likelihood by the scores of B and I of each token, and by pairs of tags; and the log likelihood."""
        c, width = len(self.n), int(self.n.max(initial=1))
        u = np.zeros((c, width, 3))
        u[(*self.slot, slice(1, 3))] = field.scores(self.tokens)
        u[:, 0, 2] = NEVER
        on = np.arange(width)[None, :] < self.n[:, None]
        forward, backward = np.zeros((c, width, 3)), np.zeros((c, width, 3))
        forward[:, 0] = u[:, 0]
        for k in range(1, width):
            step = lse(forward[:, k - 1, :, None] + field.pair, 1) + u[:, k]
            forward[:, k] = np.where(on[:, k, None], step, forward[:, k - 1])
        for k in range(width - 2, -1, -1):
            step = lse(field.pair + (u[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(on[:, k + 1, None], step, 0)
        z = lse(forward[:, -1], 1)
        tags = np.zeros((c, width), np.int64)
        tags[self.slot] = self.tags
        share = np.exp(forward + backward - z[:, None, None])
        seen = np.eye(3)[tags]
        both = np.exp(forward[:, :-1, :, None] + field.pair + (u[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        pairs = (seen[:, :-1, :, None] * seen[:, 1:, None, :] * on[:, 1:, None, None] - both).sum((0, 1))
        pairs[0, 2] = 0
        told = (np.take_along_axis(u, tags[..., None], 2)[..., 0] * on).sum() + (field.pair[tags[:, :-1], tags[:, 1:]] * on[:, 1:]).sum()
        return (seen - share)[self.slot][:, 1:], pairs, float(told - z.sum())


def made_lines(n: int = 1500, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with their secrets' places: forms that the patterns miss, and look-alikes that are no secrets."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    alnum, b64, low = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase
    word = lambda: some("aeiorstnlhd", r.randint(2, 9))
    long = lambda: "".join(word() for _ in range(4))

    def short() -> str:
        """Letters of either case, digits and a sign, or a word made odd by them."""
        if r.random() < 0.4:
            got = list(word() + word() + some(string.digits, r.randint(2, 4)) + r.choice(["", r.choice(low), r.choice("!#$%&*@")]))
            k = r.randrange(2)
            got[k] = got[k].upper()
            return "".join(got)
        got = [r.choice(low), r.choice(string.ascii_uppercase), r.choice(string.digits), *r.choices(alnum, k=r.randint(4, 9))] + [r.choice("$!#%&*~^@")] * r.randint(0, 1)
        r.shuffle(got)
        return "".join(got)

    secret = [
        lambda: "ghp_" + some(alnum, 36), lambda: "sk-" + some(alnum, r.randint(32, 48)), lambda: "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24),
        lambda: "eyJ" + some(alnum, 20) + "." + some(alnum + "_-", 40) + "." + some(alnum + "_-", 30), lambda: some(b64, 40), lambda: some(alnum, r.randint(20, 44)),
        lambda: some(b64, 42) + "==", lambda: "AIza" + some(alnum + "_-", 35), lambda: "glpat-" + some(alnum, 20),
        lambda: some(string.ascii_letters, r.randint(12, 44)), lambda: some(string.ascii_letters, r.randint(16, 40)), lambda: some(string.ascii_letters + "+/.-", 30) + some(string.ascii_letters, 2),
        lambda: "".join(c.upper() if k % 2 else c for k, c in enumerate(some(low, r.randint(12, 24)))).swapcase(),
        lambda: r.choice(("password", "passwd", "secret", "token", "api_key")) + r.choice("=:") + some(alnum, r.randint(6, 16)) + r.choice("$!#%&*~^@") + some(alnum, r.randint(6, 16)),
    ]
    lead = ["key", "access key:", "Authorization: Bearer", "credential", "client_secret:", "passphrase", "auth", "private key", ""]
    told = ["passphrase", "password", "pwd", "passwd", "login", "auth key", "secret", "credential", "my key", "bearer token", "pass"]
    other = [
        lambda: some(string.digits, 16), lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(0, 9999):04}", lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
        lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.",
        lambda: f"https://{word()}.example.com/{word()}/{r.randint(1, 99999)}?page={r.randint(1, 9)}&ref={word()}", lambda: f"{word()}_{word()}_{word()}", lambda: some(string.digits, r.randint(1, 12)),
        lambda: f"{word()}{r.randint(1, 9999)}", lambda: f"{word()}={word()}", lambda: "=" * r.randint(3, 40), lambda: "_" * r.randint(3, 40), lambda: f"{word().title()}{word()}{r.randint(10, 99)}.html",
        lambda: f"{some('0123456789abcdef', 8)}-{some('0123456789abcdef', 4)}-4{some('0123456789abcdef', 3)}-a{some('0123456789abcdef', 3)}-{some('0123456789abcdef', 12)}", lambda: f"${r.randint(1, 99)},{r.randint(100, 999)}.{r.randint(10, 99)}",
        lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 99)}", lambda: some(low, 18) + str(r.randint(1, 9)), lambda: f"/usr/{word()}/{word()}{r.randint(1, 9)}/{word()}.so.{r.randint(1, 9)}",
        lambda: long(), lambda: long().title(), lambda: long().upper(), lambda: "-".join(word() for _ in range(4)), lambda: "".join(word().title() for _ in range(4)), lambda: f"{word()}/{long()}.{word()}",
        lambda: f"{r.choice(told)} {r.choice(('is', 'was', 'and', 'of', 'required'))} {word()}", lambda: f"{r.choice(told)}: {word()}", lambda: f"the {r.choice(told)} {word()} {r.randint(1, 99)}", lambda: word().upper() + str(r.randint(1, 999)),
    ]
    out = []
    for _ in range(n):
        head = " ".join(word() for _ in range(r.randint(1, 6))) + " "
        kind = r.random()
        if kind < 0.4:
            head += r.choice(lead) + r.choice([" ", " = ", " "])
            s = r.choice(secret)()
        elif kind < 0.55:
            head += r.choice(told) + r.choice([": ", " = ", "=", " is "])
            s = short()
            # a key and its value without a space between are one token
            glued = head.endswith("=") and not head.endswith(" =")
            begin = head.rindex(" ") + 1 if glued else len(head)
            out.append((f"{head}{s} {word()} {word()}.", [(begin, len(head) + len(s))]))
            continue
        else:
            out.append((f"{head}{r.choice(other)()} {word()} {r.choice(other)()} {word()}", []))
            continue
        out.append((f"{head}{s} {word()} {word()}.", [(len(head), len(head) + len(s))]))
    return out


def train(lines: list[tuple[str, int]], steps: int = STEPS) -> Field:
    """A field learnt from made lines and from ``lines`` with the sizes of their files, labelled by the fixed patterns. Adam on the whole sample."""
    # made lines count as lines of files of any size
    sizes = random.Random(3)
    examples = [(t, s, 1 << sizes.randint(4, 17)) for t, s in made_lines()] + [(t, [(a, b) for a, _, b in base_spans(t)], n) for t, n in lines]
    data, field = Chains(examples), Field()
    at, which = np.divmod(data.tokens.signs, len(SIGNS))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.w, field.sign, field.pair)]
    index = data.tokens.index()
    for step in range(1, steps + 1):
        by_token, pairs, _ = data.gradient(field)
        w = np.stack([np.bincount(index.ravel(), np.repeat(by_token[:, tag], index.shape[1]), FEATURES) for tag in range(2)], 1)
        sign = np.stack([np.bincount(which, by_token[at, tag], len(SIGNS)) for tag in range(2)], 1)
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for x, g, (m, v) in zip((field.w, field.sign, field.pair), (w, sign, pairs), moments, strict=True):
            g = g - DECAY * len(examples) * np.where(np.abs(x) < -NEVER / 2, x, 0)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
    return field


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, train_lines: int = TRAIN_LINES) -> Field:
    """A field for these texts. Of about ``train_rows`` of them ``train_lines`` lines at most, about, come to the driver: those with spans, up to a third of that, and others."""
    n = docs.select(F.lit(1)).count()
    share = lambda part, *by: F.pmod(F.xxhash64(*by), F.lit(1 << 20)) < int((1 << 20) * min(1.0, part))
    some = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).where(share(train_rows / max(n, 1), "_id"))

    def lines(batch, texts):
        found = []
        for t in texts:
            for line in (t or "").split("\n"):
                for i in range(0, len(line), PIECE):
                    found.append((line[i : i + PIECE], len(t), bool(base_spans(line[i : i + PIECE]))))
        return [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.bool_()))]

    pieces = by_text(some, [], "_text", lines, "line string, size bigint, hit boolean").where("trim(line) <> ''").distinct()
    counts = {r.hit: r[1] for r in pieces.groupBy("hit").agg(F.count(F.lit(1))).collect()}
    most = {True: train_lines // 3, False: train_lines - train_lines // 3}
    part = F.when(F.col("hit"), most[True] / max(counts.get(True, 0), 1)).otherwise(most[False] / max(counts.get(False, 0), 1))
    taken = pieces.where(F.pmod(F.xxhash64("line", "size"), F.lit(1 << 20)) < part * (1 << 20))
    return train(sorted((r.line, r.size) for r in taken.select("line", "size").collect()))


def joint(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns and of the field's spans, by start, then kind."""
    base = base_spans(text)
    return sorted(base + [(a, 3, b) for a, b in found if beyond(text, a, b, base)])


def spans(text: str | None, field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start, then kind."""
    return joint(text or "", field.spans(text or ""))


def beyond(text: str, a: int, b: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether the text from a to b has more than white space and ``EDGES`` outside the spans ``base``, which are in order."""
    for s, _, e in base:
        if s >= b:
            break
        if s > a and text[a:s].strip(EDGES + string.whitespace):
            return True
        a = max(a, e)
    return bool(text[a:b].strip(EDGES + string.whitespace))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch, texts):
        texts = [t or "" for t in texts]
        found = [joint(t, s) for t, s in zip(texts, shared.value.many(texts), strict=True)]
        base = [[x for x in f if x[1] < 3] for f in found]
        count = lambda k: pa.array([sum(x[1] == k for x in f) for f in base], pa.int64())
        return [batch.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string()), pa.array(list(map(joined, found)), pa.string())]

    return by_text(docs, [F.col(id_col).cast("long").alias("doc_id")], text, run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def replaced(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, overlapping ones together, replaced."""
    if not text or not found:
        return text
    out, at, until = [], 0, -1
    for a, _, b in found:
        if a >= until:
            out += [text[at:a], REPLACEMENT]
        until = at = max(b, until)
    return "".join([*out, text[at:]])


def redacted(text: str | None, field: Field) -> str | None:
    return replaced(text, spans(text, field))


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns of ``docs``, with secrets replaced in ``text``, and ``n_chars`` of changed texts counted anew where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch, old in slices(batches, "text"):
            found = shared.value.many([t or "" for t in old])
            new = [replaced(t, joint(t or "", s)) for t, s in zip(old, found, strict=True)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if sized is not None:
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column(sized).to_pylist(), strict=True)]
                batch = batch.set_column(sized, batch.schema.field(sized), pa.array(sizes, batch.schema.field(sized).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))
