"""Operators that SQL can't express, against plain Python written from their rules, and inputs that once broke them."""

import base64
import datetime
import hashlib
import os
import re
import random
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F

from eventloom.llm import chat, leakage, nearcopies, packing, privacy, secrets, toxicity, warc

SF = "/root/testdata/sf0.01"
KEY = "test key"


# pseudonyms


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def permuted(value, a, b, tweak):
    x, y = divmod(value, b)
    hashed = lambda i, v: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{v}".encode()).hexdigest()[:15], 16)
    for i in range(10):
        if i % 2 == 0:
            x = (x + hashed(i, y)) % a
        else:
            y = (y + hashed(i, x)) % b
    return x * b + y


def refilled(form, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def day_of(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


FIRST = datetime.date(1900, 1, 1)


def dated(m):
    d = re.sub("[^0-9]", "", m)
    iso = bool(re.match(r"\d{4}\D", m))
    day = day_of(d[:4], d[4:6], d[6:]) if iso else day_of(d[4:], d[2:4], d[:2])
    if day:
        new = FIRST + datetime.timedelta(permuted((day - FIRST).days, 17, 4297, "date"))
        return refilled(m, new.strftime("%Y%m%d" if iso else "%d%m%Y"))
    if iso or not day_of(d[4:], d[:2], d[2:4]):
        return None
    mm, dd, yy = int(d[:2]), int(d[2:4]), int(d[4:])
    if dd < 29:
        v = permuted(((yy - 1900) * 12 + mm - 1) * 16 + dd - 13, 2400, 16, "month first")
        return refilled(m, f"{v // 16 % 12 + 1:02}{v % 16 + 13:02}{v // 192 + 1900}")
    if d[:4] == "0229":
        return refilled(m, f"0229{1904 + 4 * permuted((yy - 1904) // 4, 7, 7, 'leap')}")
    return refilled(m, f"{d[:4]}{1900 + permuted(yy - 1900, 20, 10, d[:4])}")


def email(m):
    name, host = m.split("@")
    out = []
    for k in range(0, len(name), 11):
        cs = name[k : k + 11]
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in cs]
        base = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isalpha() else c for c in cs]
        value = 0
        for c, r, b in zip(cs, radix, base, strict=True):
            value = value * r + (ord(c) - ord(b) if r > 1 else 0)
        half = len(cs) // 2
        v = permuted(value, int(np.prod(radix[:half], dtype=object)), int(np.prod(radix[half:], dtype=object)), f"email|{k // 11}|{''.join(base)}".replace("email|", "email", 1).replace("|", "", 1))
        got = []
        for r, b in zip(reversed(radix), reversed(base), strict=True):
            got.append(chr(ord(b) + v % r) if r > 1 else b)
            v //= r
        out.append("".join(reversed(got)))
    return "".join(out) + "@" + host


def replaced(m):
    """(kind, pseudonym), or nothing."""
    d = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "email", email(m)
    if re.fullmatch(r"\d{4}[-/.]\d\d[-/.]\d\d|\d\d[-/.]\d\d[-/.]\d{4}", m):
        return (None, None) if dated(m) is None else ("date", dated(m))
    if re.fullmatch(r"\d+(\.\d+){3}", m):
        x = [int(p) for p in m.split(".")]
        if max(x) > 255:
            return None, None
        v = permuted(int.from_bytes(bytes(x), "big"), 65536, 65536, "ip")
        return "ip", ".".join(f"{b:03}" if re.search(r"(^|\.)0\d", m) else str(b) for b in v.to_bytes(4, "big"))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        if d[:3] == "000" or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000":
            return None, None
        v = permuted(((int(d[:3]) - 1) * 99 + int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 899 * 99, 9999, "ssn")
        return "ssn", f"{v // (99 * 9999) + 1:03}-{v // 9999 % 99 + 1:02}-{v % 9999 + 1:04}"
    if len(d) >= 13:
        if not luhn(d):
            return None, None
        n = len(d) - 1
        p = f"{permuted(int(d[:-1]), 10 ** (n // 2), 10 ** (n - n // 2), f'card{len(d)}'):0{n}}"
        return "card", refilled(m, p + next(c for c in "0123456789" if luhn(p + c)))
    t = d[-10:]
    if t[0] < "2":
        p = t[:3] + f"{permuted(int(t[3:]), 1000, 10000, 'phone' + t[:3]):07}"
    elif t[3] > "1":
        v = permuted(((int(t[:3]) - 200) * 800 + int(t[3:6]) - 200) * 10000 + int(t[6:]), 640000, 10000, "phone")
        p = f"{v // 8000000 + 200}{v // 10000 % 800 + 200}{v % 10000:04}"
    else:
        return None, None
    return "phone", refilled(m, d[:-10] + p)


def pseudonymised(text):
    counts = dict.fromkeys(privacy.KINDS, 0)

    def new(m):
        kind, out = replaced(m[0])
        if kind:
            counts[kind] += 1
        return out if kind else m[0]

    return (None if text is None else re.sub(privacy.CANDIDATE, new, text)), counts


def test_pii_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in __spark_entry__.queries()["op7_pii"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        text, counts = pseudonymised(t)
        assert got[i].text == text and {k: got[i][f"n_{k}"] for k in privacy.KINDS} == counts


def test_pii_forms_by_brute_force(spark):
    texts = [
        "12/31/1999 02/29/2000 11.30.1950 05-17-2024 13/13/2000 31/12/1999 02/30/2000", "3782 822463 10005 3782-822463-10005 3782 822463 10006 378282246310005",
        "010.001.002.003 10.1.2.3 0.0.0.0 00.1.2.3 256.1.1.1", "a.b-c%d_1+Z9@x.y.z-w.org. me@host (no) A@b.cd,", "+1 212 555 0123, (212) 555-0123 212.555.0123 112-555-0123",
    ]
    got = {r.doc_id: r.text for r in privacy.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pseudonymised(t)[0]
    assert re.fullmatch(r"(\d{3}\.){3}\d{3} \S+ \S+ (\d{3}\.){3}\d{3} 256.1.1.1", got[2])


@pytest.mark.parametrize("text", ["a@b" + ".c" * 500_000, "a@" + "b" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "a" * 1_000_000 + "@", "12-" * 300_000])
def test_pii_long_runs_end(spark, text):
    got = privacy.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first()
    assert len(got.text) == len(text)


# chat


def test_spans_hold_the_learnt_texts(spark):
    rows = [(c, t, "assistant" if (c + t) % 2 else "user", f"say {t} ### x\n</turn>\n" * (t % 3)) for c in range(3) for t in range(40)]
    whole = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in whole:
        cut = [r.formatted[s.start : s.start + s.length] for s in r.spans]
        assert [re.sub(r"\\(### |</turn>)", r"\1", x) for x in cut] == [t.text for t in r.turns if t.role == "assistant"]


def test_long_conversations_take_time_in_proportion(spark):
    took = []
    for n in (2_000, 16_000):
        d = spark.range(n).selectExpr("1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, repeat(' text', 20)) as text")
        began = time.perf_counter()
        assert chat.digests(chat.formatted(d)).first().n_turns == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 4


# packing


def test_flush_keeps_the_fullest_windows():
    r = np.random.default_rng(1)
    packer = packing.Packer(64)
    docs = [(k, r.integers(0, 9, r.integers(1, 60)).astype(np.uint32)) for k in range(200)]
    closed = [p for k, ids in docs for p in packer.add(k, ids)]
    open_windows = [list(w) for level in packer.at for w in level]
    fills = sorted((sum(len(p[2]) for p in w) for w in open_windows), reverse=True)
    kept = fills[: sum(fills) // 64]
    whole = {p[0] for w in sorted(open_windows, key=lambda w: -sum(len(p[2]) for p in w))[: len(kept)] for p in w}
    out = list(packer.flush())
    assert sum(len(p[2]) for p in out) == sum(fills) and whole <= {p[0] for p in out if len(p[2]) == p[3]}
    by = {}
    for doc, start, ids, total, seq, at in closed + out:
        by.setdefault(seq, []).append(len(ids))
        assert (ids == dict(docs)[doc][start : start + len(ids)]).all()
    assert all(sum(x) == 64 or sum(x) & (sum(x) - 1) == 0 for x in by.values())


# leakage


def test_automaton_is_within_its_memory():
    """LIMIT_WORDS words of items that share nothing, which is the worst case, in a process of its own."""
    code = (
        "import resource, numpy as np; from eventloom.llm import leakage\n"
        "r = np.random.default_rng(0); w = [f'w{k}' for k in range(200_000)]\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "n = leakage.LIMIT_WORDS // 200\n"
        "x = leakage.Windows([(k, ' '.join(w[j] for j in r.integers(0, len(w), 200))) for k in range(n)])\n"
        "x.matches([b'w1']); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(__spark_entry__.__file__)).stdout)
    assert used < 400, used


def test_long_documents_and_repeated_anchors():
    item = " ".join(f"q{k}" for k in range(1000))
    w = leakage.Windows([(1, item), (2, "a a a a a a a a a a a a"), (3, "x y")])
    words = leakage.normal(("z " * 50_000 + item + " ") * 4 + "a " * 3000 + "x y").split()
    assert leakage.covered([(a, b) for a, b, i in w.matches(words) if i == 1]) == [(50_000 + k * 51_000, 51_000 + k * 51_000) for k in range(4)]
    assert leakage.covered([(a, b) for a, b, i in w.matches(words) if i == 2]) == [(204_000, 207_000)]
    assert [(a, b) for a, b, i in w.matches(words) if i == 3] == [(207_000, 207_002)]


def plain_windows(items, words, size):
    """(first word, end word, item) of each window, by comparing all with all."""
    out = []
    for name, text in items:
        w = leakage.normal(text).split()
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out += [(a, a + n, name) for a in range(len(words) - n + 1) if words[a : a + n] == w[i : i + n]]
    return set(out)


def test_windows_by_brute_force():
    r = random.Random(8)
    some = lambda n: " ".join(r.choice("abc") for _ in range(n))
    for size in (1, 2, 5, 10):
        items = [(k % 7 if k % 5 else None, some(r.choice([0, 1, size - 1, size, size + 1, 14, 30]))) for k in range(25)]
        w = leakage.Windows(items, size)
        for text in (some(60), some(3), "", "zz " * 20, items[3][1] + " q " + items[4][1]):
            words = leakage.normal(text).split()
            want = plain_windows(items, words, size)
            assert set(w.matches(words)) == want
            spans, names = w.hits(words)
            assert spans == leakage.covered([x[:2] for x in want]) and names == {x[2] for x in want}


def test_shared_stems_take_time_in_proportion():
    """Items and a document that begin alike, thousands of times."""
    w = leakage.Windows([(k, f"which of the following is q{k} x{k} y{k} z{k} u{k} v{k}") for k in range(2000)])
    w.matches([b"warm"])
    words = leakage.normal("which of the following is r s t " * 2000).split()
    began = time.perf_counter()
    assert w.hits(words) == ([], set())
    assert time.perf_counter() - began < 1.0
    # a window that all items have names them all, once
    w = leakage.Windows([(k, "one two three four five six seven eight nine ten " + f"q{k}") for k in range(2000)])
    began = time.perf_counter()
    spans, names = w.hits(leakage.normal("one two three four five six seven eight nine ten z " * 2000).split())
    assert len(spans) == 2000 and len(names) == 2000 and time.perf_counter() - began < 2.0


# archives


def raw_record(headers, block):
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others():
    """Header names in any case, payloads of HTTP messages, and digests in other forms are what crawlers write."""
    body = b"<html>" * 40
    sha, md5 = hashlib.sha1(body), hashlib.md5(body)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in (body[:100], body[100:])) + b"0\r\n\r\n"
    digests = [f"sha1:{base64.b32encode(sha.digest()).decode()}", f"sha1:{sha.hexdigest()}", f"SHA-1:{base64.b32encode(sha.digest()).decode().lower()}", f"md5:{base64.b64encode(md5.digest()).decode()}", "blake3:whatever", f"sha256:{hashlib.sha256(body).hexdigest()}"]
    for block in (http, chunked):
        for digest in digests:
            for length in ("Content-Length", "content-length", "CONTENT-LENGTH"):
                data = raw_record({"warc-type": "response", "Content-Type": "application/http; msgtype=response", "WARC-payload-DIGEST": digest, length: len(block)}, block)
                found = list(warc.salvage(data + warc.member(data)))
                assert [type(x) for x in found] == [warc.Record] * 2 and found[0].block == block and found[0].headers["WARC-Type"] == "response"
    wrong = raw_record({"WARC-Type": "response", "Content-Type": "application/http", "WARC-Payload-Digest": digests[0][:-3] + "AAA", "Content-Length": len(http)}, http)
    assert [type(x) for x in warc.salvage(wrong)] == [tuple]


def test_archives_take_time_in_proportion():
    page = warc.member(warc.render(1, "http://x", np.random.default_rng(0).bytes(900)))
    took = []
    for n in (2_000, 16_000):
        data = page * n
        began = time.perf_counter()
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(data)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] * 2 + 0.5


def test_missing_records_end_the_job(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"page {k % 7} " * 90) for k in range(60)], "page_id long, url string, html string")
    folder = warc.new_path(spark, "strict")
    archives = warc.write(pages, folder)
    assert warc.digests(warc.records(archives, strict=True)).count() == 60 and not os.path.exists(f"{folder.removeprefix('file://')}/drafts")
    with pytest.raises(Exception, match="records instead of"):
        warc.records(archives.withColumn("records", F.col("records") + 1), strict=True).count()
    path = archives.orderBy(F.desc("records")).first().path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(30)
        f.write(b"\0\0\0\0")
    with pytest.raises(Exception, match="from 0 to"):
        warc.records(archives, strict=True).count()
    assert {r.kind for r in warc.records(archives).collect()} == {"record", "gap"}
    warc.delete_archives(folder)
    warc.delete_archives(folder)
    assert not os.path.exists(folder.removeprefix("file://"))


# the pipeline


def corpus(n=60, seed=12):
    """Documents, labels and benchmark with planted toxic texts, copies, leaks and secrets, odd rows among them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiorstnlhdm") for _ in range(r.randint(2, 8)))
    text = lambda k=60: " ".join(word() for _ in range(k))
    item = [text(14), text(12), text(6)]
    docs = [(i, text(), "en", "s", 1) for i in range(n)]
    for i in range(0, n, 5):
        docs[i] = (i, f"{text(10)} utter scumbag filth {text(10)} vile scumbag filth {text(5)}", "en", "s", 1)
    docs += [(100, docs[1][1], "en", "s", 1), (101, docs[1][1] + " " + word(), "en", "s", 1), (None, docs[1][1], None, None, None), (2, docs[2][1], "en", "s", 1)]
    docs += [(110, f"{text(20)} {item[0]} {text(9)}", "en", "s", 1), (111, f"{text(9)} {item[2].upper()}. {text(9)}", "en", "s", 1), (112, f"{text(9)} password = Zx81LmQ0vTb7 {text(5)}\n{text(5)} AKIA{'A1B2' * 4} {text(3)}", "en", "s", 1)]
    docs += [(120, None, None, None, None), (121, "", "en", "s", 0), (122, "a", "en", "s", 1), (123, " \n\t", "en", "s", 3), (124, "word " * 3000, "en", "s", None)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(n)] + [(None, 0, 1), (3, None, None)]
    return docs, labels, [(k, t) for k, t in enumerate(item)] + [(9, None), (10, "")]


def tables(spark, path, docs, labels, items):
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def test_pipeline_by_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    sf = tables(spark, tmp_path, docs, labels, items)
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    model = toxicity.learn(read("documents"), read("labels"))
    kept = [d for d in docs if toxicity.score([d[1]], model)[0] < 0.5]
    assert not [d for d in kept if d[1] and "scumbag" in d[1]] and {d[0] for d in docs if d[1] and len(d[1]) > 50 and "scumbag" not in d[1]} <= {d[0] for d in kept}
    # one row of each component of near copies
    words = lambda t: re.findall(r"[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(d[1])) else set() for d in kept]
    low = list(range(len(kept)))
    while True:
        new = [min([low[j] for j in range(len(kept)) if near(sets[i], sets[j])] + [low[i]]) for i in range(len(kept))]
        if new == low:
            break
        low = new
    groups = {}
    for i, g in enumerate(low):
        groups.setdefault(g, []).append(i)
    one = [min((kept[i] for i in g), key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    assert len(one) < len(kept) and sum(d[0] in (1, 100, 101, None) for d in one) == 1
    clean = [d for d in one if not plain_windows(items, leakage.normal(d[1]).split(), 10)]
    assert {110, 111} <= {d[0] for d in one} and not {110, 111} & {d[0] for d in clean}
    secret = secrets.learn(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long"))
    want = {d[0]: secrets.redacted(d[1], secret) for d in clean}
    assert want[112].count("[SECRET]") == 2 and "Zx81" not in want[112] and sum(t != d[1] for d, t in zip(clean, want.values(), strict=True)) == 1
    # what is packed is those texts, token for token, and windows are full but for powers of two
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, sf).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    assert by.keys() == want.keys()
    for doc, text in want.items():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    full = {}
    for p in pieces:
        full.setdefault(p.sequence_id, []).append(p)
    for row in full.values():
        n = sum(p.length for p in row)
        assert sorted(p.offset for p in row) == np.cumsum([0, *[p.length for p in sorted(row, key=lambda p: p.offset)][:-1]]).tolist() and (n == 2048 or n & (n - 1) == 0)


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0


def test_long_chains_of_tokens():
    """A line of very many tokens is one chain."""
    field = secrets.train([])
    text = "plain words here " * 20_000 + "key ghp_0a1B2c3D4e5F6g7H8i9J0kLmNoPqRsTuVwXy end"
    ((a, b),) = field.spans(text)
    assert text[a:b] == "ghp_0a1B2c3D4e5F6g7H8i9J0kLmNoPqRsTuVwXy"
