"""Shards, the trie of prefixes and the alignment of tokens against plain versions, on odd rows and large groups."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventloom.llm import alignment, prefixes, sharding

DOCS = "doc_id long, text string, shard int, key string, n long, place long, _text string, _id long, slice long"
ODD = [None, "", " \n\t ", "a", "one two three", "one two three", "ß ÄÖ é 漢字  x", "x" * 5000, "word " * 30_000, "a\x00b", "▁x", " lead", "two  spaces\n and", "<|endoftext|> <s>", "trail ", "'s   q", "\U0001f600‍\U0001f600"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, "clash", 4, 5) for i, t in rows], DOCS)


# shards


def by_heap(rows, shards):
    """The rule, one group after another."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    heap = [(0, s) for s in range(shards)]
    found = {}
    weigh = lambda t: len(groups[t]) * (len(t.encode()) + 16)
    for t in sorted(groups, key=lambda t: (-weigh(t), hashlib.sha256(t.encode()).digest())):
        load, found[t] = heapq.heappop(heap)
        heapq.heappush(heap, (load + weigh(t), found[t]))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_dealt_as_one_by_one(seed):
    rng = random.Random(seed)
    runs = [(size, rng.choice([1, 2, 7, 50, 400])) for size in sorted((rng.randint(1, 40) ** rng.choice([1, 3]) for _ in range(25)), reverse=True)]
    heap, plain = sharding.Heap(7), [(0, s) for s in range(7)]
    for size, count in runs:
        got = [turn[k % len(turn)] for n, turn in heap.deal(size, count) for k in range(n)]
        want = []
        for _ in range(count):
            load, s = heapq.heappop(plain)
            want.append(s)
            heapq.heappush(plain, (load + size, s))
        assert got == want
    assert sorted(heap.loads) == sorted(plain)


def test_shards_as_one_by_one(spark):
    rng = random.Random(1)
    # a third of the rows are copies of one text, many texts are as long as each other, ids and rows repeat
    rows = [(i % 150, None if i % 50 == 0 else "copy" if i % 3 == 0 else "".join(rng.choices("ab", k=rng.choice([5, 5, 9, 40])))) for i in range(200)] + list(enumerate(ODD)) + [(None, "null id")] * 3
    got = sharding.sharded(docs(spark, rows), shards=7).collect()
    want = by_heap(rows, 7)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16].append(t or "")
    assert Counter((r.doc_id, r.text_crc32, r["size"], r.shard) for r in got) == Counter((*k, want[t]) for k, ts in texts.items() for t in ts)
    for s in range(7):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [-1 if r.doc_id is None else r.doc_id for r in mine] == sorted(-1 if r.doc_id is None else r.doc_id for r in mine)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_of_nothing(spark):
    assert sharding.sharded(docs(spark, [])).collect() == []


def test_large_groups_are_joined_like_others(spark, monkeypatch):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(90)]
    got = {}
    for hot in (1, 1000):
        monkeypatch.setattr(sharding, "HOT", hot)
        got[hot] = sorted(map(tuple, sharding.sharded(docs(spark, rows), 5).drop("grown_shard").collect()))
    assert got[1] == got[1000] and {t[4] for t in got[1]} == set(range(5))


# the trie of prefixes

CONV = "conv_id long, turn long, role string, text string, digest string, depth long, first long"


def words(text):
    return len([w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w])


def trie(rows, stem=20, heads=4):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    paths = {}
    for c, turns in own.items():
        turns.sort()
        base = c - (c % stem if c >= 0 else -(-c % stem))
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = [t[3:] for t in sorted(own.get(base, []))[:h] + turns[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    below = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not below[k]
            saved[k[:d]] += (len(m) - 1) * (words(k[-1][1]) if k else 0)
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), below[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], CONV)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefixes.prefix_trie(frame, **options).collect())


def test_trie_of_many_shared_prefixes(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "user", None]), rng.choice(["a b", "c", None, ""])) for c in range(120) for t in range(rng.choice([1, 2, 3, 5, 12]))]
    rows += [(c, None, "user", "no turn") for c in range(0, 60, 7)] + [(c, 1, "user", "a b") for c in range(0, 60, 9)] * 2
    rows += [(-7, 0, "user", "x"), (-20, 0, "user", "y"), (-27, 1, None, None), (None, 0, "user", "left out"), (5, 3, "user", "a b " * 9000)]
    rng.shuffle(rows)
    assert found(spark, rows, size=3) == trie(rows)


def test_trie_of_snapshots_and_copies(spark):
    """Each conversation is the one before and a turn; then a third are copies."""
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(40) for t in range(c + 1)] + [(20 * c, t, "user", f"turn {t % 2}") for c in range(40, 60) for t in range(3)]
    assert found(spark, rows, size=4) == found(spark, rows) == trie(rows)


def test_trie_of_nothing(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


def test_ids_in_many_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS", 20)
    ends = spark.createDataFrame([(bytearray(b"x"), i) for i in range(500)] + [(bytearray(b"y"), 7)], "digest binary, conv_id long")
    got = {bytes(r.digest): r.ends_sha256 for r in prefixes.end_digests(ends).collect()}
    assert got == {b"x": hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), b"y": hashlib.sha256(b"7").hexdigest()}


# alignment


class Plain:
    """Both tokenizers by their own libraries, token by token."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def bytes_a(self, i):
        return bytes(self.byte[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def one(self, text):
        """Groups and links."""
        a, b, raw = (self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text), f" {text}".encode()) if text else ([], [], b"")
        if not a or b"".join(map(self.bytes_a, a)) != raw or b"".join(map(self.bytes_b, b)) != raw:
            return [], []
        groups, links, i, j = [([a[0]], [b[0]])], [], 0, 0
        end_a, end_b = len(self.bytes_a(a[0])), len(self.bytes_b(b[0]))
        while True:
            links.append((a[i], b[j]))
            on_a, on_b = end_a <= end_b, end_b <= end_a
            if on_a and on_b and i + 1 == len(a):
                return groups, links
            if on_a and on_b:
                groups.append(([], []))
            if on_a:
                i += 1
                groups[-1][0].append(a[i])
                end_a += len(self.bytes_a(a[i]))
            if on_b:
                j += 1
                groups[-1][1].append(b[j])
                end_b += len(self.bytes_b(b[j]))

    def all(self, rows):
        each = [(i, *self.one(t)) for i, t in rows]
        n = Counter(x for _, _, links in each for x in links)
        most = Counter()
        for (_, b), k in n.items():
            most[b] = max(most[b], k)
        said = lambda groups: hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups).encode()).hexdigest() if groups else ""
        return Counter((i, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(ls), sum(n[x] == most[x[1]] for x in ls), sum(n[x] for x in ls), said(gs)) for i, gs, ls in each)


def test_alignment_token_by_token(spark):
    rng = random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "\n ", "é", "漢", ".", ",", "'s", "x1", "\t", " ", " ", "\x1c", "\x85", "﻿", "<s>", "Ünder", "ing", "é", "\r\n", "�", "0"]
    rows = [*enumerate(ODD), *((1000 + i, "".join(rng.choices(alphabet, k=rng.randint(1, 40)))) for i in range(400)), (None, "null id"), (5, "again"), (5, "again")]
    want = Plain().all(rows)
    for limit in (100, alignment.SLICE):
        assert Counter(map(tuple, alignment.alignment(docs(spark, rows), limit=limit).collect())) == want


def test_alignment_forgets_segments(spark):
    """What a task keeps doesn't change what it gives."""
    texts = [f"word{i} and more" for i in range(60)]
    small, large = alignment.Aligner(seen=5), alignment.Aligner()
    for t in texts:
        a, b = small.slice([t, None]), large.slice([t, None])
        assert a["digests"] == b["digests"] and a["pairs"].tolist() == b["pairs"].tolist() and a["times"].tolist() == b["times"].tolist()
    assert len(small.at) < 12


def test_alignment_of_nothing(spark):
    assert alignment.alignment(docs(spark, [])).collect() == []
    got = alignment.alignment(docs(spark, [(1, None), (2, ""), (3, "▁")])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_alignment_over_partitions(spark):
    rows = [(i, f"some words {i % 7} here\nand there") for i in range(50)]
    assert Counter(map(tuple, alignment.alignment(docs(spark, rows).repartition(5), limit=60).collect())) == Counter(map(tuple, alignment.alignment(docs(spark, rows).coalesce(1)).collect()))
    assert alignment.pair_counts(alignment.aligned(docs(spark, rows))).agg(F.sum("n")).first()[0] == sum(r.n_links for r in alignment.alignment(docs(spark, rows)).collect())
