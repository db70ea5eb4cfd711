"""WARC archives: a writer with revisit records, and a reader that salvages what it can.

Records are gzip members of their own, in archives of about ``ARCHIVE_BYTES``. The reader checks each record: the member's
own checksum, the version line, Content-Length, and the block and payload digests. After a failed check it searches for the next gzip
member that begins with a version line, or the next version line in a plain archive, goes on there, and logs the bytes
between as a quarantined gap.

Archives are written in two steps, at any size alike. Each task first writes every page as a response, and a row (archive, offset, length, digest) for
it. Which pages repeat a payload is found on these rows, so payloads are never shuffled; then each archive is copied, and members that
are revisits are written anew. Archives go to the folder that all executors share through pyarrow's file systems; each task writes names of its own
attempt, and only archives in the table of finished tasks are read, so the leavings of a lost executor are ignored. ``delete_archives`` removes a folder.

The reader holds one archive, and one member unpacked, at a time. Header names are matched in any case; the payload of an ``application/http`` block is
what follows its headers; digests by an unknown algorithm are not checked. Read strictly, an archive with a gap, or with fewer records than were written, is an error.

Defined results: a null html is an empty payload. A null page_id sorts before all others. Rows that repeat the largest page_id of
a payload are all responses. Equal payloads of fewer bytes than the limit are all responses. A very long payload is a record like others, held in one task while it is written and read. An empty
table gives no archive and no row. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, slices, table, written

VERSION = b"WARC/1.1\r\n"
START = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 8 << 20
#: Repeated payloads whose digests are broadcast at most; beyond, the same join shuffles digests.
BROADCAST_ROWS = 500_000
#: Header names that are known, in the form that they are kept in.
NAMES = {x.lower(): x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Type", "Content-Length", "WARC-Payload-Digest", "WARC-Payload-Length", "WARC-Block-Digest", "WARC-Profile", "WARC-Refers-To")}
ALGORITHMS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def sha1(data: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0


def render(page_id: int | None, uri: str | None, payload: bytes) -> bytes:
    """A response record."""
    return rendered(
        {
            "WARC-Type": "response",
            "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date": "1970-01-01T00:00:00Z",
            "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "urn:none"),
            "Content-Type": "text/html; charset=utf-8",
            "WARC-Payload-Digest": f"sha1:{sha1(payload)}",
            "WARC-Payload-Length": str(len(payload)),
        },
        payload,
    )


def revisiting(record: Record, refers_to: int | None) -> bytes:
    """The record without its payload, whose digest and length it keeps."""
    return rendered(record.headers | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{'' if refers_to is None else refers_to}>"}, b"")


def rendered(headers: dict[str, str], block: bytes) -> bytes:
    headers = headers | {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def agrees(digest: str, data: bytes) -> bool:
    """Whether a digest header, in base32, hexadecimal or base64 digits, is that of ``data``; an unknown algorithm is taken on trust."""
    name, colon, digits = digest.partition(":")
    if not colon or name.lower() not in ALGORITHMS:
        return True
    raw = hashlib.new(ALGORITHMS[name.lower()], data).digest()
    plain = digits.rstrip("=")
    return plain.lower() in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower()) or plain == base64.b64encode(raw).decode().rstrip("=")


def payloads(headers: dict[str, str], block: bytes) -> Iterator[bytes]:
    """What may be the payload: the block, or what follows the headers of an HTTP message in it, as it is or with its chunks joined."""
    if not headers.get("Content-Type", "").lower().startswith("application/http"):
        yield block
        return
    head, _, body = block.partition(b"\r\n\r\n")
    yield body
    if re.search(rb"(?im)^transfer-encoding:.*chunked", head):
        out, rest = [], body
        while (m := re.match(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n", rest)) and (size := int(m[1], 16)):
            out.append(rest[m.end() : m.end() + size])
            rest = rest[m.end() + size + 2 :]
        yield b"".join(out)


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at ``at`` and where it ends; ValueError if a check fails."""
    if not (m := START.match(data, at)):
        raise ValueError("no version line")
    if (end := data.find(b"\r\n\r\n", m.end() - 2)) < 0:
        raise ValueError("headers without an end")
    headers = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        name = name.decode("utf-8", "strict").strip()
        headers[NAMES.get(name.lower(), name)] = value.decode("utf-8", "strict").strip()
    if not (size := headers.get("Content-Length", "")).isdecimal():
        raise ValueError("no Content-Length")
    block, stop = data[end + 4 : end + 4 + int(size)], end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("Content-Length misses the record's end")
    if not agrees(headers.get("WARC-Block-Digest", ""), block):
        raise ValueError("WARC-Block-Digest differs")
    if headers.get("WARC-Type") == "response" and not any(agrees(headers.get("WARC-Payload-Digest", ""), p) for p in payloads(headers, block)):
        raise ValueError("WARC-Payload-Digest differs")
    return Record(headers, block, at), stop + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and where it ends; ValueError if it isn't whole."""
    z, out, view, step = zlib.decompressobj(31), [], memoryview(data), 1 << 12
    while at < len(data) and not z.eof:
        try:
            out.append(z.decompress(view[at : at + step]))
        except zlib.error as e:
            raise ValueError(str(e)) from e
        at, step = min(len(data), at + step), min(step * 2, 1 << 18)
    if not z.eof:
        raise ValueError("the member has no end")
    return b"".join(out), at - len(z.unused_data)


def partial(data: bytes, at: int) -> tuple[bytes, bool]:
    """What the broken gzip member at ``at`` gives before its fault, and whether the fault is that it has no end."""
    z, out, step = zlib.decompressobj(31), [], 1 << 16
    for i in range(at, len(data), step):
        before = z.copy()
        try:
            out.append(z.decompress(data[i : i + step]))
        except zlib.error:
            for k in range(i, i + step):
                try:
                    out.append(before.decompress(data[k : k + 1]))
                except zlib.error:
                    return b"".join(out), False
    return b"".join(out), True


def inside(data: bytes, at: int) -> tuple[list[Record], int | None, str]:
    """The records in the member at ``at``, where it ends (null if it is broken), and what is wrong in it.

    Of a broken member those records count that have an id and a digest; not one that is all of it, nor, if it has no end, the last."""
    try:
        inner, end = inflate(data, at)
        cut, wrong = False, ""
    except ValueError as e:
        (inner, cut), end, wrong = partial(data, at), None, str(e)
    found, k = [], 0
    while k < len(inner):
        try:
            record, stop = parse(inner, k)
        except ValueError as e:
            wrong = wrong or f"at {k} of the member: {e}"
            k = m.start() if (m := START.search(inner, k + 1)) else len(inner)
            continue
        if end is not None or {"WARC-Block-Digest", "WARC-Record-ID"} <= record.headers.keys() and not (stop == len(inner) and (cut or k == 0)):
            record.offset = at
            found.append(record)
        k = stop
    return found, end, wrong or ("" if found else "an empty member")


def member_head(data: bytes, at: int) -> bool:
    """Whether what begins at ``at`` unpacks to a version line."""
    try:
        return bool(START.match(zlib.decompressobj(31).decompress(data[at : at + 512], 16)))
    except zlib.error:
        return False


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """The records of an archive and, as (from, to, reason), the byte gaps between them that no valid record covers.

    Records of a member have its offset. A member that is broken, or has a fault in it, is a gap whose valid records come before it."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                records, end, wrong = inside(data, at)
                if not records:
                    raise ValueError(wrong)
            else:
                record, end = parse(data, at)
                records, wrong = [record], ""
        except ValueError as e:
            bad, reason = (at, str(e)) if bad is None else (bad, reason)
            at = following(data, at + 1)
            continue
        if bad is not None:
            yield bad, at, reason
            bad = None
        yield from records
        if wrong and end is not None:
            yield at, end, wrong
        if end is None:
            bad, reason = at, wrong
        at = following(data, at + 1) if end is None else end
    if bad is not None:
        yield bad, len(data), reason


def following(data: bytes, at: int) -> int:
    """Where the next version line, or member that begins with one, is; else the end."""
    m = START.search(data, at)
    plain = m.start() if m else len(data)
    while 0 <= (at := data.find(MAGIC, at, plain)):
        if member_head(data, at):
            return at
        at += 1
    return plain


def drafted(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a response for each row (page_id, url, html) to archives in ``folder``; the written rows path, start, end, page_id, digest, payload_bytes."""
    names, schema = ["path", "start", "end", "page_id", "digest", "payload_bytes"], "path string, start bigint, end bigint, page_id bigint, digest string, payload_bytes bigint"

    def run(batches):
        fs, root = pfs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, rows, size = [], [], 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.gz"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                for x in held:
                    f.write(x)
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(rows)), *(pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(cols))], names)

        for batch, texts in slices(batches, "_text"):
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in (0, 1)), texts, strict=True):
                payload = (html or "").encode("utf-8", "replace")
                held.append(member(render(page, url, payload)))
                rows.append((size, size + len(held[-1]), page, sha1(payload), len(payload)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, rows, size = [], [], 0
        if held:
            yield close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("_text"))
    return written(rows.mapInArrow(run, schema), "members")


def revisits(members: DataFrame) -> DataFrame:
    """path, start, refers: each member whose payload a larger page_id has too, and the largest such."""
    page = F.coalesce("page_id", F.lit(-(1 << 63)))
    largest = members.groupBy("digest", "payload_bytes").agg(F.max(page).alias("refers"), F.min(page).alias("_least")).where("_least < refers").drop("_least")
    largest = written(largest, "repeats")
    some = F.broadcast(largest) if largest.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else largest
    return members.join(some, ["digest", "payload_bytes"]).where(page < F.col("refers")).select("path", "start", "refers")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row (page_id, url, html) to archives in ``folder``; returns the written table of them: path, records, bytes."""
    spark, drafts = pages.sparkSession, f"{folder}/drafts"
    members = drafted(pages, drafts, archive_bytes)
    # an archive has as many members as fit in it, so its list is bounded
    of = members.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("members"))
    which = revisits(members).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("start", "refers"))).alias("refers"))

    def run(batches):
        fs, root = pfs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, places, refers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                refers = dict(refers or ())
                with pfs.FileSystem.from_uri(path)[0].open_input_stream(pfs.FileSystem.from_uri(path)[1], compression=None) as f:
                    data = f.read()
                name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                    for place in places:
                        x = data[place["start"] : place["end"]]
                        if place["start"] in refers:
                            x = member(revisiting(parse(inflate(x, 0)[0], 0)[0], refers[place["start"]]))
                        size += f.write(x)
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(places)], pa.int64()), "bytes": pa.array([size], pa.int64())})

    out = written(spread(of.join(which, "path", "left")).mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")
    delete_archives(drafts)
    return out


def spread(archives: DataFrame) -> DataFrame:
    spark = archives.sparkSession
    return archives.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def delete_archives(folder: str) -> None:
    """Removes a folder of archives. Call it once nothing reads them any more; a folder that isn't there is no error."""
    fs, root = pfs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type == pfs.FileType.Directory:
        fs.delete_dir(root)


def records(archives: DataFrame, strict: bool = False) -> DataFrame:
    """path, kind (record or gap), start, end, reason, headers, block of each record and gap in the archives that have a row (path, and records if it is known).

    If ``strict``, a gap or another number of records than ``records`` ends the job."""

    def table_of(path, some):
        gap = [isinstance(x, tuple) for x in some]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path] * len(some)),
                pa.array(["gap" if g else "record" for g in gap]),
                pa.array([x[0] if g else x.offset for x, g in zip(some, gap, strict=True)], pa.int64()),
                pa.array([x[1] if g else None for x, g in zip(some, gap, strict=True)], pa.int64()),
                pa.array([x[2] if g else None for x, g in zip(some, gap, strict=True)], pa.string()),
                pa.array([[] if g else list(x.headers.items()) for x, g in zip(some, gap, strict=True)], pa.map_(pa.string(), pa.string())),
                pa.array([None if g else x.block for x, g in zip(some, gap, strict=True)], pa.binary()),
            ],
            ["path", "kind", "start", "end", "reason", "headers", "block"],
        )

    def run(batches):
        for batch in batches:
            for path, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pfs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as f:
                    data = f.read()
                held, size, n = [], 0, 0
                for x in salvage(data):
                    if strict and isinstance(x, tuple):
                        raise ValueError(f"{path} from {x[0]} to {x[1]}: {x[2]}")
                    n += not isinstance(x, tuple)
                    held.append(x)
                    size += 0 if isinstance(x, tuple) else len(x.block)
                    if size > 1 << 20 or len(held) >= 200:
                        yield table_of(path, held)
                        held, size = [], 0
                if held:
                    yield table_of(path, held)
                if strict and known is not None and n != known:
                    raise ValueError(f"{path} has {n} records instead of {known}")

    known = F.col("records").cast("long") if "records" in archives.columns else F.lit(None).cast("long")
    return spread(archives.select("path", known.alias("records"))).mapInArrow(run, "path string, kind string, start bigint, end bigint, reason string, headers map<string,string>, block binary")


def digests(read: DataFrame) -> DataFrame:
    """The columns of SCHEMA for each record that was read."""
    h = lambda name: F.col("headers")[name]
    page = lambda name: F.expr(f"try_cast(regexp_extract(headers['{name}'], '<urn:page:(-?[0-9]*)>', 1) as bigint)")
    return read.where("kind = 'record'").select(
        page("WARC-Record-ID").alias("page_id"),
        h("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_replace(h("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        h("WARC-Type").alias("record_type"),
        F.when(h("WARC-Type") == "revisit", page("WARC-Refers-To")).alias("refers_to"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return digests(records(archives, strict=True))


#: DuckDB's sha1() gives hexadecimal digits; their bits, five at a time, are the base32 digits.
OP4_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last,
  array_to_string(list_transform(range(1, 41), lambda i: right(bin(strpos('0123456789abcdef', h[i]) + 15), 4)), '') AS bits FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_sum(list_transform(range(1, 6), lambda j: CASE WHEN bits[5 * i + j] = '1' THEN 1 << (5 - j) ELSE 0 END))::INT + 1]), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""
