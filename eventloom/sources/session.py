"""Session files by name, the session's description, and writers of its files.

A file is ``<base>.<type>[.<variant>].<group>[.<tag>]``; a variant names the feature space. The catalogue is a table (path, base, type, variant, group, tag), so
that choosing among variants is a query. Descriptions are YAML mappings, read on the driver: they are a page of settings.

Binary files that a legacy reader wants whole are written by the tasks in parts, in event order, and put together by copying bytes, so that no task holds a file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.transforms import Basis, Method
from ..operators.storage import numbered
from .binary import parse, read_binary

# ---------------------------------------------------------------- tokens and preferences


@dataclass(frozen=True)
class Token:
    """A variant token ``<family>[_S<order> or _C<order>][_D<lag><dims>]``; one that isn't of this form is a family of its own."""

    family: str
    kind: str | None = None
    order: int | None = None
    lag: int = 0
    dims: int = 0


def token(variant: str) -> Token:
    rest, kind, lag = variant, "", ""
    while (m := re.fullmatch(r"(.*)_(.[0-9]+)", rest, re.S)) is not None:
        rest, suffix = m[1], m[2]
        if suffix[0] in "SC" and not kind:
            kind = suffix
        elif suffix[0] == "D" and len(suffix) == 3 and not lag:
            lag = suffix
        else:
            return Token(variant)
    if not kind and (not lag or lag[1] == "0"):
        return Token(variant)
    return Token(rest, kind[0] if kind else None, int(kind[1:]) if kind else None, int(lag[1]) if lag else 0, int(lag[2]) if lag else 0)


def family(variant: str) -> str:
    return token(variant).family


def is_derivative(variant: str) -> bool:
    return family(variant) == "stderiv"


# orders of preference: fixed values; "" is a file without a variant
DERIVED, STANDARD, CANONICAL, SHARED = ("stderiv", "D", "standard", ""), ("standard", ""), ("", "stderiv", "D"), ("standard", "stderiv", "sdiff")


def session_path(base: str, kind: str, group: int | str, variant: str = "", tag: str = "") -> str:
    return ".".join(filter(None, [base, kind, variant, str(group), str(tag).replace(".", "_")]))


def fibers_path(base: str, method: str, group: int | str, stage: str = "") -> str:
    return session_path(base, "fibers", group, method, stage)


def position_path(base: str, group: int | str, method: str = "", stage: str = "") -> str:
    """The position table that mirrors the method and stage of its labels."""
    return session_path(base, "cpos", group, method, stage)


# ---------------------------------------------------------------- catalogue


def catalogue(paths: DataFrame, base: str) -> DataFrame:
    """path, type, variant, group, tag, glued of a session's files (path). A type of letters and a capital D or a variant's name glued to it is an older form."""
    tail = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))
    parts = F.split(tail, r"\.")
    number = F.coalesce(F.get(F.filter(F.transform(parts, lambda x, i: F.when(x.rlike("^[0-9]+$") & (i > 0), i)), lambda x: x.isNotNull()), F.lit(0)), F.lit(-1))
    rows = paths.where(F.col("path").startswith(base + ".")).select("path", parts.alias("_p"), number.alias("_n")).where("_n in (1, 2)")
    return rows.select("path", F.col("_p")[0].alias("type"), F.when(F.col("_n") == 2, F.col("_p")[1]).otherwise("").alias("variant"), F.element_at("_p", F.col("_n") + 1).cast("int").alias("group"), F.array_join(F.slice("_p", F.col("_n") + 2, F.size("_p")), ".").alias("tag"))


def listed(spark: SparkSession, base: str) -> DataFrame:
    """The catalogue of the files of a session that are there."""
    fs, root = pfs.FileSystem.from_uri(os.path.dirname(base) if "://" in base else os.path.abspath(os.path.dirname(base) or "."))
    head = base.rsplit("/", 1)[0] if "/" in base else "."
    names = [f"{head}/{f.base_name}" for f in fs.get_file_info(pfs.FileSelector(root)) if f.is_file]
    return catalogue(spark.createDataFrame([(n if "/" in base else n[2:],) for n in names], "path string"), base)


def preferred(files: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Of each type and group, the file of the first variant in the order that is there: by its token, then glued to the type, then the only token of its family.
    Several tokens of the family end the job, as the choice must be named."""
    here = files.where("tag = ''").withColumn("_family", tokens.family(F.col("variant")))
    want = F.array(*(F.lit(v) for v in order))
    exact = F.array_position(want, F.col("variant"))
    related = F.when((F.col("_family") != F.col("variant")), F.array_position(want, F.col("_family")))
    ranked = here.withColumn("_rank", F.when(exact > 0, exact * 3).when(related > 0, related * 3 + 2))
    older = [(here.where(F.col("type").endswith(v) & (F.length("type") > len(v)) & (F.col("variant") == "")).withColumn("type", F.expr(f"substring(type, 1, length(type) - {len(v)})")).withColumn("variant", F.lit(v)).withColumn("_rank", F.lit(3 * k + 4).cast("bigint"))) for k, v in enumerate(order) if v]
    every = reduce(DataFrame.unionByName, older, ranked.where("_rank is not null").withColumn("_rank", F.col("_rank").cast("bigint")))
    best = every.groupBy("type", "group").agg(F.min("_rank").alias("_rank"))
    chosen = every.join(best, ["type", "group", "_rank"])
    n = F.count(F.lit(1)).over(Window.partitionBy("type", "group"))
    name = F.when(n > 1, F.raise_error(F.concat(F.lit("several variants of one family: "), F.col("path")))).otherwise(F.col("path"))
    return chosen.select(name.alias("path"), "type", "variant", "group")


def shared(files: DataFrame, first: str = "") -> DataFrame:
    """Of each type and group, the one physical copy of what all variants share: the named variant, then the usual ones, then any by name, then none."""
    order = [v for v in (first, *SHARED) if v]
    at = F.array_position(F.array(*(F.lit(v) for v in order)), F.col("variant"))
    rank = F.struct(F.when(at > 0, at).when(F.col("variant") == "", F.lit(len(order) + 2)).otherwise(F.lit(len(order) + 1)), "variant")
    return files.where("tag = ''").groupBy("type", "group").agg(F.min_by(F.struct("path", "variant"), rank).alias("s")).select("s.path", "type", "s.variant", "group")


def siblings(files: DataFrame, tag: str = "", only_family: str | None = None) -> DataFrame:
    """type, group, variants: the tokens that are there for each type, group and tag, in order."""
    some = files.where((F.col("tag") == tag.replace(".", "_")) & (F.col("variant") != ""))
    some = some if only_family is None else some.where(tokens.family(F.col("variant")) == only_family)
    return some.groupBy("type", "group").agg(F.array_sort(F.collect_set("variant")).alias("variants"))


def pinned(files: DataFrame, kind: str, group: int, variant: str, tag: str = "") -> str:
    """The path of exactly this file; if it isn't there, an error that lists the tokens that are."""
    here = files.where((F.col("type") == kind) & (F.col("group") == group))
    found = here.where((F.col("variant") == variant) & (F.col("tag") == tag.replace(".", "_"))).select("path").first()
    if found is None:
        there = sorted(f"{r.variant}.{r.group}{'.' + r.tag if r.tag else ''}" for r in here.select("variant", "group", "tag").distinct().collect())
        raise FileNotFoundError(f"no {kind} of variant {variant!r} and tag {tag!r} for group {group}; there are: {', '.join(there) or 'none'}")
    return found[0]


# ---------------------------------------------------------------- readers


def chosen_path(spark: SparkSession, base: str, kind: str, group: int, order: tuple[str, ...] | None) -> str:
    files = listed(spark, base)
    found = (shared(files) if order is None else preferred(files, tuple(order))).where((F.col("type") == kind) & (F.col("group") == group)).select("path").first()
    if found is None:
        raise FileNotFoundError(session_path(base, kind, group))
    return found[0]


def read_times(spark: SparkSession, base: str, group: int, order=None) -> DataFrame:
    """spike_idx, t. Times are shared by all variants."""
    return read_binary(spark, chosen_path(spark, base, "res", group, order), "times").drop("path")


def read_labels(spark: SparkSession, base: str, group: int, order=CANONICAL, n: int | None = None) -> DataFrame:
    """spike_idx, label; of the first n events, if n is given."""
    rows = read_binary(spark, chosen_path(spark, base, "clu", group, order), "labels").drop("path")
    return rows if n is None else rows.where(F.col("spike_idx") < n)


def read_labels_at(spark: SparkSession, base: str, group: int, variant: str = "", tag: str = "", n: int | None = None) -> DataFrame:
    """Labels of exactly this variant and stage."""
    rows = read_binary(spark, pinned(listed(spark, base), "clu", group, variant, tag), "labels").drop("path")
    return rows if n is None else rows.where(F.col("spike_idx") < n)


def chosen_labels(spark: SparkSession, base: str, group: int, path: str | None = None, variant: str = "stderiv", stage: str = "refine", n: int | None = None) -> DataFrame:
    """Labels of a file that is named, else of a variant and stage."""
    if path is None:
        return read_labels_at(spark, base, group, variant, stage, n)
    rows = read_binary(spark, path, "labels").drop("path")
    return rows if n is None else rows.where(F.col("spike_idx") < n)


def read_features(spark: SparkSession, base: str, group: int, order=DERIVED) -> DataFrame:
    return read_binary(spark, chosen_path(spark, base, "fet", group, order), "features").drop("path")


def read_waves(spark: SparkSession, base: str, group: int, samples: int, channels: int, order=DERIVED) -> DataFrame:
    """spike_idx, wave (samples x channels, sample by sample); the derivative first."""
    return read_binary(spark, chosen_path(spark, base, "spk", group, order), "waves", samples * channels).drop("path")


def read_raw_waves(spark: SparkSession, base: str, group: int, samples: int, channels: int) -> DataFrame:
    """Waves as recorded; a derivative is never taken in their place."""
    return read_waves(spark, base, group, samples, channels, STANDARD)


def read_signal(spark: SparkSession, path: str, channels: int, block: int = 32_768) -> DataFrame:
    """block, t0, samples (array of arrays of channels): the signal in blocks, a row that isn't whole dropped. Spark reads a file as one row of up to 2 GB;
    longer recordings are cut into files beforehand."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x, _ = parse("waves", data, channels)
                for k in range(0, len(x), block):
                    part = x[k : k + block]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * channels), pa.array(part.ravel(), pa.int16()))
                    rows = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([k // block], pa.int64()), pa.array([k], pa.int64()), rows], ["block", "t0", "samples"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "block bigint, t0 bigint, samples array<array<smallint>>")


def labelled_times(spark: SparkSession, base: str, group: int, order=CANONICAL) -> tuple[DataFrame, bool]:
    """(spike_idx, t, label; whether both files are there and as long as each other). An empty table if one is missing."""
    try:
        t, c = read_times(spark, base, group, order), read_labels(spark, base, group, order)
    except FileNotFoundError:
        return spark.createDataFrame([], "spike_idx bigint, t bigint, label int"), False
    whole = t.join(c, "spike_idx", "full")
    return whole.where("t is not null and label is not null"), whole.where("t is null or label is null").isEmpty()


def curated(spark: SparkSession, base: str, group: int, samples: int, channels: int, variant: str = "", tag: str = "", order=STANDARD) -> DataFrame:
    """spike_idx, t, label, wave of one stage; unlike lengths are an error."""
    t, c, w = read_times(spark, base, group), read_labels_at(spark, base, group, variant, tag), read_waves(spark, base, group, samples, channels, order)
    whole = t.join(c, "spike_idx", "full").join(w, "spike_idx", "full")
    odd = F.col("t").isNull() | F.col("label").isNull() | F.col("wave").isNull()
    return whole.withColumn("label", F.when(odd, F.raise_error(F.lit("times, labels and waves differ in length"))).otherwise(F.col("label")))


def lfp_index(t: Column, rate: float, lfp_rate: float, first: int = 0) -> Column:
    """An event's sample in a slower record that begins at ``first``."""
    return (F.rint(t * F.lit(lfp_rate / rate)) - F.lit(first)).cast("bigint")


def cut_waves(events: DataFrame, signal: DataFrame, samples: int, peak: int, channels: list[int], block: int = 32_768) -> DataFrame:
    """spike_idx, wave: windows of the signal around each event (spike_idx, t), the ends of the record repeated. Events and samples meet by block, so only the blocks that
    events touch are read, and an event's window at a block's edge comes from both."""
    last = signal.agg((F.max(F.col("t0") + F.size("samples")) - 1).alias("_last"))
    want = events.select("spike_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"), "t").crossJoin(F.broadcast(last))
    want = want.withColumn("_at", F.greatest(F.lit(0), F.least(F.col("t") - peak + F.col("k"), F.col("_last")))).withColumn("block", F.floor(F.col("_at") / block))
    got = want.join(signal, "block").select("spike_idx", "k", F.transform(F.array(*(F.lit(c) for c in channels)), lambda c: F.get(F.element_at("samples", (F.col("_at") - F.col("t0") + 1).cast("int")), c)).alias("x"))
    return got.groupBy("spike_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"])).alias("wave"))


# ---------------------------------------------------------------- bases

MAGIC = 0x50434145


def parse_basis(data: bytes) -> Basis:
    """A basis file: nine int32 (seven in version 1), means, then directions, in float64."""
    if len(data) < 8 or struct.unpack_from("<i", data)[0] != MAGIC:
        raise ValueError("not a basis file")
    version = struct.unpack_from("<i", data, 4)[0]
    if version not in (1, 2):
        raise ValueError(f"version {version} of a basis file isn't known")
    channels, length, parts, start, centred = struct.unpack_from("<5i", data, 8)
    method, inputs = struct.unpack_from("<2i", data, 28) if version == 2 else (int(Method.STANDARD), 0)
    body = np.frombuffer(data, "<f8", offset=36 if version == 2 else 28)
    if len(body) != channels * length * (1 + parts):
        raise ValueError(f"{len(body)} numbers instead of {channels * length * (1 + parts)}")
    return Basis(body[: channels * length].reshape(channels, length).copy(), body[channels * length :].reshape(channels, parts, length).copy(), start, bool(centred), method, inputs)


def basis_bytes(b: Basis) -> bytes:
    channels, parts, length = b.directions.shape
    head = struct.pack("<9i", MAGIC, 2, channels, length, parts, b.start, int(b.centred), int(b.method), b.inputs if b.inputs > 0 else channels)
    return head + np.ascontiguousarray(b.means, "<f8").tobytes() + np.ascontiguousarray(b.directions, "<f8").tobytes()


def file_bytes(path: str) -> bytes:
    fs, name = pfs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    with fs.open_input_stream(name, compression=None) as f:
        return f.read()


def put_bytes(path: str, data: bytes) -> str:
    fs, name = pfs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    with fs.open_output_stream(name, compression=None) as f:
        f.write(data)
    return path


def read_basis(spark: SparkSession, base: str, group: int, order=STANDARD) -> Basis:
    return parse_basis(file_bytes(chosen_path(spark, base, "pca", group, order)))


def clustering_basis(spark: SparkSession, base: str, group: int, method: str = "standard") -> Basis | None:
    """The basis of a method, or of another token of its family; nothing if there is none."""
    files = listed(spark, base).where((F.col("type") == "pca") & (F.col("group") == group))
    names = [r.variant for r in files.select("variant").distinct().collect()]
    order = list(STANDARD) if method in ("", "standard") else [method, *sorted(v for v in names if v != method and family(v) == family(method))]
    found = next((v for v in order if v in names), None)
    return None if found is None else parse_basis(file_bytes(files.where(F.col("variant") == found).first().path))


def write_basis(path: str, b: Basis) -> str:
    return put_bytes(path, basis_bytes(b))


# ---------------------------------------------------------------- position tables

POSITION_COLUMNS = ("x0", "y0", "z0", "A", "dist", "depth_shift", "one_flank")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """spike_idx and the columns of a position table: an int32 width, then float32 rows."""
    names = ["spike_idx", *POSITION_COLUMNS]

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                width = struct.unpack_from("<i", data)[0]
                x = np.frombuffer(data, "<f4", (len(data) - 4) // 4 // width * width, 4).reshape(-1, width)
                for k in range(0, len(x), 50_000):
                    part = x[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), *(pa.array(part[:, j] if j < width else np.full(len(part), np.nan, np.float32)) for j in range(len(POSITION_COLUMNS)))], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "spike_idx bigint, " + ", ".join(f"{c} float" for c in POSITION_COLUMNS))


def probe_sites(spark: SparkSession, lines: list[str], channels: list[int] | None = None) -> DataFrame:
    """channel, x, y from the texts of probe files (a site a line: x and y, after anything that isn't two numbers is left out), numbered through all of them; of a group's channels alone, if they are given."""
    rows = spark.createDataFrame([(i, x) for i, text in enumerate(lines) for x in [text]], "file int, text string").select("file", F.posexplode(F.split("text", "\n")).alias("line", "row"))
    number = r"(-?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^\s*{number}[\s,;]+{number}\s*$"
    sites = rows.where(F.col("row").rlike(pattern)).select("file", "line", F.regexp_extract("row", pattern, 1).cast("double").alias("x"), F.regexp_extract("row", pattern, 2).cast("double").alias("y"))
    found = sites.withColumn("channel", F.row_number().over(Window.orderBy("file", "line")) - 1).select("channel", "x", "y")
    return found if channels is None else found.where(F.col("channel").isin(channels))


def probe_geometry(paths: list[str], channels: list[int]) -> np.ndarray:
    """x and y (um) of a group's channels, from probe descriptions whose sites are numbered through all of them."""
    sites = []
    for path in paths:
        found = ((load_yaml(path).get("probeFile") or {}).get("sites") or {}).get("geometry")
        if found is None:
            raise ValueError(f"{path} has no probeFile.sites.geometry")
        sites += found
    if channels and max(channels) >= len(sites):
        raise ValueError(f"channel {max(channels)} is beyond the {len(sites)} sites; give all probes, in the order of their channels")
    return np.array(sites, float).reshape(-1, 2)[list(channels)]


# ---------------------------------------------------------------- other tables


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def read_pathways(spark: SparkSession, path: str, post: str | None = None) -> DataFrame:
    """The table of pathways; comment lines begin with #."""
    t = spark.read.csv(path, sep="\t", header=True, comment="#")
    return t if post is None else t.where(F.col("post") == post)


def read_anchor_pairs(spark: SparkSession, path: str) -> DataFrame:
    """transition, atom_a, atom_b."""
    return spark.read.parquet(path).select("transition", "atom_a", "atom_b")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, x, y, z, radius, parent of the points of morphology files, comments left out; parent -1 is a root."""
    p = F.split(F.trim("value"), r"\s+")
    names = ("id", "kind", "x", "y", "z", "radius", "parent")
    types = ("bigint", "int", "double", "double", "double", "double", "bigint")
    return spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(*(p[k].cast(t).alias(n) for k, (n, t) in enumerate(zip(names, types, strict=True))))


def sections(points: DataFrame) -> DataFrame:
    """section, n, length, first, last: unbranched runs of points. A run begins at a root, after a branching point, or where the kind changes; runs are followed by pointer doubling."""
    children = points.where("parent >= 0").groupBy("parent").agg(F.count(F.lit(1)).alias("forks")).withColumnRenamed("parent", "id")
    up = points.select(F.col("id").alias("parent"), F.col("kind").alias("kind_up"), F.col("x").alias("xu"), F.col("y").alias("yu"), F.col("z").alias("zu"))
    rows = points.join(up, "parent", "left").join(children.withColumnRenamed("id", "parent").withColumnRenamed("forks", "forks_up"), "parent", "left")
    starts = F.col("kind_up").isNull() | (F.col("kind") != F.col("kind_up")) | (F.col("forks_up") > 1)
    step = F.sqrt((F.col("x") - F.col("xu")) ** 2 + (F.col("y") - F.col("yu")) ** 2 + (F.col("z") - F.col("zu")) ** 2)
    link = rows.select("id", F.when(starts, F.col("id")).otherwise(F.col("parent")).alias("to"), F.coalesce(step, F.lit(0.0)).alias("step"))
    n = max(1, link.count())
    jump = link.select("id", "to")
    for _ in range(max(1, (n - 1).bit_length())):
        jump = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"))
    return jump.join(link.select("id", "step"), "id").groupBy(F.col("to").alias("section")).agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("length"), F.min("id").alias("first"), F.max("id").alias("last"))


# ---------------------------------------------------------------- writers


def write_binary(df: DataFrame, path: str, kind: str, clusters: int | None = None) -> str:
    """One file of times (t), labels (label), features (f) or waves (wave), in the order of spike_idx."""
    column, dtype = {"times": ("t", "<i8"), "labels": ("label", "<i4"), "features": ("f", "<i8"), "waves": ("wave", "<i2"), "positions": ("row", "<f4")}[kind]
    full = path if "://" in path else "file://" + os.path.abspath(path)
    parts = f"{full}.parts-{uuid.uuid4().hex}"
    if kind == "labels":
        head = struct.pack("<i", (df.agg(F.coalesce(F.max("label") + 1, F.lit(0))).first()[0]) if clusters is None else clusters)
    elif kind in ("features", "positions"):
        head = struct.pack("<i", df.agg(F.max(F.size(column))).first()[0] or 0)
    else:
        head = b""

    def run(batches):
        fs, root = pfs.FileSystem.from_uri(parts)
        fs.create_dir(root, recursive=True)
        name, first, held = uuid.uuid4().hex, None, None
        for batch in batches:
            x = batch.column(1)
            values = (x.flatten() if pa.types.is_list(x.type) else x).to_numpy(zero_copy_only=False).astype(dtype)
            if held is None and batch.num_rows:
                first, held = batch.column(0)[0].as_py(), fs.open_output_stream(f"{root}/{name}", compression=None)
            if held is not None:
                held.write(values.tobytes())
        if held is not None:
            held.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "first": pa.array([first], pa.int64())})

    done = df.select("spike_idx", column).repartitionByRange("spike_idx").sortWithinPartitions("spike_idx").mapInArrow(run, "name string, first bigint").collect()
    fs, root = pfs.FileSystem.from_uri(full)
    with fs.open_output_stream(root, compression=None) as out:
        out.write(head)
        for r in sorted(done, key=lambda r: r.first):
            with fs.open_input_stream(f"{pfs.FileSystem.from_uri(parts)[1]}/{r.name}", compression=None) as f:
                while data := f.read(1 << 22):
                    out.write(data)
    if done:
        fs.delete_dir(pfs.FileSystem.from_uri(parts)[1])
    return path


def write_times(df: DataFrame, base: str, group: int, variant: str = "", tag: str = "") -> str:
    return write_binary(df, session_path(base, "res", group, variant, tag), "times")


def write_labels(df: DataFrame, base: str, group: int, variant: str = "", tag: str = "", clusters: int | None = None) -> str:
    return write_binary(df, session_path(base, "clu", group, variant, tag), "labels", clusters)


def write_features(df: DataFrame, base: str, group: int, variant: str = "", tag: str = "") -> str:
    return write_binary(df, session_path(base, "fet", group, variant, tag), "features")


def write_waves(df: DataFrame, base: str, group: int, variant: str = "", tag: str = "") -> str:
    return write_binary(df, session_path(base, "spk", group, variant, tag), "waves")


def write_positions(df: DataFrame, path: str) -> str:
    """spike_idx and the columns of a position table, missing ones as nan."""
    row = F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) if c in df.columns else F.lit(float("nan")).cast("float") for c in POSITION_COLUMNS))
    return write_binary(df.select("spike_idx", row.alias("row")), path, "positions")


def write_stage(atoms: DataFrame, parents: DataFrame, base: str, group: int, variant: str = "stderiv", tag: str = "microfiber") -> dict[str, str]:
    """The labels, atoms and parents of one stage, from atoms (spike_idx, atom) and parents (atom, fiber); an atom without a parent is 0."""
    labels = atoms.join(parents, "atom", "left").select("spike_idx", F.coalesce("fiber", F.lit(0)).alias("label"))
    most = atoms.agg(F.max("atom")).first()[0] or 0
    every = atoms.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("atom")).join(parents, "atom", "left").select((F.col("atom") - 1).cast("bigint").alias("spike_idx"), F.coalesce("fiber", F.lit(0)).alias("label"))
    names = {kind: session_path(base, kind, group, variant, tag) for kind in ("clu", "clc", "clp")}
    write_binary(labels, names["clu"], "labels")
    write_binary(atoms.select("spike_idx", F.col("atom").alias("label")), names["clc"], "labels")
    write_binary(every, names["clp"], "labels")
    return names


def write_identity(labels: DataFrame, base: str, group: int, variant: str, tag: str) -> dict[str, str]:
    """The same for labels that are atoms and fibers at once."""
    return write_stage(labels.select("spike_idx", F.col("label").alias("atom")), labels.select(F.col("label").alias("atom"), F.col("label").alias("fiber")).where("atom > 0").distinct(), base, group, variant, tag)


def write_report(df: DataFrame, path: str) -> None:
    """A table of values as tab-separated text with a header; for small tables, in one file."""
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_manifest(df: DataFrame, path: str, key: str = "neuron_name") -> None:
    """Rows once a name, in order of names."""
    first = df.groupBy(key).agg(*(F.min_by(c, F.struct(*df.columns)).alias(c) for c in df.columns if c != key)).select(*df.columns)
    first.coalesce(1).sortWithinPartitions(key).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_tracks(df: DataFrame, path: str, keys: tuple[str, ...] = ("fiber", "chunk")) -> None:
    """Curves and geometry in long form, sorted by their keys for readers that prune."""
    df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Merges, added to the log of those before."""
    df.write.mode("append").parquet(path)


def report_html(df: DataFrame, title: str, most: int = 100_000) -> str:
    """A page with the table; tables of more rows than a page can hold are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no page")
    cell = lambda v: str("" if v is None else v).replace("&", "&amp;").replace("<", "&lt;")
    line = lambda vs, t: "<tr>" + "".join(f"<{t}>{cell(v)}</{t}>" for v in vs) + "</tr>"
    return f"<!doctype html><meta charset=utf-8><title>{cell(title)}</title><h1>{cell(title)}</h1><table>{line(df.columns, 'th')}{''.join(line(r, 'td') for r in rows)}</table>"


def kept_events(df: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of a per-event table (spike_idx) that are kept (spike_idx), numbered anew in their order."""
    # numbers come from a sorted and written table, so no task sorts all events and none is numbered twice
    new = numbered(keep.where("spike_idx IS NOT NULL").select("spike_idx").distinct(), "_new", "spike_idx")
    return df.join(new, "spike_idx").drop("spike_idx").withColumnRenamed("_new", "spike_idx").select(*df.columns)


# ---------------------------------------------------------------- the session's description

# fixed values
PROBE_KEYS = ("probeFile", "probeFiles", "probe", "probeFileName", "probefile", "probes")


def load_yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("descriptions need PyYAML") from e
    return yaml.safe_load(file_bytes(path).decode()) or {}


def find_session(session: str) -> str | None:
    """The description of a session given by its file, its stem or its folder."""
    s = session.rstrip("/")
    stem = re.sub(r"\.ya?ml$", "", s)
    name = os.path.basename(stem)
    options = [s] * (stem != s) + [f"{stem}.yaml", f"{stem}.yml", f"{stem}/{name}.yaml", f"{stem}/{name}.yml"]
    return next((p for p in options if os.path.isfile(p)), None)


def described(session: str) -> dict:
    found = find_session(session)
    if found is None:
        raise FileNotFoundError(f"no description of session {session!r}")
    return load_yaml(found)


def groups_of(doc: dict) -> list[dict]:
    return (doc.get("spikeDetection") or {}).get("channelGroups") or []


def spike_groups(session: str) -> list[int]:
    return list(range(1, len(groups_of(described(session))) + 1)) if find_session(session) else []


def rates(doc: dict) -> dict:
    a = doc.get("acquisitionSystem") or {}
    return {"n_channels": int(a["nChannels"]), "sampling_rate": float(a["samplingRate"]), "lfp_rate": float((doc.get("fieldPotentials") or {}).get("lfpSamplingRate") or 0) or None, "n_bits": int(a.get("nBits", 16))}


def probe_files(doc: dict, folder: str, group: int | None = None) -> list[str]:
    """The probe files that a description names, each once, relative ones in its folder or in the library it names."""
    places = [doc, *(doc.get(k) or {} for k in ("files", "general", "spikeDetection", "acquisitionSystem"))]
    places += [groups_of(doc)[group - 1] or {}] if group and group <= len(groups_of(doc)) else []
    named = [x for p in places if isinstance(p, dict) for k in PROBE_KEYS for x in (p.get(k) if isinstance(p.get(k), list) else [p.get(k)])]
    listed_ = [p for p in doc.get("probes") or [] if isinstance(p, dict) and p.get("probeFile")] if isinstance(doc.get("probes"), list) else []
    named += [p["probeFile"] for p in sorted(listed_, key=lambda p: p.get("channelOffset", 0))]
    roots = [folder, *([os.path.expanduser(doc["probeLibraryPath"])] if isinstance(doc.get("probeLibraryPath"), str) else [])]
    full = lambda p: p if os.path.isabs(p) else next((q for r in roots if os.path.exists(q := os.path.normpath(os.path.join(r, p)))), os.path.normpath(os.path.join(folder, p)))
    return list(dict.fromkeys(full(p) for p in named if isinstance(p, str) and p))


@dataclass
class SessionCfg:
    """What is known of one group of a session. Other names are errors."""

    base: str | None = None
    yaml: str | None = None
    group: int | None = None
    channels: list | None = None
    ntotal: int | None = None
    nchan: int | None = None
    nsamp: int | None = None
    sr: float | None = None
    peak: int | None = None
    probe: list | None = None
    sdiff_pairs: str | None = None
    nbits: int | None = None
    nfeatures: int | None = None

    def __getitem__(self, name: str):
        if name not in self.keys():
            raise KeyError(name)
        return getattr(self, name)

    def __contains__(self, name: str) -> bool:
        return name in self.keys()

    @classmethod
    def keys(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))


def load_session(session: str, group: int) -> SessionCfg:
    path = find_session(session)
    doc = described(session)
    groups = groups_of(doc)
    if not 1 <= group <= len(groups):
        raise ValueError(f"group {group} isn't one of 1 to {len(groups)}")
    g, a = groups[group - 1], doc.get("acquisitionSystem") or {}
    channels = [int(c) for c in g.get("channels") or []]
    if not channels:
        raise ValueError(f"group {group} has no channels")
    number = lambda x, t: None if x is None else t(x)
    return SessionCfg(
        re.sub(r"\.ya?ml$", "", path), path, group, channels, number(a.get("nChannels"), int), len(channels), number(g.get("nSamples"), int), number(a.get("samplingRate"), float),
        number(g.get("peakSampleIndex"), int), probe_files(doc, os.path.dirname(os.path.abspath(path)), group) or None, g.get("sdiffPairs"), number(a.get("nBits"), int), number(g.get("nFeatures"), int),
    )


def session_parameters(session: str, group: int, require: tuple[str, ...] = ("channels", "ntotal"), **given) -> SessionCfg:
    """The description's values, with those given in their place; what is required and missing is an error."""
    cfg = load_session(session, group) if find_session(session) else SessionCfg(base=re.sub(r"\.ya?ml$", "", session.rstrip("/")), group=group)
    for name, value in given.items():
        if value is not None:
            cfg[name]
            setattr(cfg, name, value)
    if isinstance(cfg.channels, str):
        cfg.channels = [int(c) for c in cfg.channels.split(",")]
    cfg.nchan = cfg.nchan or (len(cfg.channels) if cfg.channels else None)
    if missing := [n for n in require if cfg[n] is None]:
        raise ValueError(f"not in the description, and not given: {', '.join(missing)}")
    return cfg


def refractory_samples(session: str, group: int, rate: float | None = None, default: int = 16) -> tuple[int, str]:
    """The detector's refractory period in samples, and where it is from: the group's, then all groups', in samples before milliseconds."""
    doc = described(session) if find_session(session) else {}
    all_, groups = doc.get("spikeDetection") or {}, groups_of(doc)
    own = groups[group - 1] if 1 <= group <= len(groups) else {}
    for name, place in (("group", own), ("all groups", all_)):
        if place.get("refractoryPeriod") is not None:
            return int(place["refractoryPeriod"]), name
    ms = next((float(p["refractoryMs"]) for p in (own, all_) if p.get("refractoryMs") is not None), None)
    return (max(1, int(round(ms * rate / 1000))), f"{ms} ms") if ms is not None and rate else (int(default), "default")


def program_parameters(session: str, program: str) -> dict:
    doc = described(session) if find_session(session) else {}
    entry = next((e for e in doc.get("programs") or [] if isinstance(e, dict) and e.get("name") == program), {})
    return {p["name"]: p.get("value") for p in entry.get("parameters") or [] if isinstance(p, dict) and "name" in p}


def stage_parameters(session: str, stage: str, program: str) -> dict:
    """One stage's parameters ``stage.name`` of a program."""
    return {k.removeprefix(f"{stage}."): v for k, v in program_parameters(session, program).items() if isinstance(k, str) and k.startswith(f"{stage}.")}
