"""What the training-data operators share: the shared folder, tables cut from their lineage, Arrow batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python stage holds at a time.
SLICE_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "eventloom-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/eventloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, so that a lost executor costs no recomputation before it. ``options`` are the Parquet writer's."""
    spark = df.sparkSession
    df.write.options(**options).parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the written tables that ``frames`` read."""
    for path in {os.path.dirname(f) for df in frames for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """SQL settings for what runs inside; afterwards they are as before."""
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Pieces of the batches, of whole rows, whose texts have ``limit`` bytes together or are one text; each with its texts, which become Python strings piece by piece."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start), column.slice(start).to_pylist()


def by_text(df: DataFrame, keep: list[Column], text: str, fn: Callable, schema: str, limit: int = SLICE_CHARS) -> DataFrame:
    """``df`` mapped by ``fn(batch, texts)``, which returns Arrow columns. The batch has the columns ``keep``, then ``_text``."""
    names = [x.split(" ")[0] for x in schema.split(", ")]  # types have no ", " in them

    def run(batches):
        for batch, texts in slices(batches, "_text", limit):
            yield pa.RecordBatch.from_arrays(fn(batch, texts), names)

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
