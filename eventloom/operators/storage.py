"""Tables written to the shared folder, and running values over a total order that no task has to hold."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a folder of our own only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "eventloom-shared")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table, so that what follows starts from files and a lost executor costs nothing before them."""
    path = f"{shared_dir(df.sparkSession)}/eventloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` sorted over all tasks and written; ``_part`` and ``_row`` are a row's file and place in it, so both together are its place in the order."""
    rows = written(df.orderBy(*order), "ordered")
    return rows.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("_part"), F.col("_metadata.row_index").alias("_row"))


def before(rows: DataFrame, name: str, value: Column, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """``rows`` of ``ordered`` with ``how`` (F.sum or F.max) of ``value`` over all rows before; null before the first.

    Inside a file it is a window; what files before have is one row a file, so the rows themselves meet in no single task."""
    own = rows.withColumn("_v", value)
    within = how("_v").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    carry = own.groupBy("_part").agg(how("_v").alias("_c")).select("_part", how("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    both = F.greatest("_w", "_c") if how is F.max else F.coalesce(F.col("_w") + F.col("_c"), "_w", "_c")
    return own.withColumn("_w", within).join(F.broadcast(carry), "_part").withColumn(name, both).drop("_v", "_w", "_c")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with each row's place in the order, from 0; no task holds all rows. The order is to be total, as rows that are equal in it have any of their places."""
    rows = before(ordered(df, *order), name, F.lit(1).cast("bigint"))
    return rows.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint"))).drop("_part", "_row")
