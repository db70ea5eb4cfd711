"""Tables as event trains and waveforms."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, unit, t (microseconds), kind, amp."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("event"), F.col("user_id").alias("unit"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("amp"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, cluster, w (array of double)."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("event"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("w"))


def event_trains_of_stream(spark: SparkSession, path: str) -> DataFrame:
    """event, unit, ts, kind, amp of the event files that come into a folder."""
    e = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").parquet(path)
    return e.select(F.col("event_id").alias("event"), F.col("user_id").alias("unit"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("value").alias("amp"))
