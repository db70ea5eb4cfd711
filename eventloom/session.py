"""Sessions as the library wants them."""

from pyspark.sql import SparkSession


def session(name: str = "eventloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, skew joins split."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
