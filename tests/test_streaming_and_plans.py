import math

import pytest
from pyspark.sql import functions as F

from eventloom.operators import trains
from eventloom.plans import plan
from eventloom.sources.tables import event_trains_of_stream, trains as event_trains
from eventloom.streaming import trains as streams

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")
    return event_trains_of_stream(spark, f"{tmp_path}/in")


def drained(df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_as_in_batch(spark, stream, tmp_path):
    got = drained(streams.tumbling(stream), tmp_path, "complete")
    batch = event_trains(spark, SF).groupBy("unit", F.floor(F.col("t") / trains.DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    want = sorted((r.unit, r.day, r.n) for r in batch.collect())
    assert sorted((r.unit, int(r.s) // 86400, r.n) for r in got.select("unit", F.unix_timestamp("start").alias("s"), "n").collect()) == want


def test_copies_go(spark, stream, tmp_path):
    assert drained(streams.distinct_events(stream.union(stream), "60 days"), tmp_path).count() == 1000


def test_decaying_count(spark, stream, tmp_path):
    tau, want = 40_000.0, {}
    rows = sorted((r.unit, r.t / 1e6, r.event) for r in event_trains(spark, SF).collect())
    for k, (unit, t, event) in enumerate(rows):
        same = k and rows[k - 1][0] == unit
        want[event] = math.exp(-(t - rows[k - 1][1]) / tau) * (want[rows[k - 1][2]] + 1) if same else 0.0
    got = {r.event: r.load for r in drained(streams.decaying(stream, tau), tmp_path).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-6 for e in want)


def test_plans(spark):
    e = event_trains(spark, SF)
    steps = [plan.Step("bad", lambda q: q.where("flags <> ''"), ("quality",)), plan.Step("quality", trains.quality, ("events",), {"least": 5}), plan.Step("other", trains.episodes, ("events",))]
    made = plan.run(steps, {"events": e}, "bad")
    assert set(made) == {"events", "quality", "bad"} and made["bad"].count() <= made["quality"].count()
    assert plan.lint([plan.Step("a", len, ("b",)), plan.Step("b", len, ("a",))], set())[0].startswith("a circle")
    assert plan.lint([plan.Step("a", len, ("x",))], {"a"}) == ["a is made twice", "a reads x, which nothing makes"]
    with pytest.raises(ValueError):
        plan.run([plan.Step("a", len, ("x",))], {})
