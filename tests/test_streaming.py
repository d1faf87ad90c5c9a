from __future__ import annotations

import pytest

from bidloom.operators import analytics as A
from bidloom.operators import views as V
from bidloom.streaming import state


@pytest.fixture(scope="module")
def attempts(spark, tiny, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stream") / "in")
    rows = V.attempts(spark, tiny)
    rows = rows.withColumn("ts", rows.ts.cast("timestamp"))
    rows.select("item_id", "ts", "ord", "platform", "query", "status", "match_detail", "price", "formal").repartition(3).write.parquet(at)
    batch = spark.read.parquet(at)
    return batch, lambda files=1: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files).parquet(at)


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_latest_fold_agrees_with_batch(spark, attempts):
    batch, stream = attempts
    got = run(spark, state.latest_by_item(stream().select("item_id", "ts", "ord", "status")), "latest", "update")
    last = {}
    for r in got.collect():
        if r.n_events >= last.get(r.item_id, r).n_events:
            last[r.item_id] = r
    want = A.latest(batch.select("item_id", "ts", "ord", "status"), "item_id", "ts", "ord")
    cols = ["item_id", "ts", "ord", "status", "n_events"]
    assert sorted(tuple(r[c] for c in cols) for r in last.values()) == sorted(tuple(r) for r in want.select(cols).collect())


def test_breaker_trips_once(spark, attempts):
    batch, stream = attempts
    got = run(spark, state.breaker(stream(10).select("platform", "ts", "ord", "status")), "trips", "append").collect()
    want = A.breaker_timeline(batch).where("newly_tripped").select("platform", "ord").collect()
    assert sorted((r.platform, r.ord) for r in got) == sorted((r.platform, r.ord) for r in want)


def test_windows_agree_with_batch(spark, attempts):
    from pyspark.sql import functions as F

    batch, stream = attempts
    got = run(spark, state.status_windows(stream(10), late="60 days"), "win", "complete")
    want = batch.groupBy(F.window("ts", "6 hours").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")
    assert sorted(got.collect()) == sorted(want.collect())
