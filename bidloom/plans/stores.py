"""Queries that write: workbooks by the committing sink, incremental reading, keyed state, the job store. Each writes in the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom import shared
from bidloom.operators import views as V
from bidloom.plans import names as PN
from bidloom.sources import arrivals, sink, xlsx
from bidloom.sources import workbook as W
from bidloom.streaming import keyed
from bidloom.streaming.store import Store

#: Rows of a sheet in the workbooks of ``books_by_brand``, so that small tables fill several.
BOOK_ROWS = 25


def books_by_brand(spark, d):
    """Open inquiries as workbooks by brand, long ones in parts, written by the sink and read again."""
    items, _, _ = PN._statused(spark, d)
    brand = F.concat(F.regexp_replace(F.element_at("cells", 5), "#", "-"), F.lit(".xlsx"))
    rows = W.split(W.open_rows(items, 3), brand)
    at = shared.scratch(spark, "books")
    sink.save_rows(rows, at, most=BOOK_ROWS)
    cell = lambda i, name: F.element_at("cells", i).alias(name)
    return xlsx.read_binary(spark, at).where("row > 1").select("file", "sheet", "row", cell(3, "name"), cell(4, "spec"), cell(9, "status"), cell(10, "n_quotes"))


#: Batches in which the events of a table are replayed, in order of time.
SLICES = 4


def _replayed(spark, events, make):
    """What the streaming operator ``make`` gives of ``events``, read in ``SLICES`` batches by time; a last event far ahead lets the watermark pass all others."""
    at = shared.scratch(spark, "replay")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    seconds = F.unix_seconds("ts") - F.unix_seconds(F.lit(low))
    width = max(1, int((high - low).total_seconds())) if low is not None else 1
    for k in range(SLICES):
        own = F.least(F.floor(seconds * SLICES / width), F.lit(SLICES - 1)) == k
        events.where(own).coalesce(2).write.mode("append").parquet(f"{at}/in")
    if low is not None:
        ahead = events.limit(1).withColumns({"ts": F.lit(high) + F.expr("interval 400 days"), **{c: F.lit(None).cast(t) for c, t in events.dtypes if c != "ts"}})
        ahead.coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    with keyed.state_store(spark):
        out = make(stream)
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def _events(spark, d, *columns):
    rows = V.attempts(spark, d)
    return rows.withColumn("ts", rows.ts.cast("timestamp")).select(*columns)


def pool_lookups(spark, d):
    """Searches found and missed in the candidate pool, and its entries with the times they were found, from the stream of attempts."""
    return _replayed(spark, _events(spark, d, "platform", "query", "ts", "ord", "status"), keyed.pool).where("platform is not null")


def pool_lookups_batch(spark, d):
    return keyed.pool_batch(_events(spark, d, "platform", "query", "ts", "ord", "status"))


def breaker_sessions(spark, d):
    """The first trip of each session of a platform and user group, from the stream of attempts."""
    return _replayed(spark, _grouped(spark, d), lambda s: keyed.breaker(s, gap_hours=3))


def _grouped(spark, d):
    group = F.concat_ws("/", "platform", (F.col("item_id") % 9).cast("string"))
    return _events(spark, d, group.alias("platform"), "ts", "ord", "status")


def breaker_sessions_batch(spark, d):
    return keyed.breaker_batch(_grouped(spark, d), gap_hours=3)


def item_folds(spark, d):
    """The events of each item folded by sessions, from the stream of attempts."""
    return _replayed(spark, _events(spark, d, "item_id", "ts", "ord", "status"), keyed.folds).where("item_id is not null")


def stored_jobs(spark, d):
    """The last state of each job, written exactly once: a stream of events merged batch by batch, with a compaction on the way and
    batches that come again. A ``no_membership`` event deletes its job."""
    events = _events(spark, d, "item_id", "ts", "ord", "status", "price")
    at = shared.scratch(spark, "jobs")
    events.repartition(6, "ord").write.parquet(f"{at}/in")
    store = Store(spark, f"{at}/store", events.schema, ("item_id",), ("ts", "ord"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    marked = stream.withColumn("op", F.when(F.col("status") == "no_membership", "delete").otherwise("upsert"))
    store.write(marked, f"{at}/state", compact_every=3).awaitTermination()
    done = [store.merge(events, n) for n in range(6)]  # batches come again: nothing changes
    assert not any(done)
    return store.read()


def arrived_items(spark, d):
    """Items of workbooks that come in two rounds, of which the second replaces some: each round reads only what is new."""
    at = shared.scratch(spark, "arrived")
    parts = V.read(spark, d, "part")
    odd = F.substring("p_brand", -1, 1).cast("int") % 2 == 1
    store = Store(spark, f"{at}/store", "file string, version long, item_id string, name string, spec string, unit string, qty double", ("file", "item_id"), ("version",))
    for rows in (parts.where("p_size <> 50 and p_size <> 49"), parts.where(odd & (F.col("p_size") > 25))):
        file = F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit(".xlsx"))
        cells = F.array("p_name", F.concat(F.lit("DN"), (F.col("p_size") * 10).cast("string")), F.lit("m"), F.col("p_size").cast("string"))
        body = rows.select(file.alias("file"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("ord"), cells.alias("cells"))
        heads = body.select("file").distinct().withColumns({"ord": F.lit("0"), "cells": F.array(*map(F.lit, ("材料名称", "规格型号", "单位", "数量")))})
        named = body.unionByName(heads).withColumns({"sheet_no": F.lit(1), "sheet": F.lit("安装")})
        sink.write(sink.clustered(named.select("file", "sheet_no", "sheet", "ord", "cells")), f"{at}/in")
        arrived = arrivals.stream(spark, f"{at}/in", f"{at}/log")
        query = arrived.writeStream.foreachBatch(lambda df, n: arrivals.merge(store, df, n)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return arrivals.current(store.read())


QUERIES = {f.__name__: f for f in (books_by_brand, pool_lookups, pool_lookups_batch, breaker_sessions, breaker_sessions_batch, item_folds, stored_jobs, arrived_items)}

_A = f"WITH {V.ATTEMPTS}"
_POOL = f"""{_A}, e AS (SELECT platform, lower(query) AS query, ts, ord, status = 'ok' AS put, epoch_us(ts) AS us FROM attempts),
p AS (SELECT *, count(*) FILTER (put) OVER w AS no, max(CASE WHEN put THEN us END) OVER w AS put_us FROM e WINDOW w AS (PARTITION BY platform, query ORDER BY ts, ord)),
l AS (SELECT *, NOT put AND coalesce(us - put_us <= 7 * 86400000000, false) AS live FROM p),
h AS (SELECT *, count(*) FILTER (live) OVER (PARTITION BY platform, query, no ORDER BY ts, ord) AS hits FROM l)
SELECT platform, query, CASE WHEN live THEN 'hit' ELSE 'miss' END AS kind, ts, ord, CASE WHEN live THEN us - put_us END AS age_us, CASE WHEN live THEN hits END AS hits FROM h WHERE NOT put
UNION ALL SELECT platform, query, 'entry', min(ts) FILTER (put), NULL, NULL, count(*) FILTER (live) FROM h WHERE no > 0 GROUP BY platform, query, no"""
_BREAKER = f"""{_A}, e AS (SELECT platform || '/' || CAST(item_id % 9 AS VARCHAR) AS platform, ts, ord, lower(status) AS reason FROM attempts),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY platform ORDER BY ts, ord) > INTERVAL 3 HOURS THEN 1 ELSE 0 END AS b FROM e),
n AS (SELECT *, sum(b) OVER (PARTITION BY platform ORDER BY ts, ord) AS session FROM s)
SELECT platform, ts, ord, reason FROM (SELECT *, row_number() OVER (PARTITION BY platform, session ORDER BY ts, ord) AS k FROM n
  WHERE reason IN ('rate_limited', 'captcha', 'need_login', 'need_login_fail', 'no_membership')) WHERE k = 1"""

ORACLE = {
    "books_by_brand": f"""WITH st AS ({PN._STATUS}), r AS (SELECT *, replace(p_brand, '#', '-') AS b, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(item_id AS VARCHAR)) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n
  FROM st JOIN part ON p_partkey = item_id WHERE status <> 'full_k')
SELECT b || CASE WHEN n > {BOOK_ROWS} THEN '-' || lpad(CAST(k // {BOOK_ROWS} + 1 AS VARCHAR), 4, '0') ELSE '' END || '.xlsx' AS file, '待询价' AS sheet, CAST(k % {BOOK_ROWS} + 2 AS INTEGER) AS row,
  p_name AS name, 'DN' || CAST(p_size * 10 AS VARCHAR) AS spec, status, CAST(n_quotes AS VARCHAR) AS n_quotes FROM r""",
    "pool_lookups": _POOL,
    "pool_lookups_batch": _POOL,
    "breaker_sessions": _BREAKER,
    "breaker_sessions_batch": _BREAKER,
    "item_folds": f"""{_A}, s AS (SELECT item_id, ts, ord, status, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOURS THEN 1 ELSE 0 END AS b FROM attempts WINDOW w AS (PARTITION BY item_id ORDER BY ts, ord)),
n AS (SELECT *, sum(b) OVER (PARTITION BY item_id ORDER BY ts, ord) AS session FROM s)
SELECT item_id, min(ts) AS start, max(ts) AS ts, arg_max(ord, (ts, ord)) AS ord, arg_max(status, (ts, ord)) AS status, count(*) AS n_events FROM n GROUP BY item_id, session""",
    "stored_jobs": f"{_A} SELECT item_id, ts, ord, status, price FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, ord DESC) AS k FROM attempts) WHERE k = 1 AND status <> 'no_membership'",
    "arrived_items": """WITH r AS (SELECT *, CAST(right(p_brand, 1) AS INTEGER) % 2 = 1 AS odd FROM part),
a AS (SELECT *, 1 AS version FROM r WHERE p_size NOT IN (49, 50)), b AS (SELECT *, 2 AS version FROM r WHERE odd AND p_size > 25),
v AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE p_brand NOT IN (SELECT p_brand FROM b))
SELECT replace(p_brand, '#', '-') || '.xlsx' AS file, CAST(version AS BIGINT) AS version, '安装|' || CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS VARCHAR) AS item_id,
  p_name AS name, 'DN' || CAST(p_size * 10 AS VARCHAR) AS spec, 'm' AS unit, CAST(p_size AS DOUBLE) AS qty FROM v""",
}
