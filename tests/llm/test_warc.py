from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from bidloom.llm import common, warc


def plain(rows):
    """page_id -> (bytes, digest, type, refers_to) by the rule, row by row."""
    first, out = {}, {}
    for i, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (html or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        to = first.setdefault(d, i) if len(raw) >= 100 else i
        out[i] = (len(raw), d, "response" if to == i else "revisit", None if to == i else to)
    return out


def test_tiny_table_and_round_trip(spark, tiny):
    rows = [(r.page_id, r.html) for r in common.read(spark, tiny, "pages").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op6_warc_revisits(spark, tiny).collect()}
    assert got == plain(rows)


def test_hard_payloads(spark):
    long = "WARC/1.1\r\n\r\nx" * 40
    rows = [(3, long), (1, long), (2, long), (4, None), (5, ""), (6, "short"), (7, "short"), (8, "é" * 50), (9, "é" * 50), (10, "\r\n\r\n" * 30), (11, "\r\n\r\n" * 30), (12, "a" * 3_000_000), (None, long)]
    df = spark.createDataFrame([(i, "http://x/\r\n" if i else None, h, 1, 2) for i, h in rows], "page_id long, url string, html string, row int, record int")
    at = common.scratch(spark, "test")
    warc.write_archives(df, at)
    found = warc.read_archives(spark, at)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()}
    assert got.pop(None)[2:] == ("response", None)
    assert got == plain(rows)
    assert {r.page_id: r.payload for r in warc.resolve(found).collect()} == {i: h or "" for i, h in rows}


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "u", "z" * 200), (1, "u", "z" * 200), (2, "u", "z" * 200)], "page_id long, url string, html string")
    at = common.scratch(spark, "test")
    warc.write_archives(df, at)
    assert sorted((r.page_id, r.record_type) for r in warc.read_archives(spark, at).collect()) == [(1, "response"), (1, "response"), (2, "revisit")]
    at = common.scratch(spark, "test")
    warc.write_archives(df.limit(0), at)
    assert warc.read_archives(spark, at).count() == 0


def test_records_have_own_ids_and_can_be_read_alone(spark):
    rows = [(1, "u", "z" * 200)] * 3 + [(2, "u", "z" * 200), (None, "u", ""), (None, "u", ""), (1, "u", "other"), (3, None, "a\r\n\r\nb")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for compression in ("none", "gzip"):
        at = common.scratch(spark, "test")
        warc.write_archives(df, at, compression=compression)
        found = warc.read_archives(spark, at).collect()
        assert len({r.record_id for r in found}) == len(found) == len(rows)
    plain_at = common.scratch(spark, "test")
    warc.write_archives(df, plain_at, compression="none")
    found = warc.read_archives(spark, plain_at).collect()
    for r in found:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            raw = f.read(r.length)
        (one,) = warc.parse(raw)
        assert (one["record_id"], one["payload"], one["offset"]) == (r.record_id, r.payload, 0)
        head = dict(x.split(": ", 1) for x in raw.decode().split("\r\n\r\n")[0].split("\r\n")[1:])
        if r.record_type == "revisit":
            assert head["WARC-Refers-To"] in {x.record_id for x in found if x.page_id == r.refers_to}


def test_one_repeated_page_is_dealt_out(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, 7, id) as page_id", "'u' as url", "if(id < 2900, repeat('z', 150), cast(id as string)) as html")
    full = warc.dealt_pages(df)
    sizes = [r["count"] for r in full.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and full.where("refers_to is not null").count() == 900
    at = common.scratch(spark, "test")
    warc.write_archives(df, at)
    found = warc.read_archives(spark, at)
    assert found.select("record_id").distinct().count() == 3000 and found.where("record_type = 'revisit'").select("refers_to").distinct().collect() == [(7,)]


def test_payloads_move_once(spark, tiny):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.dealt_pages(common.read(spark, tiny, "pages"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    moves = [x for x in re.split(r"\n\n", plan) if re.search(r"^\(\d+\) Exchange", x, re.M) and "payload#" in x]
    sorts = [x for x in re.split(r"\n\n", plan) if re.search(r"^\(\d+\) Sort\b", x, re.M) and "payload#" in x]
    assert len(moves) == 1 and not sorts, plan
