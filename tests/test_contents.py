from __future__ import annotations

from pyspark.sql import functions as F

from bidloom import shared
from bidloom.functions import search
from bidloom.plans import jobs, links, reports, responses, runs


def test_equal_contents_are_worked_out_once(spark):
    rows = [(i, "a" if i < 500 else None if i < 700 else f"b{i}", i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string, odd int")
    seen = []

    def work(contents):
        seen.append(contents.count())
        return contents.withColumn("said", F.concat_ws("/", F.coalesce("text", F.lit("null")), "odd"))

    got = shared.by_content(df, ["text", "odd"], work)
    assert got.columns == ["id", "text", "odd", "said"] and seen == [304]
    assert sorted(tuple(r) for r in got.collect()) == [(i, t, o, f"{'null' if t is None else t}/{o}") for i, t, o in rows]
    assert shared.by_content(df.where("false"), ["text", "odd"], work).collect() == []


def _formulas(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_search_rows_reads_each_content_once(spark):
    items = spark.createDataFrame([(i, "闸阀", "DN100", "甲" if i % 2 else None) for i in range(50)], "item_id long, name string, spec string, brand string")
    platforms = spark.createDataFrame([("yize", False), ("jd", True)], "platform string, shop boolean")
    found = search.search_rows(items, platforms)
    assert "regexp_extract_all" not in _formulas(found)  # worked out before, in a written table of contents
    assert found.select("item_id").distinct().count() == 50


def test_sound_queries_are_made_once_a_specification(spark, tiny):
    assert "regexp_extract_all" not in _formulas(jobs.sound_queries(spark, tiny))


def test_required_words_are_made_once_an_item(spark, tiny):
    assert "regexp_extract_all" not in _formulas(runs.must_words(spark, tiny))


def test_the_gate_judges_each_content_once(spark, tiny):
    assert "regexp_extract_all" not in _formulas(reports.match_gate(spark, tiny))


def test_the_gate_of_links_judges_each_content_once(spark, tiny):
    assert "regexp_extract_all" not in _formulas(links.offer_links(spark, tiny))


def test_list_pages_are_dealt_out(spark, tiny):
    assert responses._pages(spark, tiny).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
