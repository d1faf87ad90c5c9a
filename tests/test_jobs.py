from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import search as S
from bidloom.operators import jobs as J
from tests.test_functions import values


def test_diagnoses_and_scopes(spark):
    st = spark.createDataFrame([(1, "full_k", 3, None), (2, "no_match", 0, None), (3, "error", 0, "broken"), (4, "no_match", 0, None)], "item_id int, status string, n_quotes int, error string")
    why = spark.createDataFrame([(1, ""), (2, "限流"), (3, "其它")], "item_id int, reason string")
    tries = spark.createDataFrame([(1,), (1,), (2,), (3,)], "item_id int")
    got = {r.item_id: (r.fail_reason, r.hint, r.n_attempts) for r in J.diagnoses(st, why, tries).collect()}
    assert got == {1: ("", "", 2), 2: ("限流", "限流", 1), 3: ("其它", "broken", 1), 4: ("平台没有结果", "未执行或无结果", 0)}
    items = spark.createDataFrame([("a",), ("a",), (None,), ("",), ("b",)], "sheet string")
    assert {r.sheet: r["count"] for r in J.sheet_counts(items).collect()} == {"a": 2, "(未命名)": 2, "b": 1}
    n = [J.selected_count(items, *x).first().selected for x in (("all",), ("first_n", 2), ("first_n", 99), ("first_n", 0), ("sheets", 0, ("a", "c")))]
    assert n == [5, 2, 5, 5, 2]


def test_counters_and_usage(spark):
    ev = spark.createDataFrame([("k", "query_count", 2.0), ("k", "search_ms", 1.23456), ("j", "query_count", 1.0), ("j", "no such", 5.0)], "key string, field string, n double")
    got = {r.key: (r.query_count, r.search_ms, r.rejected) for r in J.counters(ev).collect()}
    assert got == {"k": (2, 1.235, 0), "j": (1, 0.0, 0), None: (3, 1.235, 0)}
    calls = spark.createDataFrame([("x", True, 3, 4, None), ("x", False, None, None, 9)], "role string, ok boolean, prompt int, completion int, total int")
    assert J.usage_by_role(calls).first()[1:] == (2, 1, 3, 4, 16)


def test_history(spark):
    h = spark.createDataFrame([("j1", 1, "old"), ("j1", 2, "new"), ("j2", 1, "x")], "id string, ts int, note string")
    assert [r.note for r in J.job(h, " j1 ").collect()] == ["new"] and J.job(h, "no").count() == J.job(h, "").count() == 0
    assert values(spark, J.rich_sources, [('{"web_list":[1]}',), ('{"web_list":[]}',), ("{}",), (None,)], "r string") == [True, False, False, False]
    rows = [("run-20240101-abc123", "evidence-20240101.json"), ("run-1", "evidence.json"), ("run-1", "x-run-1.json"), ("", "a.json"), (None, None)]
    assert values(spark, J.own_evidence, rows, "a string, b string") == [True, False, True, False, False]


def test_confirmed_names(spark, tmp_path):
    pairs = lambda *x: spark.createDataFrame(list(x), "a string, b string")
    yes, no = J.confirm(pairs(("止回阀", "单向阀")), pairs(("球阀", "蝶阀")), pairs(("蝶阀", "球阀 DN50"), ("", "x"), ("闸阀", "闸阀 DN1")), pairs(("单向阀", "止回阀"), ("泵", "灯")))
    assert [tuple(r) for r in yes.collect()] == [("蝶阀", "球阀 DN50")] and [tuple(r) for r in no.collect()] == [("单向阀", "止回阀"), ("泵", "灯")] or sorted(map(tuple, no.collect())) == sorted([("单向阀", "止回阀"), ("泵", "灯")])
    J.save_store(yes, no, str(tmp_path / "s"))
    assert [sorted(map(tuple, x.collect())) for x in J.load_store(spark, str(tmp_path / "s"))] == [sorted(map(tuple, x.collect())) for x in (yes, no)]
    yes, no = J.confirm(yes, no)
    assert yes.count() == 1 and no.count() == 2


def test_candidate_records(spark):
    rows = [("阀 发货地：成都", "", ""), ("阀 适用地区：成都 发货地：绵阳", "", None), ("阀", "重庆", "上海")]
    df = spark.createDataFrame(rows, "title string, source_price_region string, supplier_region string")
    got = [(r.source_price_region, r.supplier_region, r.requested_region) for r in J.records(df, F.lit("成都市")).collect()]
    assert got[0] == ("", "成都", "成都市") and got[2] == ("重庆", "上海", "成都市") and got[1][0].startswith("成都")
    assert values(spark, J.ship_only, [("发货地：成都",), ("报价地区：成都 发货地：x",), (None,)], "t string") == [True, False, False]
    assert values(spark, J.recovered_price, [(5.0, "市场价：￥9"), (0.01, "市场价：￥9"), (-1000.0, "查看价格")], "p double, t string") == [5.0, 9.0, None]


def test_ranks_markets_families_and_platforms(spark):
    ranked = [(1, r, s, f) for r, s, f in ((1, 90.0, "over"), (2, 85.0, "near"), (3, 80.0, "over"), (4, 0.0, "over"))]
    ranked += [(2, r, 80.0, f) for r, f in ((1, "over"), (2, "under"), (3, "over"), (4, "over"))] + [(3, 1, 80.0, "over")] + [(4, r, 20.0 * r, "over") for r in (1, 2, 3, 4)]
    df = spark.createDataFrame(ranked, "item_id int, rank int, score double, flag string")
    assert {r.item_id: r.needed for r in J.needs_review_of_rank(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    m = spark.createDataFrame([(1, "u"), (1, "v"), (2, "u")], "item_id int, url string")
    assert sorted(map(tuple, J.unlisted(m, m.where("item_id = 1 and url = 'u'")).collect())) == [(1, "v"), (2, "u")]
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_id int, name string")
    fam = spark.createDataFrame([("a", 2)], "family_key string, members int")
    assert {r.item_id: r.members for r in J.with_family(items, fam, F.col("name")).collect()} == {1: 2, 2: None}
    assert [tuple(x) for x in values(spark, J.capability, [("京东",), ("易择网",), ("x",), (None,)], "p string")] == [(True, "province,city,district"), (False, "city"), (False, ""), (False, "")]
    rows = [("领材", "四川省", "成都市", None, "510000", "510100"), ("jd", None, None, None, None, None)]
    assert [tuple(x) for x in values(spark, J.platform_region, rows, "a string, b string, c string, d string, e string, f string")] == [("lingcai", "四川省成都市", "510100"), ("jd", "", "")]


def test_queries_of_families_and_the_web(spark):
    rows = [("球 阀 DN50", "球阀", "DN50 PN16"), ("球阀", "球阀", ""), ("DN50", "阀", "DN50")]
    assert values(spark, S.family_queries, rows, "a string, b string, c string") == [["球阀", "球阀 DN50"], ["球阀"], ["DN50"]]
    web = [("闸阀（铸铁）", "DN50 PN16", ["闸门阀"]), ("LED灯", "220V", None)]
    got = values(spark, S.web_queries, web, "a string, b string, c array<string>")
    assert got[0] == ["闸阀 DN50 PN16", "闸门阀 DN50 PN16"] and got[1][0] == "LED灯 220V"
    rows = [(["球阀", "球阀 DS-999X", "闸阀 DN50", "x"], "球阀", "DN50", ["闸阀 DN50"]), (None, None, None, None)]
    assert values(spark, S.sound_queries, rows, "a array<string>, b string, c string, d array<string>") == [["球阀 DN50"], []]
