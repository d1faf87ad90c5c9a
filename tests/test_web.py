"""Web sources and region checks against stated cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import search
from bidloom.operators import families, region, web
from tests.test_functions import values


def test_prices_and_aliases(spark):
    texts = [("单价：12.5元 ¥12.5 ￥ 80 报价 2万元",), ("市场价: 0.01 ¥9000000",), ("12元",), ("",), (None,)]
    got = values(spark, lambda t: F.transform(web.visible_prices(t), lambda x: x["price"]), texts, "t string")
    assert got == [[12.5, 20000.0, 80.0], [], [], [], []]
    many = " ".join(f"¥{i}" for i in range(1, 9))
    assert values(spark, lambda t: F.transform(web.visible_prices(t), lambda x: x["shown"]), [(many,)], "t string") == [["¥1", "¥2", "¥3", "¥4", "¥5"]]
    clues = values(spark, web.alias_clues, [("单向阀", "止回单阀 价格", "单向阀 单向阀门 法兰"), ("单向阀", None, None), (None, "x", "y")], "n string, t string, b string")
    assert clues == [["止回单阀", "单向阀门"], [], []]


def test_pages_that_are_no_source(spark):
    pages = [("<title>百度安全验证</title>验证码",), ("CAPTCHA wappass",), ("captcha",), ("安全验证",), (None,)]
    assert values(spark, web.captcha, pages, "h string") == [True, True, False, False, False]
    asks = [(0, 3, False, True), (3, 3, False, True), (0, 0, False, True), (1, None, False, True), (0, 3, True, True), (0, 3, False, False)]
    assert values(spark, web.wants_fallback, asks, "n int, k int, done boolean, on boolean") == [True, False, True, False, False, False]


def test_source_kinds(spark):
    rows = [
        (1, "截止阀", "DN50", "截止阀 DN50", "规格 DN50 单价：88元", "high", "", ""),
        (2, "截止阀", "DN50", "截止阀 DN50", "规格 DN50 面议", "high", "13800000000", ""),
        (3, "截止阀", "DN50", "截止阀 DN80", "规格型号：DN80 单价：88元", "high", "13800000000", ""),
        (4, "截止阀", "DN50", "截止阀 DN50", "规格 DN50 单价：88元", "block", "", ""),
        (5, "截止阀", "DN50", "水泵", "单价：88元", "high", "13800000000", ""),
        (6, "截止阀", "DN50", None, None, "high", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, name string, spec string, title string, body string, quality string, phone string, contact string")
    out = web.source_kinds(df.withColumn("supplier", F.lit("")))
    assert set(df.columns) <= set(out.columns)
    got = {r.id: r.kind for r in out.collect()}
    assert got == {1: "web_reference", 2: "supplier_lead", 3: "reject", 4: "reject", 5: "reject", 6: "reject"}
    assert web.source_kinds(df.withColumn("supplier", F.lit("")).limit(0)).count() == 0


def test_categories_and_gray_names(spark):
    pairs = [("法兰 DN50", "止回阀"), ("闸阀", "球阀"), ("水泵", "未知"), (None, "水泵"), ("电 缆", "钢管")]
    assert values(spark, web.category_conflict, pairs, "a string, b string") == [True, False, False, False, True]
    pairs = [("不锈钢管", "薄壁不锈钢管"), ("水泵", "油泵"), ("镀锌线槽", "镀锌桥架"), ("sensor abc", "abc 1"), ("", "x"), (None, None)]
    assert values(spark, web.gray_name, pairs, "a string, b string") == [True, False, True, False, False, False]


def test_regions(spark):
    texts = [("报价地区：成都市，发货地: 杭州",), ("交货地 重庆市；",), ("厂家所在地：北京",), ("",), (None,)]
    got = [tuple(x) for x in values(spark, region.hints, texts, "t string")]
    assert got == [("成都市", "杭州"), ("重庆市", ""), ("", "北京"), ("", ""), ("", "")]
    rows = [
        ("", "成都市", "四川省", "四川 成都", True), ("", "成都市", "四川省", "四川 绵阳", True), ("", "成都市", "四川省", "北京", False),
        ("", "成都市", "四川省", "", True), ("", "成都市", "四川省", None, False), (None, None, None, "北京", True), ("重庆", "", "", "重庆市", False),
    ]
    got = [tuple(x) for x in values(spark, region.verified, rows, "l string, c string, p string, a string, e boolean")]
    assert got == [(True, "exact"), (True, "province"), (False, "mismatch"), (False, "unknown"), (True, "unknown"), (True, "unknown"), (True, "exact")]


def test_aliases(spark):
    rows = [("单向阀", 1), ("止回阀", 1), ("止回阀", 1), ("逆止阀", 1), ("水泵", 2), (None, 2)]
    got = {r.name: r.aliases for r in families.aliases(spark.createDataFrame(rows, "name string, cluster int"), 1).collect()}
    assert got == {"单向阀": ["止回阀"], "止回阀": ["单向阀"], "逆止阀": ["单向阀"], "水泵": []}
    cases = [
        (["单向阀 DN100"], "单向阀 DN100", ["止回阀", "逆止阀", "x"]), (["止回阀 DN100"], "DN100", ["止回阀"]), ([], "a", ["b"]), (["q"], None, None), (None, "a", ["b"]),
        (["a"], "DN50", ["长" * 40]),
    ]
    got = values(spark, search.with_aliases, cases, "q array<string>, n string, a array<string>")
    assert got == [["单向阀 DN100", "止回阀 DN100", "逆止阀 DN100"], ["止回阀 DN100"], [], ["q"], None, ["a", "长" * 40]]
