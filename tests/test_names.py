from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import names as N
from bidloom.sources import pages
from bidloom.operators import decisions as D
from bidloom.operators import region as R
from tests.test_functions import values


def test_places_go_but_markets_stay(spark):
    rows = [("成都 薄壁不锈钢管",), ("成都市信息价 球阀",), ("广西壮族自治区 管件",), ("市场价格表",), ("镀 锌 钢 管",), (None,), ("成都",)]
    assert values(spark, N.without_places, rows, "t string") == ["薄壁不锈钢管", "球阀", "管件", "格表", "镀锌钢管", "", ""]


def test_keys_of_names_and_titles(spark):
    rows = [("单向阀 DN100",), ("LED 线型灯(含支架)",), ("DN100",), (None,), ("型号 x",)]
    assert values(spark, N.name_key, rows, "t string") == ["单向阀", "线型灯", "", "", ""]
    assert values(spark, N.title_key, rows, "t string") == ["单向阀", "线型灯", "dn100", "", "型号x"]


def test_size_aliases(spark):
    rows = [("圆钢 直径(mm)：12 牌号：Q235B", None), ("阀 DN50", None), ("阀", "φ20"), ("阀", None), (None, None)]
    got = values(spark, N.with_size_aliases, rows, "a string, b string")
    assert got == ["圆钢 直径(mm)：12 牌号：Q235B φ12 DN12 直径12 12mm Q235B", "阀 DN50 φ50 DN50 直径50 直径(mm)：50 50mm", "阀 φ20 DN20 直径20 直径(mm)：20 20mm", "阀", ""]


def test_predicates_on_nulls_and_numbers(spark):
    for f in (N.electrical, N.bore_or_pressure, N.attribute_chain, N.measurement, N.bore):
        assert values(spark, f, [(None,), ("",)], "t string") == [False, False], f
    assert values(spark, N.bore, [("DN 50",), ("φ12",), ("1250x400",)], "t string") == [True, True, False]
    assert values(spark, lambda c: N.unit_values(c, "W"), [("9W 12.5 W x3W 7Wh",)], "t string") == [[9.0, 12.5]]
    assert values(spark, N.query_anchors, [("球阀 DN 50", "DS-2CD3T46 1250 x 400 220V")], "a string, b string") == [["DN50", "DS-2CD3T46", "1250x400"]]


def test_regions_and_runs(spark):
    fields = [("四川省", "成都市", "", "", "", ""), ("四川省", None, None, "510000", None, None), (None,) * 6]
    assert values(spark, N.region_key, fields, "a string, b string, c string, d string, e string, f string") == ["四川省|成都市", "510000", "UNSPECIFIED"]
    assert values(spark, N.region_display, [("四川省", "成都市", None), (None, None, None)], "a string, b string, c string") == ["四川省成都市", "未指定"]
    assert values(spark, N.region_specified, [("", None), ("", "510100")], "a string, b string") == [False, True]
    run = spark.range(1).select(N.run_id(F.lit("2024-05-06 07:08:09").cast("timestamp"), F.lit("s"))).first()[0]
    assert run.startswith("run-20240506-070809-") and len(run) == 28
    got = values(spark, R.parse_region, [("成都市武侯区",), ("不限地区",), ("宁夏回族自治区",), ("x" * 30,)], "t string")
    assert [(r.city_code, r.province, r.city) for r in got] == [("510100", "四川省", "成都市"), ("NATIONAL", "全国", ""), ("", "宁夏回族自治区", ""), ("", "", "x" * 20)]


def test_payload_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "x string, y int")
    keys = [r[0] for r in rows.select(N.payload_key(F.struct("x", "y"))).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 28


def test_decisions(spark):
    pairs = [("单向阀", "单向阀 DN50", 1), ("单向阀", "止回阀", 2), ("单向阀", "球阀", 3), ("单向阀", "蝶阀门", 4), (None, "x", 5), ("单向阀", "止回阀", 6), ("闸阀门", "蝶阀板", 7)]
    df = spark.createDataFrame(pairs, "name string, title string, decision int")
    yes = spark.createDataFrame([("止回阀", "单向阀"), ("球阀", "单向阀")], "a string, b string")
    no = spark.createDataFrame([("单向阀", "球阀")], "a string, b string")
    own = df.withColumnRenamed("decision", "n")
    cache = own.where("n = 7").select(N.pair_key(F.col("name"), F.col("title")).alias("pair_key"), F.lit("same").alias("decision"))
    got = {r.n: (r.decision, r.source) for r in D.decide(own, yes, no, cache).collect()}
    assert got == {1: ("same", "rule"), 2: ("same", "local_alias"), 3: ("different", "local_negative"), 4: ("unknown", ""), 5: ("unknown", ""), 6: ("same", "local_alias"), 7: ("same", "cache")}
    assert D.remembered(D.decide(own, yes, no)).count() == 3
    assert values(spark, D.allows_quote, [("same",), (" SAME ",), ("possible",), (None,)], "d string") == [True, True, False, False]
    assert values(spark, D.allows_spec, [("same",), ("different",), (None,)], "d string") == [True, False, True]
    assert values(spark, D.only_semantic, [(["品名：x1"],), (["电压 220"],), (["颜色"],), (None,)], "m array<string>") == [True, False, True, True]
    assert values(spark, D.hard_conflicts, [(["名称未命中"],), (["型号不符"],), (["其它冲突"],), ([],)], "m array<string>") == [False, True, True, False]


# Token; electrical; bore or pressure; chain of both; measurement.
TOKENS = (
    ("AC220V", 1, 0, 0, 1), ("400W/m", 1, 0, 0, 1), ("IP68", 1, 0, 0, 1), ("3500K", 1, 0, 0, 1), ("DN100", 0, 1, 0, 0), ("PN1.6", 0, 1, 0, 0), ("400W/AC220V/IP68", 0, 0, 1, 0),
    ("DN100/PN16", 0, 0, 1, 0), ("DS-2CD", 0, 0, 0, 0), ("XG1/24V", 0, 0, 0, 0), ("10A", 1, 0, 0, 0), (None, 0, 0, 0, 0),
)
ADDRESSES = (
    ("https://www.baidu.com/s?wd=1", "block"), ("https://zhidao.baidu.com/q", "block"), ("https://a.com/login?x=1", "block"), ("https://passport.a.com/", "block"),
    ("https://seo.example.com/p", "low"), ("https://www.ccgp-sichuan.gov.cn/seo", "high"), ("http://b2b.hc360.com/x", "high"), ("https://shop.example.com/p?login", "medium"),
    ("http://example.org/", "low"), ("not an address", "block"),
)
PRICES = (("¥ 12 . 5 起 ¥30 ¥30", [12.5, 30.0]), ("约 18.5元 或 20 元/台", [18.5, 20.0]), ("￥0.01 ￥99", [99.0]), ("无价 2024年", []), ("", []), (None, []))


def test_kinds_of_tokens(spark):
    df = spark.createDataFrame([(t[0],) for t in TOKENS], "t string")
    got = df.select(*[f(df.t).cast("int") for f in (N.electrical, N.bore_or_pressure, N.attribute_chain, N.measurement)]).collect()
    assert [tuple(r) for r in got] == [t[1:] for t in TOKENS]


def test_quality_of_addresses(spark):
    df = spark.createDataFrame([(a,) for a, _ in ADDRESSES], "a string")
    assert [r[0] for r in df.select(pages.quality(df.a)).collect()] == [q for _, q in ADDRESSES]


def test_numbers_of_prices(spark):
    df = spark.createDataFrame([(a,) for a, _ in PRICES], "a string")
    assert [r[0] for r in df.select(N.price_numbers(df.a)).collect()] == [q for _, q in PRICES]
