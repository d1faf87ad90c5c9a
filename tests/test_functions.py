"""Scalars, gates and families against stated cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import price as P
from bidloom.functions import text as T
from bidloom.operators import buckets, families, region
from bidloom.sources import pages


def values(spark, make, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r.x for r in df.select(make(*[F.col(c) for c in df.columns]).alias("x")).collect()]


def test_text(spark):
    assert values(spark, T.collapse_cjk_spaces, [("薄 壁 不锈钢管 DN100",), ("a　 b\n管 道",), (None,)], "t string") == ["薄壁不锈钢管 DN100", "a b 管道", ""]
    pairs = [("地埋灯", "埋地灯"), ("地 埋 灯", "埋地灯"), ("冷却塔", "塔吊"), ("阀门", "法兰"), ("热镀锌钢管", "镀锌钢管"), (None, "x")]
    assert values(spark, T.soft_same_product, pairs, "a string, b string") == [True, True, False, False, True, False]
    asked = ["DN100 DN100", "安全信号阀 DN150 DN150", "UQK-12液位计 UQK-12", "UQK-12 UQK-12液位计", None]
    assert values(spark, T.normal_query, [(q,) for q in asked], "q string") == ["DN100", "安全信号阀 DN150", "UQK-12液位计", "UQK-12液位计", ""]
    units = [("m", "米"), ("m", "套"), ("节", "台"), ("节", "个"), ("台", "套"), ("kg", "吨"), ("", "m"), (None, "m")]
    assert values(spark, T.unit_compatible, units, "a string, b string") == [True, False, True, True, True, True, None, None]
    assert values(spark, T.norm, [("A × B　Φ12",)], "t string") == ["axbφ12"]
    assert values(spark, T.tokens, [("DS-2CD3 摄像机 DN 100 AC220V 规格 ds-2cd3",)], "t string") == [["DS-2CD3", "DN100", "220V", "AC220V", "摄像机"]]
    assert values(spark, lambda t: T.title_score(t, F.array(F.lit("薄壁不锈钢管"))), [("不锈钢管 DN100",), ("阀",)], "t string") == [1, 0]
    assert values(spark, T.number_text, [("12.0",), ("1.50",), ("100",), ("0.05",)], "t string") == ["12", "1.5", "100", "0.05"]


def test_price(spark):
    assert values(spark, P.valid_price, [(None,), (0.0,), (0.01,), (-1000.0,), (128.5,), (float("nan"),)], "p double") == [False, False, False, False, True, False]
    assert values(spark, P.parse_price, [("-1000",), ("1,143.17元",), ("0.01",), ("none",), (None,)], "t string") == [1000.0, 1143.17, None, None, None]
    assert values(spark, P.lenient_number, [("¥ -1,200.5",), ("x",)], "t string") == [-1200.5, None]
    ex = lambda p, m, f: F.round(P.ex_tax(p, m, f), 9)
    assert values(spark, ex, [(113.0, "tax_incl", "jd"), (113.0, "tax_excl", "jd"), (113.0, "unknown", "yize"), (113.0, None, "jd"), (0.05, "tax_excl", "jd")], "p double, m string, f string") == [100.0, 113.0, 113.0, 100.0, None]
    assert values(spark, P.under_submit, [(100.0, 120.0), (100.0, 80.0), (100.0, 95.0), (None, 95.0)], "e double, s double") == ["under", "over", "near", "unknown"]
    assert values(spark, P.vs_submit, [(100.0, 100.0), (105.0, 100.0), (150.0, 100.0), (20.0, 100.0), (20.0, None), (20.0, 0.0)], "e double, s double") == ["below_submit", "near_submit", "above_submit", "suspicious_low", "unknown", "unknown"]
    assert values(spark, P.r2, [(1.005,), (2.675,)], "v double") == [1.01, 2.68]
    shown = ["noTaxPrice:-1000 taxPrice:-1000 查看价格", "市场价： ￥1143.17 建议价： ￥1143.17", "刚性系杆 XG1 Q235B圆钢管89×2.5 市场价 查看价格"]
    assert values(spark, pages.visible_price, [(t,) for t in shown], "t string") == [None, 1143.17, None]


def test_region(spark):
    rows = [("四川", "成都", "重庆", "重庆"), ("四川", "成都", "四川省", ""), ("四川", "成都", "四川省", "成都市"), ("四川", "成都", "全国", ""), ("四川", "成都", None, None), ("四川", "成都", "四川", "绵阳")]
    assert values(spark, region.classify, rows, "a string, b string, c string, d string") == ["conflict", "province", "exact", "national", "unknown", "province"]
    parsed = values(spark, region.parse_region, [("成都市价格",), ("全国统一价",), ("湖北省宜昌市",), (None,)], "t string")
    assert [(r.province, r.city) for r in parsed] == [("四川省", "成都市"), ("全国", ""), ("湖北省", ""), ("", "")]
    gates = [("exact", True, True, False), ("province", True, False, False), ("province", True, False, True), ("national", True, False, False), ("conflict", True, False, False), ("unknown", True, True, False), ("unknown", True, False, False), ("exact", False, False, False)]
    assert values(spark, region.decide, gates, "m string, s boolean, r boolean, p boolean") == ["allow_formal", "review", "allow_formal", "market_ref", "reject", "review", "passthrough", "passthrough"]
    assert values(spark, region.apply_to_bucket, [("discard", "review"), ("formal", "review"), ("formal", "market_ref"), ("formal", "reject"), ("candidate", "market_ref")], "b string, g string") == ["candidate", "candidate", "market_ref", "discard", "candidate"]


def test_conflicts_and_aliases(spark):
    assert values(spark, buckets.hard_conflict, [(["功率 9W，页面为 6W"],), (["名称未命中"],), (None,)], "c array<string>") == [True, False, False]
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("x", "x")], "name_a string, name_b string")
    pos = spark.createDataFrame([("b", "a"), ("c", "d")], "a string, b string")
    neg = spark.createDataFrame([("d", "c")], "a string, b string")
    got = {(r.name_a, r.name_b): r.relation for r in families.lookup(p, pos, neg).collect()}
    assert got == {("a", "b"): "same", ("b", "a"): "same", ("c", "d"): "different", ("x", "x"): "same"}


def test_search(spark):
    from bidloom.functions import search as S

    def queries(build, name, spec, brand=""):
        return values(spark, lambda n, s, b: build(S.features(n, s, b)), [(name, spec, brand)], "n string, s string, b string")[0]

    got = queries(S.cost_site_queries, "薄壁不锈钢管", "DN150")
    assert got[0] == "薄壁不锈钢管" and "薄壁不锈钢管 DN150" in got and not any("DN150 DN150" in q for q in got)
    assert queries(S.cost_site_queries, "热镀锌钢管", "DN100")[-1] == "热镀锌管"
    assert queries(S.shop_queries, "室内机", "DS-KH6320-C1")[:2] == ["海康威视 DS-KH6320-C1", "DS-KH6320-C1"]
    assert queries(S.cost_site_queries, None, None, None) == []
    again = values(spark, lambda n, s: S.requeries(S.features(n, s, F.lit("")), F.array(F.lit("闸阀"), F.lit("阀门")), F.array(F.lit("规格冲突：DN 40"))), [("闸阀", "DN150 PN16")], "n string, s string")[0]
    assert any("DN150" in q for q in again) and not any("DN40" in q for q in again)
    assert values(spark, S.platform_budget, [(True,), (False,)], "s boolean") == [2, 3]
    assert values(spark, S.hard_tags, [("闸阀 φ100", "PN16 1250X400")], "n string, s string") == [["DN100", "PN16", "1250x400"]]
    assert values(spark, S.must_terms, [("网络摄像机", "DS-2CD3T46 防水")], "n string, s string") == [["DS-2CD3T46", "2CD3T46", "网络摄像机", "防水"]]
    r = values(spark, S.structured, [("球阀 DN100 PN16 304 220V 9 W 1250×400 XZP100",)], "t string")[0]
    assert (r.model, r.diameters, r.dimensions, r.material, r.pressure, r.voltage, r.power) == ("XZP100", ["DN100"], ["1250x400"], "304", "PN16", "220V", "9W")
