"""Region gate: how a price's region relates to the item's, and what that lets a quote be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cities that texts name, with their province and the codes of both; the first that a text holds counts.
PLACES = (
    ("北京", "北京市", "110000", "110100"),
    ("上海", "上海市", "310000", "310100"),
    ("天津", "天津市", "120000", "120100"),
    ("重庆", "重庆市", "500000", "500100"),
    ("成都", "四川省", "510000", "510100"),
    ("广州", "广东省", "440000", "440100"),
    ("深圳", "广东省", "440000", "440300"),
    ("杭州", "浙江省", "330000", "330100"),
    ("南京", "江苏省", "320000", "320100"),
    ("武汉", "湖北省", "420000", "420100"),
    ("西安", "陕西省", "610000", "610100"),
    ("苏州", "江苏省", "320000", "320500"),
    ("郑州", "河南省", "410000", "410100"),
    ("长沙", "湖南省", "430000", "430100"),
    ("青岛", "山东省", "370000", "370200"),
    ("大连", "辽宁省", "210000", "210200"),
    ("厦门", "福建省", "350000", "350200"),
    ("昆明", "云南省", "530000", "530100"),
    ("贵阳", "贵州省", "520000", "520100"),
    ("南宁", "广西壮族自治区", "450000", "450100"),
    ("合肥", "安徽省", "340000", "340100"),
    ("福州", "福建省", "350000", "350100"),
    ("济南", "山东省", "370000", "370100"),
    ("沈阳", "辽宁省", "210000", "210100"),
    ("哈尔滨", "黑龙江省", "230000", "230100"),
    ("长春", "吉林省", "220000", "220100"),
    ("石家庄", "河北省", "130000", "130100"),
    ("太原", "山西省", "140000", "140100"),
    ("南昌", "江西省", "360000", "360100"),
    ("海口", "海南省", "460000", "460100"),
    ("兰州", "甘肃省", "620000", "620100"),
    ("乌鲁木齐", "新疆维吾尔自治区", "650000", "650100"),
)
NATIONAL = "全国|不限地区|通用价"


def normal_place(place: Column) -> Column:
    """A place name without its administrative ending."""
    return F.regexp_replace(F.trim(F.coalesce(place, F.lit(""))), "(?:特别行政区|省|市|区|县)", "")


def parse_region(text: Column) -> Column:
    """``struct(province, province_code, city, city_code, strategy)`` named by a free text.

    The whole country, else a known city, else a province or autonomous region, else a city by its ending, else the text
    itself, cut to 20 characters, as a city. Nothing is named by an empty text.
    """
    t = F.trim(F.coalesce(text, F.lit("")))

    def made(province: Column | str, province_code: str, city: Column | str, city_code: str, strategy: str = "strict_city") -> Column:
        own = {"province": province, "province_code": province_code, "city": city, "city_code": city_code, "strategy": strategy}
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in own.items()])

    province = F.regexp_extract(t, "([一-鿿]{2,8}(?:省|自治区))", 1)
    city = F.regexp_extract(t, "([一-鿿]{2,8}市)", 1)
    out = (
        F.when(province != "", made(province, "", "", "")).when(city != "", made("", "", city, "")).otherwise(made("", "", F.substring(t, 1, 20), ""))
    )
    for name, home, home_code, code in reversed(PLACES):
        out = F.when(F.contains(t, F.lit(name)), made(home, home_code, f"{name}市", code)).otherwise(out)
    national = made("全国", "NATIONAL", "", "NATIONAL", "national_reference")
    return F.when(t == "", made("", "", "", "")).when(t.rlike(NATIONAL), national).otherwise(out)


def classify(province: Column, city: Column, price_province: Column, price_city: Column) -> Column:
    """exact, province, national, conflict or unknown; the supplier's own place never decides."""
    p, c = normal_place(price_province), normal_place(price_city)
    tp, tc = normal_place(province), normal_place(city)
    return (
        F.when((p == "") & (c == ""), "unknown")
        .when(p == "全国", "national")
        .when((tc != "") & (c == tc), "exact")
        .when((c == "") & (p != "") & (p == tp), "province")
        .when((tp != "") & (p == tp), F.when(tc == "", "exact").otherwise("province"))
        .otherwise("conflict")
    )


def decide(match: Column, specified: Column, required: Column, allow_province: Column) -> Column:
    """allow_formal, review, market_ref, reject or passthrough."""
    return (
        F.when(~specified & ~required, "passthrough")
        .when(match == "exact", "allow_formal")
        .when(match == "province", F.when(allow_province, "allow_formal").otherwise("review"))
        .when(match == "national", "market_ref")
        .when(match == "conflict", "reject")
        .otherwise(F.when(required, "review").otherwise("passthrough"))
    )


def apply_to_bucket(bucket: Column, gate: Column) -> Column:
    """The bucket after the gate; a review gate also brings back what was discarded."""
    return (
        F.when(gate == "reject", "discard")
        .when((gate == "market_ref") & (bucket == "formal"), "market_ref")
        .when((gate == "review") & bucket.isin("formal", "discard"), "candidate")
        .otherwise(bucket)
    )


def hints(text: Column) -> Column:
    """``struct(source_price_region, supplier_region)`` that labels of a text name; one never stands for the other."""
    t = F.coalesce(text, F.lit(""))
    first = lambda labels: F.trim(F.regexp_extract(t, rf"(?U)(?:{labels})\s*[:：]?\s*([^\n，,；;]{{2,20}})", 1))
    price = F.coalesce(F.nullif(first("价格适用|适用地区|报价地区|地区价格|价格地区"), F.lit("")), first("交货地|到货地|收货城市"))
    return F.struct(price.alias("source_price_region"), first("厂家所在地|供应商所在地|所在地区|发货地|商所在地").alias("supplier_region"))


def verified(label: Column, city: Column, province: Column, actual: Column, exact: Column) -> Column:
    """``struct(ok, match)``: whether the region that a page shows (``actual``, all its words) is the one that was asked for.

    A region that is not asked for or cannot be read is ``unknown``; it passes unless ``exact`` asks for a readable one.
    """
    bare = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[省市]", ""))
    shown, asked = bare(actual), F.concat(*[F.coalesce(c, F.lit("")) for c in (label, city, province)])
    within = lambda c: (bare(c) != "") & F.contains(shown, bare(c))
    result = lambda ok, match: F.struct(ok.alias("ok"), F.lit(match).alias("match"))
    return (
        F.when(asked == "", result(F.lit(True), "unknown"))
        .when(F.trim(F.coalesce(actual, F.lit(""))) == "", result(~exact, "unknown"))
        .when(within(city) | within(label), result(F.lit(True), "exact"))
        .when(within(province), result(F.lit(True), "province"))
        .otherwise(result(F.lit(False), "mismatch"))
    )
