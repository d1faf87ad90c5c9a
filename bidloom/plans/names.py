"""Registered queries over names, keys, decisions, schemas and workbooks, each with its SQL.

Inputs are put together from columns of the tables, case by case; the SQL knows what each case must give.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions import names as N
from bidloom.functions import price as P
from bidloom.operators import decisions as D
from bidloom.operators import quotes as Q
from bidloom.operators import region as R
from bidloom.operators import views as V
from bidloom.plans import quotes as PQ
from bidloom.sources import pages as G
from bidloom.sources import schema as S
from bidloom.sources import workbook as W


def _of(values: tuple, at: Column) -> Column:
    """The value of a case."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _pick(values: tuple, at: str, as_: str) -> str:
    return f"{_list(values)}[{at} % {len(values)} + 1] AS {as_}"


# name; without places; as material; key; without hard specifications
NAMES = (
    ("成都 薄壁不锈钢管", "薄壁不锈钢管", "薄壁不锈钢管", "薄壁不锈钢管", "成都 薄壁不锈钢管"), ("四川省 单向阀 DN100", "单向阀 DN100", "单向阀 DN100", "单向阀", "四川省 单向阀"),
    ("LED线型灯 24V", "LED线型灯 24V", "LED线型灯 24V", "线型灯", "LED线型灯"), ("信息价 球阀（含垫片）", "球阀（含垫片）", "球阀（含垫片）", "球阀", "信息价 球阀 含垫片"),
    ("消声器 1250X400", "消声器 1250X400", "消声器", "消声器1250", "消声器"), ("进口 摄像机 DS-2CD3T46", "进口摄像机 DS-2CD3T46", "进口摄像机 DS-2CD3T46", "摄像机ds-2cd3", "进口 摄像机"),
)


def material_names(spark, d):
    raw = _of(tuple(x[0] for x in NAMES), F.col("item_id"))
    return V.items(spark, d).select("item_id", N.without_places(raw).alias("bare"), N.material_name(raw).alias("material"), N.name_key(raw).alias("name_key"), N.without_hard_specs(raw).alias("shared"))


def token_kinds(spark, d):
    """Values made of the numbers of line items and parts with units and prefixes, alone, in chains and glued to words, and what kind each is."""
    k, q = F.col("l_orderkey") % 13, F.col("l_quantity").cast("int").cast("string")
    price = F.round("l_extendedprice", 1).cast("decimal(18,1)").cast("string")
    forms = [("", "V"), ("AC", "V"), ("dc ", " v"), ("", "W/m"), ("", " W / 米"), ("IP", ""), ("", "00K"), ("DN", "0"), ("φ ", "×2.5"), ("PN", ""), ("DN", "/PN16"), ("DS-", "CD"), ("", "A/AC220V")]
    token = F.concat(F.lit(forms[0][0]), q, F.lit(forms[0][1]))
    for i, (before, behind) in enumerate(forms):
        token = F.when(k == i, F.concat(F.lit(before), F.when(F.col("l_linenumber") % 3 == 0, price).otherwise(q), F.lit(behind))).otherwise(token)
    rows = V.read(spark, d, "lineitem").select(token.alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    c = F.col("token")
    return rows.select("token", "n", N.electrical(c).alias("electrical"), N.bore_or_pressure(c).alias("bore"), N.attribute_chain(c).alias("chain"), N.measurement(c).alias("measurement"))


SPELLINGS = ("京东", "ALI", "广材网", "瑞达恒", " Lingcai ", "易泽网", "zjt", "other", None)
PLATFORM_IDS = ("jd", "1688", "guangcai", "huixun", "lingcai", "yize", "zaojiatong", "other", "")
PLATFORM_DOMAINS = ("jd.com", "1688.com", "gldjc.com", "iccchina.com", "hylcw.cn", "easybii.com", "zjtcn.com", "other", "unknown")


def platform_ids(spark, d):
    s = V.read(spark, d, "supplier").select("s_suppkey", _of(SPELLINGS, F.col("s_suppkey")).alias("p"))
    return s.select("s_suppkey", N.platform_id(F.col("p")).alias("platform"), N.platform_domain(F.col("p")).alias("domain"))


def cache_keys(spark, d):
    i = V.items(spark, d)
    query = F.concat(F.upper("name"), F.lit("  DN50 dn50 "))
    pool = N.pool_key(F.lit(" JD "), F.when(F.col("item_id") % 2 == 0, "510100"), query, tax=F.lit("tax_incl"))
    region = N.region_key(F.lit("四川省"), F.when(F.col("item_id") % 3 == 0, "成都市"), F.lit(None).cast("string"), F.lit(""), F.when(F.col("item_id") % 3 == 1, "510100"), F.lit(None).cast("string"))
    return i.select("item_id", pool.alias("pool_key"), N.page_key(query).alias("page_key"), region.alias("region_key"), N.row_key(F.col("name"), F.col("spec")).alias("row_key"))


def addresses(spark, d):
    i = V.items(spark, d)
    link = F.concat(F.lit("http://www.baidu.com/link?url=https%3A%2F%2Fa.example.com%2F"), F.col("item_id").cast("string"))
    href = F.when(F.col("item_id") % 3 == 0, link).when(F.col("item_id") % 3 == 1, F.concat(F.lit("//b.example.com/"), F.col("item_id").cast("string"))).otherwise(F.lit(" /c "))
    query = F.concat(F.col("name"), F.lit(" 阀*"))
    return i.select("item_id", N.unwrapped(href).alias("address"), N.percent(query).alias("once"), N.percent_twice(query).alias("twice"), N.percent_gbk(F.lit("阀门 a")).alias("gbk"), N.list_address(F.lit("管 1")).alias("list"))


def price_numbers(spark, d):
    """The prices that a text with the price and the quantity of a line item tells, with and without currency marks, some too low or split by spaces."""
    k, price, q = F.col("l_orderkey") % 5, F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_quantity").cast("int").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("￥"), price, F.lit(" 或 "), q, F.lit(" 元"))).when(k == 1, F.concat(q, F.lit("元/台 共 "), price, F.lit(" 元，"), q, F.lit("元")))
        .when(k == 2, F.concat(F.lit("¥ "), F.regexp_replace(price, r"\.", " . "), F.lit(" ¥0.01"))).when(k == 3, F.concat(F.lit("¥99999999 ¥"), q)).otherwise(price)
    )
    rows = V.read(spark, d, "lineitem").select(F.array_join(F.transform(N.price_numbers(text), lambda x: x.cast("decimal(18,2)").cast("string")), "|").alias("prices"), k.alias("form"))
    return rows.groupBy("form", "prices").agg(F.count("*").alias("n"))


# Confirmed and denied names, and titles by item: alike by rule, confirmed, denied, unknown, blank.
TITLES = ("单向阀", "止回阀", "球阀", "蝶阀门", "")
SAME_NAMES, OTHER_NAMES = (("止回阀", "单向阀"),), (("单向阀", "球阀"), ("单向阀", "单向阀 DN1"))


def _decided(spark, d):
    n = F.col("item_id")
    pairs = V.items(spark, d).select("item_id", F.lit("单向阀").alias("name"), _of(TITLES, n).alias("title"), F.lit("DN50").alias("spec"), F.lit("").alias("spec_seen"), F.when(n % 2 == 0, "规格型号：DN50").otherwise("规格型号：DN80").alias("text"))
    return D.decide(pairs, spark.createDataFrame(SAME_NAMES, "a string, b string"), spark.createDataFrame(OTHER_NAMES, "a string, b string"))


def name_decisions(spark, d):
    return _decided(spark, d).select("item_id", "decision", "source")


def spec_after_name(spark, d):
    j = D.judged(_decided(spark, d).where(D.allows_quote(F.col("decision")) | ~D.allows_spec(F.col("decision"))))
    return j.select("item_id", "decision", "outcome", "ok", F.round("score", 4).alias("score"), "skip")


def name_memo(spark, d):
    return D.remembered(_decided(spark, d)).groupBy("decision").agg(F.count("*").alias("n"))


# header cells of a sheet; header row, roles by column
SHEETS = (
    (("序号", "材料设备名称", "规格型号", "计量单位", "数量", "报送单价", "备注"), "unknown,name,spec,unit,qty,submit_price,remark"),
    (("项目名称", "项目特征", "单位", "工程量", "综合单价", "合价", "金额"), "name,spec,unit,qty,submit_price,sum_price,sum_price"),
    (("编号", "规格", "单价", "审定单价", "品牌", "城市", ""), "unknown,spec,submit_price,audit_price,brand,region,name"),
    (("甲", "乙", "丙", "丁", "", "", ""), None),
)


def _sheets(spark, d):
    """Three rows a nation: a title, a header by case, and one line of data."""
    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    heads = F.element_at(F.array(*[F.array(*map(F.lit, h)) for h, _ in SHEETS]), (F.col("k") % len(SHEETS) + 1).cast("int"))
    lines = F.array(F.array(F.lit("某项目"), F.lit("")), heads, F.array(F.col("n_name"), F.lit("DN100"), F.lit("m"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("")))
    rows = n.select(F.concat(F.lit("f"), (F.col("k") % 5).cast("string")).alias("file"), F.concat(F.lit(" s"), F.col("k").cast("string")).alias("sheet"), (F.col("k") / 5 + 1).cast("int").alias("sheet_no"), F.posexplode(lines).alias("pos", "cells"))
    return rows.select("file", "sheet", (F.col("pos") * 2 + 1).alias("row"), "cells", "sheet_no")


def sheet_schemas(spark, d):
    s = S.sheet_schemas(_sheets(spark, d))
    return s.select("sheet", "header_row", "data_start_row", F.array_join(F.transform("columns", lambda c: c["role"]), ",").alias("roles"))


def schema_cache(spark, d):
    """Workbooks of known structure are not looked at again: the first three fill the cache."""
    rows = _sheets(spark, d)
    cache = S.detect(rows.where("file < 'f3'")).select("fingerprint", "sheets")
    return S.detect(rows, cache).select("file", "source", F.size("sheets").alias("n_sheets"), F.length("fingerprint").alias("digits"))


def inquiry_scores(spark, d):
    return S.inquiry_scores(_sheets(spark, d))


def source_quality(spark, d):
    """The quality of each page as a source, by its address and title; addresses of some are in upper case, of sign-in pages or with a port."""
    k = F.col("page_id") % 6
    url = F.when(k == 0, F.upper("url")).when(k == 1, F.regexp_replace("url", r"^([a-z]+://[^/]*)", "$1:8080")).when(k == 2, F.regexp_replace("url", r"^([a-z]+://[^/]*)", "$1/Login")).otherwise(F.col("url"))
    title = F.when(k == 3, F.concat(F.col("t"), F.lit(" 转载"))).when(k == 4, F.concat(F.lit("Manufacturer "), F.col("t"))).otherwise(F.col("t"))
    pages = V.read(spark, d, "pages").withColumn("t", G.title(F.col("html")))
    return pages.select("page_id", G.quality(url, title).alias("quality"))


# text; province, city, city code, strategy
REGIONS = (
    ("成都市价格", "四川省", "成都市", "510100", "strict_city"), ("全国统一价", "全国", "", "NATIONAL", "national_reference"), ("湖北省宜昌", "湖北省", "", "", "strict_city"),
    ("内蒙古自治区", "内蒙古自治区", "", "", "strict_city"), ("绵阳市", "", "绵阳市", "", "strict_city"), ("南宁", "广西壮族自治区", "南宁市", "450100", "strict_city"),
    ("某地", "", "某地", "", "strict_city"), ("", "", "", "", "strict_city"),
)


def region_parse(spark, d):
    r = R.parse_region(_of(tuple(x[0] for x in REGIONS), F.col("c_custkey")))
    return V.read(spark, d, "customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.province", "r.city", "r.city_code", "r.strategy")


def contact_fields(spark, d):
    """Contacts of a hit and of a detail page, from one text a supplier."""
    n = F.col("s_suppkey")
    phone = F.concat(F.lit("138"), F.lpad(n.cast("string"), 8, "0"))
    text = F.concat(F.lit("公司名称："), F.lit("甲"), n.cast("string"), F.lit("\n联系人: 张三\n"), F.when(n % 2 == 0, F.concat(F.lit("电话："), phone)).otherwise(F.concat(F.lit("座机 028-8888"), F.lpad((n % 10000).cast("string"), 4, "0"))))
    s = V.read(spark, d, "supplier").select("s_suppkey", G.contacts(text).alias("h"), G.detail_contacts(text, F.lit("标题")).alias("p"))
    return s.select("s_suppkey", F.col("h.supplier").alias("hit_supplier"), F.col("h.phone").alias("hit_phone"), F.col("h.contact").alias("hit_contact"), F.col("p.supplier").alias("supplier"), F.col("p.phone").alias("phone"), F.col("p.contact").alias("contact"))


def _statused(spark, d):
    r = PQ.related(spark, d)
    known = F.col("tax_mode") != "unknown"
    best, rev = Q.top_k(r.where(known)), Q.reviews(r.where(~known))
    j = Q.statuses(V.items(spark, d), best, rev)
    audit = P.audit_price(F.col("best_ex"), F.col("submit"), cap=True) if "best_ex" in j.columns else F.lit(None).cast("double")
    return j.withColumn("audit", audit), best, rev


def result_sheet(spark, d):
    """The cells of each item's row in the result workbook that tell its state, and how many cells there are."""
    items, best, rev = _statused(spark, d)
    rows = W.result_rows(items, best, rev, 3).where("sheet_no = 1 and ord <> '0'")
    at = lambda i: F.element_at("cells", i)
    return rows.select(at(3).alias("name"), at(10).alias("state"), at(11).alias("n_quotes"), F.size("cells").alias("n_cells"), F.element_at("cells", -1).alias("note")).groupBy("name", "state", "n_quotes", "n_cells", "note").agg(F.count("*").alias("n"))


def open_sheet(spark, d):
    items, _, _ = _statused(spark, d)
    rows = W.open_rows(items, 3).where("ord <> '0'")
    return rows.select(*[F.element_at("cells", i).alias(c) for i, c in ((3, "name"), (4, "spec"), (9, "status"), (10, "n_quotes"))])


def token_usage(spark, d):
    e = V.read(spark, d, "events").select("event_id", (F.col("event_id") % 40).alias("k"))
    record = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"prompt_tokens":'), F.col("k").cast("string"), F.lit(',"total_tokens":99}'))).when(F.col("k") % 4 == 1, '{"input_tokens":7,"output_tokens":5}').when(F.col("k") % 4 == 2, "{}")
    u = N.usage(record, F.repeat(F.lit("x"), F.col("k").cast("int")), F.when(F.col("k") > 20, "answer"))
    return e.select("event_id", u.alias("u")).select("event_id", "u.prompt", "u.completion", "u.total")


QUERIES = {f.__name__: f for f in (
    material_names, token_kinds, platform_ids, cache_keys, addresses, price_numbers, name_decisions, spec_after_name, name_memo, sheet_schemas, schema_cache,
    inquiry_scores, source_quality, region_parse, contact_fields, result_sheet, open_sheet, token_usage,
)}

_COLS = lambda rows, k: tuple(x[k] for x in rows)
_QUERY = "lower(trim(regexp_replace(upper(name) || '  DN50 dn50 ', '\\s+', ' ', 'g')))"
_STATUS = PQ.ORACLE["item_status"]

ORACLE = {
    "material_names": f"WITH {V.ITEMS} SELECT item_id, {_pick(_COLS(NAMES, 1), 'item_id', 'bare')}, {_pick(_COLS(NAMES, 2), 'item_id', 'material')}, {_pick(_COLS(NAMES, 3), 'item_id', 'name_key')}, {_pick(_COLS(NAMES, 4), 'item_id', 'shared')} FROM items",
    "token_kinds": r"""WITH f AS (SELECT ['', 'AC', 'dc ', '', '', 'IP', '', 'DN', 'φ ', 'PN', 'DN', 'DS-', ''][l_orderkey % 13 + 1] AS a, ['V', 'V', ' v', 'W/m', ' W / 米', '', '00K', '0', '×2.5', '', '/PN16', 'CD', 'A/AC220V'][l_orderkey % 13 + 1] AS b,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)), 1) AS DECIMAL(18, 1))::VARCHAR ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS v FROM lineitem),
t AS (SELECT a || v || b AS token, count(*) AS n FROM f GROUP BY 1),
e AS (SELECT *, '^(?i:(?:AC|DC)\s*\d+(?:\.\d+)?\s*V|\d+(?:\.\d+)?\s*W(?:\s*/\s*(?:m|米))?|IP\s*\d\d|\d{3,5}\s*K|(?:AC|DC)?\d+(?:\.\d+)?[VWAK])$' AS el, '^(?i:(?:DN|φ)\s*\d+(?:\.\d+)?(?:\s*[×xX*]\s*\d+(?:\.\d+)?)?|PN\s*\d+(?:\.\d+)?)$' AS bo FROM t)
SELECT token, n, regexp_matches(token, el) AS electrical, regexp_matches(token, bo) AS bore,
  contains(token, '/') AND len(string_split(token, '/')) >= 2 AND len(list_filter(string_split(token, '/'), lambda p: NOT (regexp_matches(trim(p), el) OR regexp_matches(trim(p), bo)))) = 0 AS chain,
  regexp_matches(replace(token, ' ', ''), '^(?i:(?:AC|DC)?\d+(?:\.\d+)?(?:V|W|W/m|K)|IP\d\d)$') AS measurement FROM e""",
    "platform_ids": f"SELECT s_suppkey, {_pick(PLATFORM_IDS, 's_suppkey', 'platform')}, {_pick(PLATFORM_DOMAINS, 's_suppkey', 'domain')} FROM supplier",
    "cache_keys": f"""WITH {V.ITEMS}, q AS (SELECT item_id, {_QUERY} AS q, lower(name) AS name, lower(spec) AS spec FROM items)
SELECT item_id, substring(sha256('jd|' || CASE WHEN item_id % 2 = 0 THEN '510100' ELSE 'UNSPECIFIED' END || '|' || replace(q, 'dn50 dn50', 'dn50') || '|market||tax_incl'), 1, 32) AS pool_key,
  substring(sha256(q), 1, 28) AS page_key, CASE item_id % 3 WHEN 0 THEN '四川省|成都市' WHEN 1 THEN '510100' ELSE '四川省' END AS region_key,
  substring(regexp_replace(name || spec, '[^0-9a-z]', '', 'g'), 1, 120) AS row_key FROM q""",
    "addresses": f"""WITH {V.ITEMS}, q AS (SELECT item_id, replace(name, ' ', '%20') || '%20%E9%98%80%2A' AS once FROM items)
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'https://a.example.com/' || CAST(item_id AS VARCHAR) WHEN 1 THEN 'https://b.example.com/' || CAST(item_id AS VARCHAR) ELSE '/c' END AS address,
  once, replace(once, '%', '%25') AS twice, '%B7%A7%C3%C5%20a' AS gbk, 'https://gd.zjtcn.com/shichangjia/list/c_t_d_k_%E7%AE%A1%201.html' AS list FROM q""",
    "price_numbers": r"""WITH l AS (SELECT l_orderkey % 5 AS form, CAST(l_extendedprice AS DECIMAL(18, 2)) AS p, CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(18, 2)) AS q FROM lineitem)
SELECT form, CASE form WHEN 0 THEN p::VARCHAR WHEN 1 THEN CASE WHEN p = q THEN q::VARCHAR ELSE q::VARCHAR || '|' || p::VARCHAR END WHEN 2 THEN p::VARCHAR WHEN 3 THEN q::VARCHAR ELSE '' END AS prices, count(*) AS n FROM l GROUP BY 1, 2""",
    "name_decisions": f"WITH {V.ITEMS} SELECT item_id, ['same', 'same', 'different', 'unknown', 'unknown'][item_id % 5 + 1] AS decision, ['rule', 'local_alias', 'local_negative', '', ''][item_id % 5 + 1] AS source FROM items",
    "spec_after_name": f"""WITH {V.ITEMS}, i AS (SELECT item_id, item_id % 5 AS k, item_id % 2 = 0 AS fits FROM items WHERE item_id % 5 < 3)
SELECT item_id, CASE WHEN k = 2 THEN 'different' ELSE 'same' END AS decision, CASE WHEN k < 2 AND fits THEN 'accept' WHEN k = 2 THEN 'reject' WHEN k < 2 THEN 'reject' END AS outcome, k < 2 AND fits AS ok,
  CASE WHEN k = 2 THEN 0 WHEN fits THEN 1 ELSE 0.5 END::DOUBLE AS score, CASE WHEN k = 2 THEN 'name_different' ELSE '' END AS skip FROM i""",
    "name_memo": "SELECT * FROM (VALUES ('same', CAST(2 AS BIGINT)), ('different', CAST(1 AS BIGINT))) v(decision, n)",
    "sheet_schemas": f"""WITH k AS (SELECT n_nationkey AS k, {_list(_COLS(SHEETS, 1))}[n_nationkey % 4 + 1] AS roles FROM nation)
SELECT 's' || CAST(k AS VARCHAR) AS sheet, CAST(3 AS INTEGER) AS header_row, CAST(4 AS INTEGER) AS data_start_row, roles FROM k WHERE roles IS NOT NULL""",
    "schema_cache": """WITH f AS (SELECT 'f' || CAST(n_nationkey % 5 AS VARCHAR) AS file, count(*) FILTER (n_nationkey % 4 <> 3) AS n FROM nation GROUP BY 1)
SELECT file, CASE WHEN file < 'f3' THEN 'cache' ELSE 'rule' END AS source, CAST(n AS INTEGER) AS n_sheets, CAST(24 AS INTEGER) AS digits FROM f""",
    "inquiry_scores": "SELECT 'f' || CAST(n_nationkey % 5 AS VARCHAR) AS file, sum(CASE n_nationkey % 4 WHEN 0 THEN 112 WHEN 2 THEN 20 ELSE 0 END)::BIGINT AS content_score FROM nation GROUP BY 1",
    "source_quality": r"""WITH p AS (SELECT page_id, page_id % 6 AS k, regexp_extract(url, '^[a-z]+://(?:www\.)?([^/?#:]*)', 1) AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages),
b AS (SELECT *, lower(host) || ' ' || t || CASE k WHEN 3 THEN ' 转载' WHEN 4 THEN ' manufacturer' ELSE '' END AS blob FROM p)
SELECT page_id, CASE WHEN host = '' OR k = 2 OR contains(host, 'passport') OR regexp_matches(path, '/login|/signin|/passport|/auth/|/baidu[.]php') THEN 'block'
  WHEN regexp_matches(blob, '采集|转载|seo|知道|文库|百家号|贴吧') AND NOT regexp_matches(host, '[.]gov[.]cn|ccgp|ggzy') THEN 'low'
  WHEN regexp_matches(blob, '[.]gov[.]cn|ccgp|ggzy|zfcg|1688[.]com|made-in-china|hc360|globalsources|manufacturer') THEN 'high' WHEN regexp_matches(host, '[.](com|cn)$') THEN 'medium' ELSE 'low' END AS quality FROM b""",
    "region_parse": f"SELECT c_custkey, {_pick(_COLS(REGIONS, 1), 'c_custkey', 'province')}, {_pick(_COLS(REGIONS, 2), 'c_custkey', 'city')}, {_pick(_COLS(REGIONS, 3), 'c_custkey', 'city_code')}, {_pick(_COLS(REGIONS, 4), 'c_custkey', 'strategy')} FROM customer",
    "contact_fields": """WITH s AS (SELECT s_suppkey, '甲' || CAST(s_suppkey AS VARCHAR) AS c, CASE WHEN s_suppkey % 2 = 0 THEN '138' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') ELSE '028-8888' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') END AS p FROM supplier)
SELECT s_suppkey, c AS hit_supplier, p AS hit_phone, '张三' AS hit_contact, c AS supplier, p AS phone, '张三' AS contact FROM s""",
    "result_sheet": f"""WITH st AS ({_STATUS}), x AS (SELECT p_name AS name, st.* FROM st JOIN part ON p_partkey = item_id), r AS (SELECT item_id, count(*) AS n_reviews FROM ({PQ._KNOWN}, {PQ._REV_UNKNOWN} SELECT item_id FROM reviews) GROUP BY 1)
SELECT name, CASE status WHEN 'full_k' THEN '已凑满3价' WHEN 'partial' THEN '部分命中(' || n_quotes || '/3)' WHEN 'need_review' THEN '候选待核(' || n_reviews || '条)·请人工采用' ELSE '没查到' END AS state,
  CAST(n_quotes AS VARCHAR) AS n_quotes, CAST(80 AS INTEGER) AS n_cells, CASE WHEN n_quotes > 0 THEN '' WHEN n_reviews > 0 THEN '有候选价待人工确认（非严格合格价）' ELSE '无合格价且无候选' END AS note, count(*) AS n
FROM x LEFT JOIN r USING (item_id) GROUP BY 1, 2, 3, 4, 5""",
    "open_sheet": f"WITH st AS ({_STATUS}) SELECT p_name AS name, 'DN' || CAST(p_size * 10 AS VARCHAR) AS spec, status, CAST(n_quotes AS VARCHAR) AS n_quotes FROM st JOIN part ON p_partkey = item_id WHERE status <> 'full_k'",
    "token_usage": """WITH e AS (SELECT event_id, CAST(event_id % 40 AS INTEGER) AS k FROM events), u AS (SELECT event_id, k,
  CASE k % 4 WHEN 0 THEN k WHEN 1 THEN 7 ELSE greatest(1, (k + 3) // 4) END AS prompt, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE CASE WHEN k > 20 THEN 2 ELSE 0 END END AS completion FROM e)
SELECT event_id, CAST(prompt AS INTEGER) AS prompt, CAST(completion AS INTEGER) AS completion, CAST(CASE WHEN k % 4 = 0 THEN 99 ELSE prompt + completion END AS INTEGER) AS total FROM u""",
}
