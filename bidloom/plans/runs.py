"""Queries of run records over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom import shared
from bidloom.operators import analytics as A
from bidloom.operators import runs as R
from bidloom.operators import views as V
from bidloom.plans import names as PN
from bidloom.plans import quotes as PQ
from bidloom.plans import reports as PR


def status_by_sheet(spark, d):
    """How many items of each brand's sheet have which status."""
    items, _, _ = PN._statused(spark, d)
    sheet = F.when(F.col("item_id") % 9 > 0, F.col("brand"))
    return R.counts_by_sheet(items.withColumn("sheet", sheet))


def sections_first(spark, d):
    """The candidates of each item and platform that are looked at, those with the asked section first."""
    own = PQ.shown_offers(spark, d).withColumns({"inline": F.col("supplier_id") % 2 == 0, "n_quotes": (F.col("item_id") % 3).cast("int")})
    return R.sections_first(own).select("item_id", "platform", "place", "section_hits", "sku", "price", "score")


def job_sources(spark, d):
    """Stored jobs, made of pages, as they are shown: without priceless web quotes and without leads of nobody or of blocked pages."""
    p = V.read(spark, d, "pages")
    k = F.col("page_id")
    url = F.when(k % 7 == 0, F.concat(F.lit("https://zhidao.baidu.com/"), k.cast("string"))).otherwise(F.col("url"))
    quote = F.struct(k.alias("no"), F.when(k % 4 > 0, (k % 4 - 1).cast("double")).alias("price"))
    lead = F.struct(k.alias("no"), F.when(k % 3 == 0, " ").otherwise("S").alias("supplier"), F.when(k % 5 == 0, "13800150123").alias("phone"), F.lit("").alias("contact"), F.lit(None).cast("string").alias("detail_url"), url.alias("url"), F.lit("").alias("title"))
    rows = p.groupBy((k % 40).alias("id")).agg(F.sort_array(F.collect_list(quote)).alias("web_list"), F.sort_array(F.collect_list(lead)).alias("supplier_list"))
    row = F.struct("web_list", "supplier_list", F.concat(F.lit("完成；供应商线索 "), F.size("supplier_list").cast("string"), F.lit(" 条")).alias("message"))
    shown = R.sound_jobs(rows.select("id", F.array(row).alias("item_results"))).select("id", F.col("item_results")[0].alias("r"))
    return shown.select("id", F.size("r.web_list").alias("quotes"), F.size("r.supplier_list").alias("leads"), F.coalesce(F.array_max(F.transform("r.supplier_list", lambda x: x["no"])), F.lit(-1)).alias("last"), "r.message")


def target_regions(spark, d):
    """The region of each customer's items: its own, the text of its row, its nation's, the default of two regions, or none."""
    c = V.read(spark, d, "customer").join(V.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    place = lambda when, city, province=F.lit(""): F.struct(province.alias("province"), F.when(when, city).alias("city"), *[F.lit("").alias(x) for x in ("district", "province_code", "city_code")])
    k, text = F.col("c_custkey"), F.when(F.col("c_acctbal") < 500, F.concat("c_mktsegment", F.lit(" 市")))
    found = R.target_region(place(k % 4 == 0, F.col("n_name")), text, place(k % 3 == 0, F.col("c_mktsegment")), place(F.col("n_regionkey") < 2, F.lit("home")), F.when(k % 2 == 0, " Allow_Province").otherwise("x"))
    return c.select("c_custkey", found.alias("r")).select("c_custkey", "r.city", "r.source", "r.strategy")


def must_words(spark, d):
    """The words and values that a hit for an item must show, and those of its specification; equal items are looked at once."""
    k = F.col("p_partkey")
    spec = F.concat_ws(" ", F.concat(F.lit("DN"), (F.col("p_size") * 10).cast("string")), F.when(k % 2 == 0, "220 V"), F.when(k % 3 == 0, "DS-7608N/K2"), F.when(k % 5 == 0, "铸铁 名称"), F.when(k % 7 == 0, "220V"))
    part = V.read(spark, d, "part").select(k.alias("item_id"), F.concat(F.lit("镀锌"), F.when(k % 2 == 0, "钢管").otherwise("阀门"), F.lit(" "), F.col("p_name")).alias("name"), spec.alias("spec"))
    joined = lambda c: F.array_join(c, "|")
    name, spec = F.col("name"), F.col("spec")
    made = lambda c: c.withColumns({"words": joined(R.name_words(name)), "tokens": joined(R.required_tokens(spec, name)), "must": joined(R.name_must(name, spec))})
    return shared.by_content(part, ["name", "spec"], made).select("item_id", "words", "tokens", "must")


def run_meta(spark, d):
    """A run's record, its funnel and platform statistics from the attempts, read again from its JSON."""
    a = V.attempts(spark, d)
    items = V.items(spark, d)
    meta = R.run_meta(spark, "run-1", "", ["jd", "yize"], None, "", F.lit("2024-01-02 03:04:05").cast("timestamp"), A.funnel(items, a), A.platform_stats(a), {"mode": "strict"})
    at = lambda path: F.get_json_object("meta", f"$.{path}")
    long_ = lambda path: at(path).cast("long")
    return meta.select("run_id", at("k").alias("k"), at("mode").alias("mode"), at("created_at").alias("created_at"), long_("funnel.items_total").alias("items"), long_("funnel.searched").alias("searched"), long_("platform_stats.p3.queries").alias("queries"), long_("platform_stats.p4.formal_hits").alias("hits"))


QUERIES = {f.__name__: f for f in (status_by_sheet, sections_first, job_sources, target_regions, must_words, run_meta)}

ORACLE = {
    "status_by_sheet": f"""WITH st AS ({PN._STATUS}), s AS (SELECT CASE WHEN item_id % 9 > 0 THEN p_brand ELSE '（未命名表）' END AS sheet, status FROM st JOIN part ON p_partkey = item_id)
SELECT sheet, count(*) AS count, count(*) FILTER (status = 'full_k') AS full_k, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'need_review') AS need_review, count(*) FILTER (status = 'no_match') AS no_match FROM s GROUP BY 1""",
    "sections_first": f"""{PQ._BASE}, t AS (SELECT r.*, item_id % 4 = 0 AS wide, supplier_id % 4 AS s, p_size * 10 AS size FROM related r JOIN part ON p_partkey = item_id),
h AS (SELECT *, CASE WHEN NOT wide THEN 0 WHEN s = 3 THEN 2 WHEN s = 2 THEN 1 + CASE WHEN size + 10 = 200 THEN 1 ELSE 0 END WHEN s = 1 THEN CASE WHEN size IN (100, 200) THEN 1 ELSE 0 END ELSE 0 END AS section_hits FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id, platform ORDER BY section_hits DESC, score DESC, sku, price) AS place, count(*) FILTER (supplier_id % 2 = 0) OVER (PARTITION BY item_id, platform) AS inline FROM h)
SELECT item_id, platform, CAST(place AS INTEGER) AS place, CAST(section_hits AS INTEGER) AS section_hits, sku, price, score FROM p
WHERE place <= CASE WHEN inline >= 3 THEN CASE WHEN wide THEN 8 ELSE 6 END ELSE CASE WHEN wide THEN 3 ELSE 2 END - CASE WHEN item_id % 3 > 0 THEN 1 ELSE 0 END END""",
    "job_sources": """WITH p AS (SELECT page_id % 40 AS id, page_id AS k FROM pages), q AS (SELECT *, k % 4 > 1 AS priced, (k % 3 > 0 OR k % 5 = 0) AND k % 7 > 0 AS lead FROM p),
n AS (SELECT id, count(*) FILTER (priced) AS quotes, count(*) FILTER (lead) AS leads, coalesce(max(k) FILTER (lead), -1) AS last FROM q GROUP BY 1)
SELECT id, CAST(quotes AS INTEGER) AS quotes, CAST(leads AS INTEGER) AS leads, last, CASE WHEN leads > 0 THEN '完成；供应商线索' || CAST(leads AS VARCHAR) || '条' ELSE '完成' END AS message FROM n""",
    "target_regions": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND n_name IS NOT NULL THEN n_name WHEN c_acctbal < 500 THEN c_mktsegment || ' 市' WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN n_regionkey < 2 THEN 'home' ELSE '' END AS city,
  CASE WHEN (c_custkey % 4 = 0 AND n_name IS NOT NULL) OR c_acctbal < 500 THEN 'excel_row' WHEN c_custkey % 3 = 0 THEN 'task' WHEN n_regionkey < 2 THEN 'user_default' ELSE 'unspecified' END AS source,
  CASE WHEN c_custkey % 2 = 0 THEN 'allow_province' ELSE 'strict_city' END AS strategy FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "must_words": """WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '镀锌钢管' ELSE '镀锌阀门' END AS words, 'DN' || CAST(p_size * 10 AS VARCHAR) AS dn FROM part),
l AS (SELECT k, words, list_filter([CASE WHEN k % 3 = 0 THEN 'DS-7608N/K2' END, dn, CASE WHEN k % 2 = 0 OR k % 7 = 0 THEN '220V' END, CASE WHEN length(dn) >= 5 THEN dn || '-' END, CASE WHEN k % 5 = 0 THEN '铸铁' END], lambda x: x IS NOT NULL AND NOT ends_with(x, '-')) AS tokens FROM t)
SELECT k AS item_id, words, array_to_string(tokens, '|') AS tokens, array_to_string(list_concat([words], tokens[1:4]), '|') AS must FROM l""",
    "run_meta": f"""WITH f AS ({PR.ORACLE['funnel']}), s AS ({PR.ORACLE['platform_stats']})
SELECT 'run-1' AS run_id, '3' AS k, 'strict' AS mode, '2024-01-02T03:04:05' AS created_at, items_total AS items, searched, (SELECT queries FROM s WHERE platform = 'p3') AS queries, (SELECT formal_hits FROM s WHERE platform = 'p4') AS hits FROM f""",
}
