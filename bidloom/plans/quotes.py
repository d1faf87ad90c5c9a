"""Registered queries over items and offers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import names as N
from bidloom.functions import price as P
from bidloom.functions import text as T
from bidloom.operators import quotes as Q
from bidloom.operators import ranking as RK
from bidloom.operators import views as V

_PRICED = f"""priced AS (SELECT o.*, i.submit, {V.EX_TAX} AS ex FROM offers o JOIN items i USING (item_id)),
related AS (SELECT *, {V.VS} AS vs FROM priced)"""
_BASE = f"WITH {V.ITEMS}, {V.OFFERS}, {_PRICED}"
_KEY = "item_id, platform, lower(sku), supplier_id, floor(price * 10000 + 0.5::DOUBLE)"
_ORDER = "platform_no, seen_at, sku, score"


def _dedup(source: str, where: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_ORDER}, price, tax_mode) AS dup
  FROM {source} WHERE {where}) WHERE dup = 1)"""


_VALID = "price > 0.05 AND price < 5000000"
_TOP = f"{_BASE}, {_dedup('related', _VALID, 'd')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY price, {_ORDER}, supplier_id) AS rank FROM d), best AS (SELECT * FROM ranked WHERE rank <= 3)"
_KNOWN = f"{_BASE}, {_dedup('related', _VALID + " AND tax_mode <> 'unknown'", 'd')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY price, {_ORDER}, supplier_id) AS rank FROM d), best AS (SELECT * FROM ranked WHERE rank <= 3)"
_OVER = _VALID + " AND vs IN ('near_submit', 'above_submit')"
_REV = f"{_dedup('related', _OVER, 'rd')}, reviews AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ex, {_ORDER}, supplier_id) AS rank FROM rd) WHERE rank <= 5)"

_REV_UNKNOWN = _REV.replace(_OVER, _OVER + " AND tax_mode = 'unknown'")


def related(spark, d):
    return Q.with_relation(V.offers(spark, d), V.items(spark, d))


def items_projection(spark, d):
    return V.items(spark, d)


def price_valid(spark, d):
    o = V.offers(spark, d).withColumn("valid", P.valid_price(F.col("price")))
    return o.groupBy("platform", "valid").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


def ex_tax(spark, d):
    o = Q.with_tax(V.offers(spark, d))
    return o.select("item_id", "platform", "supplier_id", "sku", "price", "tax_mode", "ex")


def vs_submit_bands(spark, d):
    return related(spark, d).groupBy("platform", "vs").agg(F.count("*").alias("n"), F.min("ex").alias("low"), F.max("ex").alias("high"))


def rank_flag_bands(spark, d):
    r = V.offers(spark, d).join(V.items(spark, d).select("item_id", "submit"), "item_id")
    ex = P.ex_tax_for_rank(F.col("price"), F.col("tax_mode"), F.col("platform"))
    return r.withColumn("flag", P.under_submit(ex, F.col("submit"))).groupBy("platform", "tax_mode", "flag").agg(F.count("*").alias("n"))


def anomaly_kinds(spark, d):
    r = related(spark, d)
    hint = P.anomaly_hint(F.col("vs"), F.lit(None).cast("double"))
    return r.groupBy("item_id", hint.alias("hint")).agg(F.count("*").alias("n"))


def quotes_dedupe(spark, d):
    o = V.offers(spark, d).where(P.valid_price(F.col("price")))
    return Q.deduplicated(o).select("item_id", "platform", "supplier_id", "sku", "price", "tax_mode", "score", "seen_at")


def _best(spark, d):
    return Q.top_k(related(spark, d))


def quotes_topk(spark, d):
    return _best(spark, d).select("item_id", "rank", "platform", "supplier_id", "sku", "price", "tax_mode", "ex", "submit", "vs")


def item_status(spark, d):
    """Offers with a known tax are quotes, the others candidates to review."""
    r = related(spark, d)
    known = F.col("tax_mode") != "unknown"
    return Q.statuses(V.items(spark, d), Q.top_k(r.where(known)), Q.reviews(r.where(~known))).select("item_id", "n_quotes", "status")


def audit_price(spark, d):
    n = _best(spark, d).groupBy("item_id").agg(F.min("ex").alias("best_ex"))
    j = V.items(spark, d).join(n, "item_id", "left")
    return j.select("item_id", P.audit_price(F.col("best_ex"), F.col("submit")).alias("audit"), P.audit_price(F.col("best_ex"), F.col("submit"), cap=True).alias("capped"))


def quotes_wide(spark, d):
    return Q.wide(_best(spark, d))


def rfq_rows(spark, d):
    n = _best(spark, d).groupBy("item_id").agg(F.count("*").alias("n_quotes"))
    j = V.items(spark, d).join(n, "item_id", "left").withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0)))
    return j.where("n_quotes < 3").select("item_id", "name", "spec", "brand", "n_quotes")


def review_candidates(spark, d):
    return Q.reviews(related(spark, d)).select("item_id", "rank", "platform", "supplier_id", "sku", "price", "ex", "score", "vs")


def shown_offers(spark, d):
    """Offers of items with several hard values, and texts that show all, some or others of them, by supplier and score."""
    part = V.read(spark, d, "part")
    size, k = F.col("p_size") * 10, F.col("p_partkey")
    text = lambda c: c.cast("string")
    spec = F.concat(F.lit("DN"), text(size), F.lit(" AC220V 9W IP65"), F.when(k % 4 == 0, " 200x100").otherwise(""))
    items = part.select(k.alias("item_id"), F.col("p_name").alias("name"), spec.alias("spec"), size.alias("size"))
    items = items.withColumn("wanted", RK.wanted(F.col("name"), F.col("spec")))
    own, s, n = related(spark, d).join(items, "item_id"), F.col("supplier_id"), F.round(F.col("score") * 100).cast("int")
    seen = (
        F.when(s % 4 == 1, F.concat(F.lit("DN"), text(F.col("size")), F.lit(" AC220V"))).when(s % 4 == 2, F.concat(F.lit("DN"), text(F.col("size") + 10), F.lit(" 9W IP65 300x100")))
        .when(s % 4 == 3, F.concat(F.lit("200x100 dn "), text(F.col("size")), F.lit(" IP65 9 W AC220V"))).otherwise("")
    )
    title = F.when(n % 4 == 0, F.concat(F.lit("other "), F.split("name", " ")[1])).when(n % 4 == 1, F.upper("name")).otherwise(F.col("name"))
    return own.withColumns({"title": title, "spec_seen": seen, "url": F.when(s % 3 > 0, F.concat(F.lit("https://s/"), text(s)))})


def rule_rank(spark, d):
    """The first candidates of each item by all eight keys of the rule."""
    return Q.rule_ranked(shown_offers(spark, d)).select(
        "item_id", "rank", "platform", "sku", "price", "tax_mode", "score", "flag", "name_miss", "wrong_size", "id_hits", "hard_cover", "evidence"
    )


def waterfall_k(spark, d):
    return Q.waterfall(related(spark, d)).select("item_id", "platform", "sku", "price", "tax_mode", "formal", "formal_before")


def market_refs(spark, d):
    return Q.market_refs(related(spark, d)).select("item_id", "rank", "platform", "supplier_id", "sku", "price")


def continue_anti(spark, d):
    done = _best(spark, d).where("rank = 3").select("item_id")
    return V.items(spark, d).join(done, "item_id", "left_anti").select("item_id", "name", "spec")


def scope_semi(spark, d):
    cheap = related(spark, d).where("vs = 'suspicious_low'").select("item_id")
    return V.items(spark, d).join(cheap, "item_id", "left_semi").select("item_id", "name", "submit")


def scope_first_n(spark, d):
    return V.items(spark, d).orderBy("item_id").limit(25)


def scope_sheets(spark, d):
    return V.items(spark, d).where(F.col("brand").isin("Brand#11", "Brand#12", "Brand#23")).select("item_id", "brand")


def supplier_coverage(spark, d):
    s = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier"))
    n = _best(spark, d).groupBy("supplier_id").agg(F.count("*").alias("n_best"), F.countDistinct("item_id").alias("n_items"))
    return s.join(n, "supplier_id", "left").select("supplier_id", "supplier", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def market_full_outer(spark, d):
    a = _best(spark, d).groupBy("item_id").agg(F.min("price").alias("best"))
    b = Q.market_refs(related(spark, d)).groupBy("item_id").agg(F.min("price").alias("market"))
    return a.join(b, "item_id", "full").select("item_id", "best", "market")


def candidate_fingerprints(spark, d):
    """Items whose distinct offer set is that of another: one digest each, sets of equal digests counted."""
    sets = V.offers(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_set(F.concat_ws("/", F.col("platform"), F.col("tax_mode")))).alias("s"))
    key = sets.select("item_id", F.sha2(F.array_join("s", ","), 256).alias("fingerprint"))
    return key.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


def unit_compat(spark, d):
    asked = F.element_at(F.array(*map(F.lit, ("m", "kg", "个", "㎡", ""))), (F.col("item_id") % 5 + 1).cast("int"))
    offered = F.element_at(F.array(*map(F.lit, ("米", "吨", "台", "t"))), (F.col("item_id") % 4 + 1).cast("int"))
    i = V.items(spark, d).select("item_id", asked.alias("asked"), offered.alias("offered"))
    return i.select("item_id", T.normal_unit(F.col("asked")).alias("asked"), T.normal_unit(F.col("offered")).alias("offered"), T.unit_compatible(F.col("asked"), F.col("offered")).alias("compatible"))


def pair_key_hash(spark, d):
    """The cache key of each item's name and of an offer's title that holds the size as well."""
    key = N.pair_key(F.col("name"), F.concat_ws(" ", "name", "spec"))
    return V.items(spark, d).select("item_id", key.alias("pair_key"))


QUERIES = {f.__name__: f for f in (
    items_projection, price_valid, ex_tax, vs_submit_bands, rank_flag_bands, anomaly_kinds, quotes_dedupe, quotes_topk, item_status, audit_price,
    quotes_wide, rfq_rows, review_candidates, rule_rank, waterfall_k, market_refs, continue_anti, scope_semi, scope_first_n, scope_sheets,
    supplier_coverage, market_full_outer, candidate_fingerprints, unit_compat, pair_key_hash,
)}

_FLAG_EX = "CASE WHEN price > 0 THEN CASE WHEN tax_mode = 'tax_excl' OR (tax_mode <> 'tax_incl' AND platform IN ('guangcai','lingcai','huixun','yize','zaojiatong')) THEN price ELSE price / 1.13::DOUBLE END END"
_FLAG = "CASE WHEN submit IS NULL OR submit <= 0 OR rex IS NULL THEN 'unknown' WHEN rex <= submit * 1.02::DOUBLE THEN 'under' WHEN rex <= submit * 1.15::DOUBLE THEN 'near' ELSE 'over' END"
_WIDE = ", ".join(f"max(CASE WHEN rank = {r} THEN {c} END) AS {c}_{r}" for r in (1, 2, 3) for c in ("price", "platform"))
_N = "n AS (SELECT item_id, count(*) AS n_quotes, min(ex) AS best_ex FROM best GROUP BY 1)"
_SHOPS = "platform IN ('jd', 'ali1688')"
_MARKET = f"{_dedup('related', _SHOPS, 'md')}, market AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY price, {_ORDER}, supplier_id) AS rank FROM md) WHERE rank <= 5)"

#: The order where offers come without texts.
PLAIN_RANK = f"{_BASE}, f AS (SELECT *, {_FLAG_EX} AS rex FROM related), g AS (SELECT *, {_FLAG} AS flag FROM f) SELECT item_id, CAST(rank AS INTEGER) AS rank, platform, sku, price, tax_mode, score, flag FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN price > 0.05 THEN 1 ELSE 0 END DESC, score DESC, CASE flag WHEN 'under' THEN 0 WHEN 'near' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, COALESCE(rex, 1e18), price, tax_mode, {_ORDER}, supplier_id) AS rank FROM g) WHERE rank <= 12"

ORACLE = {
    "items_projection": f"WITH {V.ITEMS} SELECT * FROM items",
    "price_valid": f"WITH {V.OFFERS} SELECT platform, {_VALID} AS valid, count(*) AS n, min(price) AS low, max(price) AS high FROM offers GROUP BY 1, 2",
    "ex_tax": f"WITH {V.OFFERS} SELECT item_id, platform, supplier_id, sku, price, tax_mode, {V.EX_TAX} AS ex FROM offers",
    "vs_submit_bands": f"{_BASE} SELECT platform, vs, count(*) AS n, min(ex) AS low, max(ex) AS high FROM related GROUP BY 1, 2",
    "rank_flag_bands": f"{_BASE}, f AS (SELECT *, {_FLAG_EX} AS rex FROM related) SELECT platform, tax_mode, {_FLAG} AS flag, count(*) AS n FROM f GROUP BY 1, 2, 3",
    "anomaly_kinds": f"{_BASE} SELECT item_id, CASE vs WHEN 'suspicious_low' THEN '远低于报送·请核对规格/单位/是否错品' WHEN 'above_submit' THEN '高于报送·市场价如实收录，审定请人工取舍' ELSE '' END AS hint, count(*) AS n FROM related GROUP BY 1, 2",
    "quotes_dedupe": f"WITH {V.OFFERS}, {_dedup('offers', _VALID, 'd')} SELECT item_id, platform, supplier_id, sku, price, tax_mode, score, seen_at FROM d",
    "quotes_topk": f"{_TOP} SELECT item_id, CAST(rank AS INTEGER) AS rank, platform, supplier_id, sku, price, tax_mode, ex, submit, vs FROM best",
    "item_status": f"{_KNOWN}, {_REV_UNKNOWN}, {_N}, r AS (SELECT item_id, count(*) AS n_reviews FROM reviews GROUP BY 1) SELECT item_id, COALESCE(n_quotes, 0) AS n_quotes, CASE WHEN n_quotes >= 3 THEN 'full_k' WHEN n_quotes > 0 THEN 'partial' WHEN n_reviews > 0 THEN 'need_review' ELSE 'no_match' END AS status FROM items LEFT JOIN n USING (item_id) LEFT JOIN r USING (item_id)",
    "audit_price": f"{_TOP}, {_N} SELECT item_id, best_ex AS audit, CASE WHEN best_ex IS NULL THEN NULL WHEN submit > 0 THEN least(best_ex, submit) ELSE best_ex END AS capped FROM items LEFT JOIN n USING (item_id)",
    "quotes_wide": f"{_TOP} SELECT item_id, {_WIDE} FROM best GROUP BY item_id",
    "rfq_rows": f"{_TOP}, {_N} SELECT item_id, name, spec, brand, COALESCE(n_quotes, 0) AS n_quotes FROM items LEFT JOIN n USING (item_id) WHERE COALESCE(n_quotes, 0) < 3",
    "review_candidates": f"{_BASE}, {_REV} SELECT item_id, CAST(rank AS INTEGER) AS rank, platform, supplier_id, sku, price, ex, score, vs FROM reviews",
    "rule_rank": f"""{_BASE}, t AS (SELECT r.*, {_FLAG_EX} AS rex, p_name AS name, p_size * 10 AS size, item_id % 4 = 0 AS wide, CAST(round(score * 100) AS INTEGER) AS n, supplier_id % 4 AS s, supplier_id % 3 > 0 AS linked FROM related r JOIN part ON p_partkey = item_id),
w AS (SELECT *, {_FLAG} AS flag,
  CASE WHEN n % 4 = 0 THEN 1 WHEN n % 4 = 1 THEN 0 ELSE 0 END AS name_miss,
  CASE WHEN s = 2 OR (wide AND s = 2) THEN 1 ELSE 0 END AS wrong_size,
  CASE WHEN s = 1 THEN 2 WHEN s = 3 THEN 1 WHEN s = 2 AND size < 100 AND contains('dn' || CAST(size + 10 AS VARCHAR), 'dn' || CAST(size AS VARCHAR)) THEN 1 ELSE 0 END
    + CASE WHEN wide AND (s = 3 OR s = 2 AND size = 190) THEN 1 ELSE 0 END AS id_hits,
  CASE s WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS hard_cover,
  CASE WHEN s > 0 THEN 2 ELSE 0 END + CASE WHEN linked THEN 1 ELSE 0 END + CASE WHEN price > 0.05 THEN 1 ELSE 0 END AS evidence FROM t)
SELECT item_id, CAST(rank AS INTEGER) AS rank, platform, sku, price, tax_mode, score, flag, name_miss, wrong_size, id_hits, hard_cover, evidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id
  ORDER BY name_miss, wrong_size, id_hits DESC, hard_cover DESC, evidence DESC, score DESC, CASE flag WHEN 'under' THEN 0 WHEN 'near' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, COALESCE(rex, 1e18), price, tax_mode, {_ORDER}, supplier_id) AS rank FROM w) WHERE rank <= 12""",
    "waterfall_k": f"{_BASE}, w AS (SELECT *, vs IN ('below_submit', 'near_submit') AS formal, CAST(COALESCE(sum(CASE WHEN vs IN ('below_submit', 'near_submit') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY {_ORDER}, supplier_id, price, tax_mode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS formal_before FROM related) SELECT item_id, platform, sku, price, tax_mode, formal, formal_before FROM w WHERE formal_before < 3",
    "market_refs": f"{_BASE}, {_MARKET} SELECT item_id, CAST(rank AS INTEGER) AS rank, platform, supplier_id, sku, price FROM market",
    "continue_anti": f"{_TOP} SELECT item_id, name, spec FROM items WHERE item_id NOT IN (SELECT item_id FROM best WHERE rank = 3)",
    "scope_semi": f"{_BASE} SELECT item_id, name, submit FROM items WHERE item_id IN (SELECT item_id FROM related WHERE vs = 'suspicious_low')",
    "scope_first_n": f"WITH {V.ITEMS} SELECT * FROM items ORDER BY item_id LIMIT 25",
    "scope_sheets": f"WITH {V.ITEMS} SELECT item_id, brand FROM items WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#23')",
    "supplier_coverage": f"{_TOP}, c AS (SELECT supplier_id, count(*) AS n_best, count(DISTINCT item_id) AS n_items FROM best GROUP BY 1) SELECT s_suppkey AS supplier_id, s_name AS supplier, COALESCE(n_best, 0) AS n_best, COALESCE(n_items, 0) AS n_items FROM supplier LEFT JOIN c ON supplier_id = s_suppkey",
    "market_full_outer": f"{_TOP}, {_MARKET}, a AS (SELECT item_id, min(price) AS best FROM best GROUP BY 1), b AS (SELECT item_id, min(price) AS market FROM market GROUP BY 1) SELECT item_id, a.best, b.market FROM a FULL JOIN b USING (item_id)",
    "candidate_fingerprints": f"WITH {V.OFFERS}, s AS (SELECT item_id, sha256(string_agg(k, ',' ORDER BY k)) AS fingerprint FROM (SELECT DISTINCT item_id, platform || '/' || tax_mode AS k FROM offers) GROUP BY 1) SELECT fingerprint, count(*) AS n, min(item_id) AS first_item FROM s GROUP BY 1",
    "unit_compat": f"WITH {V.ITEMS}, u AS (SELECT item_id, ['m','kg','piece','m2',''][CAST(item_id % 5 + 1 AS INTEGER)] AS asked, ['m','t','piece','t'][CAST(item_id % 4 + 1 AS INTEGER)] AS offered FROM items) SELECT item_id, asked, offered, CASE WHEN asked = '' THEN NULL ELSE replace(asked, 'kg', 't') = replace(offered, 'kg', 't') END AS compatible FROM u",
    "pair_key_hash": f"WITH {V.ITEMS}, k AS (SELECT item_id, lower(replace(name, ' ', '')) AS k FROM items) SELECT item_id, substring(sha256(k || '||' || k), 1, 28) AS pair_key FROM k",
}
