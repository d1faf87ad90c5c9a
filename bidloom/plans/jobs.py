"""Registered queries over what jobs leave behind, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom import shared
from bidloom.functions import search as S
from bidloom.operators import analytics as A
from bidloom.operators import families as N
from bidloom.operators import jobs as J
from bidloom.operators import quotes as Q
from bidloom.operators import views as V
from bidloom.plans import quotes as PQ
from bidloom.plans import reports as PR


def item_diagnostics(spark, d):
    """Of every user the state, the reason without a quote, and how many attempts there were; customers stand for items that were never tried."""
    a = V.attempts(spark, d)
    ids = V.read(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    n = a.groupBy("item_id").agg(F.count_if("formal").alias("n_quotes"))
    st = ids.join(n, "item_id", "left").select("item_id", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes")).withColumn("status", F.when(F.col("n_quotes") > 0, "full_k").otherwise("no_match"))
    return J.diagnoses(st, A.fail_reasons(a), a)


def sheet_counts(spark, d):
    return J.sheet_counts(V.items(spark, d).withColumn("brand", F.when(F.col("item_id") % 9 > 0, F.col("brand"))), "brand")


def scope_counts(spark, d):
    i = V.items(spark, d)
    return J.selected_count(i, "first_n", 25).unionByName(J.selected_count(i)).unionByName(J.selected_count(i, "sheets", 0, ("Brand#11", "Brand#12"), "brand"))


def run_counters(spark, d):
    field = F.element_at(F.array(*map(F.lit, ("query_count", "search_ms", "accepted", "no such"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = V.read(spark, d, "events").select(F.col("event_type").alias("key"), field.alias("field"), (F.col("event_id") % 8).cast("double").alias("n"))
    return J.counters(e).select("key", "query_count", "accepted", "rejected", "search_ms")


def usage_by_role(spark, d):
    n = F.col("event_id") % 10
    e = V.read(spark, d, "events").select(F.col("event_type").alias("role"), (n != 0).alias("ok"), n.alias("prompt"), F.when(n > 4, n).alias("completion"), F.when(n > 7, 99).alias("total"))
    return J.usage_by_role(e)


def history_job(spark, d):
    h = V.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ts"), "event_type")
    return J.job(h, "7")


def name_store(spark, d):
    """The confirmed and the denied pairs after two confirmations each: names of parts by number."""
    i = V.items(spark, d).where("item_id < 40").select("item_id", F.concat(F.lit("品"), F.translate(F.col("item_id").cast("string"), "0123456789", "零一二三四五六七八九")).alias("n"))
    pair = lambda k: i.where(f"item_id % 4 = {k}").alias("a").join(i.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.n").alias("a"), F.col("b.n").alias("b"))
    yes, no = J.confirm(pair(0), pair(1), pair(1), pair(2))
    return yes.withColumn("relation", F.lit("same")).unionByName(no.withColumn("relation", F.lit("different"))).groupBy("relation").agg(F.count("*").alias("n"), F.min("a").alias("least"))


def platform_capabilities(spark, d):
    p = F.element_at(F.array(*map(F.lit, ("京东", "易择", "1688", "other"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return V.read(spark, d, "supplier").select("s_suppkey", J.capability(p).alias("c")).select("s_suppkey", "c.selectable", "c.levels")


def market_unlisted(spark, d):
    """Shop prices of items that no review of the same item shows."""
    r = PQ.related(spark, d)
    return J.unlisted(Q.market_refs(r), Q.reviews(r).withColumn("sku", F.col("sku")), "sku").select("item_id", "platform", "sku", "price")


def rank_review(spark, d):
    r = Q.rule_ranked(PQ.related(spark, d)).withColumn("score", F.col("score") * 1000)
    return J.needs_review_of_rank(r.select("item_id", "rank", "score", "flag"))


def item_families(spark, d):
    i = PR._families(spark, d)
    key = F.concat_ws("|", F.lower("name"), F.col("region"))
    return J.with_family(i, N.families(i), key).select("item_id", "first_item", "members", "main_query")


def family_item_queries(spark, d):
    i = V.items(spark, d)
    family = F.when(F.col("item_id") % 2 == 0, "球 阀 DN50").otherwise("闸阀")
    return i.select("item_id", F.array_join(S.family_queries(family, F.lit("阀"), F.when(F.col("item_id") % 3 > 0, F.col("spec"))), "|").alias("queries"))


def web_item_queries(spark, d):
    i = V.items(spark, d)
    name, alias = F.lit("闸阀（铸铁）"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("闸门阀")))
    return i.select("item_id", F.array_join(S.web_queries(name, F.col("spec"), alias, 2), "|").alias("queries"))


def sound_queries(spark, d):
    """Proposed queries that may be asked for each item; equal specifications are looked at once."""
    i = V.items(spark, d).select("item_id", "spec")
    offered = F.array(F.lit("闸阀"), F.concat(F.lit("闸阀 "), "spec"), F.lit("闸阀 DS-999X"), F.lit("铸铁闸阀"))
    made = lambda c: c.withColumn("queries", F.array_join(S.sound_queries(offered, F.lit("闸阀"), F.col("spec"), F.array(F.lit("x"))), "|"))
    return shared.by_content(i, ["spec"], made).select("item_id", "queries")


QUERIES = {f.__name__: f for f in (
    item_diagnostics, sheet_counts, scope_counts, run_counters, usage_by_role, history_job, name_store, platform_capabilities, market_unlisted, rank_review, item_families,
    family_item_queries, web_item_queries, sound_queries,
)}
_BASE = PQ._BASE
_RANKED = PQ.PLAIN_RANK

ORACLE = {
    "item_diagnostics": f"""WITH r AS ({PR.ORACLE['fail_reasons']}), n AS (SELECT user_id AS item_id, count(*) AS n, count(*) FILTER (event_type = 'purchase' AND user_id % 4 <> 0) AS q FROM events GROUP BY 1)
SELECT c_custkey AS item_id, CASE WHEN q > 0 THEN 'full_k' ELSE 'no_match' END AS status, COALESCE(reason, '平台没有结果') AS fail_reason, CASE WHEN n IS NULL THEN '未执行或无结果' ELSE reason END AS hint,
  COALESCE(q, 0) AS n_quotes, COALESCE(n, 0) AS n_attempts FROM customer LEFT JOIN n ON c_custkey = n.item_id LEFT JOIN r ON c_custkey = r.item_id""",
    "sheet_counts": "SELECT CASE WHEN p_partkey % 9 > 0 THEN p_brand ELSE '(未命名)' END AS sheet, count(*) AS count FROM part GROUP BY 1",
    "scope_counts": "SELECT least(count(*), 25) AS selected FROM part UNION ALL SELECT count(*) FROM part UNION ALL SELECT count(*) FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')",
    "run_counters": """SELECT event_type AS key, CAST(sum(CASE event_id % 4 WHEN 0 THEN event_id % 8 ELSE 0 END) AS BIGINT) AS query_count, CAST(sum(CASE event_id % 4 WHEN 2 THEN event_id % 8 ELSE 0 END) AS BIGINT) AS accepted,
  CAST(0 AS BIGINT) AS rejected, CAST(sum(CASE event_id % 4 WHEN 1 THEN event_id % 8 ELSE 0 END) AS DOUBLE) AS search_ms FROM events WHERE event_id % 4 < 3 GROUP BY ROLLUP (event_type)""",
    "usage_by_role": """WITH e AS (SELECT event_type AS role, event_id % 10 AS n FROM events) SELECT role, count(*) AS calls, count(*) FILTER (n = 0) AS failed, CAST(sum(n) AS BIGINT) AS prompt,
  CAST(sum(CASE WHEN n > 4 THEN n ELSE 0 END) AS BIGINT) AS completion, CAST(sum(CASE WHEN n > 7 THEN 99 WHEN n > 4 THEN 2 * n ELSE n END) AS BIGINT) AS total FROM e GROUP BY 1""",
    "history_job": "SELECT user_id AS id, event_id AS ts, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 1",
    "name_store": """WITH i AS (SELECT p_partkey AS k, '品' || translate(CAST(p_partkey AS VARCHAR), '0123456789', '零一二三四五六七八九') AS n FROM part WHERE p_partkey < 40),
p AS (SELECT a.k % 4 AS m, a.n FROM i a JOIN i b ON b.k = a.k + 1) SELECT CASE WHEN m < 2 THEN 'same' ELSE 'different' END AS relation, count(*) AS n, min(n) AS least FROM p WHERE m < 3 GROUP BY 1""",
    "platform_capabilities": "SELECT s_suppkey, s_suppkey % 4 = 0 AS selectable, ['province,city,district', 'city', 'province,city', ''][s_suppkey % 4 + 1] AS levels FROM supplier",
    "market_unlisted": f"{_BASE}, {PQ._MARKET}, {PQ._REV} SELECT item_id, platform, sku, price FROM market m WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.item_id = m.item_id AND r.sku = m.sku)",
    "rank_review": f"WITH r AS ({_RANKED}) SELECT item_id, count(*) >= 4 AND NOT COALESCE(bool_or(flag = 'under') FILTER (rank <= 3), false) AND max(score * 1000) FILTER (rank <= 3) - min(score * 1000) FILTER (rank <= 3) < 15 AS needed FROM r GROUP BY 1",
    "item_families": f"{PR._FAM}, f AS (SELECT family_key, min(item_id) AS first_item, count(*) AS members, min(name) AS main_query FROM r GROUP BY 1) SELECT item_id, first_item, members, main_query FROM r LEFT JOIN f USING (family_key)",
    "family_item_queries": f"WITH {V.ITEMS} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '球阀' || CASE WHEN item_id % 3 > 0 THEN '|球阀 ' || spec ELSE '' END ELSE '闸阀' || CASE WHEN item_id % 3 > 0 THEN '|闸阀 ' || spec ELSE '' END END AS queries FROM items",
    "web_item_queries": f"WITH {V.ITEMS} SELECT item_id, '闸阀 ' || spec || CASE WHEN item_id % 2 = 0 THEN '|闸门阀 ' || spec ELSE '' END AS queries FROM items",
    "sound_queries": f"WITH {V.ITEMS} SELECT item_id, '闸阀 ' || spec || '|铸铁闸阀 ' || spec AS queries FROM items",
}
