"""Views that read the driver's star schema as items, offers and attempts.

Items are parts, offers are line items with their supplier, attempts are events. The SQL texts
are the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Platform names by number; the last two are shops.
PLATFORMS = ("guangcai", "lingcai", "huixun", "yize", "zaojiatong", "jd", "ali1688")
SHOPS = PLATFORMS[5:]
TAX = {"A": "tax_incl", "N": "tax_excl", "R": "unknown"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("DN"), (F.col("p_size") * 10).cast("string")).alias("spec"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("submit"),
    )


ITEMS = "items AS (SELECT p_partkey AS item_id, p_name AS name, 'DN' || CAST(p_size * 10 AS VARCHAR) AS spec, p_brand AS brand, p_retailprice AS submit FROM part)"


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns that offers need are scanned; platform and tax mode are computed beside the scan.

    Of ten items one has no offers, one a few, and one none with a known tax. Some prices are not valid, and a third of the
    offers carry their supplier's one code and a round price, so that some of them repeat.
    """
    rows = read(spark, sf_dir, "lineitem").where("l_quantity > 0 and l_partkey % 10 <> 7")
    rows = rows.where("(l_partkey % 10 <> 3 or l_orderkey % 8 = 0) and (l_partkey % 10 <> 9 or l_returnflag = 'R')")
    platform = F.element_at(F.array(*[F.lit(p) for p in PLATFORMS]), (F.col("l_suppkey") % 7 + 1).cast("int"))
    paid, order = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_orderkey")
    price = F.when(order % 19 == 0, 0.01).when(order % 23 == 0, 6_000_000.0).when(order % 3 == 0, F.floor(paid / 500) * 500 + 250.0).otherwise(paid)
    code = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "S-").otherwise("s-"), F.col("l_suppkey").cast("string"))
    return rows.select(
        F.col("l_partkey").alias("item_id"),
        (F.col("l_suppkey") % 7).cast("int").alias("platform_no"),
        platform.alias("platform"),
        F.col("l_suppkey").alias("supplier_id"),
        F.when(order % 3 == 0, code).otherwise(F.concat_ws("-", order.cast("string"), F.col("l_linenumber").cast("string"))).alias("sku"),
        price.alias("price"),
        F.when(F.col("l_returnflag") == "A", "tax_incl").when(F.col("l_returnflag") == "N", "tax_excl").otherwise("unknown").alias("tax_mode"),
        F.col("l_discount").alias("score"),
        F.col("l_shipdate").alias("seen_at"),
    )


OFFERS = """offers AS (SELECT l_partkey AS item_id, CAST(l_suppkey % 7 AS INTEGER) AS platform_no,
  ['guangcai','lingcai','huixun','yize','zaojiatong','jd','ali1688'][CAST(l_suppkey % 7 + 1 AS INTEGER)] AS platform,
  l_suppkey AS supplier_id,
  CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'S-' ELSE 's-' END || CAST(l_suppkey AS VARCHAR)
       ELSE CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS sku,
  CASE WHEN l_orderkey % 19 = 0 THEN 0.01::DOUBLE WHEN l_orderkey % 23 = 0 THEN 6000000::DOUBLE
       WHEN l_orderkey % 3 = 0 THEN floor(l_extendedprice / l_quantity / 500) * 500 + 250 ELSE l_extendedprice / l_quantity END AS price,
  CASE WHEN l_returnflag = 'A' THEN 'tax_incl' WHEN l_returnflag = 'N' THEN 'tax_excl' ELSE 'unknown' END AS tax_mode,
  l_discount AS score, l_shipdate AS seen_at FROM lineitem
  WHERE l_quantity > 0 AND l_partkey % 10 <> 7 AND (l_partkey % 10 <> 3 OR l_orderkey % 8 = 0) AND (l_partkey % 10 <> 9 OR l_returnflag = 'R'))"""

#: Price without tax and relation to the submitted price, over offers joined to items.
EX_TAX = """CASE WHEN price > 0.05 THEN CASE WHEN tax_mode = 'tax_excl' OR (tax_mode <> 'tax_incl' AND platform IN
  ('guangcai','lingcai','huixun','yize','zaojiatong')) THEN price ELSE price / 1.13::DOUBLE END END"""
VS = """CASE WHEN submit IS NULL OR submit <= 0 OR ex IS NULL THEN 'unknown' WHEN ex < submit * 0.25::DOUBLE THEN 'suspicious_low'
  WHEN ex <= submit * 1.02::DOUBLE THEN 'below_submit' WHEN ex <= submit * 1.10::DOUBLE THEN 'near_submit' ELSE 'above_submit' END"""
#: The order in which equal quotes are kept, and in which quotes rank.
KEEP_FIRST = ("platform_no", "seen_at", "sku", "score")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts. Of four users one never gets a formal quote, for one of nine reasons (``why``)."""
    kind, user = F.col("event_type"), F.col("user_id")
    lost, why = user % 4 == 0, F.floor(user / 4) % 9
    limited = F.when(lost & (why == 1), "captcha").when(lost & (why > 1), "empty_page").otherwise("rate_limited")
    status = (
        F.when(kind == "error", limited).when((kind == "signup") & (~lost | (why == 2)), "no_membership").when(kind.isin("signup", "click"), "empty_page").otherwise("ok")
    )
    # What a view says to a user without a quote, by reason.
    said = F.element_at(F.array(*map(F.lit, ("", "", "", "", "名称未命中", "规格冲突：DN100", "规格缺少：电压", "无价", "待定"))), (why + 1).cast("int"))
    told = (
        F.when(kind == "purchase", "名称命中").when((kind == "view") & (F.col("value") < 20), "名称未命中").when((kind == "view") & (F.col("value") < 40), "规格冲突：DN100")
        .when((kind == "view") & (F.col("value") < 60), "规格缺少：电压").otherwise("")
    )
    detail = F.when(lost, F.when(kind == "view", said).otherwise("")).otherwise(told)
    return read(spark, sf_dir, "events").select(
        user.alias("item_id"),
        F.col("event_id").alias("ord"),
        "ts",
        F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")).alias("platform"),
        F.concat(F.lit("Q"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("query"),
        status.alias("status"),
        detail.alias("match_detail"),
        F.when(lost & (why == 7), 0.0).otherwise(F.col("value") + 1.0).alias("price"),
        ((kind == "purchase") & ~lost).alias("formal"),
    )


ATTEMPTS = """attempts AS (SELECT user_id AS item_id, event_id AS ord, ts, 'p' || CAST(event_id % 5 AS VARCHAR) AS platform,
  'Q' || COALESCE(json_extract_string(props, '$.k'), '') AS query,
  CASE event_type WHEN 'error' THEN CASE WHEN lost AND why = 1 THEN 'captcha' WHEN lost AND why > 1 THEN 'empty_page' ELSE 'rate_limited' END
    WHEN 'signup' THEN CASE WHEN NOT lost OR why = 2 THEN 'no_membership' ELSE 'empty_page' END WHEN 'click' THEN 'empty_page' ELSE 'ok' END AS status,
  CASE WHEN lost THEN CASE WHEN event_type = 'view' THEN ['', '', '', '', '名称未命中', '规格冲突：DN100', '规格缺少：电压', '无价', '待定'][why + 1] ELSE '' END
       WHEN event_type = 'view' AND value < 20 THEN '名称未命中' WHEN event_type = 'view' AND value < 40 THEN '规格冲突：DN100'
       WHEN event_type = 'view' AND value < 60 THEN '规格缺少：电压' WHEN event_type = 'purchase' THEN '名称命中' ELSE '' END AS match_detail,
  CASE WHEN lost AND why = 7 THEN 0 ELSE value + 1.0::DOUBLE END AS price, event_type = 'purchase' AND NOT lost AS formal
  FROM (SELECT *, user_id % 4 = 0 AS lost, CAST(user_id // 4 % 9 AS INTEGER) AS why FROM events))"""
