"""Registered queries over web sources and region checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.operators import families as N
from bidloom.operators import quotes as Q
from bidloom.operators import region as R
from bidloom.operators import views as V
from bidloom.operators import web as W


def fallback_items(spark, d):
    """Items with fewer than three formal offers; those of one brand have been asked before."""
    n = V.offers(spark, d).where("tax_mode = 'tax_incl'").groupBy("item_id").agg(F.count("*").alias("n_formal"))
    j = V.items(spark, d).join(n, "item_id", "left").withColumn("n_formal", F.coalesce("n_formal", F.lit(0)))
    wants = W.wants_fallback(F.col("n_formal"), F.lit(Q.K), F.col("brand") == "Brand#11", F.lit(True))
    return j.where(wants).select("item_id", "n_formal")


def visible_prices(spark, d):
    """The first price and the number of prices that an offer's text shows: one labelled, one with a currency mark."""
    text = F.concat(F.lit("含税价："), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "A", "万元").otherwise("元"), F.lit(" ¥"), F.col("l_quantity").cast("int").cast("string"))
    rows = V.read(spark, d, "lineitem").select(W.visible_prices(text).alias("p"))
    return rows.groupBy(F.get("p", F.lit(0))["price"].alias("price"), F.size("p").alias("n_prices")).agg(F.count("*").alias("n"))


def region_verify(spark, d):
    """Whether the nation or region that a customer asks for is what an order's supplier page would show."""
    nation = V.read(spark, d, "nation").join(V.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = V.read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    shown = nation.select(F.col("n_nationkey").alias("shown_key"), F.concat_ws(" ", "n_name", "r_name").alias("shown"))
    j = c.join(shown, F.col("c_custkey") % 25 == F.col("shown_key"), "left")
    out = j.select(R.verified(F.lit(""), F.col("n_name"), F.col("r_name"), F.col("shown"), F.lit(True)).alias("v"))
    return out.groupBy(F.col("v.ok").alias("ok"), F.col("v.match").alias("match")).agg(F.count("*").alias("n"))


def region_hints(spark, d):
    """Price and supplier regions that a supplier's page names."""
    s = V.read(spark, d, "supplier").join(V.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    price = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("报价地区："), "n_name", F.lit("，"))).otherwise("")
    text = F.concat(price, F.lit("发货地: "), F.lit("N"), F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", R.hints(text).alias("h")).select("s_suppkey", "h.source_price_region", "h.supplier_region")


def alias_names(spark, d):
    """Other names of parts that begin and end alike, four at most."""
    names = V.items(spark, d).select("name", F.concat(F.substring("name", 1, 2), F.substring("name", -1, 1)).alias("cluster"))
    return N.aliases(names).select("name", F.array_join("aliases", "|").alias("aliases"))


QUERIES = {f.__name__: f for f in (fallback_items, visible_prices, region_verify, region_hints, alias_names)}
ORACLE = {
    "alias_names": f"""WITH {V.ITEMS}, c AS (SELECT DISTINCT name, substring(name, 1, 2) || right(name, 1) AS cluster FROM items),
g AS (SELECT cluster, list_sort(list(name)) AS known FROM c GROUP BY 1)
SELECT name, array_to_string(list_filter(known, lambda x: x <> name)[1:4], '|') AS aliases FROM c JOIN g USING (cluster)""",
    "fallback_items": f"""WITH {V.ITEMS}, {V.OFFERS}, n AS (SELECT item_id, count(*) AS n_formal FROM offers WHERE tax_mode = 'tax_incl' GROUP BY 1)
SELECT item_id, COALESCE(n_formal, 0) AS n_formal FROM items LEFT JOIN n USING (item_id) WHERE brand <> 'Brand#11' AND COALESCE(n_formal, 0) < 3""",
    "visible_prices": """WITH p AS (SELECT CAST(l_linenumber * CASE WHEN l_returnflag = 'A' THEN 10000 ELSE 1 END AS DOUBLE) AS price, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS marked FROM lineitem)
SELECT price, CAST(CASE WHEN price = marked THEN 1 ELSE 2 END AS INTEGER) AS n_prices, count(*) AS n FROM p GROUP BY 1, 2""",
    "region_verify": """WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
j AS (SELECT a.n_name AS city, a.r_name AS province, b.n_name || ' ' || b.r_name AS shown FROM customer LEFT JOIN n a ON c_nationkey = a.n_nationkey LEFT JOIN n b ON c_custkey % 25 = b.n_nationkey),
m AS (SELECT CASE WHEN contains(shown, city) THEN 'exact' WHEN contains(shown, province) THEN 'province' ELSE 'mismatch' END AS match FROM j)
SELECT match <> 'mismatch' AS ok, match, count(*) AS n FROM m GROUP BY 1, 2""",
    "region_hints": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE '' END AS source_price_region, 'N' || CAST(s_nationkey AS VARCHAR) AS supplier_region FROM supplier JOIN nation ON s_nationkey = n_nationkey",
}
