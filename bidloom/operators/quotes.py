"""Quotes: tax columns, merging of duplicates, top-K, status, audit, review, waterfall and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.functions import price as P
from bidloom.operators import ranking
from bidloom.operators.views import KEEP_FIRST, SHOPS

K = 3


def with_tax(offers: DataFrame) -> DataFrame:
    return offers.withColumn("ex", P.ex_tax(F.col("price"), F.col("tax_mode"), F.col("platform")))


def with_relation(offers: DataFrame, items: DataFrame) -> DataFrame:
    """Offers with the item's submitted price, their price without tax and its relation to that."""
    joined = with_tax(offers).join(items.select("item_id", "submit"), "item_id")
    return joined.withColumn("vs", P.vs_submit(F.col("ex"), F.col("submit")))


def price_key(price: Column) -> Column:
    """Prices that agree to four decimals have one key."""
    return F.floor(price * 10000 + 0.5)


def deduplicated(quotes: DataFrame) -> DataFrame:
    """One quote of each (item, platform, sku, supplier, price): the first in ``KEEP_FIRST`` order.

    An aggregation with partial sums on the map side, not a window: hot items shrink before they move.
    """
    rest = [c for c in quotes.columns if c not in KEEP_FIRST and c not in ("item_id", "platform", "supplier_id")]
    first = F.min(F.struct(*KEEP_FIRST, *rest)).alias("q")
    keyed = quotes.groupBy("item_id", "platform", F.lower("sku").alias("identity"), "supplier_id", price_key(F.col("price")).alias("key")).agg(first)
    return keyed.select("item_id", "platform", "supplier_id", "q.*").select(*quotes.columns)


def ranked(quotes: DataFrame, *order: Column | str) -> DataFrame:
    """``quotes`` with ``rank`` within each item. The window's sort key ends with every column that breaks ties."""
    return quotes.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order, *KEEP_FIRST, "supplier_id")))


def top_k(quotes: DataFrame, k: int = K) -> DataFrame:
    """The k cheapest distinct valid quotes of each item."""
    good = deduplicated(quotes.where(P.valid_price(F.col("price"))))
    return ranked(good, "price").where(F.col("rank") <= k)


def statuses(items: DataFrame, best: DataFrame, reviews: DataFrame, k: int = K) -> DataFrame:
    """Every item with the number of its quotes and a status: full_k, partial, need_review or no_match."""
    n = best.groupBy("item_id").agg(F.count("*").alias("n_quotes"), F.min("ex").alias("best_ex"))
    r = reviews.groupBy("item_id").agg(F.count("*").alias("n_reviews"))
    out = items.join(n, "item_id", "left").join(r, "item_id", "left")
    count = F.coalesce("n_quotes", F.lit(0))
    status = F.when(count >= k, "full_k").when(count > 0, "partial").when(F.coalesce("n_reviews", F.lit(0)) > 0, "need_review").otherwise("no_match")
    return out.withColumn("n_quotes", count).withColumn("status", status)


def wide(best: DataFrame, k: int = K) -> DataFrame:
    """One row an item with the price and platform of each rank."""
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}")
    return best.groupBy("item_id").agg(*[at(c, r) for r in range(1, k + 1) for c in ("price", "platform")])


def reviews(quotes: DataFrame, limit: int = 5) -> DataFrame:
    """Priced quotes over the submitted price that a person should look at: best score, then least price without tax."""
    near = quotes.where(P.valid_price(F.col("price")) & F.col("vs").isin("near_submit", "above_submit"))
    return ranked(deduplicated(near), F.desc("score"), "ex").where(F.col("rank") <= limit)


def rule_ranked(quotes: DataFrame, n: int = 12) -> DataFrame:
    """The first n candidates of each item by the order of ``ranking``: what an offer shows, evidence, score, band of the submitted price and last the price."""
    return ranked(ranking.keyed(quotes), *ranking.order(), "price", "tax_mode").where(F.col("rank") <= n)


def waterfall(quotes: DataFrame, k: int = K) -> DataFrame:
    """What a collector keeps that asks platform after platform and stops at k formal quotes.

    A row stays while fewer than k formal quotes stand before it. Only each item's first k formal quotes are
    ranked, which tasks cut down before they are shuffled; their places then meet all rows of the
    item in a join that can be split, so an item with a third of all offers needs no sort of its own.
    """
    place = F.struct(*KEEP_FIRST, "supplier_id", "price", "tax_mode")
    own = quotes.withColumn("formal", F.col("vs").isin("below_submit", "near_submit")).withColumn("place", place)
    order = W.partitionBy("item_id").orderBy("place")
    first = own.where("formal").select("item_id", "place").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    places = first.groupBy("item_id").agg(F.collect_list("place").alias("places"))
    out = own.join(places, "item_id", "left")
    before = F.size(F.filter(F.coalesce("places", F.array().cast(places.schema["places"].dataType)), lambda p: p < F.col("place")))
    return out.withColumn("formal_before", before).where(F.col("formal_before") < k).drop("place", "places")


def market_refs(quotes: DataFrame, limit: int = 5) -> DataFrame:
    """Shop prices stand beside the quotes, the cheapest few of each item."""
    return ranked(deduplicated(quotes.where(F.col("platform").isin(*SHOPS))), "price").where(F.col("rank") <= limit)
