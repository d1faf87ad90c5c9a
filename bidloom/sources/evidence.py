"""Evidence records: quotes of each item as one JSON document a row, written and read back with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE = "struct<rank:int,platform:string,supplier_id:bigint,sku:string,price:double,ex:double,vs:string>"
SCHEMA = f"item_id bigint, status string, quotes array<{QUOTE}>"


def documents(statuses: DataFrame, best: DataFrame) -> DataFrame:
    """``(item_id, evidence)``: an item's status and its ranked quotes (a few by contract) as JSON."""
    quote = F.struct("rank", "platform", "supplier_id", "sku", "price", "ex", "vs")
    per = best.groupBy("item_id").agg(F.sort_array(F.collect_list(quote)).alias("quotes"))
    j = statuses.join(per, "item_id", "left")
    empty = F.array().cast(f"array<{QUOTE}>")
    return j.select("item_id", F.to_json(F.struct("item_id", "status", F.coalesce("quotes", empty).alias("quotes"))).alias("evidence"))


def write(docs: DataFrame, to: str) -> None:
    docs.select("evidence").write.mode("overwrite").option("compression", "gzip").text(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    """Evidence as columns; a document that is not of the schema gives nulls, statuses of old names are mapped."""
    parsed = spark.read.text(at).select(F.from_json("value", SCHEMA).alias("e")).select("e.*")
    old = F.lower(F.coalesce("status", F.lit("no_match")))
    known = ("full_k", "partial", "need_review", "no_match", "error", "skipped")
    n = F.size(F.coalesce("quotes", F.array().cast(f"array<{QUOTE}>")))
    verified = F.when(n >= 3, "full_k").when(n > 0, "partial").otherwise("no_match")
    status = F.when(old == "verified", verified).when(old.isin(*known), old).when(old.startswith("fail"), "error").otherwise("no_match")
    return parsed.withColumn("status", status)
