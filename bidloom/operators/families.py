"""Families of items that share searches, name pairs, alias clusters and blocked name matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.functions import text as T


def families(items: DataFrame) -> DataFrame:
    """Items by (name, region): first member, number of members, distinct sizes, and the shared query."""
    key = F.concat_ws("|", F.lower("name"), F.col("region"))
    grouped = items.groupBy(key.alias("family_key")).agg(
        F.min("item_id").alias("first_item"), F.count("*").alias("members"), F.countDistinct("spec").alias("sizes"), F.min("name").alias("main_query")
    )
    return grouped


def shared_queries(items: DataFrame) -> DataFrame:
    """Queries that each family saves by asking once for its name and once for each size."""
    key = F.concat_ws("|", F.lower("name"), F.col("region"))
    return items.groupBy(key.alias("family_key")).agg(
        (2 * F.count("*")).alias("alone"), (1 + F.countDistinct("spec")).alias("shared")
    )


def name_pairs(items: DataFrame, same_length: bool = False) -> DataFrame:
    """``(name_a, name_b)``: names that share a word, each with the least name of that word's class.

    A class of n names gives n - 1 pairs, so a word in a third of all names does not give all of their pairs; names hang together by their
    classes' least names. ``same_length`` makes classes of a word and a length.
    """
    words = items.select("name").distinct().select("name", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("word"))
    key = ["word", "size"] if same_length else ["word"]
    words = words.withColumn("size", F.length("name")).select("name", *key)
    least = words.groupBy(*key).agg(F.min("name").alias("name_a"))
    return words.join(least, key).where("name_a < name").select("name_a", F.col("name").alias("name_b")).distinct()


def gray_pairs(pairs: DataFrame, least: float = 0.45) -> DataFrame:
    """Pairs with the Dice coefficient of their characters, and whether a person should review them."""
    chars = lambda c: F.split(F.replace(F.lower(c), F.lit(" "), F.lit("")), "")
    joined = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    d = T.dice(chars(F.col("name_a")), chars(F.col("name_b")))
    shared = F.size(F.array_intersect(T.bigrams(joined(F.col("name_a"))), T.bigrams(joined(F.col("name_b")))))
    return pairs.withColumn("dice", d).withColumn("shared_bigrams", shared).withColumn("gray", (F.col("dice") >= least) | (F.col("shared_bigrams") > 0))


def lookup(pairs: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """The known relation of pairs: different beats same, and pairs in neither table are unknown."""
    key = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    own = pairs.select(*pairs.columns, *key("name_a", "name_b"))
    pos = positive.select(*key("a", "b")).distinct().withColumn("pos", F.lit(True))
    neg = negative.select(*key("a", "b")).distinct().withColumn("neg", F.lit(True))
    out = own.join(pos, ["lo", "hi"], "left").join(neg, ["lo", "hi"], "left")
    relation = F.when(F.col("lo") == F.col("hi"), "same").when(F.col("neg"), "different").when(F.col("pos"), "same").otherwise("unknown")
    return out.withColumn("relation", relation).select(*pairs.columns, "relation")


def aliases(clusters: DataFrame, most: int = 4) -> DataFrame:
    """``(name, aliases)``: up to ``most`` other spellings of each name of ``(name, cluster)``, in order.

    Each cluster's first ``most + 1`` spellings serve all of its names, so no pairs within a cluster are made.
    """
    names = clusters.select("name", "cluster").where("name is not null").distinct()
    first = names.withColumn("n", F.row_number().over(W.partitionBy("cluster").orderBy("name"))).where(F.col("n") <= most + 1)
    first = first.groupBy("cluster").agg(F.sort_array(F.collect_list("name")).alias("known"))
    others = F.slice(F.filter("known", lambda x: x != F.col("name")), 1, most)
    return names.join(first, "cluster").select("name", others.alias("aliases"))
