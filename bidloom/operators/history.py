"""Job history and alias stores as tables: upsert, delete, join with evidence, clusters, and ordered search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom import shared
from bidloom.sources import pages


def upsert(base: DataFrame, updates: DataFrame, *key: str) -> DataFrame:
    """``base`` with the rows of ``updates`` in place of those of their keys. Keys of updates are distinct."""
    return base.join(updates.select(*key), list(key), "left_anti").unionByName(updates)


def delete(base: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    return base.join(ids.select(*key), list(key), "left_anti")


def hydrated(jobs: DataFrame, evidence: DataFrame, key: str, *cols: str) -> DataFrame:
    """Jobs with what they lack taken from their evidence."""
    renamed = evidence.select(key, *[F.col(c).alias(f"{c} of evidence") for c in cols])
    out = jobs.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(c, F.col(f"{c} of evidence")) for c in cols}).drop(*[f"{c} of evidence" for c in cols])


def clusters(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(name, cluster)`` of confirmed pairs: the least name that is reached; a name that is paired with itself alone is its own cluster."""
    own = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    names = own.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    found = shared.components(own).select(F.col("node").alias("name"), F.col("root").alias("cluster"))
    return names.join(found.hint("merge"), "name", "left").select("name", F.coalesce("cluster", "name").alias("cluster"))


def kept_hits(hits: Column, most: int = 5) -> Column:
    """A query's search hits ``array<struct<url, title>>`` in order, cleared of blocked sources and of repeated addresses
    and titles, best quality first. A hit dropped for its title does not register its address: an ordered fold."""
    empty = F.struct(F.array().cast("array<string>").alias("urls"), F.array().cast("array<string>").alias("titles"), F.array().cast("array<struct<q:int,i:int,url:string,title:string>>").alias("out"))
    rank = lambda u: F.when(pages.quality(u) == "high", 0).when(pages.quality(u) == "medium", 1).otherwise(2)

    def step(acc: Column, h: Column) -> Column:
        url, title = F.lower(F.regexp_extract(h["url"], "^([^#]*)", 1)), F.lower(F.trim(h["title"]))
        fresh_url = ~F.array_contains(acc["urls"], url) & (pages.quality(h["url"]) != "block")
        fresh = fresh_url & ~((title != "") & F.array_contains(acc["titles"], title))
        row = F.struct(rank(h["url"]).alias("q"), F.size(acc["out"]).alias("i"), h["url"].alias("url"), h["title"].alias("title"))
        return F.when(
            fresh, F.struct(F.concat(acc["urls"], F.array(url)).alias("urls"), F.concat(acc["titles"], F.array(title)).alias("titles"), F.concat(acc["out"], F.array(row)).alias("out"))
        ).otherwise(acc)

    kept = F.aggregate(hits, empty, step, lambda acc: acc["out"])
    return F.slice(F.transform(F.array_sort(kept), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))), 1, most)
