"""Reports over attempts: funnel, platform statistics, failure reasons, breakers and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Parts of a status that trip a platform's breaker.
TRIPS = ("rate_limited", "captcha", "need_login", "need_login_fail", "no_membership", "403", "429")


def fail_reasons(attempts: DataFrame) -> DataFrame:
    """The main reason of each item without a formal quote; empty for items that have one."""
    has = lambda x: F.contains("match_detail", F.lit(x))
    n = attempts.groupBy("item_id").agg(
        F.bool_or("formal").alias("formal"),
        F.bool_or(F.contains("status", F.lit("rate_limited"))).alias("limited"),
        F.bool_or(F.contains("status", F.lit("captcha"))).alias("captcha"),
        F.bool_or(F.contains("status", F.lit("no_membership"))).alias("login"),
        F.bool_or(F.col("match_detail") != "").alias("matched"),
        F.count_if(has("名称未命中")).alias("name_n"),
        F.count_if(has("规格冲突")).alias("conflict_n"),
        F.count_if(has("缺少")).alias("missing_n"),
        F.count_if((F.col("match_detail") != "") & (F.col("price") <= 0.05)).alias("no_price_n"),
    )
    reason = (
        F.when(F.col("formal"), "").when(F.col("limited"), "限流").when(F.col("captcha"), "验证码").when(F.col("login"), "未登录/无会员")
        .when(~F.col("matched"), "平台没有结果")
        .when((F.col("name_n") > 0) & (F.col("name_n") >= F.greatest("conflict_n", "missing_n", F.lit(1))), "名称不匹配")
        .when(F.col("conflict_n") > 0, "规格冲突").when(F.col("missing_n") > 0, "规格证据缺失").when(F.col("no_price_n") > 0, "没有数字价")
        .otherwise("其它")
    )
    return n.select("item_id", reason.alias("reason"), "name_n", "conflict_n", "missing_n")


def funnel(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: how many items were searched, had candidates, matched by name, had a formal and a priced quote."""
    n = attempts.groupBy("item_id").agg(
        F.bool_or(F.col("status") == "ok").alias("has"),
        F.bool_or(F.contains("match_detail", F.lit("名称命中"))).alias("name"),
        F.count_if("formal").alias("quotes"),
        F.bool_or(F.col("formal") & (F.col("price") > 0.05)).alias("priced"),
    )
    j = items.select("item_id").distinct().join(n.withColumn("searched", F.lit(True)), "item_id", "left")
    return j.agg(
        F.count("*").alias("items_total"), F.count_if("searched").alias("searched"), F.count_if("has").alias("has_candidates"),
        F.count_if("name").alias("name_matched"), F.count_if(F.col("quotes") > 0).alias("spec_full_match"), F.count_if("priced").alias("has_real_price"),
        F.count_if(F.col("quotes") >= 3).alias("full_k"), F.count_if((F.col("quotes") > 0) & (F.col("quotes") < 3)).alias("partial"),
        F.count_if(F.coalesce("quotes", F.lit(0)) == 0).alias("no_quote"),
    )


def platform_stats(attempts: DataFrame) -> DataFrame:
    """Per platform: distinct queries, candidates, name and spec rejects, formal hits."""
    return attempts.groupBy("platform").agg(
        F.countDistinct(F.lower("query")).alias("queries"), F.count_if(F.col("status") == "ok").alias("candidates"),
        F.count_if(F.contains("match_detail", F.lit("名称未命中"))).alias("name_reject"), F.count_if(F.contains("match_detail", F.lit("规格冲突"))).alias("spec_reject"),
        F.count_if("formal").alias("formal_hits"),
    )


def status_rollup(attempts: DataFrame) -> DataFrame:
    """Counts by platform and status with totals."""
    return attempts.rollup("platform", "status").agg(F.count("*").alias("n"), F.sum(F.col("price").cast("decimal(18,4)")).alias("total"))


def breaker_timeline(attempts: DataFrame) -> DataFrame:
    """Attempts of each platform from its first trip on, the first marked. The first trip is an aggregate of
    one row a platform that is broadcast back, so no platform is sorted in one task."""
    trips = F.lower("status").rlike("|".join(TRIPS))
    first = attempts.where(trips).groupBy("platform").agg(F.min(F.struct("ts", "ord")).alias("first"))
    out = attempts.join(F.broadcast(first), "platform").where(F.struct("ts", "ord") >= F.col("first"))
    return out.select("platform", "item_id", "ord", "ts", "status", (F.struct("ts", "ord") == F.col("first")).alias("newly_tripped"))


def consecutive_rejects(attempts: DataFrame) -> DataFrame:
    """Longest run of attempts without a formal quote for each item: gaps and islands.

    Rows are sorted by item and day; an island's number is the formal quotes before it, those of earlier days from a
    window over one row a day. Runs across days have one number and add up, so a busy item is not sorted whole in one task.
    """
    own = attempts.select("item_id", F.to_date("ts").alias("day"), "ts", "ord", F.col("formal").cast("int").alias("f"))
    days = own.groupBy("item_id", "day").agg(F.sum("f").alias("formal"))
    earlier = F.sum("formal").over(W.partitionBy("item_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    days = days.select("item_id", "day", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum("f").over(W.partitionBy("item_id", "day").orderBy("ts", "ord").rowsBetween(W.unboundedPreceding, 0))
    local = own.withColumn("inside", inside).where("f = 0").groupBy("item_id", "day", "inside").agg(F.count("*").alias("run"))
    runs = local.join(days, ["item_id", "day"]).groupBy("item_id", (F.col("before") + F.col("inside")).alias("island")).agg(F.sum("run").alias("run"))
    return runs.groupBy("item_id").agg(F.max("run").alias("longest"), F.count("*").alias("runs"))


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key: a fold as an aggregate, without a sort."""
    rest = [c for c in events.columns if c != key and c not in order]
    last = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e"), F.count("*").alias("n_events"))
    return last.select(key, "e.*", "n_events")


def keep_newest(events: DataFrame, n: int = 50) -> DataFrame:
    """The n newest events of all: a top-n report."""
    return events.orderBy(F.desc("ts"), F.desc("ord")).limit(n)
