"""What a job leaves behind: diagnoses of items, counts of scopes, counters, history, the store of confirmed names, candidate records.

Tables in, tables out; a store is two tables of edges, and confirming a name is a union and an anti join on their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import names as N
from bidloom.functions import price as P
from bidloom.operators import region as R
from bidloom.sources import responses as A

# Counters and times of a run.
COUNTERS = (
    "query_count", "candidate_count", "detail_open_count", "cache_hits", "region_switch_count", "region_verify_ok", "region_verify_fail", "llm_calls", "tokens",
    "accepted", "review", "rejected",
)
TIMES = ("name_match_ms", "spec_match_ms", "search_ms", "detail_ms", "total_ms")
SOURCE_LISTS = ("quote_list", "review_list", "market_list", "web_list", "supplier_list")
SHARED_FILES = ("evidence.json", "result.xlsx", "rfq.xlsx")
# Whether a platform's pages offer a choice of region, and of what.
CAPABILITIES = {
    "guangcai": (True, "province,city"), "huixun": (True, "province,city"), "lingcai": (True, "province,city"), "yize": (False, "city"), "zaojiatong": (True, "province,city"),
    "jd": (True, "province,city,district"), "1688": (False, "province,city"), "baidu_web": (False, ""),
}


def diagnoses(statuses: DataFrame, reasons: DataFrame, attempts: DataFrame) -> DataFrame:
    """``(item_id, status, fail_reason, hint, n_quotes, n_attempts)``; an item without any attempt had no result of a platform.

    statuses: ``(item_id, status, n_quotes)`` with an ``error`` or not; reasons: ``(item_id, reason)``.
    """
    n = attempts.groupBy("item_id").agg(F.count("*").alias("n_attempts"))
    error = F.coalesce(F.col("error"), F.lit("")) if "error" in statuses.columns else F.lit("")
    j = statuses.join(reasons.select("item_id", "reason"), "item_id", "left").join(n, "item_id", "left")
    why = F.coalesce("reason", F.lit("平台没有结果"))
    hint = F.coalesce(F.nullif(error, F.lit("")), F.when(F.col("n_attempts").isNull(), "未执行或无结果"), why)
    return j.select("item_id", "status", why.alias("fail_reason"), hint.alias("hint"), "n_quotes", F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"))


def sheet_counts(items: DataFrame, sheet: str = "sheet") -> DataFrame:
    """``(sheet, count)`` of the items of each sheet; those without one stand under one name."""
    return items.groupBy(F.coalesce(F.nullif(F.col(sheet), F.lit("")), F.lit("(未命名)")).alias("sheet")).agg(F.count("*").alias("count"))


def selected_count(items: DataFrame, mode: str = "all", n: int = 0, sheets: tuple[str, ...] = (), sheet: str = "sheet") -> DataFrame:
    """One row ``(selected)``: how many items a scope holds; the first n of none are all."""
    if mode == "sheets":
        return items.agg(F.count_if(F.col(sheet).isin(*sheets)).alias("selected"))
    return items.agg((F.least(F.count("*"), F.lit(n)) if mode == "first_n" and n > 0 else F.count("*")).alias("selected"))


def counters(events: DataFrame) -> DataFrame:
    """``(key, …)`` of counter events ``(key, field, n)``: sums of every counter and time by key, and a row of all, whose key is null.

    Counters take whole numbers, times are rounded to three digits; other fields do not count.
    """
    total = lambda f: F.coalesce(F.sum(F.when(F.col("field") == f, F.col("n"))), F.lit(0.0))
    known = events.where(F.col("field").isin(*COUNTERS, *TIMES))
    return known.rollup("key").agg(*[total(f).cast("long").alias(f) for f in COUNTERS], *[F.round(total(f), 3).alias(f) for f in TIMES])


def usage_by_role(calls: DataFrame) -> DataFrame:
    """``(role, calls, failed, prompt, completion, total)`` of calls ``(role, ok, prompt, completion, total)``; a missing total is the sum of its parts."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = F.when(zero("total") == 0, zero("prompt") + zero("completion")).otherwise(zero("total"))
    return calls.groupBy("role").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum(zero("prompt")).alias("prompt"), F.sum(zero("completion")).alias("completion"), F.sum(whole).alias("total"))


def job(history: DataFrame, job_id: str, at: str = "ts") -> DataFrame:
    """The newest record of a job; none for an unknown or blank id."""
    own = history.where((F.col("id").cast("string") == job_id.strip()) & F.lit(bool(job_id.strip())))
    rest = [c for c in history.columns if c != at]
    return own.agg(F.max(F.struct(at, *rest)).alias("r")).where("r is not null").select("r.*").select(*history.columns)


def rich_sources(row: Column) -> Column:
    """Whether a stored row (JSON) lists any source."""
    own = F.lit(False)
    for name in SOURCE_LISTS:
        own = own | ~F.coalesce(F.get_json_object(row, f"$.{name}"), F.lit("[]")).isin("[]", "null", "")
    return own


def own_evidence(run_id: Column, file: Column) -> Column:
    """Whether an evidence file is that of a run alone: its name holds the id or a part of it of six characters or more."""
    low, name = F.lower(F.trim(F.coalesce(run_id, F.lit("")))), F.lower(F.coalesce(file, F.lit("")))
    parts = F.filter(F.split(F.regexp_replace(low, "[^0-9a-z]+", "-"), "-"), lambda p: F.length(p) >= 6)
    return (low != "") & ~name.isin(*SHARED_FILES) & (F.contains(name, low) | F.exists(parts, lambda p: F.contains(name, p)))


# The store of confirmed names


def _keyed(edges: DataFrame) -> DataFrame:
    a, b = N.name_key(F.col("a")), N.name_key(F.col("b"))
    return edges.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})


def confirm(positive: DataFrame, negative: DataFrame, same: DataFrame | None = None, different: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The two tables ``(a, b)`` after confirmations: what is the same is no longer denied, what differs no longer the same.

    Blank names and names of one key confirm nothing; a pair stands once whichever name is first.
    """
    empty = positive.limit(0)
    new = {True: _keyed(same if same is not None else empty), False: _keyed(different if different is not None else empty)}
    new = {k: x.where("lo <> '' and hi <> '' and lo <> hi") for k, x in new.items()}

    def after(own: DataFrame, added: DataFrame, denied: DataFrame) -> DataFrame:
        kept = _keyed(own).unionByName(added).join(denied.select("lo", "hi"), ["lo", "hi"], "left_anti")
        return kept.groupBy("lo", "hi").agg(F.min(F.struct("a", "b")).alias("e")).select("e.a", "e.b")

    return after(positive, new[True], new[False]), after(negative, new[False], new[True])


def save_store(positive: DataFrame, negative: DataFrame, to: str) -> None:
    both = positive.select("a", "b", F.lit("same").alias("relation")).unionByName(negative.select("a", "b", F.lit("different").alias("relation")))
    both.write.mode("overwrite").json(to)


def load_store(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    own = spark.read.schema("a string, b string, relation string").json(at)
    return tuple(own.where(F.col("relation") == r).select("a", "b") for r in ("same", "different"))


# Candidates


def ship_only(text: Column) -> Column:
    """Whether a text names a place of dispatch or origin and none that a price holds for."""
    t = F.coalesce(text, F.lit(""))
    return ~t.rlike("价格适用|适用地区|报价地区") & t.rlike("发货地|厂家所在|供应商所在|所在地区")


def records(candidates: DataFrame, requested: Column) -> DataFrame:
    """Candidates with ``requested_region``, and their price and supplier regions filled from what their texts name.

    A given region stays. A price region that is only the place of dispatch is none.
    """
    text = F.concat_ws(" ", *[c for c in ("title", "spec_seen", "detail_text", "price_context", "supplier") if c in candidates.columns])
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if c in candidates.columns else F.lit(None).cast("string")
    h = R.hints(text)
    price, supplier = F.coalesce(blank("source_price_region"), h["source_price_region"], F.lit("")), F.coalesce(blank("supplier_region"), h["supplier_region"], F.lit(""))
    misread = (supplier != "") & (supplier == price) & ~text.rlike("适用|价格地区") & ship_only(text)
    return candidates.withColumns({"requested_region": requested, "source_price_region": F.when(misread, "").otherwise(price), "supplier_region": supplier})


def recovered_price(price: Column, *texts: Column) -> Column:
    """An attempt's price, or where that is a stand-in the price that its texts show."""
    return F.coalesce(F.when(P.valid_price(price), price), A.shown_price(F.concat_ws(" ", *texts))["price"])


def needs_review_of_rank(ranked: DataFrame) -> DataFrame:
    """``(item_id, needed)`` of ranked candidates ``(item_id, rank, score, flag)``: whether rules do not tell the first three apart.

    They do with fewer than four candidates, with one of the three under the submitted price, or with scores fifteen apart.
    """
    top = F.col("rank") <= 3
    spread = F.max(F.when(top, F.col("score"))) - F.min(F.when(top, F.col("score")))
    return ranked.groupBy("item_id").agg(((F.count("*") >= 4) & ~F.coalesce(F.bool_or(top & (F.col("flag") == "under")), F.lit(False)) & (spread < 15)).alias("needed"))


def unlisted(market: DataFrame, reviews: DataFrame, url: str = "url") -> DataFrame:
    """Market references whose address no review of the same item shows."""
    return market.join(reviews.select("item_id", url).distinct(), ["item_id", url], "left_anti")


def with_family(items: DataFrame, families: DataFrame, key: Column) -> DataFrame:
    """Items with their family's first member, size and shared query; an item without one keeps its row."""
    return items.withColumn("family_key", key).join(families, "family_key", "left")


def capability(platform: Column) -> Column:
    """``struct(selectable, levels)``: whether a platform lets a region be chosen, and of which levels; unknown platforms do not."""
    made = lambda ok, levels: F.struct(F.lit(ok).alias("selectable"), F.lit(levels).alias("levels"))
    own, out = N.platform_id(platform), made(False, "")
    for pid, (ok, levels) in CAPABILITIES.items():
        out = F.when(own == pid, made(ok, levels)).otherwise(out)
    return out


def platform_region(platform: Column, province: Column, city: Column, district: Column, province_code: Column, city_code: Column) -> Column:
    """``struct(platform, label, code)``: a target region as a platform is asked for it; no label where none is specified."""
    label = F.when(N.region_specified(province, city, district, province_code, city_code), N.region_display(province, city, district)).otherwise("")
    code = F.coalesce(F.nullif(city_code, F.lit("")), F.nullif(province_code, F.lit("")), F.lit(""))
    return F.struct(N.platform_id(platform).alias("platform"), label.alias("label"), code.alias("code"))
