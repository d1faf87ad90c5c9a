"""Is an offer's name the item's? What rules and a store of confirmed names say, and what follows for specification and quote.

``decide`` works on the distinct pairs of names, so a pair that stands in a third of all rows is decided once; its verdict comes back by a join.
Decisions: ``same``, ``different`` or ``unknown``; sources: ``rule``, ``local_alias``, ``local_negative`` or ``cache``. Blank names are unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import names as N
from bidloom.functions import search as S
from bidloom.functions import text as T
from bidloom.operators import buckets as B
from bidloom.operators import match as M

# What makes a missing or conflicting condition a hard one.
HARD_WORDS = (
    "型号", "尺寸", "口径", "通径", "电压", "功率", "色温", "角度", "防护等级", "端口", "通道", "压力", "流量", "容量", "单位", "DN", "φ", "PN",
)


def _list(texts: Column) -> Column:
    return F.coalesce(texts, F.array().cast("array<string>"))


def allows_quote(decision: Column) -> Column:
    """Only a confirmed name may become a formal quote."""
    return F.lower(F.trim(F.coalesce(decision, F.lit("")))) == "same"


def allows_spec(decision: Column) -> Column:
    """A name known to be another product is not looked at further."""
    return F.lower(F.trim(F.coalesce(decision, F.lit("")))) != "different"


def _hard(text: Column) -> Column:
    return text.rlike(rf"(?iu)(?<!品)\d|{'|'.join(HARD_WORDS)}|IP\s*\d")


def only_semantic(missing: Column) -> Column:
    """Whether nothing that is missing is a hard specification: names may be judged by meaning, numbers and models may not."""
    return ~F.exists(_list(missing), lambda x: ~x.rlike("^品名[：:]") & _hard(x))


def hard_conflicts(conflicts: Column) -> Column:
    """Whether any conflict is about more than the name."""
    other = F.exists(_list(conflicts), lambda x: ~F.contains(x, F.lit("名称未命中")) & (_hard(x) | F.contains(x, F.lit("冲突"))))
    return B.hard_conflict(conflicts) | other


def store(confirmed: DataFrame) -> DataFrame:
    """``(lo, hi)``: pairs of names ``(a, b)`` by key, whichever stands first, each once."""
    a, b = N.name_key(F.col("a")), N.name_key(F.col("b"))
    return confirmed.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> '' and lo <> hi").distinct()


def decide(pairs: DataFrame, positive: DataFrame, negative: DataFrame, cache: DataFrame | None = None, name: str = "name", title: str = "title") -> DataFrame:
    """``pairs`` with ``decision`` and ``source`` of each (name, title); the stores are tables ``(a, b)``, the cache ``(pair_key, decision)``.

    A rule that finds the names alike beats the stores, a denial beats a confirmation, both beat the cache.
    """
    key = N.pair_key(F.col(name), F.col(title))
    each = pairs.select(F.col(name).alias("own name"), F.col(title).alias("own title")).distinct()
    a, b = N.name_key(F.col("own name")), N.title_key(F.col("own title"))
    each = each.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b), "pair_key": N.pair_key(F.col("own name"), F.col("own title"))})
    each = each.join(store(positive).withColumn("yes", F.lit(True)), ["lo", "hi"], "left").join(store(negative).withColumn("no", F.lit(True)), ["lo", "hi"], "left")
    known = cache.groupBy("pair_key").agg(F.max("decision").alias("known")) if cache is not None else None
    each = each.join(known, "pair_key", "left") if known is not None else each.withColumn("known", F.lit(None).cast("string"))
    blank = (F.trim(F.coalesce("own name", F.lit(""))) == "") | (F.trim(F.coalesce("own title", F.lit(""))) == "")
    alike = T.soft_same_product(F.col("own name"), F.col("own title")) | (F.col("lo") == F.col("hi"))
    made = lambda d, s: F.struct(d.alias("decision"), F.lit(s).alias("source"))
    verdict = (
        F.when(blank, made(F.lit("unknown"), "")).when(alike, made(F.lit("same"), "rule")).when(F.col("no"), made(F.lit("different"), "local_negative"))
        .when(F.col("yes"), made(F.lit("same"), "local_alias")).when(F.col("known").isNotNull(), made(F.col("known"), "cache")).otherwise(made(F.lit("unknown"), ""))
    )
    each = each.select("own name", "own title", verdict.alias("v"))
    same = pairs[name].eqNullSafe(each["own name"]) & pairs[title].eqNullSafe(each["own title"])
    return pairs.join(each, same, "left").select(*pairs.columns, key.alias("pair_key"), F.col("v.decision").alias("decision"), F.col("v.source").alias("source"))


def remembered(decided: DataFrame) -> DataFrame:
    """``(pair_key, decision)`` worth keeping in a cache: unknown is never kept."""
    return decided.where(F.col("decision").isin("same", "different")).groupBy("pair_key").agg(F.max("decision").alias("decision"))


def judged(decided: DataFrame, name: str = "name", spec: str = "spec", title: str = "title", text: str = "text", spec_seen: str = "spec_seen") -> DataFrame:
    """``decided`` rows through the formal gate, with ``structured`` (what the offer says of itself) and ``skip``.

    A different name is rejected without a look at its specification. A confirmed one is matched with the item's own name
    beside the offer's text, so that only the specification can fail; it scores 0.9 at least where all is well. A hard conflict rejects.
    """
    own = decided.withColumn("all text", F.when(allows_quote(F.col("decision")), F.concat_ws(" ", name, title, text)).otherwise(F.col(text)))
    open_ = M.matched(own.where(allows_spec(F.col("decision"))), name, spec, title, "all text", spec_seen)
    hard = F.size("conflicts") > 0
    sure = allows_quote(F.col("decision")) & F.col("ok")
    open_ = open_.withColumns({
        "outcome": F.when(hard, "reject").otherwise(F.col("outcome")), "ok": F.col("ok") & ~hard, "score": F.when(sure & ~hard, F.greatest("score", F.lit(0.9))).otherwise(F.col("score")),
        "structured": S.structured(F.concat_ws(" ", title, spec_seen, text)), "skip": F.lit(""),
    })
    shut = own.where(~allows_spec(F.col("decision")))
    known = {"name_ok": F.lit(False), "outcome": F.lit("reject"), "ok": F.lit(False), "score": F.lit(0.0), "conflicts": F.array(F.lit("名称不同物")), "skip": F.lit("name_different")}
    rest = [f for f in open_.schema if f.name not in own.columns]
    shut = shut.select(*own.columns, *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rest])
    return open_.select(*own.columns, *[f.name for f in rest]).unionByName(shut).drop("all text")
