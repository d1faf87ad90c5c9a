"""Ranking by what an offer shows of its item: the specification first, the price last.

``wanted`` reads an item once: product noun, model code, bore, section and hard values. ``shown`` compares an offer's texts with it. The order is:
name shown, no other bore or section than the item's, model, bore and section shown, hard values shown, evidence, score, band of the
submitted price, price without tax. Texts that are missing count as empty, items without a specification want nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import price as P
from bidloom.functions import text as T
from bidloom.operators import match as M

# What counts as a hard value of a specification.
HARD = (r"(?i)(?:AC|DC)\s*\d+(?:\.\d+)?\s*V", r"(?i)\d+(?:\.\d+)?\s*W(?:\s*[/／]\s*(?:m|米))?", r"(?i)IP\s*\d{2}", r"(?i)\d{3,5}\s*K", r"(?i)PN\s*\d+")
BORE, SECTION, MODEL = r"(?iu)(?:DN|φ)\s*(\d+)", r"(?<!\d)(\d{2,5})\s*[xX×*]\s*(\d{2,5})", r"(?i)[A-Za-z]{1,8}\d{2,}[A-Za-z0-9\-]*"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def wanted(name: Column, spec: Column) -> Column:
    """``struct(core, words, model, bore, section, hard)`` of an item."""
    name, spec = _text(name), _text(spec)
    both = F.concat(name, F.lit(" "), spec)
    hard = F.flatten(F.array(*[F.transform(M.every(spec, p), lambda x: F.lower(_bare(x))) for p in HARD]))
    return F.struct(
        M.core_name(name).alias("core"), F.slice(M.every(name, f"[{T.CJK}]{{2,}}"), 1, 3).alias("words"), F.lower(F.regexp_extract(both, MODEL, 0)).alias("model"),
        F.regexp_extract(both, r"(?iu)(?:DN|φ)\s*(\d{2,4})(?!\d)", 1).alias("bore"),
        F.filter(F.array(F.regexp_extract(both, SECTION, 1), F.regexp_extract(both, SECTION, 2)), lambda x: x != "").alias("section"), hard.alias("hard"),
    )


def shown(want: Column, title: Column, *texts: Column) -> Column:
    """``struct(name_miss, wrong_size, id_hits, hard_cover)`` of an offer beside ``wanted`` of its item."""
    title = _text(title)
    blob = F.concat_ws(" ", title, *map(_text, texts))
    low = F.lower(blob)
    core, words = want["core"], want["words"]
    plain = F.regexp_replace(low, f"[^0-9a-z{T.CJK}]+", "")
    named = (core != "") & (F.contains(blob, core) | F.contains(plain, _bare(core)))
    named = named | F.exists(words, lambda w: F.contains(title, w))
    bores = M.every(blob, BORE, 1)
    model = (want["model"] != "") & F.contains(low, want["model"])
    bore = (want["bore"] != "") & F.array_contains(bores, want["bore"])
    wide = F.size(want["section"]) > 0
    section = wide & F.forall(want["section"], lambda n: F.contains(blob, n))
    wrong = ((want["bore"] != "") & (F.size(bores) > 0) & ~bore) | (wide & ~section & blob.rlike(r"\d{2,5}\s*[xX×*]\s*\d{2,5}"))
    cover = F.size(F.filter(want["hard"], lambda x: F.contains(F.replace(low, F.lit(" "), F.lit("")), x)))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct((1 - one(named)).alias("name_miss"), one(wrong).alias("wrong_size"), (one(model) + one(bore) + one(section)).alias("id_hits"), cover.alias("hard_cover"))


def keyed(offers: DataFrame) -> DataFrame:
    """``offers`` with the eight keys of the order: ``name_miss``, ``wrong_size``, ``id_hits``, ``hard_cover``, ``evidence``, ``score``, ``flag`` and ``rank_ex``.

    Columns read where there are any: name, spec and wanted of the item; title, spec_seen, detail_text, price_context, url and score of the offer."""
    has = set(offers.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    want = F.col("wanted") if "wanted" in has else wanted(text("name"), text("spec"))
    out = offers.withColumn("_want", want)
    out = out.withColumn("_shown", shown(F.col("_want"), text("title"), text("spec_seen"), text("detail_text"), text("price_context")))
    ex = P.ex_tax_for_rank(F.col("price"), F.col("tax_mode"), F.col("platform"))
    out = out.withColumns({"rank_ex": ex, **{k: F.col(f"_shown.{k}") for k in ("name_miss", "wrong_size", "id_hits", "hard_cover")}})
    read = F.when(F.trim(F.concat(text("spec_seen"), text("detail_text"))) != "", 2).otherwise(0)
    evidence = read + F.when(text("url") != "", 1).otherwise(0) + F.when(F.coalesce(F.col("price") > 0.05, F.lit(False)), 1).otherwise(0)
    out = out.withColumn("evidence", evidence).withColumn("flag", P.under_submit(F.col("rank_ex"), F.col("submit")))
    return out.drop("_want", "_shown")


def order() -> list[Column]:
    """The sort keys of ``keyed`` rows."""
    tier = F.when(F.col("flag") == "under", 0).when(F.col("flag") == "near", 1).when(F.col("flag") == "over", 3).otherwise(2)
    last = [tier, F.coalesce("rank_ex", F.lit(1e18))]
    return [F.col("name_miss"), F.col("wrong_size"), F.desc("id_hits"), F.desc("hard_cover"), F.desc("evidence"), F.desc("score"), *last]
