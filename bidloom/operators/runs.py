"""Records of runs: what a stored job still shows, counts by sheet, candidates with the asked section first, target regions, required words, run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.functions import names as N
from bidloom.functions import search as S
from bidloom.functions import text as T
from bidloom.operators import match as M
from bidloom.operators import ranking as R
from bidloom.operators import region as G
from bidloom.sources import pages

STRATEGIES = ("strict_city", "allow_province", "national_reference")
# Fixed value: how a row's message tells the number of supplier leads.
LEADS = r"供应商线索\s*\d+\s*条"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def sound_sources(row: Column) -> Column:
    """A stored row ``struct<…, web_list, supplier_list, message>`` without web quotes that have no price and without leads that name nobody or stand on a blocked page.

    Quotes are structs with ``price``; leads with ``supplier``, ``phone``, ``contact``, ``detail_url``, ``url`` and ``title``. The message tells the leads that are left."""
    none = lambda c: F.filter(c, lambda x: x.isNotNull())
    web = F.filter(none(row["web_list"]), lambda q: F.coalesce(q["price"].cast("double") > 0.05, F.lit(False)))
    address = lambda q: F.when(_text(q["detail_url"]) != "", _text(q["detail_url"])).otherwise(_text(q["url"]))
    named = lambda q: F.concat(_text(q["supplier"]), _text(q["phone"]), _text(q["contact"])) != ""
    open_ = lambda q: (address(q) == "") | (pages.quality(address(q)) != "block")
    leads = F.filter(none(row["supplier_list"]), lambda q: named(q) & open_(q))
    n = F.greatest(F.coalesce(F.size(leads), F.lit(0)), F.lit(0))
    message = F.coalesce(row["message"], F.lit(""))
    told = F.when(n > 0, F.regexp_replace(message, F.lit(LEADS), F.concat(F.lit("供应商线索"), n.cast("string"), F.lit("条")))).otherwise(F.regexp_replace(message, rf"[；;]?\s*{LEADS}", ""))
    return row.withField("web_list", web).withField("supplier_list", leads).withField("message", F.trim(told))


def sound_jobs(jobs: DataFrame, rows: str = "item_results") -> DataFrame:
    """Stored jobs as they are shown: ``sound_sources`` of each of their rows. Nothing that is stored changes."""
    return jobs.withColumn(rows, F.transform(F.coalesce(F.col(rows), F.array().cast(jobs.schema[rows].dataType)), sound_sources))


def counts_by_sheet(items: DataFrame) -> DataFrame:
    """``(sheet, count, full_k, partial, need_review, no_match)``; errors and skipped items count as no match, sheets without a name as one."""
    sheet = F.when(_text(F.col("sheet")) == "", "（未命名表）").otherwise(F.col("sheet")).alias("sheet")
    status = F.col("status")
    each = [F.count_if(status == s).alias(s) for s in ("full_k", "partial", "need_review")]
    return items.groupBy(sheet).agg(F.count("*").alias("count"), *each, F.count_if(status.isin("no_match", "error", "skipped")).alias("no_match"))


def sections_first(candidates: DataFrame, group: tuple[str, ...] = ("item_id", "platform")) -> DataFrame:
    """The candidates of a search that are looked at, with ``place``: those that show the item's section first, then by score.

    Columns: name and spec, title, spec_seen, detail_text (may be missing), score, ``inline`` (its price stands in the list), ``n_quotes`` (formal quotes that the item has).
    Three or more inline candidates need no page to be opened, so more are looked at: 6, or 8 of an item with a section. Else 2 are, or 3, and
    one fewer once there is a quote."""
    has = set(candidates.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    both = F.concat_ws(" ", text("name"), text("spec"))
    asked = F.filter(F.array(F.regexp_extract(both, R.SECTION, 1), F.regexp_extract(both, R.SECTION, 2)), lambda x: x != "")
    blob = F.concat_ws(" ", text("title"), text("spec_seen"), text("detail_text"))
    own = candidates.withColumns({"_wide": both.rlike(r"\d{2,5}\s*[xX×*]\s*\d{2,5}"), "section_hits": F.size(F.filter(asked, lambda n: F.contains(blob, n)))})
    inline = own.groupBy(*group).agg(F.count_if(F.coalesce("inline", F.lit(False))).alias("_inline"))
    order = W.partitionBy(*group).orderBy(F.desc("section_hits"), F.desc(F.coalesce("score", F.lit(0.0))), *[c for c in ("sku", "price") if c in has])
    most = F.when(F.col("_inline") >= 3, F.when(F.col("_wide"), 8).otherwise(6)).otherwise(F.when(F.col("_wide"), 3).otherwise(2) - (F.coalesce("n_quotes", F.lit(0)) > 0).cast("int"))
    first = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 8)  # cut down before groups meet
    return first.join(inline, list(group)).where(F.col("place") <= most).drop("_wide", "_inline")


def target_region(item: Column | None, raw: Column, task: Column | None, default: Column | None, strategy: Column) -> Column:
    """``struct(province, city, district, source, strategy)``: the region that prices of an item must hold for.

    Its row's own region, its row's text, the task's, the user's, else none; regions are structs of province, city, district and their codes, and
    count where any of them is given. An unknown strategy is the strictest."""
    known = F.lower(_text(strategy))
    chosen = F.when(known.isin(*STRATEGIES), known).otherwise(STRATEGIES[0])

    def made(r: Column, source: str) -> Column:
        return F.struct(*[F.coalesce(r[c], F.lit("")).alias(c) for c in ("province", "city", "district")], F.lit(source).alias("source"), chosen.alias("strategy"))

    fields = ("province", "city", "district", "province_code", "city_code")
    given = lambda r: F.coalesce(N.region_specified(*[r[c] for c in fields]), F.lit(False))
    parsed = G.parse_region(raw)
    read = F.struct(parsed["province"].alias("province"), parsed["city"].alias("city"), F.lit("").alias("district"))
    found = [F.when(given(r), made(r, s)) for r, s in ((item, "excel_row"),) if r is not None]
    found.append(F.when(_text(raw) != "", made(read, "excel_row")))
    found += [F.when(given(r), made(r, s)) for r, s in ((task, "task"), (default, "user_default")) if r is not None]
    nothing = F.struct(*[F.lit("").alias(c) for c in ("province", "city", "district")])
    return F.coalesce(*found, made(nothing, "unspecified"))


def _first_of(words: Column) -> Column:
    """Words whose normal form is two characters or more, each form once."""
    held = lambda w: F.transform(w, lambda x: F.struct(x.alias("w"), T.norm(x).alias("k")))
    first = lambda own, keys: F.filter(own, lambda x, i: (F.length(x["k"]) >= 2) & (F.array_position(keys, x["k"]) == i + 1))
    return F.transform(T.let(held(words), lambda own: T.let(F.transform(own, lambda x: x["k"]), lambda keys: first(own, keys))), lambda x: x["w"])


def name_words(name: Column) -> Column:
    """Up to four words that must stand in an offer of the product: its noun, other CJK words, codes; longest first, none that a longer one holds."""

    def words(bare: Column, core: Column) -> Column:
        other = F.when(F.contains(core, F.lit("线型")), F.replace(core, F.lit("线型"), F.lit("线形"))).when(F.contains(core, F.lit("线形")), F.replace(core, F.lit("线形"), F.lit("线型")))
        forms = F.array(core, F.when(F.startswith(core, F.lit("型")), F.substring(core, 2, 100)), other)
        runs = F.filter(M.every(bare, f"[{T.CJK}]{{2,10}}"), lambda w: ~((core != "") & F.contains(w, core)) & ~w.rlike("(?:长度|宽度|高度|厚度|尺寸)$"))
        codes = F.filter(M.every(bare, r"(?i)[A-Za-z]{1,6}\d{2,}[A-Za-z0-9\-]*"), lambda w: F.length(w) >= 4)
        found = F.filter(F.concat(forms, runs, codes), lambda w: F.coalesce(w != "", F.lit(False)) & ~w.isin(*T.STOP_WORDS))
        return F.array_sort(F.transform(found, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"), F.lower(w).alias("low"))))

    def kept(own: Column, name: Column) -> Column:
        left = F.filter(own, lambda x, i: ~F.exists(F.slice(own, 1, i), lambda y: F.contains(y["low"], x["low"])))
        whole = F.when(name != "", F.array(F.substring(name, 1, 6))).otherwise(F.array().cast("array<string>"))
        return T.let(F.transform(left, lambda x: x["w"]), lambda w: F.when(F.size(w) > 0, F.slice(w, 1, 4)).otherwise(whole))

    def of(own: Column) -> Column:
        bare = F.coalesce(F.nullif(T.peel_dimensions(own), F.lit("")), own)
        return T.let(bare, lambda b: T.let(M.core_name(b), lambda c: T.let(words(b, c), lambda w: kept(w, own))))

    return T.let(N.material_name(F.coalesce(name, F.lit(""))), of)


def required_tokens(spec: Column, name: Column) -> Column:
    """Up to 16 values of a specification that a page must show: codes, bores, measures, and its CJK words that the name does not have."""
    spec, both = F.coalesce(spec, F.lit("")), F.concat(F.coalesce(spec, F.lit("")), F.lit(" "), F.coalesce(name, F.lit("")))
    bare = lambda xs: F.transform(xs, lambda x: F.regexp_replace(x, r"\s+", ""))
    others = lambda known: F.filter(M.every(spec, f"[{T.CJK}]{{2,6}}"), lambda w: ~w.isin(*T.STOP_WORDS) & ~F.contains(known, w))
    found = F.concat(
        M.every(both, rf"(?i){S.PREFIXES}[A-Z0-9/\-.()]+"), bare(M.every(both, r"(?iu)(?:DN|φ)\s*\d{2,4}(?:\s*[×xX*]\s*\d+(?:\.\d+)?)?")), bare(M.every(both, r"(?i)\d+(?:\.\d+)?\s*(?:kW|W|V|mm|MPa|TB|T)")),
        M.every(both, r"(?i)[A-Z]{1,5}\d{3,}[A-Z0-9\-]*"), T.let(F.array_join(name_words(name), ""), others),
    )
    whole = F.regexp_replace(spec, r"(?U)\s+", "")
    return T.let(F.slice(_first_of(found), 1, 16), lambda kept: F.when(F.size(kept) > 0, kept).when(F.length(whole).between(2, 40), F.array(whole)).otherwise(kept))


def name_must(name: Column, spec: Column) -> Column:
    """Up to eight words that a hit must show: the name's and the first four of the specification."""
    both = F.slice(F.concat(name_words(name), F.slice(required_tokens(spec, name), 1, 4)), 1, 8)
    return T.let(both, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.substring(F.coalesce(name, F.lit("")), 1, 4))))


def run_meta(spark, run_id: str, input_path: str, platforms: list[str], k: int | None = None, mode: str = "", created_at: Column | None = None, funnel: DataFrame | None = None, stats: DataFrame | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """One row ``(run_id, meta)``, a run's record as JSON; ``funnel`` is one row, ``stats`` one row a platform. Empty parts are left out; ``extra`` comes last and replaces."""
    at = F.date_format(created_at if created_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    fields = {"run_id": F.lit(run_id), "input_path": F.lit(input_path or ""), "platforms": F.lit(list(platforms or [])) if platforms else F.array().cast("array<string>"), "k": F.lit(int(k or 3)), "mode": F.lit(mode or "practical"), "created_at": at}
    out = spark.range(1).select()
    if funnel is not None:
        out = out.join(F.broadcast(funnel.limit(1).select(F.struct("*").alias("funnel"))))
        fields["funnel"] = F.col("funnel")
    if stats is not None:
        by = stats.groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", F.struct(*[c for c in stats.columns if c != "platform"]))))).alias("platform_stats"))
        out = out.join(F.broadcast(by))
        fields["platform_stats"] = F.when(F.size("platform_stats") > 0, F.col("platform_stats"))
    fields |= {c: F.lit(v) for c, v in (extra or {}).items()}
    return out.select(F.lit(run_id).alias("run_id"), F.to_json(F.struct(*[v.alias(c) for c, v in fields.items()])).alias("meta"))


def cleared(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty history, and ``(path)`` of the files that its jobs named in ``result_path``, ``rfq_path`` and ``evidence_path``, for whoever deletes them."""
    named = [F.col(c) for c in ("result_path", "rfq_path", "evidence_path") if c in history.columns]
    paths = history.select(F.explode(F.array(*named)).alias("path")) if named else history.select(F.lit("").alias("path"))
    return history.where("false"), paths.where("path <> ''").distinct()


def save_items(items: DataFrame, to: str) -> None:
    """Items as JSON, one a line, null fields told."""
    items.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(to)
