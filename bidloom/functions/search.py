"""Search queries of items for each kind of platform, as array columns that keep their order.

Features of an item (core name, model code, sizes, identity words, electrical values) are computed once as a
struct; queries are built from it. ``search_rows`` turns them into ``(item_id, platform, ord, query)`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom import shared
from bidloom.functions import names as N
from bidloom.functions import text as T
from bidloom.operators.match import core_name, every

# Prefixes of model codes, words of identity, materials, and brands that a prefix shows.
PREFIXES = r"(?:DS-|RG-|iDS-|HM-|JB-|MS-|LRS-|GTYQ-|ZN-|WDZN-)"
IDENTITY = "脱机 联机 无线 有线 户外 户内 室外 室内 防水 防雨 防爆 阻燃 耐火 明装 暗装".split()
MATERIALS = "304 316L 316 Q235 球墨铸铁 不锈钢 碳钢 铜".split()
# Fixed value: hard values that an alias query keeps.
HARD = r"(?iu)(?:DN|φ|PN)\s*[0-9]+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?\s*(?:W(?:/m)?|V|K|mm|MPa)|IP\s*[0-9]{2}|(?:DS-|RG-|iDS-)[A-Z0-9/\-.]+|[A-Z]{1,6}[0-9]{2,}[A-Z0-9_-]*"
SHOP_MOST, COST_MOST, LONGEST = 5, 4, 40
#: A table of platforms of more rows is refused.
PLATFORMS_MOST = 200


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def section_sizes(text: Column) -> Column:
    found = every(text, r"(?<!\d)\d{2,5}\s*[xX×*]\s*\d{2,5}(?:\s*[xX×*]\s*\d{2,5})?(?!\d)")
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s*[xX×*]\s*", "x")))


def bore_sizes(text: Column) -> Column:
    return F.array_distinct(F.transform(every(text, r"(?iu)(?:DN|φ)\s*\d{2,3}"), lambda x: F.regexp_replace(x, r"\s+", "")))


def hard_tags(name: Column, spec: Column, most: int = 8) -> Column:
    """Sizes, pressures and model codes that a query for the item must keep; φ counts as DN."""
    both = F.concat_ws(" ", name, spec)
    bores = F.transform(every(both, r"(?iu)(?:DN|φ|PN)\s*\d+(?:\.\d+)?"), lambda x: F.replace(F.upper(F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "(?u)[φΦ]", "DN")), F.lit("φ"), F.lit("DN")))
    return F.slice(F.array_distinct(F.concat(bores, section_sizes(both), every(both, rf"(?i){PREFIXES}[A-Z0-9/\-.]+"))), 1, most)


def structured(text: Column) -> Column:
    """``struct(model, diameters, dimensions, material, pressure, voltage, power)`` of a text; empty where it names none."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    model = F.coalesce(_first(s, rf"(?i)(?:{PREFIXES}|XZP)[A-Z0-9/\-.]+"), _first(s, r"(?i)\b([A-Z]{1,6}\d{2,}[A-Z0-9\-_/.]*)\b", 1), F.lit(""))
    bores = F.array_distinct(F.transform(every(s, r"(?iu)(?:DN|φ)\s*(\d{2,4})", 1), lambda x: F.concat(F.lit("DN"), x)))
    material = F.coalesce(*[F.when(F.contains(s, F.lit(m)), m) for m in MATERIALS], F.lit(""))
    pressure = F.coalesce(F.concat(F.lit("PN"), _first(s, r"(?i)PN\s*(\d+(?:\.\d+)?)", 1)), F.lit(""))
    voltage = F.coalesce(F.concat(_first(s, r"(?i)(\d+(?:\.\d+)?)\s*V\b", 1), F.lit("V")), F.lit(""))
    power = F.regexp_replace(F.regexp_extract(s, r"(?i)\d+(?:\.\d+)?\s*(?:kW|W)\b", 0), r"\s+", "")
    return F.struct(
        F.when(F.length(model) >= 4, model).otherwise("").alias("model"), bores.alias("diameters"), section_sizes(s).alias("dimensions"), material.alias("material"),
        pressure.alias("pressure"), voltage.alias("voltage"), power.alias("power"),
    )


def features(name: Column, spec: Column, brand: Column) -> Column:
    n, s, b = (F.trim(F.coalesce(c, F.lit(""))) for c in (name, spec, brand))
    both = F.concat_ws(" ", n, s)
    short = F.substring(F.trim(F.regexp_extract(n, r"^([^（(【\[]*)", 1)), 1, 28)
    model = F.coalesce(_first(both, rf"(?i){PREFIXES}[A-Z0-9/\-.]+"), _first(both, r"(?<![A-Za-z0-9])(?!(?i:DN|PN|IP)\d)[A-Z]{1,5}\d{3,}[A-Z0-9\-]*"), F.lit(""))
    known = F.when(model.rlike("(?i)^i?DS-"), "海康威视").when(model.rlike("(?i)^RG-"), "锐捷").otherwise("")
    ports = F.transform(every(both, r"\d+\s*(?:端口|通道|路)"), lambda x: F.regexp_replace(x, r"\s+", ""))
    volts = F.filter(F.array(*[F.regexp_replace(F.regexp_extract(s, p, 0), r"\s+", "") for p in (r"(?i)(?:AC|DC)\s*\d+(?:\.\d+)?\s*V", r"(?i)\d+(?:\.\d+)?\s*W\s*(?:[/／]\s*(?:m|米))?", r"(?i)IP\s*\d{2}", r"(?i)\d{3,5}\s*K")]), lambda x: x != "")
    core = core_name(short)
    return F.struct(
        F.when(core == "", short).otherwise(core).alias("core"), short.alias("short"), model.alias("model"), F.concat(bore_sizes(both), section_sizes(both)).alias("sizes"),
        F.concat(F.filter(F.array(*map(F.lit, IDENTITY)), lambda w: F.contains(both, w)), F.array_distinct(ports)).alias("identity"), volts.alias("electrical"),
        F.when(b != "", b).otherwise(known).alias("brand"), F.when(n.rlike("(?i)LED"), F.concat(F.lit("LED"), core)).otherwise("").alias("led"),
    )


def deduplicated(queries: Column, most: int) -> Column:
    """Queries of 2 to 40 characters with each of their words once, each query once in either case, the first few."""
    clean = F.filter(F.transform(F.filter(queries, lambda q: q.isNotNull()), T.normal_query), lambda q: F.length(q).between(2, LONGEST))
    keys = F.transform(clean, lambda q: F.lower(q))
    return F.slice(F.filter(clean, lambda q, i: F.array_position(keys, F.lower(q)) == i + 1), 1, most)


def _join(*parts: Column) -> Column:
    """The parts as one query; null if one is missing."""
    whole = F.concat_ws(" ", *parts)
    return F.when(~F.coalesce(F.greatest(*[(F.coalesce(p, F.lit("")) == "") for p in parts], F.lit(False)), F.lit(True)), whole)


def _some(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def cost_site_queries(f: Column) -> Column:
    """Name first for a wide recall, then name and hard values for precision."""
    size = F.coalesce(F.get(f["sizes"], F.lit(0)), F.lit(""))
    bare = F.when((F.length(f["core"]) >= 4) & F.contains(f["core"], F.lit("钢")) & ~F.contains(f["core"], F.lit("不锈钢")), F.regexp_replace(f["core"], "^(.*?)钢", "$1"))
    short = F.when(F.length(f["short"]) <= 16, f["short"])
    return deduplicated(F.array(
        f["core"], _join(f["model"], size), _join(f["core"], size), _join(f["core"], f["model"]), _join(f["core"], _some(f["identity"], 3)),
        _join(f["core"], _some(f["electrical"], 3)), f["led"], short, _join(f["brand"], f["core"]), bare,
    ), COST_MOST)


def shop_queries(f: Column) -> Column:
    """Brand and model first, as shop titles put them."""
    size = F.coalesce(F.get(f["sizes"], F.lit(0)), F.lit(""))
    tail = F.array_join(F.concat(F.slice(f["identity"], 1, 1), F.slice(f["electrical"], 1, 2)), " ")
    compact = F.concat_ws(" ", f["core"], F.array_join(F.concat(F.slice(f["identity"], 1, 1), F.slice(f["electrical"], 1, 3)), " "))
    return deduplicated(F.array(
        _join(f["brand"], f["model"]), f["model"], F.when(f["brand"] != "", F.trim(F.concat_ws(" ", f["brand"], f["core"], tail))), f["short"], f["led"],
        F.trim(compact), _join(f["core"], size), f["core"],
    ), SHOP_MOST)


def platform_budget(shop: Column, cost_most: int = 3, shop_most: int = 2) -> Column:
    """Queries that a platform may be asked: 1 to 3 for shops, 2 to 4 for others."""
    return F.when(shop, F.lit(max(1, min(3, shop_most or 2)))).otherwise(F.lit(max(2, min(4, cost_most or 3))))


def must_terms(name: Column, spec: Column, most: int = 12) -> Column:
    """Terms that a title must show: model codes and their longer parts, sizes, the first word of the name, one identity word."""
    both = F.concat_ws(" ", name, spec)
    models = every(both, rf"(?i){PREFIXES}[A-Z0-9/\-.]+")
    parts = F.filter(F.flatten(F.transform(models, lambda m: F.split(m, "[-/]"))), lambda p: F.length(p) >= 4)
    words = F.filter(every(F.coalesce(name, F.lit("")), f"[{T.CJK}]{{2,8}}"), lambda w: ~w.isin(*T.STOP_WORDS))
    marks = F.filter(F.array(*map(F.lit, IDENTITY)), lambda w: F.contains(F.coalesce(spec, F.lit("")), w))
    whole = F.concat(models, parts, bore_sizes(both), F.slice(words, 1, 1), F.slice(marks, 1, 1))
    keys = F.transform(whole, lambda x: F.lower(x))
    return F.slice(F.filter(whole, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, most)


def requeries(f: Column, tried: Column, reasons: Column, most: int = 3) -> Column:
    """New queries for what failed: sizes after a size conflict, the model after a model conflict, names after a missed name."""
    why = F.array_join(reasons, "；")
    size = F.coalesce(F.get(f["sizes"], F.lit(0)), F.lit(""))
    missing, bore = why.rlike("缺少|缺失|未展示"), why.rlike("(?iu)DN|口径|通径|φ|直径|尺寸")
    model, name = F.contains(why, F.lit("型号")), why.rlike("名称.*未命中")
    when = lambda c, q: F.when(c, q)
    own = F.array(
        when(bore | missing, _join(f["core"], size)), when(bore | missing, _join(size, f["core"])), when(bore | missing, _join(f["model"], size)),
        when(model | missing, _join(f["core"], f["model"])), when(model | missing, F.nullif(f["model"], F.lit(""))), when(name, f["short"]), when(name, f["core"]), when(name, F.nullif(f["led"], F.lit(""))),
    )
    rest = F.array(_join(f["core"], size), _join(f["core"], f["model"]), _join(f["core"], F.get(f["identity"], F.lit(0))), f["short"])
    known = F.transform(tried, lambda q: F.lower(F.trim(F.regexp_replace(q, r"\s+", " "))))
    fresh = lambda qs: F.array_distinct(F.filter(qs, lambda q: q.isNotNull() & F.length(q).between(2, LONGEST) & ~F.array_contains(known, F.lower(q))))
    return F.slice(F.when(F.size(fresh(own)) > 0, fresh(own)).otherwise(fresh(rest)), 1, most)


def search_rows(items: DataFrame, platforms: DataFrame) -> DataFrame:
    """``(item_id, platform, ord, query)`` for a table ``(platform, shop)`` of at most ``PLATFORMS_MOST`` rows: queries within each platform's budget.

    Queries depend on name, specification and brand alone, so equal ones are worked out once."""
    known = platforms.select("platform", "shop").limit(PLATFORMS_MOST + 1).collect()
    if len(known) > PLATFORMS_MOST:
        raise ValueError(f"over {PLATFORMS_MOST} platforms")
    made = lambda c: c.withColumn("f", features(F.col("name"), F.col("spec"), F.col("brand"))).withColumns({"cost": cost_site_queries(F.col("f")), "shop_q": shop_queries(F.col("f"))}).drop("f")
    q = shared.by_content(items.select("item_id", "name", "spec", "brand"), ["name", "spec", "brand"], made)
    every = F.array(*[F.struct(F.lit(r.platform).alias("platform"), F.lit(bool(r.shop)).alias("shop")) for r in known])
    j = q.select("item_id", "cost", "shop_q", F.inline(every if known else F.array().cast("array<struct<platform:string,shop:boolean>>")))
    own = F.slice(F.when(F.col("shop"), F.col("shop_q")).otherwise(F.col("cost")), 1, platform_budget(F.col("shop")))
    return j.select("item_id", "platform", F.posexplode(own).alias("ord", "query"))


def with_aliases(queries: Column, name: Column, aliases: Column, most: int = 2) -> Column:
    """The queries, and after them the first aliases of the name with the hard values of the first query and the name.

    An alias query that is too long is the alias alone; one that stands already is left out. No queries stay none.
    """
    asked = F.concat_ws(" ", F.get(queries, F.lit(0)), name)
    hard = F.array_join(F.array_distinct(F.regexp_extract_all(asked, F.lit(HARD), F.lit(0))), " ")
    whole = lambda a: F.trim(F.regexp_replace(F.concat_ws(" ", a, hard), r"(?U)\s+", " "))
    some = F.slice(F.coalesce(aliases, F.array().cast("array<string>")), 1, most)
    more = F.transform(some, lambda a: F.when(F.length(whole(a)).between(2, LONGEST), whole(a)).otherwise(F.substring(a, 1, LONGEST)))
    keys = lambda xs: F.transform(xs, lambda x: F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))))
    fresh = F.filter(more, lambda q, i: ~F.array_contains(keys(queries), F.lower(q)) & (F.array_position(keys(more), F.lower(q)) == i + 1))
    return F.when(F.size(queries) > 0, F.concat(queries, fresh)).otherwise(queries)


def gap_query(family: Column, name: Column, spec: Column) -> Column:
    """A family's query with the first hard value of one of its items; null where the item has none or the query holds it."""
    main = family_query(family)
    tag = F.get(hard_tags(name, spec), F.lit(0))
    return F.when(~F.contains(F.upper(main), F.upper(tag)), F.substring(F.concat_ws(" ", main, tag), 1, 60))


def family_query(family: Column) -> Column:
    """What a family is searched by: its name without white space and sizes, at most 40 characters."""
    bare = F.regexp_replace(F.coalesce(family, F.lit("")), r"(?U)\s+", "")
    return F.substring(F.coalesce(F.nullif(F.regexp_replace(bare, r"(?i)(?:DN|PN)\d+", ""), F.lit("")), F.substring(F.coalesce(family, F.lit("")), 1, 24)), 1, 40)


def family_queries(family: Column, name: Column, spec: Column, most: int = 3) -> Column:
    """The queries of an item within its family: the family's, then the one for its own size."""
    main, gap = family_query(family), gap_query(family, name, spec)
    both = F.filter(F.array(F.nullif(main, F.lit("")), gap), lambda q: q.isNotNull())
    return F.slice(F.filter(both, lambda q, i: (i == 0) | (F.lower(q) != F.lower(both[0]))), 1, max(1, most))


def web_queries(name: Column, spec: Column, aliases: Column, most: int = 2) -> Column:
    """Queries for a search engine: the name, then confirmed aliases, then the product noun, each with the item's hard values as they are."""
    both = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(spec, F.lit("")))
    values = r"(?iu)(?:DN|φ|PN)\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?\s*(?:W(?:\s*[/／]\s*m)?|V|K|mm|MPa|kPa|A)|IP\s*\d{2}|(?:DS-|RG-|iDS-|HM-|JB-|MS-|LRS-)[A-Z0-9/\-.]+|[A-Z]{1,8}\d{2,}[A-Z0-9\-_/.]*"
    hard = F.array_join(F.slice(F.array_distinct(F.concat(F.transform(every(both, values), lambda x: F.regexp_replace(x, r"\s+", "")), section_sizes(both))), 1, 8), " ")
    short = F.trim(F.regexp_extract(F.coalesce(name, F.lit("")), r"^([^（(【\[]*)", 1))
    core = core_name(name)
    made = lambda x: F.substring(T.normal_query(F.trim(F.concat_ws(" ", x, hard))), 1, 60)
    first = F.coalesce(F.nullif(short, F.lit("")), core)
    more = F.transform(F.slice(F.coalesce(aliases, F.array().cast("array<string>")), 1, 2), made)
    all_ = F.filter(F.concat(F.array(made(first)), more, F.array(F.when((core != "") & (core != first), made(core)))), lambda q: q.isNotNull() & (q != ""))
    keys = F.transform(all_, lambda x: F.lower(x))
    return F.slice(F.filter(all_, lambda q, i: F.array_position(keys, F.lower(q)) == i + 1), 1, most)


def sound_queries(offered: Column, name: Column, spec: Column, tried: Column, most: int = 2) -> Column:
    """Proposed queries that may be asked: 2 to 40 characters, not tried, without model codes that the item does not name.

    A query that has lost the item's first bore, model or section gets it back where that keeps it short enough.
    """
    blob = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(spec, F.lit(""))))
    anchors = N.query_anchors(name, spec)
    low = lambda xs: F.transform(xs, lambda x: F.lower(x))
    own = F.filter(F.transform(F.coalesce(offered, F.array().cast("array<string>")), T.normal_query), lambda q: F.length(q).between(2, LONGEST))
    invented = lambda q: F.exists(every(q, r"(?i)(?:DS-|RG-|iDS-)[A-Z0-9/\-.]+|[A-Z]{2,6}\d{2,}[A-Z0-9\-_]*"), lambda m: ~F.contains(blob, F.lower(m)) & ~F.array_contains(low(anchors), F.lower(m)))
    lost = lambda q: F.get(F.filter(F.slice(anchors, 1, 2), lambda a: ~F.contains(F.lower(q), F.lower(a)) & F.contains(blob, F.lower(a))), F.lit(0))
    held = lambda q: F.coalesce(F.when(F.length(F.concat_ws(" ", q, lost(q))) <= LONGEST, T.normal_query(F.concat_ws(" ", q, lost(q)))), q)
    good = F.transform(F.filter(own, lambda q: ~invented(q)), held)
    known, keys = low(F.transform(F.coalesce(tried, F.array().cast("array<string>")), T.normal_query)), low(good)
    return F.slice(F.filter(good, lambda q, i: ~F.array_contains(known, F.lower(q)) & (F.array_position(keys, F.lower(q)) == i + 1)), 1, most)
