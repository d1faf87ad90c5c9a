"""Text columns for names, specifications, units and queries. All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"

# Unit spellings and what they stand for.
UNITS = {
    "m": "米 延米 m", "m2": "平方米 ㎡ m2", "m3": "立方米 m³ m3", "kg": "千克 公斤 kg", "t": "吨 t",
    "piece": "个 只 件 台 套 组 节 根 支 块 片 set pcs pc",
}
# Words that name no product.
STOP_WORDS = "有效长度 长度 宽度 高度 厚度 口径 截面 外形尺寸 外形 规格 型号 名称 品牌 单位 数量 备注 功率 电压 色温 角度".split()


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands in there; elements of arrays would else have it worked out for each."""
    return F.transform(F.array(value), use)[0]


def collapse_cjk_spaces(text: Column) -> Column:
    """No white space between two CJK characters, single spaces elsewhere, trimmed."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s　]+", " ")
    return F.trim(F.regexp_replace(one, f"(?<=[{CJK}]) (?=[{CJK}])", ""))


def norm(text: Column) -> Column:
    """No white space, one spelling of times and diameter signs, lower case."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s　]+", "")
    return F.lower(F.translate(bare, "×Ｘ＊*Φ∅", "xxxxφφ"))


def number_text(value: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def query_part_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^0-9a-z{CJK}]+", "")


def normal_query_key(query: Column) -> Column:
    """Lower case, single spaces, and ``dn50 dn50`` as ``dn50``."""
    one = F.trim(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"(?U)\s+", " "))
    return F.regexp_replace(one, r"\b(dn\d+)(?: \1\b)+", "$1")


def normal_query(query: Column) -> Column:
    """Words of a query, each once: a fold that drops a word whose key stands in an earlier one and
    lets a fuller word take the place of an earlier size, pressure or model code that it contains."""
    anchor = r"(?iu)^(?:DN\d+|PN\d+(?:\.\d+)?|IP\d{2}|φ\d+.*|\d+(?:\.\d+)?(?:kW|W|V|mm|MPa)|[A-Z0-9]+(?:-[A-Z0-9]+)+|[A-Z]+\d+[A-Z0-9]*)$"
    words = F.filter(F.split(F.trim(F.coalesce(query, F.lit(""))), r"(?U)\s+"), lambda w: query_part_key(w) != "")
    held = lambda acc, w: F.exists(acc, lambda a: (query_part_key(a) == query_part_key(w)) | (w.rlike(anchor) & F.contains(query_part_key(a), query_part_key(w))))
    fuller = lambda a, w: a.rlike(anchor) & F.contains(query_part_key(w), query_part_key(a))
    replaced = lambda acc, w: F.array_distinct(F.transform(acc, lambda a: F.when(fuller(a, w), w).otherwise(a)))
    step = lambda acc, w: F.when(held(acc, w), acc).when(F.exists(acc, lambda a: fuller(a, w)), replaced(acc, w)).otherwise(F.concat(acc, F.array(w)))
    return F.array_join(F.aggregate(words, F.array().cast("array<string>"), step), " ")


def normal_unit(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for to, names in UNITS.items() for n in names.split() for x in (n, to)])
    key = norm(unit)
    return F.coalesce(F.try_element_at(table, key), key)


def unit_compatible(asked: Column, offered: Column) -> Column:
    """True for one unit or family, false for a conflict, null where one side names none."""
    a, b = normal_unit(asked), normal_unit(offered)
    family = lambda u: F.when(u.isin("kg", "t"), "mass").when(u.isin("m", "延米"), "m").otherwise(u)
    return F.when((a == "") | (b == ""), F.lit(None).cast("boolean")).otherwise(family(a) == family(b))


def cjk_chars(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{CJK}]"), F.lit(0))


def bag(text: Column) -> Column:
    """The characters of a text in order: equal for equal multisets."""
    return F.array_join(F.array_sort(F.split(text, "")), "")


def bigrams(text: Column) -> Column:
    chars = F.split(text, "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b)))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays' distinct elements."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.try_divide(2.0 * F.size(F.array_intersect(x, y)), (F.size(x) + F.size(y)).cast("double"))


def peel_dimensions(name: Column) -> Column:
    """A name without sizes such as 1250X400 or 长度：1500mm."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"\d+(?:\.\d+)?\s*(?:[xX×*＊]\s*\d+(?:\.\d+)?)+(?:\s*mm)?", " ")
    out = F.regexp_replace(out, r"(?:有效长度|长度|宽度|高度|厚度|口径|截面|外形尺寸)\s*[:：]?\s*\d+(?:\.\d+)?\s*(?:mm|cm|m)?", " ")
    out = F.regexp_replace(out, r"[:：]\s*\d+(?:\.\d+)?\s*mm\s*$", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def undecorated(name: Column) -> Column:
    """A product name without LED, 成品, 新型, 进口, 国产 and a leading 型."""
    bare = F.coalesce(F.nullif(peel_dimensions(name), F.lit("")), name, F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?i)^(?:LED|成品|新型|进口|国产)+", ""), "^型", ""))


def soft_same_product(name: Column, title: Column, text: Column | None = None) -> Column:
    """Whether two product names mean one thing: one contains the other, their CJK characters are the
    same in any order, or a fragment of the page has or almost has the name's characters."""
    q, t = undecorated(name), undecorated(title)
    qn, tn = norm(q), norm(t)
    qc, tc = cjk_chars(q), cjk_chars(t)
    pool = title if text is None else F.concat_ws(" ", title, text)
    frags = F.regexp_extract_all(F.coalesce(pool, F.lit("")), F.lit(f"[{CJK}]{{2,8}}"), F.lit(0))
    frags = F.filter(frags, lambda f: ~f.isin(*STOP_WORDS))
    near = lambda f: (
        (bag(f) == F.array_join(F.array_sort(qc), ""))
        | ((F.abs(F.size(qc) - F.length(f)) <= 2) & (F.size(qc) >= 2) & ((F.size(F.array_except(qc, F.split(f, ""))) == 0) | (F.size(F.array_except(F.split(f, ""), qc)) == 0)))
    )
    contained = (qn != "") & (F.contains(tn, qn) | ((tn != "") & F.contains(qn, tn)))
    return F.when(q == "", F.lit(False)).otherwise(contained | ((F.size(qc) >= 2) & (F.array_sort(qc) == F.array_sort(tc))) | ((F.size(qc) >= 1) & F.exists(frags, near)))


def tokens(text: Column, most: int = 28) -> Column:
    """Model codes, sizes, electrical values, mixed codes and CJK words of a text, in this order, each once."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    every = lambda p: F.regexp_extract_all(flat, F.lit(p), F.lit(0))
    bare = lambda xs: F.transform(xs, lambda x: F.regexp_replace(x, r"\s+", ""))
    # Prefixes of model codes.
    models = every(r"(?i)(?:DS-|RG-|ST|iDS-|HM-|JB-|MS-|LRS-|GTYQ-|ZN-|WDZN-)[A-Z0-9/\-.()]+")
    sizes = bare(every(r"(?iu)(?:DN|φ)\s*\d{2,3}(?:\s*[×xX*]\s*\d+(?:\.\d+)?)?"))
    values = bare(every(r"(?i)\d+(?:\.\d+)?\s*(?:kW|W|V|mm|MPa)"))
    codes = F.filter(every(r"(?i)[A-Z]{1,6}[-_]?\d{2,}[A-Z0-9\-_/.]*"), lambda x: F.length(x) >= 4)
    words = F.filter(every(f"[{CJK}]{{2,8}}"), lambda x: ~x.isin(*STOP_WORDS))
    both = F.filter(F.concat(models, sizes, values, codes, words), lambda x: F.length(x) >= 2)
    keyed = F.transform(both, lambda x: F.struct(x.alias("x"), F.lower(x).alias("key")))
    first = lambda own, keys: F.filter(own, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    kept = let(keyed, lambda own: let(F.transform(own, lambda x: x["key"]), lambda keys: first(own, keys)))
    return F.transform(F.slice(kept, 1, most), lambda x: x["x"])


def title_score(title: Column, must: Column) -> Column:
    """How many required terms a title shows: one in the other, or by a CJK piece of two to four characters, or by a code with digits."""
    t = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", ""))
    bare = lambda m: F.lower(F.regexp_replace(F.coalesce(m, F.lit("")), r"(?U)\s+", ""))
    pieces = lambda m: F.concat(F.regexp_extract_all(m, F.lit(f"[{CJK}]{{2,4}}"), F.lit(0)), F.regexp_extract_all(m, F.lit(r"[a-z]{0,8}\d{2,}[a-z0-9_-]*"), F.lit(0)))
    hit = lambda m: (m != "") & (F.contains(t, m) | F.contains(m, t) | F.exists(pieces(m), lambda p: F.contains(t, p)))
    return F.when(t == "", 0).otherwise(F.size(F.filter(F.transform(F.coalesce(must, F.array().cast("array<string>")), bare), hit)))
