"""Web pages as evidence of last resort: prices and aliases that they show, and what a page may count as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.operators import match as M

# Labels of a price, words that are no product, and the words of product categories in order.
PRICE_LABELS = "价格|单价|报价|售价|市场价|含税价|除税价|参考价"
NO_PRODUCT = "产品 价格 规格 型号 厂家 供应商 公司".split()
CATEGORIES = {
    "flange": "法兰", "valve": "阀门 止回阀 单向阀 闸阀 截止阀 球阀 蝶阀", "light": "灯具 线型灯 线条灯 地埋灯 埋地灯 射灯", "pump": "水泵 泵组 离心泵",
    "pipe": "钢管 给水管 排水管 铸铁管 管材", "rebar": "钢筋 圆钢 螺纹钢 盘螺", "cable": "电缆 电线 线缆", "controller": "控制器 分控器 主控器",
}
#: How much of a page counts as its start, as the place of its aliases, and as evidence of a specification.
HEAD_CHARS, ALIAS_CHARS, BODY_CHARS = 3000, 1500, 5000
#: Characters that most products share.
GENERIC = "器阀管灯箱机泵门板套线件类型式"


def visible_prices(text: Column, most: int = 5) -> Column:
    """``array<struct<price,shown>>``: labelled prices, then those with a currency mark, each price once. 万元 counts as 10,000."""
    t = F.coalesce(text, F.lit(""))
    number = lambda x: F.regexp_extract(x, r"\d+(?:\.\d+)?", 0).try_cast("double")

    def priced(pattern: str) -> Column:
        some = F.filter(M.every(t, pattern), lambda x: (number(x) > 0.05) & (number(x) < 5_000_000))
        return F.transform(some, lambda x: F.struct((number(x) * F.when(F.contains(x, F.lit("万元")), 10_000).otherwise(1)).alias("price"), F.substring(x, 1, 80).alias("shown")))

    both = F.concat(priced(rf"(?U)(?:{PRICE_LABELS})\s*[:：]?\s*[¥￥]?\s*[0-9]+(?:\.[0-9]+)?\s*(?:元|万元)?"), priced(r"(?U)[¥￥]\s*[0-9]+(?:\.[0-9]+)?"))
    values = F.transform(both, lambda x: x["price"])
    return F.slice(F.filter(both, lambda x, i: F.array_position(values, x["price"]) == i + 1), 1, most)


def alias_clues(name: Column, title: Column, body: Column, most: int = 3, head: int = ALIAS_CHARS) -> Column:
    """CJK words of a page's title and head that share two characters with the product's noun and are about as long."""
    core = M.core_name(name)
    words = M.every(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, head)), f"[{T.CJK}]{{2,12}}")
    shared = lambda w: F.size(F.array_intersect(F.split(core, ""), F.split(w, "")))
    near = lambda w: ~w.isin(*NO_PRODUCT) & (F.lower(w) != F.lower(core)) & (shared(w) >= 2) & (F.abs(F.length(w) - F.length(core)) <= 4)
    return F.slice(F.array_distinct(F.filter(words, near)), 1, most)


def captcha(html: Column, head_chars: int = HEAD_CHARS) -> Column:
    """Whether a stored page is a robot check: such a page says so at its start, where an article on them does not."""
    head = F.substring(F.coalesce(html, F.lit("")), 1, head_chars)
    low = F.lower(head)
    return (F.contains(head, F.lit("安全验证")) | F.contains(low, F.lit("captcha"))) & (F.contains(head, F.lit("验证码")) | low.rlike("wappass|passport"))


def wants_fallback(n_formal: Column, k: Column, done: Column, enabled: Column) -> Column:
    """Whether an item still asks for web sources: fewer than K formal quotes, not done, not switched off."""
    return enabled & ~done & (n_formal < F.greatest(F.lit(1), F.coalesce(k, F.lit(1))))


def source_kinds(pages: DataFrame, name: str = "name", spec: str = "spec", title: str = "title", body: str = "body", quality: str = "quality", body_chars: int = BODY_CHARS) -> DataFrame:
    """``pages`` (an item and a page a row) with ``aliases``, ``prices`` and ``kind``.

    Kinds: ``web_reference`` (accepted with a price), ``supplier_lead`` (a contact and no conflict), ``alias_only`` and
    ``reject``. ``phone``, ``contact`` and ``supplier`` are the page's contacts. Nulls count as empty texts.
    """
    held = pages.withColumn("seen spec", F.lit("")).withColumn("page text", F.concat_ws("\n", title, F.substring(F.col(body), 1, body_chars)))
    out = M.matched(held, name, spec, title, "page text", "seen spec").drop("seen spec", "page text")
    out = out.withColumn("aliases", alias_clues(F.col(name), F.col(title), F.col(body))).withColumn("prices", visible_prices(F.col(body)))
    known = F.trim(F.concat_ws("", "phone", "contact", "supplier")) != ""
    other = F.when(F.size("aliases") > 0, "alias_only").otherwise("reject")
    conflict = F.size("conflicts") > 0
    kind = (
        F.when((F.col(quality) == "block") | ~F.col("name_ok"), other)
        .when((F.col("outcome") == "reject") & conflict, "reject")
        .when(F.col("ok") & (F.size("prices") > 0), "web_reference")
        .when(known & (F.col("outcome").isin("review", "accept") | ~conflict), "supplier_lead")
        .otherwise(other)
    )
    return out.withColumn("kind", kind)


def category(name: Column) -> Column:
    """The first category whose words a name holds, else the empty text."""
    bare, out = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", ""), F.lit("")
    for label, words in reversed(CATEGORIES.items()):
        out = F.when(bare.rlike(words.replace(" ", "|")), label).otherwise(out)
    return out


def category_conflict(asked: Column, offered: Column) -> Column:
    a, b = category(asked), category(offered)
    return (a != "") & (b != "") & (a != b)


def gray_name(asked: Column, offered: Column, least: float = 0.45) -> Column:
    """Whether two names are near enough for a person to decide: one in the other, or a telling character and much in common."""
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(F.nullif(M.core_name(c), F.lit("")), c, F.lit("")), f"[^0-9a-zA-Z{T.CJK}]+", ""))
    q, t = bare(asked), bare(offered)
    qc, tc = T.cjk_chars(q), T.cjk_chars(t)
    telling = F.size(F.array_except(F.array_intersect(qc, tc), F.array(*[F.lit(c) for c in GENERIC]))) > 0
    pairs = lambda xs: T.bigrams(F.array_join(xs, ""))
    shared = F.filter(F.array_intersect(pairs(qc), pairs(tc)), lambda g: F.length(g) == 2)
    chinese = telling & (F.coalesce(T.dice(qc, tc) >= least, F.lit(False)) | (F.size(shared) > 0))
    parts = lambda c: M.every(c, "[a-z0-9]{3,}")
    return (
        F.when((q == "") | (t == ""), F.lit(False))
        .when(F.contains(t, q) | F.contains(q, t), F.lit(True))
        .when((F.size(qc) > 0) & (F.size(tc) > 0), chinese)
        .otherwise(F.arrays_overlap(parts(q), parts(t)))
    )
