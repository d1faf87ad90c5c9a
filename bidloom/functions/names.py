"""Cleaning of product names, and the keys and ids that caches and logs use. All take and return Columns.

A pattern here is put together from fixed words and two small pieces: a number, and a number with a unit.
Nulls count as empty texts.
"""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from bidloom.functions import text as T

C = T.CJK
NUMBER = r"\d+(?:\.\d+)?"
# Endings of provinces and of smaller places, cities that stand without an ending, words of price sources.
PROVINCE_ENDS = ("省", "自治区", "特别行政区")
PLACE_ENDS = ("市(?!场)", "州", "盟", "地区", "(?<!市)区(?!域)", "县")
CITY_NAMES = (
    "北京", "上海", "天津", "重庆", "成都", "广州", "深圳", "杭州", "武汉", "西安", "南京", "苏州", "青岛", "大连", "厦门", "福州", "长沙", "郑州",
    "济南", "合肥", "昆明", "贵阳", "南宁", "海口", "哈尔滨", "长春", "沈阳", "石家庄", "太原", "南昌", "兰州", "宁波", "无锡", "东莞", "佛山", "珠海",
    "中山", "惠州", "泉州", "温州", "嘉兴", "金华", "绍兴", "台州", "嘉峪关", "乌鲁木齐", "呼和浩特", "银川", "西宁", "拉萨",
)
PRICE_SOURCES = ("全国", "本市", "当地", "当地价", "信息价", "市场价", "指导价", "除税价", "含税价", "除税", "含税")
DECORATIONS = ("LED", "成品", "新型", "进口", "国产")
MODEL_PREFIXES = ("DS-", "RG-", "iDS-", "HM-", "JB-", "MS-", "LRS-")
# Other names of a platform, and its domain.
PLATFORMS = {
    "jd": ("jingdong", "京东"), "1688": ("alibaba", "ali", "阿里"), "guangcai": ("广材", "广材网", "gldjc", "guangcaiwang"),
    "huixun": ("慧讯", "慧讯网", "huixunwang", "iccchina", "rcc", "瑞达恒"), "lingcai": ("领材", "领材网", "领财网", "lingcaiwang", "hylcw"),
    "yize": ("易择", "易择网", "易泽", "易泽网", "easybii", "yizewang"), "zaojiatong": ("造价通", "zjtcn", "zjt", "zaojia", "中建普联"),
}
DOMAINS = {
    "guangcai": "gldjc.com", "huixun": "iccchina.com", "lingcai": "hylcw.cn", "yize": "easybii.com", "zaojiatong": "zjtcn.com", "jd": "jd.com",
    "1688": "1688.com", "baidu_web": "baidu.com",
}


def _or(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(words)})"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _single(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(group))


def once(xs: Column, key=lambda x: F.lower(x)) -> Column:
    """The elements whose key stands nowhere before them."""
    keys = F.transform(xs, key)
    return F.filter(xs, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


# Names


def without_places(name: Column) -> Column:
    """A name without provinces, cities and other places, and without words of price sources."""
    out = T.collapse_cjk_spaces(name)
    for pattern in (f"[{C}]{{1,8}}{_or(PROVINCE_ENDS)}", f"[{C}]{{2,8}}{_or(PLACE_ENDS)}", f"{_or(CITY_NAMES)}市?", _or(PRICE_SOURCES)):
        out = F.regexp_replace(out, pattern, " ")
    return F.regexp_replace(_single(out), r"^[ ，,；;/-]+|[ ，,；;/-]+$", "")


def material_name(name: Column) -> Column:
    """What a name is stored, matched and searched as: no places, no sizes."""
    bare = without_places(name)
    return _single(F.coalesce(F.nullif(T.peel_dimensions(bare), F.lit("")), bare))


_SIZE = rf"(?:DN|φ|PN)\s*{NUMBER}"
_UNITS = "(?:W(?:\\s*[/／]\\s*m)?|V|K|mm|MPa{more}|A)"


def name_key(name: Column) -> Column:
    """The key of a name: no places, decorations, sizes, model codes, brackets and white space, lower case."""
    out = F.regexp_replace(without_places(name), f"(?i)^{_or(DECORATIONS)}+", "")
    measured = rf"{NUMBER}\s*{_UNITS.format(more='')}"
    out = F.regexp_replace(out, rf"(?iu){_SIZE}|{measured}|IP\s*\d{{2}}|[A-Z]{{1,8}}\d{{2,}}[A-Z0-9\-_]*", " ")
    for pattern in (r"(?U)\s+", "[（(].*?[）)]", "(?:型号|规格).*$"):
        out = F.regexp_replace(out, pattern, "")
    return F.lower(out)


def title_key(title: Column) -> Column:
    """The key of a title; one that is nothing but size or place keeps its characters."""
    return F.coalesce(F.nullif(name_key(title), F.lit("")), F.lower(F.regexp_replace(_text(title), r"(?U)\s+", "")))


def without_hard_specs(name: Column) -> Column:
    """A name without sizes, electrical values, protection classes, model codes and brackets: what a family shares."""
    bare = F.coalesce(F.nullif(T.peel_dimensions(name), F.lit("")), _text(name))
    measured = rf"{NUMBER}\s*{_UNITS.format(more='|kPa')}"
    models = rf"{_or(MODEL_PREFIXES)}[A-Z0-9/\-.]+|[A-Z]{{1,8}}\d{{2,}}[A-Z0-9\-_/.]*"
    section = r"(?<!\d)\d{2,5}(?:\s*[xX×*]\s*\d{2,5}){1,2}"
    out = F.regexp_replace(bare, rf"(?iu){_SIZE}|{measured}|IP\s*\d{{2}}|{models}|{section}", " ")
    return _single(F.regexp_replace(out, r"[()（）\[\]【】]", " "))


def with_size_aliases(text: Column, more: Column | None = None) -> Column:
    """A page's text, and after it the other ways to write the bores and grades that it (or ``more``) names."""
    blob = F.concat_ws(" ", _text(text), _text(more) if more is not None else F.lit(""))
    forms = lambda kinds: lambda n: F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in kinds])
    round_ = F.transform(every(blob, rf"(?i)直径\s*(?:\(mm\)|mm)?\s*[:：]?\s*({NUMBER})", 1), forms((("φ", ""), ("Φ", ""), ("DN", ""), ("直径", ""), ("", "mm"))))
    bore = F.transform(every(blob, rf"(?iu)(?:DN|φ|ф)\s*({NUMBER})", 1), forms((("φ", ""), ("DN", ""), ("直径", ""), ("直径(mm)：", ""), ("", "mm"))))
    grade = every(blob, r"(?i)牌号\s*[:：]?\s*([A-Z0-9]+)", 1)
    extra = once(F.concat(F.flatten(round_), F.flatten(bore), grade))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", _text(text), F.array_join(extra, " "))).otherwise(_text(text))


# Tokens


def measurement(token: Column) -> Column:
    """Whether a token is nothing but an electrical value or a protection class."""
    return F.regexp_replace(_text(token), r"\s+", "").rlike(rf"(?i)^(?:(?:AC|DC)?{NUMBER}(?:V|W|W/m|K)|IP\d\d)$")


def electrical(token: Column) -> Column:
    """Whether a token is nothing but a voltage, a power, a current, a colour temperature or a protection class."""
    own = rf"(?:AC|DC)\s*{NUMBER}\s*V|{NUMBER}\s*W(?:\s*[/／]\s*(?:m|米))?|IP\s*\d\d|\d{{3,5}}\s*K|(?:AC|DC)?{NUMBER}[VWAK]"
    return F.trim(_text(token)).rlike(f"(?i)^(?:{own})$")


def bore_or_pressure(token: Column) -> Column:
    """Whether a token is nothing but a bore, with a second size or not, or a nominal pressure."""
    return F.trim(_text(token)).rlike(rf"(?iu)^(?:(?:DN|φ|ф|ø)\s*{NUMBER}(?:\s*[×xX*]\s*{NUMBER})?|PN\s*{NUMBER})$")


def attribute_chain(token: Column) -> Column:
    """Whether a token with slashes is made of such values alone, and hence no model code."""
    parts = F.filter(F.split(F.trim(_text(token)), "[/／]"), lambda p: F.trim(p) != "")
    return F.contains(F.translate(_text(token), "／", "/"), F.lit("/")) & (F.size(parts) >= 2) & F.forall(parts, lambda p: electrical(p) | bore_or_pressure(p))


def bore(size: Column) -> Column:
    return T.norm(size).rlike(r"^(?:dn|φ|ф|ø)\d")


def unit_values(text: Column, unit: str) -> Column:
    """The numbers that stand before a unit and apart from letters and digits."""
    return F.transform(every(text, rf"(?i)(?<![A-Za-z0-9])({NUMBER})\s*{unit}(?![A-Za-z0-9])", 1), lambda x: x.cast("double"))


def price_numbers(text: Column) -> Column:
    """Numbers with a currency mark, or where there is none those before 元, each once; a decimal split by spaces is joined."""
    joined = F.regexp_replace(_text(text), r"(?<=\d)\s*\.\s*(?=\d)", ".")
    marked, counted = every(joined, rf"[¥￥]\s*({NUMBER})", 1), every(joined, rf"(?<!\d)({NUMBER})(?=\s*元)", 1)
    values = F.transform(F.when(F.size(marked) > 0, marked).otherwise(counted), lambda x: x.cast("double"))
    return F.array_distinct(F.filter(values, lambda v: (v > 0.01) & (v < 5_000_000)))


def query_anchors(name: Column, spec: Column, most: int = 6) -> Column:
    """Bores, model codes and sections of an item: what another query for it must keep."""
    both = F.concat_ws(" ", _text(name), _text(spec))
    bare = lambda xs: F.transform(xs, lambda x: F.regexp_replace(x, r"\s+", ""))
    models = every(both, rf"(?i){_or((*MODEL_PREFIXES, 'GTYQ-', 'ZN-', 'WDZN-'))}[A-Z0-9/\-.]+|[A-Z]{{1,6}}\d{{2,}}[A-Z0-9\-_]*")
    models = F.filter(models, lambda x: ~x.rlike(r"(?i)^(?:AC|DC)?\d+V?$"))
    sections = F.transform(every(both, r"(?<!\d)\d{2,5}\s*[xX×*]\s*\d{2,5}"), lambda x: F.regexp_replace(x, r"\s*[xX×*]\s*", "x"))
    return F.slice(F.array_distinct(F.concat(bare(every(both, r"(?iu)(?:DN|φ)\s*\d{2,3}")), models, sections)), 1, most)


# Keys and ids


def _digest(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def pair_key(asked: Column, offered: Column) -> Column:
    """The cache key of a decision on two names."""
    return _digest(F.concat(name_key(asked), F.lit("||"), title_key(offered)), 28)


def pool_key(platform: Column, region: Column, query: Column, price_type: Column | None = None, day: Column | None = None, tax: Column | None = None) -> Column:
    """The cache key of a platform's answer to a query."""
    low = lambda c, other="": F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(other)))) if c is not None else F.lit(other)
    place = F.trim(F.coalesce(F.nullif(region, F.lit("")), F.lit("UNSPECIFIED")))
    return _digest(F.concat_ws("|", low(platform), place, T.normal_query_key(query), low(price_type, "market"), F.trim(_text(day)) if day is not None else F.lit(""), low(tax)), 32)


def page_key(query: Column) -> Column:
    """The cache key of a web search."""
    return _digest(F.lower(_single(_text(query))), 28)


def payload_key(payload: Column) -> Column:
    """The cache key of a request: a digest of its JSON."""
    return _digest(F.to_json(payload), 28)


def row_key(name: Column, text: Column) -> Column:
    """What two rows of a list must differ in to be two rows."""
    return F.substring(F.regexp_replace(F.lower(F.concat(_text(name), F.lit("|"), _text(text))), f"[^0-9a-z{C}]+", ""), 1, 120)


def run_id(at: Column, seed: Column) -> Column:
    """A run's id: its time, and eight hex digits that follow from ``seed``."""
    return F.concat(F.lit("run-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.md5(seed.cast("string").cast("binary")), 1, 8))


def platform_id(name: Column) -> Column:
    """A platform's one id, whatever it is called."""
    table = {alias: pid for pid, names in PLATFORMS.items() for alias in names}
    low = F.lower(F.trim(F.coalesce(name.cast("string"), F.lit(""))))
    return F.coalesce(_lookup(table, low), _lookup(table, F.replace(low, F.lit("网"), F.lit(""))), low)


def platform_domain(name: Column) -> Column:
    own = platform_id(name)
    return F.coalesce(_lookup(DOMAINS, own), F.nullif(own, F.lit("")), F.lit("unknown"))


def region_key(province: Column, city: Column, district: Column, province_code: Column, city_code: Column, district_code: Column) -> Column:
    """The smallest code that is given, else the names, else UNSPECIFIED."""
    given = [F.nullif(F.trim(_text(c)), F.lit("")) for c in (district_code, city_code, province_code)]
    names = F.concat_ws("|", *[F.nullif(F.trim(_text(c)), F.lit("")) for c in (province, city, district)])
    return F.coalesce(*given, F.nullif(names, F.lit("")), F.lit("UNSPECIFIED"))


def region_display(province: Column, city: Column, district: Column) -> Column:
    return F.coalesce(F.nullif(F.concat(*[F.trim(_text(c)) for c in (province, city, district)]), F.lit("")), F.lit("未指定"))


def region_specified(*fields: Column) -> Column:
    return F.concat(*[F.trim(_text(c)) for c in fields]) != ""


def token_estimate(*parts: Column) -> Column:
    """About four characters a token, one at least."""
    n = sum((F.length(_text(p)) for p in parts), F.lit(0))
    return F.greatest(F.lit(1), F.floor((n + 3) / 4).cast("int"))


def usage(record: Column, asked: Column, answer: Column) -> Column:
    """``struct(prompt, completion, total)`` of a JSON usage record in any of its spellings, estimated where it has no total."""
    first = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(record, f"$.{n}").cast("int"), F.lit(0)) for n in names], F.lit(0))
    prompt, done = first("prompt_tokens", "input_tokens", "prompt_token_count"), first("completion_tokens", "output_tokens", "completion_token_count")
    total = first("total_tokens", "total_token_count")
    guess = F.when(_text(answer) == "", 0).otherwise(token_estimate(answer))
    p = F.when((total == 0) & (prompt == 0), token_estimate(asked)).otherwise(prompt)
    d = F.when((total == 0) & (done == 0), guess).otherwise(done)
    return F.struct(p.alias("prompt"), d.alias("completion"), F.when(total == 0, p + d).otherwise(total).alias("total"))


# Addresses


def shop_price_text(text: Column) -> Column:
    """A shop's price text with split decimals joined and plain spaces."""
    return F.regexp_replace(F.replace(_text(text), F.lit(" "), F.lit(" ")), r"(?<=\d)\s*\.\s*(?=\d)", ".")


def percent(text: Column) -> Column:
    """Percent-encoded UTF-8, spaces as %20."""
    out = F.url_encode(_text(text))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_twice(text: Column) -> Column:
    return percent(percent(text))


@pandas_udf(StringType())
def percent_gbk(text: pd.Series) -> pd.Series:
    """Percent-encoded GBK, which Spark's own functions cannot encode; characters outside it become a question mark."""
    return text.fillna("").map(lambda t: urllib.parse.quote_from_bytes(t.encode("gbk", errors="replace"), safe=""))


def list_address(query: Column, host: str = "https://gd.zjtcn.com") -> Column:
    """The address of a list page for a query of at most 40 characters."""
    return F.concat(F.lit(f"{host.rstrip('/')}/shichangjia/list/c_t_d_k_"), percent(F.substring(F.trim(_text(query)), 1, 40)), F.lit(".html"))


def unwrapped(href: Column) -> Column:
    """The address behind a search engine's redirect; a link without a scheme gets one."""
    own = F.trim(_text(href))
    target = F.try_parse_url(own, F.lit("QUERY"), F.lit("url"))
    inner = F.when(F.contains(own, F.lit("baidu.com/link")), F.nullif(F.try_url_decode(target), F.lit("")))
    return F.coalesce(inner, F.when(F.startswith(own, F.lit("//")), F.concat(F.lit("https:"), own)).otherwise(own))
