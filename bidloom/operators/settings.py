"""Nested settings laid over one another, and the registry of platforms made of them.

Settings are JSON documents, kept as VARIANT. A document is taken apart level by level into rows ``(path, leaf)``; of two documents of a key the rows
of the upper one hold, and lower rows stay where no upper leaf stands above, at or below them. So objects are merged at any depth and anything else
is replaced as a whole, null included. Rows are put together again from the deepest level up, keys in order. The number of
levels is the depth of the deepest document; all documents are handled at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom import shared
from bidloom.functions import names as N

#: Levels beyond which a document is refused.
DEEPEST = 40
# Id, name, login page, search page and handler of the platforms that are known without settings.
PLATFORMS = (
    ("guangcai", "广材网", "https://www.gldjc.com/login", "https://www.gldjc.com/scj/so.html?l=1&keyword={query}", "gldjc"),
    ("huixun", "慧讯网", "https://services.iccchina.com/login", "https://services.iccchina.com/products", "huixun"),
    ("lingcai", "领材网", "https://www.hylcw.cn/userInfo/index.html", "https://www.hylcw.cn/marketPrice/so.html?index=0&type=1&gjz={query}", "lingcai"),
    ("yize", "易择网", "https://www.easybii.com/", "https://www.easybii.com/P4-3-info-price-home.html", "yize"),
    ("zaojiatong", "造价通", "https://member.zjtcn.com/common/login.html?url=https%3A%2F%2Fgd.zjtcn.com%2Fshichangjia%2Flist%2Fc_t_d_k.html", "https://gd.zjtcn.com/shichangjia/list/c_t_d_k_{query}.html", "zaojiatong"),
    ("jd", "京东", "https://www.jd.com/", "https://search.jd.com/Search?keyword={query}&enc=utf-8", "jd"),
    ("1688", "1688批发", "https://login.taobao.com/?redirect_url=https%3A%2F%2Fwww.1688.com%2F", "https://s.1688.com/selloffer/offer_search.htm?keywords={query}", "1688"),
)


def _object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def leaves(docs: DataFrame, key: str = "key", doc: str = "doc") -> DataFrame:
    """``(key, path array<string>, leaf string)`` of documents ``(key, doc variant)``, one a key: leaves as JSON; an empty object is a leaf."""
    level = docs.where(F.col(doc).isNotNull()).select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.col(doc).alias("v"))
    done: list[DataFrame] = []
    for _ in range(DEEPEST):
        inner = _object(F.col("v")) & (F.schema_of_variant("v") != "OBJECT<>")
        done.append(level.where(~inner).select("key", "path", F.to_json("v").alias("leaf")))
        more = level.where(inner)
        if more.isEmpty():
            break
        more.createOrReplaceTempView(view := f"settings_level_{len(done)}")
        level = shared.cut(docs.sparkSession.sql(f"SELECT {view}.key AS key, concat(path, array(e.key)) AS path, e.value AS v FROM {view}, LATERAL variant_explode({view}.v) AS e(pos, key, value)"), "level")
        docs.sparkSession.catalog.dropTempView(view)
    else:
        raise ValueError(f"settings are nested deeper than {DEEPEST} levels")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return shared.cut(out, "leaves")


def documents(rows: DataFrame) -> DataFrame:
    """``(key, doc variant)`` of rows of ``leaves``."""
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for n in range(deepest, 0, -1):
        name = F.to_json(F.struct(F.element_at("path", -1).alias("k")))  # {"k":"..."}: the name as JSON writes it
        field = F.concat(F.regexp_extract(name, r'^\{"k":(.*)\}$', 1), F.lit(":"), F.col("leaf"))
        own = rows.where(F.size("path") == n).groupBy("key", F.slice("path", 1, n - 1).alias("path"))
        built = own.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("name"), field.alias("field")))), lambda x: x["field"]), ","), F.lit("}")).alias("leaf"))
        rows = rows.where(F.size("path") < n).unionByName(built)
    return rows.where(F.size("path") == 0).select("key", F.parse_json("leaf").alias("doc"))


def merged(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """``(key, doc)``: documents of ``upper`` laid over those of ``lower``; a full outer join by key, then by path."""
    return documents(laid_over(leaves(lower), leaves(upper)))


def laid_over(low: DataFrame, up: DataFrame) -> DataFrame:
    """Rows of ``leaves`` of upper documents laid over those of lower ones.

    Both sides grow, and paths weigh far more in memory than in their files: they meet in shuffles, never sent whole."""
    inside = F.col("leaf") == "{}"
    # What an upper leaf replaces: its own place and what stands below it, but an empty object leaves an object as it is.
    above = lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: F.slice(p, 1, k))
    each = low.select("key", "path", "leaf", F.explode(above(F.col("path"))).alias("at"))
    hit = each.join(up.select("key", F.col("path").alias("at"), inside.alias("empty")).hint("merge"), ["key", "at"])
    hit = hit.where(~F.col("empty") | ((F.size("at") == F.size("path")) & (F.col("leaf") != "{}"))).select("key", "path").distinct()
    # Lower leaves above an upper one give way to its object.
    below = up.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.struct(F.slice("path", 1, k).alias("path"), (k < F.size("path")).alias("strict")))).alias("p"))
    below = below.where("p.strict").select("key", "p.path").distinct()
    kept = low.join(hit.hint("merge"), ["key", "path"], "left_anti").join(below.hint("merge"), ["key", "path"], "left_anti")
    # An empty upper object adds nothing where anything of an object is kept below it or it is there already.
    roots = kept.select("key", F.explode(above(F.col("path"))).alias("path")).distinct()
    new = up.where(~inside).unionByName(up.where(inside).join(roots.hint("merge"), ["key", "path"], "left_anti"))
    return shared.cut(kept.unionByName(new), "merged")


def defaults(spark) -> DataFrame:
    """``(platform, doc)`` of the known platforms."""
    rows = spark.createDataFrame([(i, n, a, s, h) for i, n, a, s, h in PLATFORMS], "platform string, name string, login_url string, search_url string, handler string")
    return rows.select("platform", F.parse_json(F.to_json(F.struct("name", "login_url", "search_url", "handler"))).alias("doc"))


def registry(known: DataFrame, given: DataFrame) -> DataFrame:
    """The platforms of each user: ``known (platform, doc)`` with the user's settings ``given (user, doc)``, ``{platform: {...}}``, laid over them.

    Names of platforms are read in any spelling; settings under several spellings of one are taken in the order of their names. A platform of either side
    appears (full outer join). A home page stands in for a login page, ``search_url_template`` for ``search_url``; a field that is
    empty leaves the known one. ``requires_config`` tells platforms that still lack a page. Null settings count as none."""
    users = given.select("user").distinct()
    spelled = leaves(given.select(F.col("user").alias("key"), "doc")).where(F.size("path") > 1)
    own = spelled.select(F.struct(F.col("key").alias("user"), N.platform_id(F.col("path")[0]).alias("platform")).alias("key"), F.col("path")[0].alias("as"), F.slice("path", 2, 1000).alias("path"), "leaf")
    own = own.groupBy("key", "path").agg(F.max_by("leaf", "as").alias("leaf"))
    filled = own.where((F.size("path") > 1) | ~F.col("leaf").isin('""', "null"))
    own = shared.cut(filled.select("key", "path", "leaf"), "own")
    # A registry is a table of fixed size, sent to all tasks. Its documents are taken apart once, not once a user, and only those that a user has settings for are laid under them.
    plain = leaves(known.select(F.col("platform").alias("key"), "doc")).withColumnRenamed("key", "platform")
    keys = own.select("key").distinct()
    low = keys.select("key", F.col("key.platform").alias("platform")).join(F.broadcast(plain), "platform").select("key", "path", "leaf")
    laid = documents(laid_over(shared.cut(low, "lower"), own))
    base = documents(plain.withColumnRenamed("platform", "key")).select(F.col("key").alias("platform"), "doc")
    ids = [r.platform for r in known.select("platform").collect()]  # a registry: as many as there are platforms
    # A missing user is one as any other.
    had = keys.select(F.col("key.user").alias("its"), F.col("key.platform").alias("at"))
    rest = users.select("user", F.explode(F.lit(ids)).alias("platform")).join(had.hint("merge"), F.col("user").eqNullSafe(F.col("its")) & (F.col("platform") == F.col("at")), "left_anti")
    rest = rest.join(F.broadcast(base), "platform").select("user", "platform", "doc")
    doc = rest.unionByName(laid.select("key.user", "key.platform", "doc"))
    get = lambda path: F.variant_get("doc", f"$.{path}", "string")
    known_url = lambda c: F.variant_get("known", f"$.{c}", "string")
    out = doc.join(F.broadcast(known.select("platform", F.col("doc").alias("known"))), "platform", "left")
    home = get("home_url")
    login = F.coalesce(F.when(F.coalesce(get("login_url") != known_url("login_url"), get("login_url").isNotNull()), get("login_url")), home, get("login_url"), F.lit(""))
    search = F.coalesce(F.when(F.coalesce(get("search_url") != known_url("search_url"), get("search_url").isNotNull()), get("search_url")), get("search_url_template"), get("search_url"), F.lit(""))
    return out.select(
        "user", "platform", F.coalesce(get("name"), F.col("platform")).alias("name"), login.alias("login_url"), search.alias("search_url"), F.coalesce(get("handler"), F.lit("generic")).alias("handler"),
        ((login == "") | (search == "")).alias("requires_config"), "doc",
    )
