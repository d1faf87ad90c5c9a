"""Queries of joins without a shared id, of stored alias clusters and of the platform registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom import shared
from bidloom.operators import aliases as A
from bidloom.operators import history as H
from bidloom.operators import linkage as L
from bidloom.operators import match as M
from bidloom.operators import settings as S
from bidloom.operators import views as V
from bidloom.sources import pages

_TAG = r"\bdn\d+\b"


def _texts(spark, d):
    """Items with a description, some without a size; and offers that carry no item id, whose titles name a product in one of three ways."""
    part = V.read(spark, d, "part")
    size = F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("DN"), (F.col("p_size") * 10).cast("string")))
    items = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), size.alias("spec"), F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand", size).alias("text"))
    line = V.read(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber") % 3 == 0, F.col("l_linenumber") % 3 == 1, "l_returnflag", (F.col("l_suppkey") % 5).alias("s")).toDF("k", "zero", "one", "flag", "s")
    own = line.distinct().join(part, F.col("k") == F.col("p_partkey"))
    dn = F.concat(F.lit("DN"), (F.col("p_size") * 10 + F.when(F.col("flag") == "R", 10).otherwise(0)).cast("string"))
    words = F.split("p_name", " ")
    title = (
        F.when(F.col("zero"), F.concat_ws(" ", "p_name", F.lower("p_type"), dn, "p_brand"))
        .when(F.col("one"), F.concat_ws(" ", F.lower("p_type"), "p_name", dn))
        .otherwise(F.concat_ws(" ", words[1], words[0], dn, F.lower("p_type"), F.concat(F.lit("seller"), F.col("s").cast("string"))))
    )
    titles = own.select(title.alias("text")).distinct().withColumn("id", F.col("text"))
    split = lambda df: df.withColumns({"tags": F.regexp_extract_all(F.lower("text"), F.lit(_TAG), F.lit(0)), "tokens": F.regexp_extract_all(F.regexp_replace(F.lower("text"), _TAG, " "), F.lit("[a-z0-9#]+"), F.lit(0))})
    return split(items), split(titles)


def offer_links(spark, d):
    """Offers found for items by their words and sizes alone, each pair judged by the formal gate. Equal items are one class."""
    items, titles = _texts(spark, d)
    left, right = shared.cut(L.classes(items, "id"), "items"), shared.cut(L.classes(titles, "id"), "offers")
    found = shared.cut(L.candidates(left, right, 0.6), "links")
    # What the gate says depends on name, size and offer alone: equal ones are judged once.
    named = shared.cut(found.join(items.select(F.col("id").alias("item"), "name", "spec"), "item"), "named")
    text = F.concat(F.lit("规格型号："), F.col("offer"))
    made = lambda c: M.judged_by(M.asked_of(c).withColumns({"title": F.col("offer"), "text": text, "spec_seen": F.lit("")})).drop("title", "text", "spec_seen", "missing", "conflicts")
    return shared.by_content(named, ["name", "spec", "offer"], made).select("item", "offer", "common", "similarity", "name_ok", "outcome")


def offer_classes(spark, d):
    """The class of each item by its words and sizes."""
    items, _ = _texts(spark, d)
    return L.members(items, "id").groupBy("rep").agg(F.count("*").alias("members"), F.max("id").alias("last"))


def _title_words(spark, d):
    title = F.lower(pages.title(F.col("html")))
    return V.read(spark, d, "pages").select(F.explode(F.regexp_extract_all(title, F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("name")).where(F.length("name").between(4, 9))


def near_names(spark, d):
    """Words of page titles whose characters are almost the same: for each class of equal character bags how many others are near it."""
    sets = shared.cut(L.character_sets(_title_words(spark, d)), "sets")
    pairs = L.near_bags(sets)
    both = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep"))
    return sets.join(both.groupBy("rep").agg(F.count("*").alias("near")), "rep", "left").select("rep", F.coalesce("near", F.lit(0)).alias("near"), F.col("n").alias("names"))


def dictionary_hits(spark, d):
    """The words of benchmark items that stand in documents, anywhere in a word: in how many, in which first, and where there."""
    words = V.read(spark, d, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 5)
    found = L.found_words(V.read(spark, d, "documents"), words, "doc_id", "text")
    return found.groupBy("word").agg(F.count("*").alias("documents"), F.min("id").alias("first_doc"), F.min_by("at", "id").cast("long").alias("at"))


def _alias_pairs(spark, d):
    """Pairs of part numbers as names: stored ones, added, removed and denied ones."""
    part = V.read(spark, d, "part")
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    pair = lambda where, to: part.where(where).select(name(F.col("p_partkey")).alias("a"), name(to).alias("b"))
    k = F.col("p_partkey")
    return pair("p_size % 5 > 1", k + 1), pair("p_size % 11 = 0", k * 2), pair("p_size % 9 = 2", k + 1), pair("p_size % 7 = 3", k + 2)


def alias_updates(spark, d):
    """Stored clusters of aliases after an update that adds and removes pairs, and the pairs left."""
    stored, added, removed, _ = _alias_pairs(spark, d)
    held = shared.cut(H.clusters(stored), "held")
    return A.updated(held, stored, added, removed)


def alias_denials(spark, d):
    """Denied pairs that the confirmed ones hold together after the update, and over how many of these."""
    stored, added, removed, denied = _alias_pairs(spark, d)
    now = shared.cut(A.updated(shared.cut(H.clusters(stored), "held"), stored, added, removed), "now")
    found = A.contradictions(now, denied)
    steps = A.between(A.changed(stored, added, removed), shared.cut(found.select("a", "b"), "found"), 4)
    return found.join(steps.hint("merge"), ["a", "b"]).select("a", "b", "cluster", "steps")


def platform_registry(spark, d):
    """Each supplier's platforms: the known ones with the supplier's own settings laid over them, and its limits as nested settings."""
    s = V.read(spark, d, "supplier")
    spelling = F.element_at(F.array(*map(F.lit, ("广材网", "慧讯", "hylcw", "易泽网", "zjt", "京东", "ali", "own"))), (F.col("s_suppkey") % 8 + 1).cast("int"))
    k = F.col("s_suppkey").cast("string")
    page = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('"home_url":"https://h/'), k, F.lit('"'))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('"search_url":"https://s/'), k, F.lit('"'))).otherwise('"name":""')
    limits = F.concat(F.lit('"limits":{"day":{"most":'), k, F.lit('},"note":null}'))
    given = s.select(F.col("s_suppkey").alias("user"), F.parse_json(F.concat(F.lit('{"'), spelling, F.lit('":{'), page, F.lit(","), limits, F.lit("}}"))).alias("doc"))
    base = S.defaults(spark).select("platform", F.parse_json(F.regexp_replace(F.to_json("doc"), r"\}$", ',"limits":{"day":{"most":9,"least":1},"note":"x"}}')).alias("doc"))
    found = S.registry(base, given)
    limit = lambda path: F.variant_get("doc", f"$.limits.{path}", "string")
    return found.select("user", "platform", "name", "login_url", "search_url", "requires_config", limit("day.most").alias("most"), limit("day.least").alias("least"), limit("note").alias("note"))


QUERIES = {f.__name__: f for f in (offer_links, offer_classes, near_names, dictionary_hits, alias_updates, alias_denials, platform_registry)}

_SPLIT = r"list_sort(list_distinct(regexp_extract_all(lower(text), '\bdn\d+\b'))) AS tags, list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(text), '\bdn\d+\b', ' ', 'g'), '[a-z0-9#]+'))) AS tokens"
_ITEMS = f"""i0 AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'DN' || CAST(p_size * 10 AS VARCHAR) END AS spec, p_type, p_brand FROM part),
i AS (SELECT id, name, spec, {_SPLIT} FROM (SELECT *, concat_ws(' ', name, lower(p_type), p_brand, spec) AS text FROM i0))"""
_WORD = r"(?is)<title[^>]*>(.*?)</title>"

_ALIASES = """n AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS a, p_partkey AS k, p_size FROM part),
e0 AS (SELECT a, lpad(CAST(k + 1 AS VARCHAR), 9, '0') AS b FROM n WHERE p_size % 5 > 1 UNION SELECT a, lpad(CAST(k * 2 AS VARCHAR), 9, '0') FROM n WHERE p_size % 11 = 0 AND k > 0),
e AS (SELECT * FROM e0 EXCEPT SELECT a, lpad(CAST(k + 1 AS VARCHAR), 9, '0') FROM n WHERE p_size % 9 = 2),
g AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
reach AS (SELECT u AS name, u AS other FROM g UNION SELECT r.name, g.v FROM reach r JOIN g ON g.u = r.other),
c AS (SELECT name, min(other) AS cluster FROM reach GROUP BY 1)"""
_KNOWN = ", ".join(f"({', '.join(repr(x) for x in p[:4])})" for p in S.PLATFORMS)

ORACLE = {
    "alias_updates": f"WITH RECURSIVE {_ALIASES} SELECT * FROM c",
    "alias_denials": f"""WITH RECURSIVE {_ALIASES}, w AS (SELECT u AS name, v AS other, 1 AS k FROM g UNION SELECT w.name, g.v, k + 1 FROM w JOIN g ON g.u = w.other WHERE k < 4),
s AS (SELECT name, other, min(k) AS steps FROM w GROUP BY 1, 2), d AS (SELECT a, lpad(CAST(k + 2 AS VARCHAR), 9, '0') AS b FROM n WHERE p_size % 7 = 3)
SELECT a, b, x.cluster, steps FROM d JOIN c x ON x.name = a JOIN c y ON y.name = b AND y.cluster = x.cluster LEFT JOIN s ON s.name = a AND s.other = b""",
    "platform_registry": f"""WITH known AS (SELECT * FROM (VALUES {_KNOWN}) t(platform, name, login_url, search_url)),
own AS (SELECT s_suppkey AS user, ['guangcai', 'huixun', 'lingcai', 'yize', 'zaojiatong', 'jd', '1688', 'own'][s_suppkey % 8 + 1] AS platform,
  CASE WHEN s_suppkey % 3 = 0 THEN 'https://h/' || CAST(s_suppkey AS VARCHAR) END AS home, CASE WHEN s_suppkey % 3 = 1 THEN 'https://s/' || CAST(s_suppkey AS VARCHAR) END AS search, CAST(s_suppkey AS VARCHAR) AS most FROM supplier),
u AS (SELECT s_suppkey AS user, k.* FROM supplier, known k)
SELECT coalesce(u.user, o.user) AS user, coalesce(u.platform, o.platform) AS platform, coalesce(name, o.platform) AS name, coalesce(o.home, login_url, '') AS login_url, coalesce(o.search, search_url, '') AS search_url,
  coalesce(o.home, login_url, '') = '' OR coalesce(o.search, search_url, '') = '' AS requires_config, coalesce(o.most, '9') AS most, CASE WHEN u.user IS NOT NULL THEN '1' END AS least, CASE WHEN o.user IS NULL THEN 'x' END AS note
FROM u FULL JOIN own o ON u.user = o.user AND u.platform = o.platform""",
    "offer_links": f"""WITH {_ITEMS}, c AS (SELECT tokens, tags, min(id) AS item FROM i GROUP BY ALL),
l AS (SELECT DISTINCT l_partkey, l_linenumber % 3 AS v, l_returnflag = 'R' AS r, l_suppkey % 5 AS s FROM lineitem),
t AS (SELECT DISTINCT CASE v WHEN 0 THEN concat_ws(' ', p_name, lower(p_type), dn, p_brand) WHEN 1 THEN concat_ws(' ', lower(p_type), p_name, dn)
    ELSE concat_ws(' ', split_part(p_name, ' ', 2), split_part(p_name, ' ', 1), dn, lower(p_type), 'seller' || CAST(s AS VARCHAR)) END AS text
  FROM (SELECT *, 'DN' || CAST(p_size * 10 + CASE WHEN r THEN 10 ELSE 0 END AS VARCHAR) AS dn FROM l JOIN part ON l_partkey = p_partkey)),
o AS (SELECT tokens, tags, min(text) AS offer FROM (SELECT text, {_SPLIT} FROM t) GROUP BY ALL),
p AS (SELECT item, offer, len(list_intersect(c.tokens, o.tokens)) AS common, len(c.tokens) + len(o.tokens) AS total FROM c JOIN o ON list_has_all(o.tags, c.tags)),
q AS (SELECT item, offer, CAST(common AS INTEGER) AS common, common::DOUBLE / (total - common) AS similarity FROM p WHERE common >= 0.6::DOUBLE * (total - common))
SELECT q.*, contains(replace(lower(offer), ' ', ''), replace(lower(name), ' ', '')) AS name_ok,
  CASE WHEN contains(replace(lower(offer), ' ', ''), replace(lower(name), ' ', '')) THEN 'accept' ELSE 'reject' END AS outcome FROM q JOIN i ON q.item = i.id""",
    "offer_classes": f"WITH {_ITEMS} SELECT min(id) AS rep, count(*) AS members, max(id) AS last FROM i GROUP BY tokens, tags",
    "near_names": f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(regexp_extract(html, '{_WORD}', 1)), '[a-zà-ÿ]+')) AS name FROM pages),
s AS (SELECT array_to_string(list_sort(string_split(name, '')), '') AS bag, min(name) AS rep, count(*) AS n FROM w WHERE length(name) BETWEEN 4 AND 9 GROUP BY 1),
c AS (SELECT *, list_distinct(string_split(bag, '')) AS chars FROM s),
p AS (SELECT a.rep, count(*) AS near FROM c a JOIN c b ON a.rep <> b.rep AND abs(length(a.bag) - length(b.bag)) <= 2 AND (list_has_all(b.chars, a.chars) OR list_has_all(a.chars, b.chars)) GROUP BY 1)
SELECT rep, coalesce(near, 0) AS near, n AS names FROM c LEFT JOIN p USING (rep)""",
    "dictionary_hits": r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS word FROM benchmark),
h AS (SELECT word, doc_id, strpos(text, word) AS place FROM documents JOIN w ON length(word) >= 5 AND contains(text, word))
SELECT word, count(*) AS documents, min(doc_id) AS first_doc, arg_min(place, doc_id) AS at FROM h GROUP BY word""",
}
