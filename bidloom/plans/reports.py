"""Registered queries over attempts, regions, names, pages and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom import shared
from bidloom.functions import search as S
from bidloom.functions import text as T
from bidloom.operators import analytics as A
from bidloom.operators import buckets as B
from bidloom.operators import families as N
from bidloom.operators import history as H
from bidloom.operators import match as M
from bidloom.operators import region as R
from bidloom.operators import views as V
from bidloom.sources import pages as G
from bidloom.sources import schema as SC

#: Header words that cells of ``header_scores`` are made of.
HEADER_WORDS = ("材料名称", "名称", "规格型号", "单位", "单价", "工程量", "品牌", "备注", "合计", "序号")


def fail_reasons(spark, d):
    return A.fail_reasons(V.attempts(spark, d))


def fail_histogram(spark, d):
    return A.fail_reasons(V.attempts(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


def funnel(spark, d):
    return A.funnel(V.items(spark, d), V.attempts(spark, d))


def platform_stats(spark, d):
    return A.platform_stats(V.attempts(spark, d))


def status_rollup(spark, d):
    return A.status_rollup(V.attempts(spark, d))


def breaker_timeline(spark, d):
    return A.breaker_timeline(V.attempts(spark, d))


def consecutive_rejects(spark, d):
    return A.consecutive_rejects(V.attempts(spark, d))


def event_fold_latest(spark, d):
    return A.latest(V.attempts(spark, d).select("item_id", "ts", "ord", "status", "match_detail"), "item_id", "ts", "ord")


def conversation_fold(spark, d):
    c = V.read(spark, d, "conversations")
    return A.latest(c.select("conv_id", "turn", "role", F.length("text").alias("chars")), "conv_id", "turn")


def history_keep_n(spark, d):
    return A.keep_newest(V.attempts(spark, d)).select("item_id", "ord", "ts", "status")


def ttl_cache(spark, d):
    fresh = V.attempts(spark, d).where(F.col("ts") >= F.lit("2024-01-23 00:00:00").cast("timestamp"))
    last = fresh.groupBy("platform", F.lower("query").alias("query")).agg(F.max(F.struct("ts", "ord", "status")).alias("e"), F.count("*").alias("uses"))
    return last.select("platform", "query", F.col("e.ts").alias("ts"), F.col("e.status").alias("status"), "uses")


def status_by_hour(spark, d):
    w = V.attempts(spark, d).groupBy(F.window("ts", "6 hours").alias("w"), "status").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "status", "n")


def _regioned(spark, d):
    nation = V.read(spark, d, "nation")
    customer = V.read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customer = customer.select("c_custkey", F.col("n_nationkey").alias("city"), F.col("n_regionkey").alias("province"), "c_mktsegment")
    supplier = V.read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    supplier = supplier.select("s_suppkey", F.col("n_nationkey").alias("price_city"), F.col("n_regionkey").alias("price_province"))
    orders = V.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = V.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def region_gate(spark, d):
    """Lines are counted by places, segment and flag first; the gate then decides on a few thousand rows."""
    keys = ["province", "city", "price_province", "price_city", "c_mktsegment", "l_returnflag"]
    j = _regioned(spark, d).groupBy(*keys).agg(F.count("*").alias("lines"))
    text = lambda c: F.concat(F.lit("R"), F.col(c).cast("string"))
    match = R.classify(text("province"), text("city"), text("price_province"), text("price_city"))
    gate = R.decide(F.col("match"), F.lit(True), F.lit(False), F.col("c_mktsegment") == "BUILDING")
    bucket = F.when(F.col("l_returnflag") == "A", "formal").when(F.col("l_returnflag") == "N", "candidate").otherwise("discard")
    out = j.withColumn("match", match).withColumn("gate", gate).withColumn("bucket", R.apply_to_bucket(bucket, F.col("gate")))
    return out.groupBy("match", "gate", "bucket").agg(F.sum("lines").alias("n"))


def region_priority(spark, d):
    """An item's own region before the nation's, before none."""
    nation = V.read(spark, d, "nation")
    c = V.read(spark, d, "customer").join(nation, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("n_regionkey") < 3), "left")
    own = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))
    source = F.when(own.isNotNull(), "row").when(F.col("n_name").isNotNull(), "default").otherwise("none")
    return c.select("c_custkey", F.coalesce(own, "n_name", F.lit("UNSPECIFIED")).alias("region"), source.alias("source"))


def bucket_matrix(spark, d):
    """What the gate decides of line items, whose columns stand for its inputs, and of how many."""
    li, c = V.read(spark, d, "lineitem"), F.col
    mode = F.element_at(F.array(*map(F.lit, ("strict", "practical", "loose"))), (c("l_orderkey") % 3 + 1).cast("int"))
    outcome = F.element_at(F.array(*map(F.lit, ("accept", "review", "reject"))), (c("l_suppkey") % 3 + 1).cast("int"))
    unit = F.when(c("l_returnflag") == "A", True).when(c("l_returnflag") == "R", False)
    own = li.select(mode.alias("mode"), (c("l_discount") > 0.05).alias("ok"), outcome.alias("outcome"), (c("l_quantity") < 20).alias("missed"), unit.alias("unit_ok"), (c("l_linenumber") == 4).alias("ambiguous"))
    own = own.withColumn("r", B.decide(c("ok"), c("outcome"), c("missed"), c("unit_ok"), c("ambiguous"), c("mode")))
    return own.groupBy("mode", "ok", "outcome", "missed", "unit_ok", "ambiguous", c("r.bucket").alias("bucket"), c("r.outcome").alias("decision")).agg(F.count("*").alias("n"))


def _families(spark, d):
    return V.items(spark, d).withColumn("region", F.concat(F.lit("R"), (F.col("item_id") % 2).cast("string")))


def families(spark, d):
    return N.families(_families(spark, d))


def family_shared_queries(spark, d):
    return N.shared_queries(_families(spark, d))


def alias_pairs(spark, d):
    return N.name_pairs(V.items(spark, d))


def name_gray_dice(spark, d):
    return N.gray_pairs(N.name_pairs(V.items(spark, d)))


def alias_lookup(spark, d):
    pairs = N.name_pairs(V.items(spark, d))
    bags = pairs.where(F.length("name_a") == F.length("name_b")).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    differ = pairs.where(F.substring("name_a", 1, 1) == F.substring("name_b", 1, 1)).select(F.col("name_b").alias("a"), F.col("name_a").alias("b"))
    return N.lookup(pairs, bags, differ)


def name_bag_equal(spark, d):
    """Words of parts with their characters in order, and how many names share each."""
    words = V.items(spark, d).select("item_id", F.explode(F.split(F.lower("name"), " ")).alias("word"))
    return words.groupBy(T.bag(F.col("word")).alias("bag")).agg(F.count("*").alias("n"), F.countDistinct("word").alias("words"))


def title_scores(spark, d):
    """Items whose id is divisible by 50 against all distinct names that share a word with theirs."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    asked = V.items(spark, d).where("item_id % 50 = 0").select("item_id", words(F.col("name")).alias("must"))
    titles = V.items(spark, d).select(F.col("name").alias("title")).distinct()
    met = asked.select("item_id", "must", F.explode("must").alias("word")).join(titles.select("title", F.explode(words(F.col("title"))).alias("word")), "word")
    pairs = met.select("item_id", "must", "title").distinct()
    return pairs.select("item_id", "title", T.title_score(F.col("title"), F.col("must")).alias("hits"), F.size("must").alias("asked"))


def spec_struct(spark, d):
    """What each specification says of bore, pressure, material and voltage, and the items of each."""
    text = F.concat(F.col("spec"), F.lit(" PN"), (F.col("item_id") % 3 * 6 + 10).cast("string"), F.when(F.col("item_id") % 2 == 0, " 不锈钢").otherwise(""), F.lit(" 220V"))
    s = V.items(spark, d).select("item_id", S.structured(text).alias("s"))
    keys = [F.get("s.diameters", F.lit(0)).alias("bore"), F.col("s.pressure").alias("pressure"), F.col("s.material").alias("material"), F.col("s.voltage").alias("voltage")]
    return s.groupBy(*keys).agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


def match_gate(spark, d):
    """Offers of each item by the size that their text names, through the formal gate. Equal texts are judged once."""
    o = V.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("int").alias("quantity")).agg(F.count("*").alias("n"))
    o = shared.cut(o.join(V.items(spark, d).select("item_id", "name", "spec"), "item_id"), "offers")
    size = F.concat(F.lit("规格型号：DN"), (F.col("quantity") * 10).cast("string"), F.lit(" PN16 供应商名称：S"))
    made = lambda c: M.judged_by(M.asked_of(c).withColumns({"title": F.col("name"), "text": size, "spec_seen": F.lit("")})).drop("title", "text", "spec_seen", "missing", "conflicts")
    return shared.by_content(o, ["name", "spec", "quantity"], made).select("item_id", "quantity", "n", "name_ok", "outcome", "score")


def pages_text(spark, d):
    return V.read(spark, d, "pages").select("page_id", G.title(F.col("html")).alias("title"), F.sha2(G.text(F.col("html")), 256).alias("text_sha256"), F.length(G.text(F.col("html"))).cast("long").alias("chars"))


def pages_links(spark, d):
    return G.links(V.read(spark, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def domain_quality(spark, d):
    p = V.read(spark, d, "pages").select("page_id", G.domain(F.col("url")).alias("domain"), G.quality(F.col("url")).alias("quality"))
    return p.groupBy("domain", "quality").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def url_dedupe(spark, d):
    """Pages once for each address without query and fragment: the first by id."""
    clean = F.lower(F.regexp_replace(F.regexp_extract("url", r"^([^?#]*)", 1), "/+$", ""))
    p = V.read(spark, d, "pages").groupBy(clean.alias("address")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    return p


def document_tokens(spark, d):
    """Model codes, sizes, electrical values, mixed codes and words of each document's whole text."""
    return V.read(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), "|").alias("tokens"))


def document_phones(spark, d):
    """The telephone number that each document's text gives as a contact."""
    return V.read(spark, d, "documents").select("doc_id", G.contacts(F.col("text"))["phone"].alias("phone"))


def search_queries(spark, d):
    """The queries of every item for a cost site and a shop."""
    platforms = spark.createDataFrame([("yize", False), ("jd", True)], "platform string, shop boolean")
    return S.search_rows(V.items(spark, d), platforms)


def hard_tags(spark, d):
    i = V.items(spark, d)
    return i.select("item_id", F.array_join(S.hard_tags(F.col("name"), F.col("spec")), ",").alias("tags"), F.array_join(S.must_terms(F.col("name"), F.col("spec")), ",").alias("must"))


def history_upsert(spark, d):
    """The last event of each user and kind, with later ones in place of earlier ones: a merge by key."""
    e = V.read(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    last = lambda x: x.groupBy("user_id", "event_type").agg(F.max(F.struct("event_id", "value")).alias("m")).select("user_id", "event_type", "m.event_id", "m.value")
    return H.upsert(last(e.where("event_id % 3 <> 0")), last(e.where("event_id % 3 = 0")), "user_id", "event_type")


def history_delete(spark, d):
    e = V.read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    gone = e.where("event_type = 'error' and value > 150").select("user_id").distinct()
    return H.delete(e, gone, "user_id")


def alias_clusters(spark, d):
    """Names of parts linked by a shared word, as clusters by their least name."""
    pairs = N.name_pairs(V.items(spark, d), same_length=True)
    return H.clusters(pairs, "name_a", "name_b")


def header_scores(spark, d):
    """Cells made of a header word, alone or with what parts are called before or behind it, and the role that each is read as."""
    words = F.array(*map(F.lit, HEADER_WORDS))
    k = F.col("p_partkey")
    word = F.element_at(words, (k % len(HEADER_WORDS) + 1).cast("int"))
    text = F.when(k % 3 == 0, word).when(k % 3 == 1, F.concat(word, F.col("p_type"))).otherwise(F.concat(F.col("p_name"), word))
    return SC.scored(V.read(spark, d, "part").select(text.alias("text"))).groupBy("text", "role").agg(F.count("*").alias("n"), F.max(F.round("score", 6)).alias("score"))


QUERIES = {f.__name__: f for f in (
    fail_reasons, fail_histogram, funnel, platform_stats, status_rollup, breaker_timeline, consecutive_rejects, event_fold_latest, conversation_fold,
    history_keep_n, ttl_cache, status_by_hour, region_gate, region_priority, bucket_matrix, families, family_shared_queries, alias_pairs,
    name_gray_dice, alias_lookup, name_bag_equal, title_scores, spec_struct, match_gate, pages_text, pages_links, domain_quality, url_dedupe, document_tokens,
    document_phones, header_scores, search_queries, hard_tags, history_upsert, history_delete,
    alias_clusters,
)}

_HINTS = ", ".join(f"({i}, '{role}', '{hint}', {SC.PRIORITY[role]})" for i, (role, hint) in enumerate((r, h) for r, hs in SC.HINTS.items() for h in hs))
_A = f"WITH {V.ATTEMPTS}"
_FAIL = f"""{_A}, n AS (SELECT item_id, bool_or(formal) AS formal, bool_or(contains(status, 'rate_limited')) AS limited, bool_or(contains(status, 'no_membership')) AS login, bool_or(contains(status, 'captcha')) AS captcha,
  bool_or(match_detail <> '') AS matched, count(*) FILTER (contains(match_detail, '名称未命中')) AS name_n, count(*) FILTER (contains(match_detail, '规格冲突')) AS conflict_n,
  count(*) FILTER (contains(match_detail, '缺少')) AS missing_n, count(*) FILTER (match_detail <> '' AND price <= 0.05) AS no_price_n FROM attempts GROUP BY 1),
f AS (SELECT item_id, CASE WHEN formal THEN '' WHEN limited THEN '限流' WHEN captcha THEN '验证码' WHEN login THEN '未登录/无会员' WHEN NOT matched THEN '平台没有结果'
  WHEN name_n > 0 AND name_n >= greatest(conflict_n, missing_n, 1) THEN '名称不匹配' WHEN conflict_n > 0 THEN '规格冲突' WHEN missing_n > 0 THEN '规格证据缺失'
  WHEN no_price_n > 0 THEN '没有数字价' ELSE '其它' END AS reason, name_n, conflict_n, missing_n FROM n)"""
_PAIRS = f"WITH {V.ITEMS}, w AS (SELECT DISTINCT name, unnest(string_split(lower(name), ' ')) AS word FROM items), pairs AS (SELECT DISTINCT low AS name_a, name AS name_b FROM (SELECT name, min(name) OVER (PARTITION BY word) AS low FROM w) WHERE low < name)"
_FAM = f"WITH {V.ITEMS}, r AS (SELECT *, lower(name) || '|R' || CAST(item_id % 2 AS VARCHAR) AS family_key FROM items)"
_CHARS = "list_distinct(string_split(replace(lower({c}), ' ', ''), ''))"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length(replace(lower({c}), ' ', '')), 1)), lambda i: substring(replace(lower({c}), ' ', ''), CAST(i AS BIGINT), 2)))"
_TEXT = r"regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_TEXT = f"replace(replace(replace(replace(replace({_TEXT}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_TEXT = rf"trim(regexp_replace({_TEXT}, '[ \t\n\r\f]+', ' ', 'g'))"

ORACLE = {
    "fail_reasons": f"{_FAIL} SELECT * FROM f",
    "fail_histogram": f"{_FAIL} SELECT reason, count(*) AS n FROM f GROUP BY 1",
    "funnel": f"""{_A}, {V.ITEMS}, n AS (SELECT item_id, true AS searched, bool_or(status = 'ok') AS has, bool_or(contains(match_detail, '名称命中')) AS name,
  count(*) FILTER (formal) AS quotes, bool_or(formal AND price > 0.05) AS priced FROM attempts GROUP BY 1)
SELECT count(*) AS items_total, count(*) FILTER (searched) AS searched, count(*) FILTER (has) AS has_candidates, count(*) FILTER (n.name) AS name_matched,
  count(*) FILTER (quotes > 0) AS spec_full_match, count(*) FILTER (priced) AS has_real_price, count(*) FILTER (quotes >= 3) AS full_k,
  count(*) FILTER (quotes > 0 AND quotes < 3) AS partial, count(*) FILTER (COALESCE(quotes, 0) = 0) AS no_quote
FROM (SELECT DISTINCT item_id FROM items) i LEFT JOIN n USING (item_id)""",
    "platform_stats": f"{_A} SELECT platform, count(DISTINCT lower(query)) AS queries, count(*) FILTER (status = 'ok') AS candidates, count(*) FILTER (contains(match_detail, '名称未命中')) AS name_reject, count(*) FILTER (contains(match_detail, '规格冲突')) AS spec_reject, count(*) FILTER (formal) AS formal_hits FROM attempts GROUP BY 1",
    "status_rollup": f"{_A} SELECT platform, status, count(*) AS n, sum(CAST(price AS DECIMAL(18,4))) AS total FROM attempts GROUP BY ROLLUP (platform, status)",
    "breaker_timeline": f"{_A}, t AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ts, ord) AS k, regexp_matches(lower(status), 'rate_limited|captcha|need_login|no_membership|403|429') AS trip FROM attempts), f AS (SELECT platform, min(k) AS k0 FROM t WHERE trip GROUP BY 1) SELECT platform, item_id, ord, ts, status, k = k0 AS newly_tripped FROM t JOIN f USING (platform) WHERE k >= k0",
    "consecutive_rejects": f"{_A}, g AS (SELECT *, sum(CASE WHEN formal THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS island FROM attempts), r AS (SELECT item_id, island, count(*) AS run FROM g WHERE NOT formal GROUP BY 1, 2) SELECT item_id, max(run) AS longest, count(*) AS runs FROM r GROUP BY 1",
    "event_fold_latest": f"{_A} SELECT item_id, ts, ord, status, match_detail, n_events FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, ord DESC) AS k, count(*) OVER (PARTITION BY item_id) AS n_events FROM attempts) WHERE k = 1",
    "conversation_fold": "SELECT conv_id, turn, role, chars, n_events FROM (SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, length(text) DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n_events FROM conversations) WHERE k = 1",
    "history_keep_n": f"{_A} SELECT item_id, ord, ts, status FROM attempts ORDER BY ts DESC, ord DESC LIMIT 50",
    "ttl_cache": f"{_A}, f AS (SELECT *, lower(query) AS q FROM attempts WHERE ts >= TIMESTAMP '2024-01-23 00:00:00') SELECT platform, q AS query, ts, status, uses FROM (SELECT *, row_number() OVER (PARTITION BY platform, q ORDER BY ts DESC, ord DESC) AS k, count(*) OVER (PARTITION BY platform, q) AS uses FROM f) WHERE k = 1",
    "status_by_hour": f"{_A} SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01 00:00:00') AS start, status, count(*) AS n FROM attempts GROUP BY 1, 2",
    "region_gate": """WITH j AS (SELECT l_returnflag, c_mktsegment, cn.n_nationkey AS city, cn.n_regionkey AS province, sn.n_nationkey AS price_city, sn.n_regionkey AS price_province
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey),
m AS (SELECT *, CASE WHEN city = price_city THEN 'exact' WHEN province = price_province THEN 'province' ELSE 'conflict' END AS match FROM j),
g AS (SELECT *, CASE match WHEN 'exact' THEN 'allow_formal' WHEN 'province' THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'allow_formal' ELSE 'review' END ELSE 'reject' END AS gate,
  CASE l_returnflag WHEN 'A' THEN 'formal' WHEN 'N' THEN 'candidate' ELSE 'discard' END AS b FROM m),
o AS (SELECT match, gate, CASE WHEN gate = 'reject' THEN 'discard' WHEN gate = 'review' AND b IN ('formal', 'discard') THEN 'candidate' ELSE b END AS bucket FROM g)
SELECT match, gate, bucket, count(*) AS n FROM o GROUP BY 1, 2, 3""",
    "region_priority": "SELECT c_custkey, COALESCE(CASE WHEN c_acctbal < 0 THEN c_mktsegment END, n_name, 'UNSPECIFIED') AS region, CASE WHEN c_acctbal < 0 AND c_mktsegment IS NOT NULL THEN 'row' WHEN n_name IS NOT NULL THEN 'default' ELSE 'none' END AS source FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3",
    "bucket_matrix": """WITH g AS (SELECT ['strict', 'practical', 'loose'][l_orderkey % 3 + 1] AS mode, l_discount > 0.05::DOUBLE AS ok, ['accept', 'review', 'reject'][l_suppkey % 3 + 1] AS outcome, l_quantity < 20 AS missed,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS unit_ok, l_linenumber = 4 AS ambiguous FROM lineitem),
r AS (SELECT *, CASE WHEN ambiguous THEN CASE WHEN missed AND mode <> 'loose' THEN 'discard/reject' WHEN mode = 'strict' THEN 'discard/review' ELSE 'candidate/review' END
  WHEN unit_ok = false THEN CASE WHEN mode = 'strict' OR missed THEN 'discard/reject' ELSE 'candidate/review' END
  WHEN ok THEN 'formal/accept' WHEN mode = 'strict' THEN CASE WHEN outcome = 'review' THEN 'candidate/review' ELSE 'discard/' || outcome END
  WHEN missed THEN CASE WHEN mode = 'practical' THEN 'discard/reject' ELSE 'candidate/review' END
  WHEN outcome = 'reject' AND mode = 'practical' THEN 'discard/reject' ELSE 'candidate/review' END AS x FROM g)
SELECT mode, ok, outcome, missed, unit_ok, ambiguous, split_part(x, '/', 1) AS bucket, split_part(x, '/', 2) AS decision, count(*) AS n FROM r GROUP BY ALL""",
    "families": f"{_FAM} SELECT family_key, min(item_id) AS first_item, count(*) AS members, count(DISTINCT spec) AS sizes, min(name) AS main_query FROM r GROUP BY 1",
    "family_shared_queries": f"{_FAM} SELECT family_key, 2 * count(*) AS alone, 1 + count(DISTINCT spec) AS shared FROM r GROUP BY 1",
    "alias_pairs": f"{_PAIRS} SELECT * FROM pairs",
    "name_gray_dice": f"""{_PAIRS}, s AS (SELECT *, {_CHARS.format(c='name_a')} AS ca, {_CHARS.format(c='name_b')} AS cb, {_GRAMS.format(c='name_a')} AS ga, {_GRAMS.format(c='name_b')} AS gb FROM pairs),
d AS (SELECT name_a, name_b, 2.0::DOUBLE * len(list_intersect(ca, cb)) / CAST(len(ca) + len(cb) AS DOUBLE) AS dice, CAST(len(list_intersect(ga, gb)) AS INTEGER) AS shared_bigrams FROM s)
SELECT *, dice >= 0.45::DOUBLE OR shared_bigrams > 0 AS gray FROM d""",
    "alias_lookup": f"{_PAIRS} SELECT name_a, name_b, CASE WHEN substring(name_a, 1, 1) = substring(name_b, 1, 1) THEN 'different' WHEN length(name_a) = length(name_b) THEN 'same' ELSE 'unknown' END AS relation FROM pairs",
    "name_bag_equal": f"WITH {V.ITEMS}, w AS (SELECT unnest(string_split(lower(name), ' ')) AS word FROM items) SELECT array_to_string(list_sort(string_split(word, '')), '') AS bag, count(*) AS n, count(DISTINCT word) AS words FROM w GROUP BY 1",
    "title_scores": f"""WITH {V.ITEMS}, a AS (SELECT item_id, list_distinct(string_split(lower(name), ' ')) AS must FROM items WHERE item_id % 50 = 0), t AS (SELECT DISTINCT name AS title FROM items)
SELECT item_id, title, CAST(len(list_filter(must, lambda m: contains(replace(lower(title), ' ', ''), m) OR contains(m, replace(lower(title), ' ', '')))) AS INTEGER) AS hits, CAST(len(must) AS INTEGER) AS asked
FROM a, t WHERE len(list_intersect(must, string_split(lower(title), ' '))) > 0""",
    "spec_struct": f"WITH {V.ITEMS} SELECT spec AS bore, 'PN' || CAST(item_id % 3 * 6 + 10 AS VARCHAR) AS pressure, CASE WHEN item_id % 2 = 0 THEN '不锈钢' ELSE '' END AS material, '220V' AS voltage, count(*) AS n, min(item_id) AS first_item FROM items GROUP BY 1, 2, 3, 4",
    "match_gate": f"WITH {V.ITEMS}, o AS (SELECT l_partkey AS item_id, CAST(l_quantity AS INTEGER) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT item_id, quantity, n, true AS name_ok, CASE WHEN spec = 'DN' || CAST(quantity * 10 AS VARCHAR) THEN 'accept' ELSE 'reject' END AS outcome, CASE WHEN spec = 'DN' || CAST(quantity * 10 AS VARCHAR) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM o JOIN items USING (item_id)",
    "pages_text": f"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, sha256({_TEXT}) AS text_sha256, length({_TEXT}) AS chars FROM pages",
    "pages_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(range(0, len(h))) AS pos, unnest(h) AS href FROM l""",
    "domain_quality": r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS domain, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
SELECT domain, CASE WHEN domain = '' OR domain = 'baidu.com' OR ends_with(domain, '.baidu.com') OR contains(domain, 'passport') OR regexp_matches(path, '/login|/signin|/passport|/auth/|/baidu[.]php') THEN 'block'
  WHEN regexp_matches(domain, '采集|转载|seo|知道|文库|百家号|贴吧') AND NOT regexp_matches(domain, '[.]gov[.]cn|ccgp|ggzy') THEN 'low'
  WHEN regexp_matches(domain, '[.]gov[.]cn|ccgp|ggzy|zfcg|1688[.]com|made-in-china|hc360|globalsources|manufacturer') THEN 'high' WHEN regexp_matches(domain, '[.](com|cn)$') THEN 'medium' ELSE 'low' END AS quality,
  count(*) AS n, min(page_id) AS first_page FROM h GROUP BY 1, 2""",
    "url_dedupe": "SELECT lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '')) AS address, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1",
    "document_tokens": r"""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS t FROM documents),
f AS (SELECT doc_id, list_filter(list_concat(regexp_extract_all(t, '(?i)(?:DS-|RG-|ST|iDS-|HM-|JB-|MS-|LRS-|GTYQ-|ZN-|WDZN-)[A-Z0-9/\-.()]+'),
  list_transform(regexp_extract_all(t, '(?i)(?:DN|φ)\s*\d{2,3}(?:\s*[×xX*]\s*\d+(?:\.\d+)?)?'), lambda x: regexp_replace(x, '\s+', '', 'g')),
  list_transform(regexp_extract_all(t, '(?i)\d+(?:\.\d+)?\s*(?:kW|W|V|mm|MPa)'), lambda x: regexp_replace(x, '\s+', '', 'g')),
  list_filter(regexp_extract_all(t, '(?i)[A-Z]{1,6}[-_]?\d{2,}[A-Z0-9\-_/.]*'), lambda x: length(x) >= 4),
  regexp_extract_all(t, '[一-鿿]{2,8}')), lambda x: length(x) >= 2) AS w FROM d)
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)[1:28], '|') AS tokens FROM f""",
    "document_phones": "SELECT doc_id, coalesce(nullif(regexp_extract(coalesce(text, ''), '1[3-9]\\d{9}'), ''), regexp_extract(coalesce(text, ''), '0\\d{2,3}[-–—\\s]?\\d{7,8}')) AS phone FROM documents",
    "search_queries": f"""WITH {V.ITEMS}, f AS (SELECT item_id, brand, substring(trim(name), 1, 24) AS core, substring(trim(name), 1, 28) AS short, spec FROM items),
q AS (SELECT item_id, 'yize' AS platform, list_distinct(list_filter([core, core || ' ' || spec, CASE WHEN length(short) <= 16 THEN short END, brand || ' ' || core], lambda x: length(x) BETWEEN 2 AND 40)) AS d,
    list_filter([core, core || ' ' || spec, CASE WHEN length(short) <= 16 THEN short END, brand || ' ' || core], lambda x: length(x) BETWEEN 2 AND 40) AS l, 3 AS n FROM f
  UNION ALL SELECT item_id, 'jd', NULL, list_filter([brand || ' ' || core, short, core, core || ' ' || spec], lambda x: length(x) BETWEEN 2 AND 40), 2 FROM f),
e AS (SELECT item_id, platform, n, unnest(l) AS query, unnest(range(0, len(l))) AS pos FROM q),
u AS (SELECT item_id, platform, n, query, row_number() OVER (PARTITION BY item_id, platform ORDER BY pos) - 1 AS ord FROM (SELECT item_id, platform, n, arg_min(query, pos) AS query, min(pos) AS pos FROM e GROUP BY item_id, platform, n, lower(query)))
SELECT item_id, platform, CAST(ord AS INTEGER) AS ord, query FROM u WHERE ord < n""",
    "history_upsert": """WITH k AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 = 0 ORDER BY event_id DESC, value DESC) AS n, event_id % 3 = 0 AS new FROM events),
l AS (SELECT * FROM k WHERE n = 1) SELECT user_id, event_type, event_id, value FROM l WHERE new OR NOT EXISTS (SELECT 1 FROM l m WHERE m.new AND m.user_id = l.user_id AND m.event_type = l.event_type)""",
    "history_delete": "SELECT event_id, user_id, event_type, value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)",
    "alias_clusters": f"{_PAIRS.replace('WITH', 'WITH RECURSIVE', 1).replace('PARTITION BY word', 'PARTITION BY word, length(name)')}, e AS (SELECT name_a AS u, name_b AS v FROM pairs WHERE length(name_a) = length(name_b) UNION SELECT name_b, name_a FROM pairs WHERE length(name_a) = length(name_b)), reach AS (SELECT u AS name, u AS other FROM e UNION SELECT r.name, e.v FROM reach r JOIN e ON e.u = r.other) SELECT name, min(other) AS cluster FROM reach GROUP BY 1",
    "hard_tags": f"WITH {V.ITEMS} SELECT item_id, spec AS tags, spec AS must FROM items",
    "header_scores": f"""WITH h(ord, role, hint, priority) AS (VALUES {_HINTS}), p AS (SELECT *, {list(HEADER_WORDS)}[p_partkey % {len(HEADER_WORDS)} + 1] AS w FROM part),
c AS (SELECT CASE p_partkey % 3 WHEN 0 THEN w WHEN 1 THEN w || p_type ELSE p_name || w END AS text FROM p),
m AS (SELECT DISTINCT text, ord, role, priority, CASE WHEN hint = text THEN 1.0::DOUBLE WHEN hint = '单价' THEN 0.55::DOUBLE WHEN hint = '名称' AND NOT regexp_matches(text, '材料|设备|项目') THEN least(0.85::DOUBLE, 0.7::DOUBLE) ELSE 0.85::DOUBLE END + priority / 2000.0::DOUBLE AS s
  FROM c JOIN h ON contains(text, hint) OR contains(hint, text) WHERE length(text) <= 40),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s DESC, ord) AS k FROM m) WHERE k = 1)
SELECT c.text, role, count(*) AS n, round(least(1.0::DOUBLE, coalesce(max(s), 0)), 6) AS score FROM c LEFT JOIN b ON c.text = b.text GROUP BY ALL""",
}
