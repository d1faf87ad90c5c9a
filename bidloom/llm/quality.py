"""Quality rules by hashed n-gram log-likelihood ratio, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 3-word windows of each whole text. The
verdict compares two multinomials over ``BUCKETS`` hashed n-grams (single and double tokens, a token
being a run of letters and digits or one other mark): the raw corpus, counted over all documents, and
the trusted target, counted over all documents that are marked trusted and smoothed towards the raw one
by ``PRIOR`` pseudo-counts. A document's score is its mean log ratio an n-gram; it is kept from ``THRESHOLD``
on. With no trusted text the ratio is zero everywhere, and every document passes this part.

Counting is one scan: n-grams are summed up on the map side to at most ``BUCKETS`` rows a task, and the
table of ratios has ``BUCKETS`` doubles whatever the corpus size. Trusted ids are broadcast only while
there are at most ``BROADCAST_IDS`` of them; beyond that the join shuffles.

Defined results: a null text is empty; texts without n-grams score 0; repeated rows each count and each
give a row; null ids are never trusted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

BUCKETS = 1 << 16
PRIOR = float(BUCKETS)
THRESHOLD = -0.1
BROADCAST_IDS = 500_000
MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def with_buckets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``buckets``: the hashed n-grams of the text, repeats included."""
    low = F.lit(BUCKETS - 1)
    out = df.withColumn("hashes", F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    pairs = F.greatest(F.size("hashes") - 1, F.lit(0))
    double = F.zip_with(F.slice("hashes", 1, pairs), F.slice("hashes", 2, pairs), lambda a, b: F.xxhash64(a, b).bitwiseAND(low).cast("int"))
    single = F.transform("hashes", lambda h: h.bitwiseAND(low).cast("int"))
    return out.withColumn("buckets", F.concat(single, double)).drop("hashes")


def ratio_table(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(ratios array<double>)``: the log ratio of each bucket. ``trusted``: the ids (column ``id_col``)."""
    spark = docs.sparkSession
    ids = trusted.select(F.col(id_col).alias("key")).where("key is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    own = own.join(ids.withColumn("good", F.lit(1)), "key", "left")
    # An outer explode: an inner one would have every n-gram computed again for a filter on the array's size.
    counts = (
        with_buckets(own)
        .select("good", F.explode_outer("buckets").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    )
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    row = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("t"), F.sum("raw").alias("r"), F.sum("target").alias("g"))
    raw = lambda x: (x["raw"] + 1.0) / (F.col("r") + float(BUCKETS))
    ratio = lambda x: F.log((x["target"] / raw(x) + PRIOR) / (F.col("g") + PRIOR))
    return row.select(F.transform("t", ratio).alias("ratios"))


def base_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("words", _words(text)).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    windows = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))
    out = out.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "windows": windows,
    }).drop("words", "lines")
    # Only texts with a repeated window need their windows in order with their places.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("placed", placed).drop("windows")
    same = lambda x, k: (F.get("placed", k - 1)["h"] == x["h"]) | (F.get("placed", k + 1)["h"] == x["h"])
    places = F.sort_array(F.transform(F.filter("placed", same), lambda x: x["i"]))
    # A window covers three words; less where it overlaps the repeated window before it.
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("placed")


def rate(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, ``score``, ``base_failed`` and ``kept`` of each row of ``docs`` by id."""
    ratios = ratio_table(docs, trusted, id_col, text_col).scalar()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_buckets(base_rules(own)).withColumn("ratios", ratios)
    total = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get("ratios", b))
    out = out.withColumn("score", F.coalesce(F.try_divide(total, F.size("buckets")), F.lit(0.0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score",
    )


def op8_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base_failed, kept and score for all documents; the target is documents labelled quality 1."""
    good = common.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rate(common.read(spark, sf_dir, "documents"), good)


QUERIES = {"op8_quality_llr": op8_quality_llr}
ORACLE: dict[str, str] = {}
