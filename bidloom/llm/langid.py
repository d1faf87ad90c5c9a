"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts.
A text, whole, lower-cased and with runs of other than letters turned to one space, is compressed in
blocks with each language's dictionary; the language with the smallest total is chosen. Blocks keep
a long text from compressing by itself alone. The score is the share of the choice when each byte
more halves a language's weight. A choice whose margin over the next language is under ``MARGIN`` of the
next one's size is marked rejected.

Bounds of the sample (parameters): about ``SAMPLE_ROWS`` texts a language, chosen by a hash, of each a passage of at most
``PASSAGE`` characters at a place fixed by a hash; a dictionary holds all of them. Everything else covers whole texts and all
rows. Languages are learnt and compared in groups of ``GROUP``, so that a broadcast holds no more dictionaries than that
however many languages there are; each further group is one more pass over the texts.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; ties go to the
language with more labelled rows, then to the lesser name; with no labelled row every text is
``und``; a language whose texts hold no letter has an empty dictionary and is compared like any other;
repeated rows give equal rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

SAMPLE_ROWS = 400
PASSAGE = 256
GROUP = 400
BLOCK = 4096
LEVEL = 5
MARGIN = 0.01
_OTHER = re.compile(r"[\W\d_]+")
#: Of the languages compared so far: the best, its size, the next size, and the sum of all weights, the best one's being 1.
Standing = tuple[str | None, int | None, int | None, float]
NOTHING: Standing = (None, None, None, 0.0)


def normal(text: str) -> bytes:
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Iterator[list[tuple[str, bytes]]]:
    """``(language, dictionary bytes)`` in groups of ``GROUP``, the language with most labelled rows first."""
    own = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    counts = common.cut(own.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    order = [F.desc("n"), F.asc("lang")]
    some = counts.orderBy(*order).limit(GROUP).collect()
    while some:
        yield _dictionaries(own, some)
        last = some[-1]
        after = (F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("lang") > last.lang))
        some = counts.where(after).orderBy(*order).limit(GROUP).collect() if len(some) == GROUP else []


def _dictionaries(own: DataFrame, some: list[Row]) -> list[tuple[str, bytes]]:
    """The dictionaries of the languages ``some`` (lang, n) from rows (text, lang, h)."""
    # A hash threshold for each language, so that about SAMPLE_ROWS rows of it come back.
    share = F.create_map(*[x for r in some for x in (F.lit(r.lang), F.lit(min(1.0, SAMPLE_ROWS / r.n)))])
    place = f"int(pmod(shiftright(h, 20), greatest(length(text) - {PASSAGE}, 0) + 1)) + 1"
    chosen = own.where((F.pmod("h", F.lit(1_000_000)) + 0.5) / 1_000_000 < F.try_element_at(share, F.col("lang")))
    parts = defaultdict(list)
    for r in chosen.select("lang", "h", F.expr(f"substring(text, {place}, {PASSAGE})").alias("part")).dropDuplicates().collect():
        parts[r.lang].append((r.h, r.part))
    # A raw dictionary has eight bytes at least: spaces, which every normal text begins with.
    return [(r.lang, b"".join(normal(p) for _, p in sorted(parts[r.lang])).ljust(8)) for r in some]


class Classifier:
    """A group of learned dictionaries inside a task."""

    def __init__(self, learned: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in learned]
        self.by = []
        for _, raw in learned:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def compare(self, text: str | None, before: Standing = NOTHING) -> Standing:
        """How the languages so far stand for one whole text once this group has been compared as well."""
        if not self.langs or not text or not any(c.isalpha() for c in text):
            return before
        raw = normal(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.by]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        lang, best, second, total = before
        own = sizes[order[0]]
        least = own if best is None else min(own, best)
        total = sum(2.0 ** max(least - s, -1000) for s in sizes) + (0.0 if best is None else total * 2.0 ** max(least - best, -1000))
        low = sorted(x for x in (best, second, *(sizes[i] for i in order[:2])) if x is not None)
        return (lang if best is not None and best <= own else self.langs[order[0]]), least, (low[1] if len(low) > 1 else None), total


def _classifier(learned: list[tuple[str, bytes]]) -> Classifier:
    """The dictionaries are digested once a worker process."""
    key = tuple((lang, hash(raw)) for lang, raw in learned)
    if _classifier.__dict__.get("key") != key:
        _classifier.made, _classifier.key = Classifier(learned), key
    return _classifier.made


def classify(docs: DataFrame, learned: Iterable[list[tuple[str, bytes]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``: a row for each row. ``learned``: groups of dictionaries."""
    spark = docs.sparkSession
    common.small_batches(spark)
    names, types = ["lang", "best", "second", "total"], [pa.string(), pa.int64(), pa.int64(), pa.float64()]
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("best"),
        F.lit(None).cast("long").alias("second"), F.lit(0.0).alias("total"), F.col(text_col).alias("text"),
    )
    groups = iter(learned)
    group = next(groups, None)
    while group is not None:
        held, group = spark.sparkContext.broadcast(group), next(groups, None)
        further = group is not None  # the last pass leaves the texts behind

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held, further: bool = further) -> Iterator[pa.RecordBatch]:
            by = _classifier(held.value)
            for b in batches:
                before = zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)
                found = [by.compare(t, x) for t, x in zip(b.column(5).to_pylist(), before, strict=True)]
                cols = [b.column(0), *(pa.array([x[k] for x in found], t) for k, t in enumerate(types))]
                yield pa.RecordBatch.from_arrays(cols + [b.column(5)] * further, names=["doc_id", *names] + ["text"] * further)

        out = out.mapInArrow(run, "doc_id long, lang string, best long, second long, total double" + ", text string" * further)
    narrow = F.col("best").isNull() | F.coalesce(F.col("second") - F.col("best") < MARGIN * F.col("second"), F.lit(False))
    score = F.when(F.col("best").isNull(), 0.0).otherwise(1 / F.col("total"))
    return out.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), score.alias("score"), narrow.alias("rejected"))


def fold(mod: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for all documents; learnt outside the held-out fold."""
    docs = common.read(spark, sf_dir, "documents")
    learned = learn(docs.where((fold(4) != 2) & F.col("doc_id").isNotNull()))
    found = classify(docs, learned)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict[str, str] = {}
