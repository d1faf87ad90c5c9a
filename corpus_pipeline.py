"""From raw documents to token ids: five stages, each written as Parquet and read again.

1. ``toxicity``: documents that score 0.5 or more go. The network learns from the documents that are
   labelled in the table ``labels`` of the same folder.
2. ``near_duplicates``: of each SimHash component the document with the least id stays, as one row.
   Rows without an id stay only where none of their component has one.
3. ``decontamination``: documents that hold a benchmark item within 10 % edits go.
4. ``pii``: personal data give way to keyed surrogates; no document goes.
5. ``tokens``: texts become byte-level BPE ids, with the decoded text beside them.

All but the last stage return the columns of their input. A null text is scored, linked, kept and
encoded as an empty one; its row keeps the null. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bidloom.llm import bpe, common, decontaminate, pii, simhash, toxicity

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net, prior = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.keep(docs, net, prior)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The key of the surrogates is the session's setting ``spark.bidloom.pii.key``; without one the public key of the module, which is for tests."""
    key = spark.conf.get("spark.bidloom.pii.key", "").encode() or pii.DEMO_KEY
    return pii.anonymise(docs, key)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded, and the counts and digests of both."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(found, "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the table ``documents``; what one stage keeps is written and read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
