"""Secret scan with corpus-wide ownership frequency.

Every whole text gives candidate spans: three base kinds that are always reported, and two weaker
kinds that only corpus-wide evidence can confirm. Candidate values are hashed; the hashes are
aggregated over the whole corpus by distinct repositories and distinct owners. A value that
``WIDE`` or more owners (or ``WIDE_REPOS`` repositories) hold is a copied example; one held by fewer
is owner-specific and looks live. Base spans keep their place either way and carry the verdict;
weaker spans are reported only when they look live.

Defined results: null text is an empty text; a null repository or owner counts as one unnamed one;
repeated rows give a row each; a text without candidates gives empty spans; an empty table gives no
rows; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

WIDE = 3
WIDE_REPOS = 10
#: Least bits a character of a weak candidate's value.
ENTROPY = 3.0
#: In the order that breaks ties of spans with one start.
KINDS = ("assign", "access", "hex", "token", "short")
BASE = KINDS[:3]

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run is taken whole, so asking for the length in the pattern drops exactly the shorter runs.
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9_+=-]{20,}")
_MIXED = (re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]"))

SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.string())])
SPANS = "array<struct<start:long,rank:int,end:long,kind:string,hash:string>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str | None) -> list[dict]:
    """All candidate spans of one whole text, by start and then kind."""
    text = text or ""
    found: list[tuple[int, int, str, str]] = []
    for m in _ASSIGN.finditer(text):
        value = m[2]
        if len(value) >= 12:
            found.append((m.start(), m.end(), "assign", value))
        elif len(value) >= 8 and _MIXED[0].search(value) and _MIXED[1].search(value.lower()):
            found.append((m.start(), m.end(), "short", value))
    found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    taken = sorted((s, e) for s, e, k, _ in found if k in BASE)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in _TOKEN.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that start before this one ends
        if all(r.search(m[0]) for r in _MIXED) and not (before and reach[before - 1] > m.start()):
            if entropy(m[0]) >= ENTROPY:
                found.append((m.start(), m.end(), "token", m[0]))
    return [
        {"start": s, "rank": KINDS.index(k), "end": e, "kind": k, "hash": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()}
        for s, e, k, v in sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = pa.array([candidates(t) for t in b.column(3).to_pylist()], pa.list_(SPAN))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), spans], names=["doc_id", "repo", "owner", "spans"])


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo", owner_col: str = "owner"
) -> DataFrame:
    """``(doc_id, spans)``: spans by start and kind, each with its value's hash, owners, repositories and verdict.

    ``verdict`` is ``example`` or ``live``; weak kinds appear only when live.
    """
    common.small_batches(docs.sparkSession)
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.col(text_col).alias("text"),
    )
    found = own.mapInArrow(_scan, f"doc_id long, repo string, owner string, spans {SPANS}")
    found = common.cut(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = found.select("row", "repo", "owner", F.explode("spans").alias("span")).withColumn("hash", F.col("span.hash"))
    # Distinct holders first: a value copied into a third of the corpus shrinks to its holders before it moves.
    holders = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    spread = holders.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"), F.sum("n").alias("n"))
    spread = common.cut(spread, "ownership")
    wide = (F.col("owners") >= WIDE) | (F.col("repos") >= WIDE_REPOS)
    judged = common.join_counted(each, spread, "hash", "n").withColumn("verdict", F.when(wide, "example").otherwise("live"))
    kept = judged.where(F.col("span.kind").isin(*BASE) | (F.col("verdict") == "live"))
    spans = kept.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("span.start", "span.rank", "span.end", "span.kind", "hash", "owners", "repos", "verdict"))).alias("spans")
    )
    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string,hash:string,owners:long,repos:long,verdict:string>>")
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, all spans, and counts by verdict for all documents.

    Documents name one origin, ``source``: it is both the repository and the owner, so ``WIDE`` decides and ``WIDE_REPOS`` never does.
    """
    docs = common.read(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text", F.col("source").alias("repo"), F.col("source").alias("owner")))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE: dict[str, str] = {}
