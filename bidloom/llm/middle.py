"""Fill-in-middle transformation by in-place block rotation.

A text's units are runs of ASCII letters and single other characters. Two keyed cuts split them into prefix, middle and
suffix. A scan over the UTF-8 bytes finds the cuts; a bytearray then takes the segments in their own order, each after its
sentinel; neighbouring segments change places by three reversals inside that buffer: the segments one by one, then both
together. ``psm`` exchanges middle and suffix, ``spm`` then prefix and suffix. Going back, the same rotations are undone
and the sentinels cut out, which gives the text byte by byte. Reversals swap ``BLOCK`` bytes at a time, so a rotation needs no second copy of the text.

The result is computed over all of a text. As no text that holds a sentinel is transformed, and as sentinels begin with a
character that occurs in them once and end with another, a transformed text holds each sentinel once.

Defined results: a null text counts as empty; empty texts, texts that hold a sentinel and the texts that the third
number leaves stay as they are (form ``plain``); a null id is hashed as an empty string; repeated rows give equal rows;
extra columns are ignored; an empty table gives no rows. Texts are handled as bytes, so invalid UTF-8 passes through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

#: Bytes that a reversal swaps at a time.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Plan:
    """How texts are transformed: the key of the cuts, percentages of transformed texts and, of these, of suffix-first ones, and the sentinels."""

    key: str = "1"
    rate: int = 90
    suffix_first: int = 20
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def __post_init__(self):
        marks = self.marks
        plain = all(len(m) > 2 and m.isascii() and m[:1] not in m[1:] and m[-1:] not in m[:-1] for m in marks)
        if len(set(marks)) < 3 or len({m[:1] for m in marks}) > 1 or len({m[-1:] for m in marks}) > 1 or len({len(m) for m in marks}) > 1 or not plain:
            raise ValueError("sentinels must be distinct ASCII strings of one length, of three characters or more, with a first and a last character that they share and that occur in them once")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle


def unit_starts(text: bytes) -> np.ndarray:
    """Places of the bytes that begin a unit: any character but a letter that follows a letter."""
    raw = np.frombuffer(text, dtype=np.uint8)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def characters(buffer: bytes | bytearray, lo: int, hi: int) -> int:
    return int(((np.frombuffer(buffer, dtype=np.uint8)[lo:hi] & 0xC0) != 0x80).sum())


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Reverses ``view[lo:hi]`` in place, from both ends inwards."""
    while hi - lo > 1:
        n = min(BLOCK, (hi - lo) // 2)
        left = view[lo : lo + n].copy()
        view[lo : lo + n] = view[hi - n : hi][::-1]
        view[hi - n : hi] = left[::-1]
        lo, hi = lo + n, hi - n


def exchange(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """The segments ``[lo, mid)`` and ``[mid, hi)`` change places."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    reverse(view, lo, mid)
    reverse(view, mid, hi)
    reverse(view, lo, hi)


def transform(text: bytes, first: int, second: int, spm: bool, plan: Plan) -> bytearray:
    """``text`` cut at two places and put in the order that ``spm`` names, behind sentinels."""
    out, n = bytearray(text), len(plan.prefix)
    for at, mark in ((second, plan.suffix), (first, plan.middle), (0, plan.prefix)):
        out[at:at] = mark
    first, second = first + n, second + 2 * n  # where the sentinels of middle and suffix begin
    exchange(out, first, second, len(out))
    if spm:
        exchange(out, 0, first, first + len(out) - second)
    return out


def invert(output: bytes, form: str, plan: Plan) -> bytes:
    """The text that was transformed to ``output``."""
    if form == "plain":
        return output
    out, n = bytearray(output), len(plan.prefix)
    if form == "spm":
        exchange(out, 0, out.find(plan.prefix), out.find(plan.middle))
    first, suffix = out.find(plan.suffix), out.find(plan.middle)  # behind the prefix stand suffix and middle
    exchange(out, first, suffix, len(out))
    second = first + len(out) - suffix
    for at in (second, first, 0):
        del out[at : at + n]
    return bytes(out)


def keyed(id_: Column, key: str) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of key and id."""
    h = F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def fill_in_middle(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``: units, form, the lengths of prefix and middle, the transformed bytes."""
    plan = plan or Plan()
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keyed(F.col(id_col), plan.key), text.alias("text"))

    def row(h1: int, h2: int, h3: int, h4: int, text: bytes) -> tuple:
        starts = unit_starts(text)
        n = len(starts)
        if not text or h3 % 100 >= plan.rate or any(m in text for m in plan.marks):
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        first, second = (int(starts[k]) if k < n else len(text) for k in (first, second))
        spm = h4 % 100 < plan.suffix_first
        return n, "spm" if spm else "psm", characters(text, 0, first), characters(text, first, second), bytes(transform(text, first, second, spm, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            made = list(zip(*(row(*x) for x in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True)), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, made, kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, SCHEMA)


def restored(transformed: DataFrame, plan: Plan | None = None) -> DataFrame:
    """``transformed`` with a column ``restored``: the bytes of the text, rebuilt from ``output`` and ``form`` alone. Null outputs give null."""
    plan = plan or Plan()
    common.small_batches(transformed.sparkSession)
    names = transformed.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in transformed.dtypes) + ", restored binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if o is None else invert(o, f, plan) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*names, "restored"])

    return transformed.mapInArrow(run, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for all documents."""
    made = restored(fill_in_middle(common.read(spark, sf_dir, "documents")))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLE = {
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
k AS (SELECT *, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
       WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM s"""
}
