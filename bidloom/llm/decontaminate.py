"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are brought to one form (lower case, runs of other than letters and digits to one
space). An item of m characters has an error budget of ``k = floor(RATE * m)`` edits and is split
into k + 1 pieces: a passage within k edits of the item must hold one piece unchanged. All pieces are
found in whole texts by one Aho-Corasick pass; the surroundings of each hit are verified with Myers'
bit-parallel distance, so every match within budget is found and nothing beyond it is reported.
A match begins and ends at a word's border (or beside a letter of a script that is written without spaces), so the item
"no" is not found in "another". Verification climbs: the pieces are the leaves of a binary tree in which a node of j pieces has a budget of
j - 1 edits. Of a node's two halves one must keep its own budget, so some leaf of a true match has all nodes
above it within theirs, and a hit is given up at the first node that is not. Items that share a piece are first looked at
together: those for which the stretch lacks more characters than their budget are left out. What a string of a node costs at a
place is worked out once, whichever pieces and items lead there.

Items reach the tasks in blocks of about ``BLOCK_CHARS`` characters, each broadcast and searched in its
own pass, so a benchmark of any size never makes a large broadcast; texts are streamed and not shuffled.

Defined results: null and empty texts match nothing; null, empty and symbol-only items match nothing;
items with equal texts are all reported; an item without an id is matched like any other and reported with a null id; repeated rows are reported each; an empty table gives no
rows; extra columns do not matter. A text that only shares a part of an item is not a match.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

RATE = 0.1
BLOCK_CHARS = 8_000_000
#: Items of one piece that are looked at all at once, kinds of characters told apart there, and findings kept while a text is read.
GROUP, BUCKETS, KNOWN = 8, 61, 200_000
_OTHER = re.compile(r"[\W_]+")
#: Letters of scripts written without spaces between words: Thai to Myanmar, Khmer, kana, CJK.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in ``budget + 1`` parts of nearly equal length."""
    at = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(x, item[x:y]) for x, y in zip(at, at[1:], strict=False)]


def myers(masks: dict[str, int], m: int, text: str, enough: int = 0) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of ``text`` and the end of the first such part.

    The search ends at the first distance of at most ``enough``.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
                if best <= enough:
                    break
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


def buckets(text: str) -> np.ndarray:
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % BUCKETS).astype(np.int64)


def bordered(text: str, at: int) -> bool:
    """Whether a match may begin or end between the characters ``at - 1`` and ``at`` of a normalised text."""
    if not 0 < at < len(text) or text[at - 1] == " " or text[at] == " ":
        return True
    return bool(_UNSPACED.match(text[at - 1]) or _UNSPACED.match(text[at]))


def ends(masks: dict[str, int], m: int, text: str, k: int) -> list[tuple[int, int]]:
    """(distance, end) of each end in ``text`` at which some part of it is within k edits of the pattern."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        if score <= k:
            out.append((score, i + 1))
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return out


def prefixes(masks: dict[str, int], m: int, text: str) -> Iterator[int]:
    """The edit distance of the pattern to the first 1, 2, ... characters of ``text``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        yield score
        ph, mh = ph << 1 | 1, mh << 1  # each further character of the text costs one
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full


class Matcher:
    """One block of items inside a task."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.ids = defaultdict(list)
        for i, t in items:
            self.ids[t].append(i)
        self.items = sorted(self.ids)
        self.budget = [int(rate * len(t)) for t in self.items]
        self.starts = [[o for o, _ in pieces(t, k)] + [len(t)] for t, k in zip(self.items, self.budget, strict=True)]
        self.nodes: dict[tuple[int, int, int], tuple[int, dict[str, int]]] = {}
        self.strings: dict[str, tuple[int, dict[str, int]]] = {}
        self.backward: dict[int, dict[str, int]] = {}
        places = defaultdict(list)
        for n, t in enumerate(self.items):
            for p, (_, piece) in enumerate(pieces(t, self.budget[n])):
                places[piece].append((n, p))
        self.machine = ahocorasick.Automaton()
        for piece, at in places.items():
            self.machine.add_word(piece, (len(piece), self._groups(at)))
        self.machine.make_automaton()
        self.bags = np.zeros((len(self.items), BUCKETS), dtype=np.int32)
        for n, t in enumerate(self.items):
            self.bags[n] = np.bincount(buckets(t), minlength=BUCKETS)

    def _groups(self, at: list[tuple[int, int]]) -> list[tuple[list[tuple[int, int]], tuple | None]]:
        """The items of one piece, by length and by where the piece stands; of ``GROUP`` or more what ``_possible`` needs to look at all at once."""
        parts = defaultdict(list)
        for n, p in at:
            parts[len(self.items[n]).bit_length(), self.starts[n][p] >> 5].append((n, p))
        out = []
        for own in parts.values():
            wide = None
            if len(own) >= GROUP:
                before = max(self.starts[n][p] + self.budget[n] for n, p in own)
                after = max(len(self.items[n]) - self.starts[n][p] + self.budget[n] for n, p in own)
                wide = before, after, np.array([n for n, _ in own]), np.array([self.budget[n] for n, _ in own])
            out.append((own, wide))
        return out

    def _possible(self, wide: tuple, codes: np.ndarray, at: int) -> np.ndarray:
        """Which items of a group the stretch around a piece has characters for: each one that it lacks is an edit."""
        before, after, items, budget = wide
        here = np.bincount(codes[max(0, at - before) : at + after], minlength=BUCKETS)
        return np.nonzero(np.maximum(self.bags[items] - here, 0).sum(axis=1) <= budget)[0]

    def find(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, distance, end in the normalised text) of each item within its budget, at its best place."""
        text, near = normal(text), defaultdict(set)
        if not text or not self.items:
            return []
        codes, known = None, {}
        for last, (size, groups) in self.machine.iter(text):
            at = last + 1 - size
            for own, wide in groups:
                if wide is not None:
                    codes = buckets(text) if codes is None else codes
                    own = [own[i] for i in self._possible(wide, codes, at)]
                for n, p in own:
                    start = at - self.starts[n][p]
                    if start not in near.get(n, ()) and self._climbs(n, p, text, start, known):
                        near[n].add(start)
        out = []
        for n, starts in near.items():
            k, m, best = self.budget[n], len(self.items[n]), None
            for lo, hi in self._windows(starts, m, k, len(text)):
                found = self._bordered_match(n, text, lo, hi)
                if found and (best is None or found[0] < best[0]):
                    best = found
            if best:
                out += [(i, *best) for i in self.ids[self.items[n]]]
        return sorted(out, key=lambda x: (x[0] is not None, x))

    def _bordered_match(self, n: int, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """(distance, end) of the best match of an item in ``text[lo:hi]`` that has borders on both sides."""
        item, k = self.items[n], self.budget[n]
        found = [(d, lo + e) for d, e in ends(self._masks(n, 0, k + 1), len(item), text[lo:hi], k) if bordered(text, lo + e)]
        best: tuple[int, int] | None = None
        for least, end in sorted(found):  # a match that ends here has at least so many edits
            if best is not None and least >= best[0]:
                break
            if k == 0:
                if bordered(text, end - len(item)):
                    return 0, end
                continue
            if (mask := self.backward.get(n)) is None:
                mask = self.backward[n] = {}
                for j, c in enumerate(reversed(item)):
                    mask[c] = mask.get(c, 0) | 1 << j
            back = text[max(0, end - len(item) - k) : end][::-1]
            own = [d for j, d in enumerate(prefixes(mask, len(item), back)) if d <= k and bordered(text, end - j - 1)]
            if own and (best is None or min(own) < best[0]):
                best = min(own), end
        return best

    def _node(self, n: int, lo: int, hi: int) -> tuple[int, dict[str, int]]:
        """The pieces lo to hi of an item: a number that items with the same string there share, and where each character stands in it."""
        if (node := self.nodes.get((n, lo, hi))) is None:
            own = self.items[n][self.starts[n][lo] : self.starts[n][hi]]
            if own not in self.strings:
                mask: dict[str, int] = {}
                for j, c in enumerate(own):
                    mask[c] = mask.get(c, 0) | 1 << j
                self.strings[own] = len(self.strings), mask
            node = self.nodes[n, lo, hi] = self.strings[own]
        return node

    def _masks(self, n: int, lo: int, hi: int) -> dict[str, int]:
        return self._node(n, lo, hi)[1]

    def _climbs(self, n: int, p: int, text: str, start: int, known: dict[tuple[int, int, int], bool]) -> bool:
        """Whether all nodes between the root and piece p keep their budgets, for an item that begins at ``start`` by that piece's place.

        ``known`` holds what was found for a string at a place: other pieces of the item and items that share the string do not look again."""
        starts, path = self.starts[n], []
        lo, hi = 0, self.budget[n] + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if p < mid else (mid, hi)
            path.append((lo, hi))
        if len(known) > KNOWN:
            known.clear()
        for lo, hi in reversed(path[:-1]):  # the last is the piece itself
            k = hi - lo - 1
            name, masks = self._node(n, lo, hi)
            place = start + starts[lo]
            if (held := known.get((name, k, place))) is None:
                held = known[name, k, place] = myers(masks, starts[hi] - starts[lo], text[max(0, place - k) : start + starts[hi] + k], k)[0] <= k
            if not held:
                return False
        return True

    @staticmethod
    def _windows(starts: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
        """The stretches that may hold the item, overlapping ones as one."""
        lo = hi = None
        for s in sorted(set(starts)):
            a, b = max(0, s - k), min(n, s + m + k)
            if hi is not None and a <= hi:
                hi = max(hi, b)
                continue
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
        if hi is not None:
            yield lo, hi


def blocks(bench: DataFrame, id_col: str | None, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[Broadcast]:
    """The items as broadcasts of (id, normal text), about ``block_chars`` each; without ids each text once."""
    own = bench.select((F.lit(None) if id_col is None else F.col(id_col)).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    own = own.distinct() if id_col is None else own
    n = -(-int(own.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars)
    for k in range(n):
        part = own.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k).collect()
        yield bench.sparkSession.sparkContext.broadcast([(r.i, x) for r in part if (x := normal(r.t))])


def _matcher(items: Broadcast, rate: float) -> Matcher:
    """The last block's matcher stays with the worker process."""
    key = (len(items.value), hash(tuple(items.value)), rate)
    if _matcher.__dict__.get("key") != key:
        _matcher.made, _matcher.key = Matcher(items.value, rate), key
    return _matcher.made


def matches(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
) -> DataFrame:
    """``(doc_id, item_id, distance, end_at)``: each document and test item that it holds within the budget."""
    spark = docs.sparkSession
    common.small_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, end_at int"
    out = spark.createDataFrame([], schema)
    for items in blocks(bench, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            found = _matcher(items, rate)
            for b in batches:
                rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in found.find(t)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "distance", "end_at"])

        out = out.unionByName(own.mapInArrow(run, schema))
    return out


def decontaminate(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_text_col: str = "text", rate: float = RATE
) -> DataFrame:
    """``docs`` without the rows that hold a test item within the budget; all columns stay. Items need no ids."""
    common.small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for items in blocks(bench, None, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items: Broadcast = items) -> Iterator[pa.RecordBatch]:
            found = _matcher(items, rate)
            for b in batches:
                yield b.filter(pa.array([not found.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, end_at for every document that holds a benchmark item within 10 % edits."""
    return matches(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
ORACLE: dict[str, str] = {}
