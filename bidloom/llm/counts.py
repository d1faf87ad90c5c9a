"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch lie in one flat array of symbols with the pre-token of each symbol beside it (ragged rows, no
padding). In every round each sequence finds the least rank among its adjacent pairs and merges that pair at all its places
at once, a run of equal symbols from its left end in steps of two; the array is then compacted, and only pairs that
touch a merged symbol are looked up again. Sequences without a mergeable pair leave the array and count their
symbols. A merge only makes pairs of a higher rank than its own, so merging the least pair everywhere at once gives what merging it
place by place gives. ``Vocabulary`` checks that property of a merge list.

A sequence of over ``LONG`` symbols would keep a batch going for as many rounds as it has ranks. It is merged by the same rule with
an index: places are held by rank, the least rank is applied at all its places at once, and only places that a merge makes
new are added. Each rank is met once at most, so time is bounded by symbols times their logarithm and by the number of ranks.

Vocabularies are tokenizer files of the byte-level BPE kind; anything in a file that would count in another
way (normalizers, other pre-tokenizers, dropout, prefixes) is refused. Added tokens of a file are found in texts as its library
does by default: leftmost, longest first, one token each.

Defined results: null and empty texts have no tokens; repeated rows give equal rows; extra columns are ignored; an empty
table gives no rows. The file is read on the driver and broadcast: ``MAX_FILE`` bounds it, not the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

MAX_FILE = 64_000_000
#: Pre-tokens whose counts a worker remembers between batches, and characters of them; beyond either it starts afresh, results do not change.
MEMORY, MEMORY_CHARS = 300_000, 8_000_000
LONG = 256
#: Symbols that are merged in one array.
FLAT = 1_000_000
NONE = np.int32(2**31 - 1)
#: How byte-level tokenizers split texts; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 characters as themselves, all others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What a file says: byte symbols, merges with their ranks, added tokens."""

    def __init__(self, text: str):
        file = json.loads(text)
        model, splits = file["model"], file.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or file.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are counted")
        if splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
            raise ValueError("only byte-level pre-tokenizers without a prefix space are counted")
        if any(t[k] for t in file.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that match by words or eat space are not counted")
        ids, letters = model["vocab"], byte_letters()
        if missing := [c for c in letters if c not in ids]:
            raise ValueError(f"bytes without a symbol: {len(missing)}")
        self.byte_id = np.zeros(256, dtype=np.int32)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left, self.right = (np.array([ids[p[i]] for p in pairs], dtype=np.int32) for i in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        # A symbol must be made before it is part of a later merge, or merging a pair everywhere at once would not be the library's order.
        first = np.full(max(ids.values()) + 1, NONE, dtype=np.int64)
        np.minimum.at(first, self.made, np.arange(len(pairs)))
        first[self.byte_id] = -1
        if len(pairs) and (np.maximum(first[self.left], first[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        self.added = sorted((t["content"] for t in file.get("added_tokens") or []), key=len, reverse=True)


class Counter:
    """Counts the symbols that are left of byte strings, inside a task."""

    def __init__(self, words: Vocabulary):
        self.words, self.split = words, regex.compile(PATTERN)
        self.added = regex.compile("|".join(map(regex.escape, words.added))) if words.added else None
        keys = words.left.astype(np.int64) << 32 | words.right.astype(np.int64)
        bits = max(4, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 4
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        slot, todo, self.depth = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):  # open addressing: of the keys that want a free slot one gets it, the others go one on
            at, first = np.unique(slot[todo], return_index=True)
            won = todo[first[self.keys[at] == -1]]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
            self.depth += 1
        self.known: dict[str, int] = {}
        self.chars = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``NONE``."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot, out = self._slot(keys), np.full(len(keys), NONE, dtype=np.int32)
        rest = np.arange(len(keys))
        for _ in range(self.depth):
            seen = self.keys[slot]
            hit = seen == keys
            out[rest[hit]] = self.ranks[slot[hit]]
            on = np.nonzero(~hit & (seen != -1))[0]
            if not len(on):
                break
            rest, keys, slot = rest[on], keys[on], (slot[on] + 1) & self.mask
        return out

    @staticmethod
    def alternate(at: np.ndarray, adjoin: np.ndarray) -> np.ndarray:
        """Of the ordered places ``at``, every other one of each chain in which a place ``adjoin``s the one before it, the first included."""
        n = np.arange(len(at))
        start = np.maximum.accumulate(np.where(adjoin, 0, n))
        return at[(n - start) % 2 == 0]

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols left of each piece, all pieces merged side by side."""
        out = np.array([len(p) for p in pieces], dtype=np.int64)
        sym = self.words.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), out)
        rank = np.full(len(sym), NONE, dtype=np.int32)  # of the pair that begins here
        inner = np.nonzero(seq[:-1] == seq[1:])[0]
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        while len(sym):
            begin = np.concatenate([[0], np.nonzero(seq[1:] != seq[:-1])[0] + 1])
            size = np.diff(np.append(begin, len(seq)))
            least = np.minimum.reduceat(rank, begin)
            done = least == NONE
            out[seq[begin[done]]] = size[done]
            go = np.repeat(~done, size)
            least = np.repeat(least, size)[go]
            sym, seq, rank = sym[go], seq[go], rank[go]
            at = np.nonzero(rank == least)[0]
            at = self.alternate(at, np.concatenate([[False], at[1:] == at[:-1] + 1])) if len(at) else at
            if not len(at):
                break
            sym[at] = self.words.made[rank[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, seq, rank, at = sym[stay], seq[stay], rank[stay], place[at]
            # Pairs that hold a merged symbol: those that begin with it and those that begin before it.
            again = np.unique(np.concatenate([at, at - 1]))
            again = again[again >= 0]
            rank[again] = NONE
            inner = again[again + 1 < len(seq)]
            inner = inner[seq[inner] == seq[inner + 1]]
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
        return out

    def merge_long(self, piece: bytes) -> int:
        """The number of symbols left of one long piece: its least rank at all its places at once, places held by rank."""
        sym = self.words.byte_id[np.frombuffer(piece, dtype=np.uint8)].copy()
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            found = self.rank(sym[at], sym[after[at]])
            at, found = at[found != NONE], found[found != NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.concatenate([[0], np.nonzero(np.diff(found))[0] + 1, [len(found)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo < hi:
                    r = int(found[lo])
                    if r not in places:
                        places[r] = []
                        heapq.heappush(heap, r)
                    places[r].append(at[lo:hi])

        add(np.arange(n - 1))
        left = n
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            # Places whose pair has changed since are no more this rank's.
            at = at[(sym[at] == self.words.left[r]) & (after[at] < n)]
            at = at[sym[after[at]] == self.words.right[r]]
            if not len(at):
                continue
            at = self.alternate(at, np.concatenate([[False], after[at[:-1]] == at[1:]]))
            gone = after[at]
            sym[at], sym[gone] = self.words.made[r], -1
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            left -= len(at)
            add(np.unique(np.concatenate([before[at[before[at] >= 0]], at[inside]])))
        return left

    def learn(self, pieces: set[str]) -> None:
        """Counts the pieces that are not known yet."""
        if len(self.known) > MEMORY or self.chars > MEMORY_CHARS:
            self.known, self.chars = {}, 0
        new = [p for p in pieces if p not in self.known]
        raw = [p.encode("utf-8") for p in new]
        self.chars += sum(map(len, new))
        short = [i for i, p in enumerate(raw) if len(p) <= LONG]
        bounds = np.cumsum([len(raw[i]) for i in short]) // FLAT if short else np.zeros(0, dtype=np.int64)
        for part in np.split(np.array(short, dtype=np.int64), np.nonzero(np.diff(bounds))[0] + 1):
            part = part.tolist()
            self.known.update(zip((new[i] for i in part), self.merge([raw[i] for i in part]).tolist(), strict=True))
        for i, p in enumerate(raw):
            if len(p) > LONG:
                self.known[new[i]] = self.merge_long(p)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens stand between them."""
        if self.added is None:
            return self.split.findall(text), 0
        parts = self.added.split(text)
        return list(chain.from_iterable(map(self.split.findall, parts))), len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.pieces(t) if t else ([], 0) for t in texts]
        self.learn(set().union(*(p for p, _ in cut)))
        return [sum(map(self.known.__getitem__, p)) + extra for p, extra in cut]


def load(path: str) -> str:
    with open(path, "rb") as f:
        raw = f.read(MAX_FILE + 1)
    if len(raw) > MAX_FILE:
        raise ValueError("the vocabulary file is too large to broadcast")
    Vocabulary(raw.decode("utf-8"))  # refused here, not in a task
    return raw.decode("utf-8")


def _counter(file: Broadcast, name: str) -> Counter:
    """One counter a worker process and file."""
    if _counter.__dict__.get("key") != name:
        _counter.counter, _counter.key = Counter(Vocabulary(file.value)), name
    return _counter.counter


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``: UTF-8 bytes and tokens of each row's whole text, and whether these are over ``limit``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    text = load(path)
    file, name = spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(file, name)
        for b in batches:
            n = pa.array(counter.count(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text")
    )
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (512) for all documents."""
    import public_tokenizers

    return count_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE: dict[str, str] = {}
