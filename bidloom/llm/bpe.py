"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Each Arrow batch is split by the public pattern; the distinct pieces of the batch are put in
matrices of one row per piece, bucketed and padded by length. In every round each row merges its
leftmost pair of least rank: ranks come from a hashed pair table (sorted 64-bit pair keys), the merged
position is written, and the row is compacted one step to the left. Rows without a mergeable pair
leave the matrix. Merging one pair a round in rank order, leftmost first, gives what the rank
definition gives: the pair of least rank in the piece, the leftmost of equals, until none is left.

Pieces of over ``LONG`` bytes, which would make a wide matrix, are merged one by one by the same
rule on a heap, in n log n, so one giant "word" cannot fill memory.

Defined results: null and empty texts give no ids and decode to the empty string; repeated rows give
equal rows; extra columns are ignored; an empty table gives no rows; special-token strings are
ordinary text. Vocabulary files are read on the driver and broadcast: their size is fixed by the file
(``MAX_VOCAB_BYTES`` is checked), not by the data.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

MAX_VOCAB_BYTES = 64_000_000
#: Pieces, and ids of them, that a worker remembers between batches; beyond either it starts afresh, results do not change.
MEMORY, MEMORY_IDS = 200_000, 4_000_000
LONG = 512
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256, LONG)
#: Cells of one matrix.
CELLS = 4_000_000
NONE = np.int64(2**31)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in rank order; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCAB_BYTES + 1)
    if len(raw) > MAX_VOCAB_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    pairs = [line.split() for line in raw.splitlines() if line]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if len(set(tokens)) != len(tokens) or b"" in tokens:
        raise ValueError("ranks must be distinct tokens numbered from 0")
    return tokens


class Codec:
    """Encoding and decoding by one vocabulary inside a task."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.split = tokens, regex.compile(pattern)
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int64)
        # A pair of ids merges to the id of their joined bytes: every split of a token in two tokens.
        left, right, made = [], [], []
        for t, i in rank.items():
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        # Open-addressing table: multiplicative hash, linear probing to a bounded depth.
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.table = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.full(1 << self.bits, NONE, dtype=np.int64)
        self.depth = 0
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.table[slot[todo]] == -1
            at = slot[todo[free]]
            _, first = np.unique(at, return_index=True)
            won = todo[free][first]
            self.table[slot[won]], self.value[slot[won]] = keys[won], np.array(made, dtype=np.int64)[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
            self.depth += 1
        self._forget()

    def _forget(self) -> None:
        """No piece is known: ``number`` gives a piece's place in ``start``, the ends of its ids in ``ids``."""
        self.number: dict[str, int] = {}
        self.start = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged id of each pair, or ``NONE``."""
        keys = a << 32 | b
        slot, out = self._slot(keys), np.full(keys.shape, NONE, dtype=np.int64)
        seen = self.table[slot]
        hit = seen == keys
        out[hit] = self.value[slot[hit]]
        rest = np.nonzero(~hit & (seen != -1))
        slot, keys = slot[rest], keys[rest]
        for _ in range(self.depth):
            if not len(keys):
                break
            slot = (slot + 1) & (len(self.table) - 1)
            seen = self.table[slot]
            hit = seen == keys
            out[tuple(r[hit] for r in rest)] = self.value[slot[hit]]
            on = ~hit & (seen != -1)
            rest, slot, keys = tuple(r[on] for r in rest), slot[on], keys[on]
        return out

    def merge_matrix(self, ids: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """Rows of ids padded to one width, ``size`` of them real: each row's final ids."""
        out: list[list[int]] = [[]] * len(ids)
        rows = np.arange(len(ids))
        col = np.arange(ids.shape[1])
        rank = np.full(ids.shape, NONE, dtype=np.int64)
        if ids.shape[1] > 1:
            rank[:, :-1] = self.pair_rank(ids[:, :-1], ids[:, 1:])
        rank[col[None, :] >= size[:, None] - 1] = NONE
        while len(rows):
            at = rank.argmin(axis=1)  # the leftmost of the least
            n = np.arange(len(rows))
            made = rank[n, at]
            stop = made == NONE
            if stop.any():
                for r in np.nonzero(stop)[0]:
                    out[rows[r]] = ids[r, : size[r]].tolist()
                go = ~stop
                rows, ids, rank, size, at, made = rows[go], ids[go], rank[go], size[go], at[go], made[go]
                if not len(rows):
                    break
                n = np.arange(len(rows))
                width = int(size.max())
                ids, rank, col = ids[:, :width], rank[:, :width], col[:width]
            # Compaction: what stands right of the merged pair moves one step left.
            take = np.minimum(col[None, :] + (col[None, :] > at[:, None]), ids.shape[1] - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[n, at] = made
            size = size - 1
            rank[n, size - 1] = NONE
            right = at < size - 1
            rank[n[right], at[right]] = self.pair_rank(made[right], ids[n[right], at[right] + 1])
            rank[n[~right], at[~right]] = NONE
            left = at > 0
            rank[n[left], at[left] - 1] = self.pair_rank(ids[n[left], at[left] - 1], made[left])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece: the same merges on a heap of (rank, place)."""
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        rank = lambda a, b: int(self.pair_rank(np.array([a]), np.array([b]))[0])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank(r, ids[after[i]])) != NONE:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := rank(ids[before[i]], r)) != NONE:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return [x for x in ids if x != -1]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        by_width: dict[int, list[int]] = {w: [] for w in WIDTHS}
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self.merge_long(p)
            elif p:
                by_width[next(w for w in WIDTHS if len(p) <= w)].append(i)
        for width, own in by_width.items():
            step = max(1, CELLS // width)
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                raw = b"".join(pieces[i].ljust(width, b"\0") for i in part)
                ids = self.byte_id[np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)]
                size = np.array([len(pieces[i]) for i in part])
                for i, row in zip(part, self.merge_matrix(ids, size), strict=True):
                    out[i] = row
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that are not known yet."""
        if len(self.number) > MEMORY or len(self.ids) > MEMORY_IDS:
            self._forget()
        new = [p for p in pieces if p not in self.number]
        rows = self.encode_pieces([p.encode("utf-8") for p in new])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        self.start = np.concatenate([self.start, self.start[-1] + ends])
        self.ids = np.concatenate([self.ids, np.array([x for r in rows for x in r], dtype=np.int32)])

    def gather(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces one after another, and how many ids stand before each piece and in all."""
        at = np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        size = self.start[at + 1] - self.start[at]
        before = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(size)])
        place = np.arange(before[-1]) + np.repeat(self.start[at] - before[:-1], size)
        return self.ids[place], before


def digest(tokens: list[bytes]) -> str:
    """What tells one vocabulary from another: a hash of all its tokens in order."""
    h = hashlib.sha256()
    for t in tokens:
        h.update(len(t).to_bytes(4, "big") + t)
    return h.hexdigest()


def _codec(tokens: Broadcast, name: str, pattern: str) -> Codec:
    """One codec a worker process and vocabulary: the pair table is built once, not for every task."""
    if _codec.__dict__.get("key") != (name, pattern):
        _codec.codec, _codec.key = Codec(tokens.value, pattern), (name, pattern)
    return _codec.codec


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)``: each row's token ids, and the text its ids decode to."""
    spark = docs.sparkSession
    common.small_batches(spark)
    ranks = load_ranks(ranks_path)
    tokens, name = spark.sparkContext.broadcast(ranks), digest(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokens, name, pattern)
        for b in batches:
            split = [codec.split.findall(t) if t else [] for t in b.column(1).to_pylist()]
            codec.learn(set().union(*split))
            ids, before = codec.gather(list(chain.from_iterable(split)))
            starts = before[np.cumsum([0, *map(len, split)])]
            values = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            decoded = [codec.decode(ids[x:y].tolist()).decode("utf-8") for x, y in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), values, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from token ids; null ids count as none, ids outside the vocabulary raise."""
    spark = encoded.sparkSession
    common.small_batches(spark)
    tokens = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.value
        for b in batches:
            texts = [b"".join(known[i] for i in ids or ()).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of ``encode``'s ids and decoded texts; ``more`` columns of it follow."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for all documents."""
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    return digests(encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLE: dict[str, str] = {}
