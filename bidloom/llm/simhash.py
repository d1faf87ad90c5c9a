"""SimHash near-duplicate detection with pivot distance tables.

1. Every whole text becomes a 64-bit fingerprint (3-word shingles, XXH64 seed 42, bit majority).
2. Distinct fingerprints are dealt to buckets by exact pigeonhole keys: 64 bits in five blocks, a
   link of at most three differing bits leaves two blocks untouched, so each fingerprint goes to
   the ten buckets named by its pairs of blocks. Buckets of over ``max_bucket`` fingerprints are
   dealt again on the bits that remain, four parts of which one must be untouched. Each deal fixes
   a quarter of what remains, so a bucket ends with at most ``2**14`` possible fingerprints: no
   group grows without bound, and no link is lost.
3. Inside a bucket each fingerprint has a table of Hamming distances to ``PIVOTS`` reference
   fingerprints. By the triangle inequality, a pair whose tables differ by more than three in
   any coordinate cannot link and is discarded; survivors are verified by exact distance. A bucket
   gives a spanning forest of its links, never all pairs.
4. Components of the links run over fingerprints, and documents take the least doc_id of theirs.

``deduplicate`` links more than the query op9 does: besides those links, differing texts whose sets of five-word
shingles have a Jaccard similarity of at least 0.8. Such texts differ by up to some 16 of 64 bits, where pigeonhole keys
no longer tell anything apart, so they meet by MinHash bands (``copies``) and are verified on the whole sets.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like
any other; repeated rows with one id give one output row each; a null id takes no part in the choice
of the least id; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

SEED = 42
SHINGLE = 3
RADIUS = 3
PIVOTS = 16
MAX_BUCKET = 4096
#: Edited copies: words of a shingle, least Jaccard similarity, bands and minima a band. A pair of similarity s shares no
#: band with probability (1 - s**4)**20: 3 in 100,000 at 0.8.
COPY_SHINGLE = 5
COPY_JACCARD = 0.8
BANDS = 20
BAND_ROWS = 4
#: Bands of at most so many texts give all their pairs; larger ones give each text's pairs with two times ``HUBS`` of them.
MAX_BAND = 32
HUBS = 2
#: Rows of one side that meet in a task where texts of large bands are compared whole.
CELL = 256
#: Up to so many candidate rows are broadcast to find their texts; beyond that the texts are shuffled.
BROADCAST_ROWS = 100_000
#: Bit ranges [low, high) of the five blocks.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))


def fingerprint_text(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint_text(t) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, row, fp)``: one row per input row; row is ``row_col`` or null, fp the fingerprint as a signed long."""
    common.small_batches(docs.sparkSession)
    row = F.lit(None) if row_col is None else F.col(row_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text_col).alias("text"))
    return own.mapInArrow(_fingerprints, "doc_id long, row long, fp long")


def references(n: int = PIVOTS) -> np.ndarray:
    """The fixed reference fingerprints: hashes of their own numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], dtype=np.uint64)


def distance_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, one row per fingerprint."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def bucket_links(fp: np.ndarray, refs: np.ndarray, radius: int = RADIUS, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one bucket."""
    table = distance_table(fp, refs)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    first = table[:, 0].astype(np.int64)
    label = np.arange(len(fp))  # of the component so far: its least row
    out = []
    for lo in range(0, len(fp), block):
        hi = min(lo + block, len(fp))
        # Sorted by the first coordinate: later rows beyond its reach cannot link to this block.
        for at in range(lo, int(np.searchsorted(first, first[hi - 1] + radius, "right")), block):
            to = min(at + block, len(fp))
            near = label[lo:hi, None] != label[None, at:to]
            for k in range(table.shape[1]):
                near &= np.abs(table[lo:hi, None, k] - table[None, at:to, k]) <= radius
            i, j = np.nonzero(near)
            i, j = i + lo, j + at
            linked = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            i, j = i[linked], j[linked]
            while len(i):
                # Each component joins one with a lesser label, so what is joined is a forest.
                low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                high, one = np.unique(high, return_index=True)
                out += zip(fp[i[one]].tolist(), fp[j[one]].tolist(), strict=True)
                to_low = np.arange(len(fp))
                to_low[high] = low[one]
                while (to_low[to_low] != to_low).any():
                    to_low = to_low[to_low]
                label = to_low[label]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
    return out


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def first_deal() -> list[tuple[int, list[int]]]:
    """Ten (mask, bits not in the mask): the pairs of blocks."""
    out = []
    for i in range(len(BLOCKS)):
        for j in range(i + 1, len(BLOCKS)):
            own = [*range(*BLOCKS[i]), *range(*BLOCKS[j])]
            out.append((_mask(own), [b for b in range(64) if b not in own]))
    return out


def _redeal(masks: list[int]) -> dict[int, list[int]]:
    """Each mask with four finer ones: the mask plus a quarter of the bits it leaves out."""
    out = {}
    for m in masks:
        rest = [b for b in range(64) if not (m >> b) & 1]
        parts = [rest[k::4] for k in range(4)]
        out[m] = [_mask([b for b in range(64) if (m >> b) & 1] + p) for p in parts]
    return out


def links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``, distinct), enough to give every component.

    ``radius`` is at most three, which is what the deals guarantee.
    """
    if radius > RADIUS:
        raise ValueError(f"the deals guarantee links of at most {RADIUS} differing bits")
    spark = fps.sparkSession
    common.small_batches(spark)
    masks = [m for m, _ in first_deal()]
    dealt = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    whole = None
    while True:
        dealt = dealt.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        full = common.cut(dealt.join(sizes, ["mask", "key"]), "buckets")
        done = [m for m in masks if 64 - bin(m & (2**64 - 1)).count("1") <= 14]
        over = (F.col("n") > max_bucket) & ~F.col("mask").isin(done) if done else F.col("n") > max_bucket
        small = full.where(~over)
        whole = small if whole is None else whole.union(small)
        left = [r.mask for r in full.where(over).select("mask").distinct().collect()]  # at most the masks of this deal
        if not left:
            break
        finer = _redeal(left)
        masks = sorted({x for xs in finer.values() for x in xs})
        table = F.create_map(*[y for m, xs in finer.items() for y in (F.lit(m), F.array(*[F.lit(x) for x in xs]))])
        dealt = full.where(over).select("fp", F.explode(table[F.col("mask")]).alias("mask"))
    refs = references()

    def forest(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        found = bucket_links(np.unique(pdf["fp"].to_numpy().view(np.uint64)), refs, radius)
        ab = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1]})

    # Small in bytes but heavy in work: a stated number of partitions keeps them from being joined in one task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.select("mask", "key", "fp").repartition(parts, "mask", "key")
    return dealt.groupBy("mask", "key").applyInPandas(forest, "a long, b long").distinct()


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's five-word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = min(COPY_SHINGLE, len(words))
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(words) - n + 1))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    own = [np.array([xxhash.xxh64_intdigest(f"{k}{i}".encode(), SEED) for i in range(BANDS * BAND_ROWS)], dtype=np.uint64) for k in "ab"]
    return own[0] | np.uint64(1), own[1]


def bands(own: np.ndarray, mul: np.ndarray, add: np.ndarray, block: int = 4096) -> list[int]:
    """The keys of a shingle set's bands: hashes of ``BAND_ROWS`` minima each, as signed longs."""
    if not len(own):
        return []
    # The high halves of the products: the low bits of a product depend on the low bits alone.
    low = np.min([((own[at : at + block, None] * mul + add) >> np.uint64(32)).min(axis=0) for at in range(0, len(own), block)], axis=0)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mul, add = _multipliers()
    for b in batches:
        texts = b.column(2).to_pylist()
        sets = [shingle_set(t) for t in texts]
        # Sets stand for texts here; equal sets give equal keys and equal bands.
        same = [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets]
        longs = [np.array(x, dtype=np.uint64).view(np.int64) for x in ([fingerprint_text(t) for t in texts], same)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *map(pa.array, longs), pa.array([len(x) for x in sets], pa.int32()), pa.array([bands(x, mul, add) for x in sets], pa.list_(pa.int64()))],
            names=["doc_id", "row", "fp", "same", "n", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        fp = np.array([fingerprint_text(t) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), pa.array([shingle_set(t).tobytes() for t in texts], pa.binary())], names=["row", "fp", "own"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [[np.frombuffer(x, dtype=np.uint64) for x in b.column(k).to_pylist()] for k in (2, 3)]
        near = pa.array([jaccard(x, y) >= COPY_JACCARD for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(near)


def shared_bands(reps: DataFrame) -> DataFrame:
    """``(key, row, n, m)``: the bands of ``reps (row, n, bands)`` that several rows hold, with the number of these."""
    dealt = common.cut(reps.select("row", "n", F.explode("bands").alias("key")), "bands")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return common.cut(dealt.join(sizes, "key"), "shared")


def candidates(shared: DataFrame) -> DataFrame:
    """``(x, y)``: rows that share a band of ``shared_bands`` and whose sizes allow the similarity, x < y.

    A band of over ``MAX_BAND`` rows is a large cluster of copies, or a line that many texts hold. It gives
    each row's pairs with ``HUBS`` rows by fixed hashes and with the ``HUBS`` rows that have most neighbours in large bands, so that
    pairs grow with the rows: copies of one text, each edited elsewhere, are further from each other than from the text between
    them, which has most neighbours; and copies that merely share a frequent line meet in their other bands. What these
    pairs leave apart is compared whole by ``rest``.
    """
    small, large = shared.where(F.col("m") <= MAX_BAND), shared.where(F.col("m") > MAX_BAND)
    pairs = small.select("key", F.col("row").alias("x"), F.col("n").alias("nx")).join(small.select("key", F.col("row").alias("y"), F.col("n").alias("ny")), "key").where("x < y")
    neighbours = common.cut(large.groupBy("row").agg(F.sum("m").alias("near")), "neighbours")
    large = common.cut(large.join(neighbours, "row"), "large")
    order = [F.xxhash64("row", F.lit(i)) for i in range(HUBS)] + [-10 * F.col("near") + i * F.pmod(F.xxhash64("row"), F.lit(10)) for i in range(HUBS)]
    least = [F.min(F.struct(x.alias("h"), "row", "n")) for x in order]
    hubs = large.groupBy("key").agg(F.array(*least).alias("hubs")).select("key", F.explode("hubs").alias("hub"))
    stars = large.join(hubs.distinct(), "key").where(F.col("row") != F.col("hub.row"))
    stars = stars.select(F.least("row", "hub.row").alias("x"), F.greatest("row", "hub.row").alias("y"), F.col("n").alias("nx"), F.col("hub.n").alias("ny"))
    both = pairs.select("x", "y", "nx", "ny").union(stars)
    return both.where(F.least("nx", "ny") >= F.greatest("nx", "ny") * COPY_JACCARD - 1e-6).select("x", "y").distinct()


def _apart(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
    """The links of a cell's texts that hang together by no link so far: for each two roots one. A pair counts in the first band that it shares."""
    none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    fp, root, side, n = (pdf[c].to_numpy() for c in ("fp", "root", "side", "n"))
    held = np.array(pdf["bands"].tolist(), dtype=np.int64)
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    wanted = (root[:, None] < root[None, :]) & (low >= high * COPY_JACCARD - 1e-6)
    if not pdf["whole"].iloc[0]:
        wanted &= side[:, None] != side[None, :]
    first = np.zeros(wanted.shape, dtype=bool)  # pairs that share an earlier band
    for k in range(held.shape[1]):
        same = held[:, None, k] == held[None, :, k]
        now = held[:, k] == key[0]
        if now.any():
            wanted &= same & ~first & now[:, None]
            break
        first |= same
    if not wanted.any():
        return none
    sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["own"]]
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    out = []
    for i in np.nonzero(wanted.any(axis=1))[0]:
        lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(of[at], minlength=len(sets))
        near = wanted[i] & (both / np.maximum(1, n[i] + n - both) >= COPY_JACCARD)
        out += [(root[i], root[j], fp[i], fp[j]) for j in np.nonzero(near)[0]]
    if not out:
        return none
    links = pd.DataFrame(out, columns=["x", "y", "a", "b"]).drop_duplicates(["x", "y"])
    return links[["a", "b"]].astype("int64")


def rest(shared: DataFrame, reps: DataFrame, edges: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(a, b)``: the links within large bands between texts that ``edges`` leave apart, so that no such link is lost.

    Of each band with several components the texts outside its largest are compared with those of the largest and with each other, on whole sets, dealt to a grid
    of cells of ``CELL`` rows a side. Bands of one component need nothing. ``sets_of`` gives ``(row, own)`` for rows. The work is quadratic only in what stays apart.
    """
    large = shared.where(F.col("m") > MAX_BAND).select("key", "row", "n").join(reps.select("row", "fp"), "row")
    roots = common.components(edges)
    own = common.cut(large.join(roots, large["fp"] == roots["node"], "left").select("key", "row", "n", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    counts = own.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("held"), F.count("*").alias("kinds"))
    blocks = lambda c: F.ceil(c / CELL).cast("int")
    mixed = counts.where("kinds > 1").select("key", F.col("top.root").alias("main"), F.col("held"), blocks(F.col("top.c")).alias("mains"), blocks(F.col("held") - F.col("top.c")).alias("rests"))
    mixed = common.cut(mixed, "mixed")
    met = common.join_counted(own, mixed, "key", "held").withColumn("is_main", F.col("root") == F.col("main"))
    block = F.pmod(F.xxhash64("row"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    own_block = F.col("block")
    to_main = F.transform(upto(F.col("mains")), lambda i: cell("main", i, own_block, F.lit(-1)))
    to_rest = F.transform(upto(F.col("rests")), lambda j: cell("rest", F.least(own_block, j), F.greatest(own_block, j), own_block))
    from_main = F.transform(upto(F.col("rests")), lambda j: cell("main", own_block, j, F.lit(-2)))
    dealt = met.withColumn("block", block).withColumn("c", F.explode(F.when(F.col("is_main"), from_main).otherwise(F.concat(to_main, to_rest))))
    dealt = dealt.select("key", "row", "n", "fp", "root", "c.kind", "c.i", "c.j", "c.side", ((F.col("c.kind") == "rest") & (F.col("c.i") == F.col("c.j"))).alias("whole"))
    sets = sets_of(met.select("row").distinct())
    full = dealt.join(reps.select("row", "bands").join(sets.select("row", "own"), "row"), "row")
    return full.groupBy("key", "kind", "i", "j").applyInPandas(_apart, "a long, b long").distinct()


def copies(held: DataFrame, profiles: DataFrame, row_col: str, text_col: str, most: int = BROADCAST_ROWS, known: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: fingerprints of texts in ``held`` that are edited copies of each other, enough to give every component together with the links ``known``."""
    reps = common.cut(profiles.where("n > 0").groupBy("fp", "same", "n").agg(F.min("row").alias("row"), F.first("bands").alias("bands")), "reps")

    def sets_of(rows: DataFrame) -> DataFrame:
        rows = common.cut(rows, "rows")
        wanted = rows.select(F.col("row").alias(row_col))
        texts = held.select(row_col, text_col).join(F.broadcast(wanted) if rows.count() <= most else wanted, row_col)
        return common.cut(texts.mapInArrow(_sets, "row long, fp long, own binary"), "sets")

    shared = shared_bands(reps)
    pairs = common.cut(candidates(shared), "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("x", "y")).alias("row")).distinct())
    side = [sets.select(F.col("row").alias(r), F.col("fp").alias(f), F.col("own").alias(o)) for r, f, o in (("x", "a", "p"), ("y", "b", "q"))]
    met = pairs.join(side[0], "x").join(side[1], "y").where("a <> b").select("a", "b", "p", "q")
    met = met.mapInArrow(_verified, "a long, b long")
    if shared.where(F.col("m") > MAX_BAND).isEmpty():
        return met
    met = common.cut(met, "met")
    return met.union(rest(shared, reps, met if known is None else met.union(known), sets_of))


def _lowest(per_doc: DataFrame, least: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, row, fp, component_id)`` by the components of ``edges`` among the fingerprints of ``least (fp, low, n)``."""
    roots = common.components(edges)
    owned = (
        least.join(roots, least["fp"] == roots["node"], "left")
        .select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    )
    owned = common.cut(owned, "owned")
    lowest = owned.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = common.cut(owned.join(lowest, "root").select("fp", "n", "component_id"), "of-fp")
    return common.join_counted(per_doc.select("doc_id", "row", "fp"), of_fp, "fp", "n").select("doc_id", "row", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, row, fp, component_id)``: each row's fingerprint and the least doc_id reachable from it."""
    per_doc = common.cut(fingerprints(docs, id_col, text_col, row_col), "fingerprints")
    least = common.cut(per_doc.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "least")
    return _lowest(per_doc, least, links(least.select("fp")))


def edited_duplicates(docs: DataFrame, id_col: str, text_col: str, row_col: str) -> DataFrame:
    """As ``near_duplicates``, with the links of ``copies`` besides."""
    common.small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    profiles = common.cut(own.mapInArrow(_profiles, "doc_id long, row long, fp long, same long, n int, bands array<long>"), "profiles")
    least = common.cut(profiles.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "least")
    near = common.cut(links(least.select("fp")), "links")
    return _lowest(profiles, least, near.union(copies(docs, profiles, row_col, text_col, known=near)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id. All columns stay.

    Components are those of op9's links and of edited copies together (``edited_duplicates``).
    Rows without an id never stand for others: of a component with ids they go, of one without any they stay.
    Rows that repeat the least id count by a row number, which is written before it is used.
    """
    row = common.unused(docs.columns, "row")
    held = common.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = common.cut(edited_duplicates(held, id_col, text_col, row), "found")
    heads = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("row"))
    stay = heads.select("row").union(found.where("component_id is null").select("row"))
    go = found.select("row").join(stay, "row", "left_anti").select(F.col("row").alias(row))
    return held.join(go, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all documents."""
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLE: dict[str, str] = {}
