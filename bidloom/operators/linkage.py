"""Joins without a shared id: items to offers by their words, names to names by their characters, dictionaries to texts.

Each finds candidates by keys that a match must share, verifies them exactly, and compares distinct contents only: rows of equal content
are one class, told by its least id, and ``members`` says who belongs to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from bidloom import shared
from bidloom.functions import text as T

#: Rows of one side of one key that meet in a task: keys with more are dealt to a grid of tasks.
CELL = 20_000
#: Characters of a text that are looked through at once, so that finding a place takes no longer in a long text.
BLOCK = 128
#: Characters of texts that are hashed together, multiplier of the hashes, and first lengths at which beginnings of words are told from others.
HASHED, MULTIPLIER, LEVELS = 1_000_000, np.uint64(0x9E3779B97F4A7C15), 16
#: Words and bytes up to which a dictionary is sent to all tasks.
SENT_WORDS, SENT_BYTES = 200_000, 16_000_000


def content(tokens: Column, tags: Column) -> Column:
    """One value for equal sets of words and tags."""
    return F.struct(F.array_sort(F.array_distinct(tokens)).alias("tokens"), F.array_sort(F.array_distinct(tags)).alias("tags"))


def classes(rows: DataFrame, id_col: str, tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """``(rep, tokens, tags, n)``: distinct contents with their least id and the number of their rows. Rows without words are left out."""
    own = rows.select(F.col(id_col).alias("id"), content(F.coalesce(tokens, F.array()), F.coalesce(tags, F.array())).alias("c")).where(F.size("c.tokens") > 0)
    return own.groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("rep", "c.tokens", "c.tags", "n")


def members(rows: DataFrame, id_col: str, tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """``(id, rep)``: the class of each row that has words."""
    own = rows.select(F.col(id_col).alias("id"), content(F.coalesce(tokens, F.array()), F.coalesce(tags, F.array())).alias("c")).where(F.size("c.tokens") > 0)
    reps = own.groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("key", F.xxhash64("c"))
    # Equal hashes of different contents are told apart below; hot contents are broadcast.
    return _counted(own.withColumn("key", F.xxhash64("c")), reps.withColumnRenamed("c", "of"), "key").where(F.col("c") == F.col("of")).select("id", "rep")


def _counted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``join_counted`` for a table that may hold several rows a key."""
    grouped = table.groupBy(key).agg(F.sum("n").alias("n"), F.collect_list(F.struct(*[c for c in table.columns if c not in (key, "n")])).alias("found"))
    return shared.join_counted(rows, shared.cut(grouped, "classes"), key, "n").withColumn("found", F.explode("found")).select(*rows.columns, "found.*")


def _keys(side: DataFrame, order: DataFrame, least: float) -> DataFrame:
    """``side`` with ``pairs``: pairs of its rarest words, one of which every set of a Jaccard similarity of ``least`` or more shares with it.

    Of n words, ceil(least * n) at least are shared. Two sets that share o words, o >= 2, share two of their n - o + 2 rarest; sets of one
    word are only similar to themselves, as ``least`` is over 0.5."""
    words = side.select("rep", F.explode("tokens").alias("token"))
    ranked = shared.join_counted(words, order, "token", "n").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("w"))
    n = F.size("w")
    prefix = F.transform(F.slice("w", 1, F.when(n == 1, 1).otherwise(n - F.ceil(F.lit(least) * n).cast("int") + 2)), lambda x: x["token"])
    pairs = F.flatten(F.transform(prefix, lambda a, i: F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda b: F.array_sort(F.array(a, b)))))
    return ranked.select("rep", F.when(n == 1, F.array(prefix)).otherwise(pairs).alias("pairs"))


def candidates(items: DataFrame, offers: DataFrame, least: float = 0.6) -> DataFrame:
    """``(item, offer, common, similarity)``: classes of ``classes`` whose word sets have a Jaccard similarity of ``least`` or more, and of which the
    offer has all tags of the item.

    Keys are a pair of rare words (``_keys``) with the item's rarest tag, or without one. Lengths and tags are looked at before a pair
    counts as a candidate. A key with many rows on both sides is dealt to a grid of tasks."""
    if not 0.5 < least <= 1:
        raise ValueError("least must be over 0.5 and at most 1")
    words = items.select(F.explode("tokens").alias("token")).unionByName(offers.select(F.explode("tokens").alias("token")))
    order = shared.cut(words.groupBy("token").agg(F.count("*").alias("df")).withColumn("n", F.col("df")), "words")
    tags = shared.cut(offers.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("df")), "tags")
    held = items.select("rep", F.explode("tags").alias("tag"))
    counted = held.groupBy("tag").agg(F.count("*").alias("n")).join(tags, "tag", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = shared.join_counted(held, shared.cut(counted, "tags"), "tag", "n").groupBy("rep").agg(F.min(F.struct("df", "tag"))["tag"].alias("tag"))
    key = F.xxhash64("pair", "tag").alias("key")
    left = items.join(_keys(items, order, least), "rep").join(rarest, "rep", "left").withColumn("tag", F.coalesce("tag", F.lit("")))
    left = left.select("rep", "tokens", "tags", "tag", F.explode("pairs").alias("pair")).select("rep", "tokens", "tags", key)
    right = offers.join(_keys(offers, order, least), "rep").select("rep", "tokens", "tags", F.explode("pairs").alias("pair"), F.array_union("tags", F.array(F.lit(""))).alias("of"))
    right = right.withColumn("tag", F.explode("of")).select("rep", "tokens", "tags", key)
    left, right = shared.cut(left, "item_keys"), shared.cut(right, "offer_keys")
    grid = left.groupBy("key").agg(F.count("*").alias("n_left")).join(right.groupBy("key").agg(F.count("*").alias("n_right")), "key")
    grid = shared.cut(grid.withColumns({"a": F.ceil(F.col("n_left") / CELL).cast("int"), "b": F.ceil(F.col("n_right") / CELL).cast("int")}), "grid")
    cells = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    left = shared.join_counted(left, grid.select("key", F.col("n_left").alias("n"), "a", "b"), "key", "n").withColumns({"i": place("a"), "j": cells("b")})
    right = shared.join_counted(right, grid.select("key", F.col("n_right").alias("n"), "a", "b"), "key", "n").withColumns({"i": cells("a"), "j": place("b")})
    x = left.select(F.col("rep").alias("item"), F.col("tokens").alias("x"), F.col("tags").alias("x_tags"), "key", "i", "j")
    y = right.select(F.col("rep").alias("offer"), F.col("tokens").alias("y"), F.col("tags").alias("y_tags"), "key", "i", "j")
    sizes = (F.size("x") >= F.lit(least) * F.size("y")) & (F.size("y") >= F.lit(least) * F.size("x"))
    met = x.join(y, ["key", "i", "j"]).where(sizes & (F.size(F.array_except("x_tags", "y_tags")) == 0))
    common = F.size(F.array_intersect("x", "y"))
    met = met.select("item", "offer", common.alias("common"), (common / (F.size("x") + F.size("y") - common)).alias("similarity"))
    return met.where(F.col("similarity") >= least).distinct()


def character_sets(names: DataFrame, name: str = "name", most: int = 12) -> DataFrame:
    """``(bag, chars, size, rep, n)``: names by their character multisets. Names of fewer than two characters and of over ``most`` are not compared by characters."""
    own = names.select(F.col(name).alias("name")).where(F.length("name").between(2, most))
    sets = own.groupBy(T.bag(F.col("name")).alias("bag")).agg(F.min("name").alias("rep"), F.count("*").alias("n"))
    return sets.select("bag", F.array_distinct(F.split("bag", "")).alias("chars"), F.length("bag").alias("size"), "rep", "n")


def near_bags(sets: DataFrame, apart: int = 2) -> DataFrame:
    """``(rep_a, rep_b)``, ``rep_a < rep_b``: classes of ``character_sets`` whose lengths differ by ``apart`` at most and of which one has only characters
    that the other has, too.

    The smaller set is a key; the other side gives the subsets of its set that such a partner may have. A name whose characters repeat has a
    smaller set than its length says, so as many more characters may be left out as the most repeated name has repeats."""
    repeats = F.col("size") - F.size("chars")
    most = int(sets.agg(F.max(repeats)).first()[0] or 0)
    key = lambda c: F.array_join(c, "\x1f")
    small = sets.select(key(F.col("chars")).alias("key"), F.col("rep").alias("a"), F.col("size").alias("a_size"))
    grown = F.aggregate("chars", F.array(F.array().cast("array<string>")), lambda acc, c: F.concat(acc, F.transform(acc, lambda x: F.concat(x, F.array(c)))))
    least = F.greatest(F.lit(1), F.size("chars") - (apart + most) + repeats)
    large = sets.select(F.col("rep").alias("b"), F.col("size").alias("b_size"), F.explode(F.filter(grown, lambda x: F.size(x) >= least)).alias("set"))
    large = large.select(key(F.col("set")).alias("key"), "b", "b_size")
    counts = shared.cut(small.groupBy("key").agg(F.count("*").alias("keys")).join(large.groupBy("key").agg(F.count("*").alias("n")), "key"), "bags")
    large = shared.join_counted(large, counts.select("key", "n"), "key", "n").drop("n")  # only subsets that are some name's whole set go on
    met = large.join(small, "key").where((F.abs(F.col("a_size") - F.col("b_size")) <= apart) & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b")).distinct()


def _hashes(words: list[str], n: int) -> np.ndarray:
    """Polynomial hashes of the first ``n`` characters of words that have as many."""
    chars = np.frombuffer("".join(w[:n] for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n).astype(np.uint64)
    h = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        h = h * MULTIPLIER + chars[:, k]
    return h


def _finder(words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Finds the words of a dictionary in batches ``(id, text)``: hashes of all places' beginnings are compared with those of the words' beginnings,
    a character more at a time, so that few places are left; what has a whole word's hash is compared with the word."""
    words = sorted(words, key=lambda w: (len(w), w))
    size = np.array([len(w) for w in words])
    lengths = sorted({*size.tolist()})
    levels = sorted({*lengths, *range(1, min(lengths[-1], LEVELS) + 1)})

    def places(chars: np.ndarray, begin: dict, whole: dict, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of words of equal hash."""
        least, found = lengths[0], ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
        n = len(chars) - least + 1
        if n <= 0:
            return found[0][0], found[1][0]
        h = np.zeros(n, dtype=np.uint64)
        for k in range(least):
            h = h * MULTIPLIER + chars[k : k + n]
        at = np.nonzero(bits[h >> np.uint64(44)])[0]
        h, done = h[at], least
        for n in (x for x in levels if x >= least):
            room = at + n <= len(chars)
            at, h = at[room], h[room]
            for k in range(done, n):
                h = h * MULTIPLIER + chars[at + k]
            done = n
            if n in begin:
                stay = begin[n][np.minimum(np.searchsorted(begin[n], h), len(begin[n]) - 1)] == h
                at, h = at[stay], h[stay]
            if n in whole:
                own, number = whole[n]
                k = np.minimum(np.searchsorted(own, h), len(own) - 1)
                hit = own[k] == h
                found[0].append(at[hit])
                found[1].append(number[k[hit]])
        return np.concatenate(found[0]), np.concatenate(found[1])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words of equal hashes of one length would hide each other: they are looked for by ``str.find``.
        begin, whole, clash = {}, {}, []
        for n in levels:
            if n <= LEVELS:
                begin[n] = np.unique(_hashes([w for w in words if len(w) >= n], n))
            number = np.nonzero(size == n)[0]
            if len(number):
                h, first = np.unique(_hashes([words[i] for i in number], n), return_index=True)
                whole[n] = h, number[first]
                clash += [words[i] for i in set(number.tolist()) - set(number[first].tolist())]
        bits = np.zeros(1 << 20, dtype=bool)
        bits[np.unique(_hashes(words, lengths[0])) >> np.uint64(44)] = True
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            row, word, place = [], [], []
            lo = 0
            while lo < len(texts):
                hi, total = lo + 1, len(texts[lo])
                while hi < len(texts) and total + len(texts[hi]) <= HASHED:
                    total += len(texts[hi])
                    hi += 1
                starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])])
                # A long text goes in pieces that overlap by the longest word.
                whole_text = "".join(texts[lo:hi])
                pieces = [(k, whole_text[k : k + HASHED + lengths[-1]]) for k in range(0, max(total, 1), HASHED)]
                met = [(at + k, no) for k, piece in pieces for at, no in [places(np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), begin, whole, bits)]]
                at, no = (np.concatenate([x[i] for x in met]) for i in (0, 1))
                order = np.argsort(at, kind="stable")
                at, no = at[order], no[order]
                doc = np.searchsorted(starts, at, "right") - 1
                _, first = np.unique(doc * len(words) + no, return_index=True)
                for d, w, p in zip(doc[first].tolist(), no[first].tolist(), (at[first] - starts[doc[first]]).tolist(), strict=True):
                    text = texts[lo + d]
                    # The first place of equal hash is the word's own, or else the text is searched.
                    p = p if text.startswith(words[w], p) else text.find(words[w])
                    if p >= 0:
                        row.append(lo + d), word.append(words[w]), place.append(p + 1)
                lo = hi
            for w in clash:
                for i, t in enumerate(texts):
                    if (p := t.find(w)) >= 0:
                        row.append(i), word.append(w), place.append(p + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(word, pa.string()), pa.array(place, pa.int32())], names=["id", "word", "at"])

    return find


def found_words(texts: DataFrame, words: DataFrame, id_col: str, text_col: str, gram: int = 3) -> DataFrame:
    """``(id, word, at)``: the words of a dictionary ``(word)`` that stand in a text, with the first place, counted from 1.

    A dictionary of up to ``SENT_WORDS`` and ``SENT_BYTES`` is sent to the tasks, and texts do not move (``_finder``). Words of a larger one are keyed by their
    first ``gram`` characters, shorter ones by all they have; a text gives, at each place, the few characters that the longest word can need, and where
    they begin with a key they meet that key's words in a shuffle. Empty and null words are in no text."""
    words = words.select("word").where("word <> ''").distinct()
    n, size, longest = words.agg(F.count("*"), F.sum(F.octet_length("word")), F.max(F.length("word"))).first()
    out = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not n:
        return out.where("false").select("id", F.lit("").alias("word"), F.lit(0).alias("at"))
    if n <= SENT_WORDS and size <= SENT_BYTES:
        kinds = StructType().add("id", out.schema["id"].dataType).add("word", StringType()).add("at", IntegerType())
        found = out.where("text <> ''").mapInArrow(_finder([r.word for r in words.collect()]), kinds)
        return found.groupBy("id", "word").agg(F.min("at").alias("at"))  # an id may have several texts
    keyed = words.select(F.substring("word", 1, gram).alias("key"), "word")
    widths = [r[0] for r in keyed.select(F.length("key")).distinct().collect()]  # at most ``gram`` numbers
    step = max(BLOCK, longest)
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    own = F.array_size(F.col("blocks"))
    lapped = F.transform("blocks", lambda x, i: F.struct(x.alias("own"), F.when(i + 1 < own, F.substring(F.try_element_at("blocks", i + 2), 1, longest - 1)).otherwise("").alias("next")))
    rows = out.where("text <> ''").select("id", blocks.alias("blocks")).select("id", F.posexplode(lapped).alias("no", "b"))
    places = F.transform(F.sequence(F.lit(1), F.length("b.own")), lambda i: F.substring(F.concat("b.own", "b.next"), i, F.lit(longest)))
    window = rows.select("id", "no", F.posexplode(places).alias("k", "window")).select("id", (F.col("no") * step + F.col("k")).alias("at"), "window")
    keys = [F.substring("window", 1, w) for w in sorted(widths)]
    window = window.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array_distinct(F.array(*keys))))
    counts = window.groupBy("key").agg(F.count("*").alias("n")).join(keyed.groupBy("key").agg(F.collect_list("word").alias("words")), "key")
    met = shared.join_counted(window, shared.cut(counts, "grams"), "key", "n").withColumn("word", F.explode("words"))
    return met.where(F.startswith("window", "word")).groupBy("id", "word").agg((F.min("at") + 1).alias("at"))
