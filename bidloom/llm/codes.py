"""Vector code compression: product codes by k-means whose parts keep adaptive distance bounds.

Vectors become integers, ``floor(256 * x)``, and are cut into equal parts. Each part position has a codebook that is
refined in rounds: every part goes to its nearest entry (squared Euclidean distance, ties to the lower index), then each
entry becomes the componentwise floor of its parts' mean. The first round compares every part with all entries. From it
each part keeps, in a written table, an upper bound on the distance to its own entry, its ``b`` next closest entries in
the order of their lower bounds, and one outer bound below the distances to all others. When entries move, the upper
bound grows and the lower ones shrink by how far the entries moved; a part whose upper bound stays below the first lower
bound keeps its entry unseen. Of the others, those whose upper bound stays below the outer bound look at as many
of the listed entries as are not ruled out, the rest look at all. Whatever the bounds leave open is decided by integer
distances, so results are exact. ``b`` is adapted a part position at a time to the depth that the last move made
necessary (``COVER`` of the parts are served by their list) and never grows.

Bounds are two bytes each: a float without its sign and lowest bits, rounded down for lower and up for upper bounds.

Spark holds the state: one row a vector, written once a round; tasks send sums by part position and entry, at most
``parts * entries`` rows a task, which are added before the driver reads one row each. The driver holds
``entries`` rows (the first codebooks) and the codebooks, whose sizes the input does not change.

Defined results: rows whose vector is null, empty or holds a null or a non-finite component are dropped, as are vectors that
``parts`` does not divide and those of another length than the first kept one (by id, null ids last, then by components).
Fewer vectors than ``entries`` give smaller codebooks; repeated ids count as rows of their own; an empty table gives no
rows and empty codebooks; extra columns are ignored unless carried. Components of ``LARGEST`` or more raise, as their
squared distances do not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that a part's list holds after the first round, a quarter of a full codebook; later rounds adapt it.
START = 16
#: Of the parts that must look beyond their own entry, the share that the adapted list serves.
COVER = 0.95
LARGEST = 2.0**18
#: Relative room for the rounding of square roots and sums.
ROOM = 1e-9


def lower(x: np.ndarray) -> np.ndarray:
    """Two bytes that stand for at most ``x``; what is below zero counts as zero."""
    return (np.maximum(x * (1 - ROOM), 0).astype(np.float32).view(np.uint32) // 2**15 - (x > 0)).clip(0).astype(np.uint16)


def upper(x: np.ndarray) -> np.ndarray:
    """Two bytes that stand for at least ``x``."""
    return (x.astype(np.float32).view(np.uint32) // 2**15 + (x > 0)).astype(np.uint16)


def bound(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint32) * np.uint32(2**15)).view(np.float32).astype(np.float64)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to all entries, exact: floats multiply only where every sum stays an integer below 2**53."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), dtype=np.int64)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - entries[None, :, d]) ** 2
    return out


def own_square(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(axis=-1)


class Part:
    """What one part position knows of a batch: entry, upper bound, listed entries, lower bounds with the outer one last."""

    def __init__(self, code: np.ndarray, up: np.ndarray, near: np.ndarray, low: np.ndarray):
        self.code, self.up, self.near, self.low = code, up, near, low

    @classmethod
    def searched(cls, x: np.ndarray, entries: np.ndarray, b: int) -> Part:
        """Compares with all entries. The list is ordered by distance, ties by index; nothing beyond it leaves the outer bound infinite."""
        d2 = squares(x, entries)
        order = np.argsort(d2, axis=1, kind="stable")[:, : b + 2]
        ranked = np.sqrt(np.take_along_axis(d2, order, 1).astype(np.float64))
        low = np.full((len(x), b + 1), np.inf)
        low[:, : order.shape[1] - 1] = ranked[:, 1:]
        near = np.zeros((len(x), b), dtype=np.int64)
        near[:, : min(b, order.shape[1] - 1)] = order[:, 1 : b + 1]
        return cls(order[:, 0], ranked[:, 0], near, low)

    def moved(self, moves: np.ndarray) -> None:
        """Bounds after each entry went as far as ``moves`` says; lower ones become the least of themselves and all later ones, which keeps their order."""
        self.up = (self.up + moves[self.code]) * (1 + ROOM)
        self.low[:, :-1] -= moves[self.near]
        self.low[:, -1] -= moves.max(initial=0)
        self.low = np.minimum.accumulate(self.low[:, ::-1] * (1 - ROOM), axis=1)[:, ::-1]

    def depth(self) -> np.ndarray:
        """How many lower bounds do not rule their entries out; one more than the list is long where the outer bound does not either."""
        return (self.low <= self.up[:, None]).sum(axis=1)

    def settle(self, x: np.ndarray, entries: np.ndarray) -> None:
        """Nearest entries by the bounds, and by integer distances where they leave it open."""
        rows = np.nonzero(self.depth())[0]
        self.up[rows] = np.sqrt(own_square(x[rows], entries[self.code[rows]]).astype(np.float64))
        depth, b = self.depth(), self.near.shape[1]
        full = np.nonzero(depth > b)[0]
        for z in range(1, b + 1):
            at = np.nonzero(depth == z)[0]
            if not len(at):
                continue
            seen = np.sort(np.concatenate([self.code[at, None], self.near[at, :z]], axis=1), axis=1)
            d2 = own_square(x[at, None, :], entries[seen])
            order = np.argsort(d2, axis=1, kind="stable")
            seen, ranked = np.take_along_axis(seen, order, 1), np.sqrt(np.take_along_axis(d2, order, 1).astype(np.float64))
            self.code[at], self.up[at] = seen[:, 0], ranked[:, 0]
            self.near[at, :z], self.low[at, :z] = seen[:, 1:], ranked[:, 1:]
        if len(full):
            new = Part.searched(x[full], entries, b)
            self.code[full], self.up[full], self.near[full], self.low[full] = new.code, new.up, new.near, new.low

    def shortened(self, b: int) -> Part:
        """Lists of ``b`` entries at most: the first bound that is left out becomes the outer one, as none of the later ones is lower."""
        low = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1]
        return Part(self.code, self.up, self.near[:, :b], low[:, : b + 1])


class State:
    """The columns of the written table as matrices: ``widths`` says how long each part position's list is."""

    FIELDS = (("ints", T.BinaryType()), ("code", T.BinaryType()), ("up", T.BinaryType()), ("near", T.BinaryType()), ("low", T.BinaryType()))

    def __init__(self, widths: list[int]):
        self.widths = widths
        self.near_at = np.concatenate([[0], np.cumsum(widths)])
        self.low_at = np.concatenate([[0], np.cumsum([b + 1 for b in widths])])

    def read(self, code: pa.Array, up: pa.Array, near: pa.Array, low: pa.Array) -> list[Part]:
        n, p = len(code), len(self.widths)
        codes, ups = unpacked(code, np.uint8, n, p), unpacked(up, np.uint16, n, p)
        nears, lows = unpacked(near, np.uint8, n, self.near_at[-1]), unpacked(low, np.uint16, n, self.low_at[-1])
        return [
            Part(codes[:, i].astype(np.int64), bound(ups[:, i]), nears[:, a:b].astype(np.int64), bound(lows[:, c:d]))
            for i, (a, b, c, d) in enumerate(zip(self.near_at, self.near_at[1:], self.low_at, self.low_at[1:], strict=False))
        ]

    @staticmethod
    def write(parts: list[Part]) -> list[pa.Array]:
        return [
            packed(np.stack([x.code for x in parts], axis=1).astype(np.uint8)),
            packed(np.stack([upper(x.up) for x in parts], axis=1)),
            packed(np.concatenate([x.near for x in parts], axis=1).astype(np.uint8)),
            packed(np.concatenate([lower(x.low) for x in parts], axis=1)),
        ]


def packed(rows: np.ndarray) -> pa.Array:
    """One binary value a row of the matrix."""
    raw = np.ascontiguousarray(rows)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def unpacked(column: pa.Array, kind: type, n: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, width)


def sound(vector: Column, parts: int) -> Column:
    """The vector can be cut into ``parts`` and all its components are numbers; never null."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite, F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """``(parts, entries, width)`` from the first rows by id."""
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    width = len(first[0].vector)
    kept = rows.where(F.size("vector") == width)
    if any(len(r.vector) != width for r in first):
        first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    most = kept.agg(F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))))).first()[0]
    if most >= LARGEST:
        raise ValueError(f"a component of {most} is too large: squared distances would not fit 64 bits")
    ints = integers(np.array([r.vector for r in first], dtype=np.float64))
    return ints.reshape(len(first), parts, width // parts).transpose(1, 0, 2)


def _tasks(df: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(run, schema)


def _opened(rows: DataFrame, books: np.ndarray, b: int) -> DataFrame:
    """First round: every part against all entries, with the state of each vector."""
    parts, _, width = books.shape
    names = [f.name for f in rows.schema.fields if f.name != "vector"]
    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField(n, t) for n, t in State.FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            x = integers(flat).reshape(batch.num_rows, parts, width)
            own = [Part.searched(x[:, p], books[p], b) for p in range(parts)]
            ints = packed(x.reshape(batch.num_rows, parts * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [ints, *State.write(own)], names=schema.names)

    return _tasks(rows, run, schema)


def _settled(state: DataFrame, widths: list[int], books: np.ndarray, moves: np.ndarray, narrow: list[int] | None) -> DataFrame:
    """A later round: bounds moved, parts settled. With ``narrow`` the state is kept on with lists that long, else code and error come out."""
    parts, _, width = books.shape
    own = [n for n, _ in State.FIELDS]
    names = [n for n in state.columns if n not in own]
    more = State.FIELDS if narrow is not None else (("code", T.BinaryType()), ("error", T.LongType()))
    schema = T.StructType([state.schema[n] for n in names] + [T.StructField(n, t) for n, t in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = State(widths)
        for batch in batches:
            x = unpacked(batch.column("ints"), np.int32, batch.num_rows, parts * width).astype(np.int64).reshape(-1, parts, width)
            held = layout.read(*(batch.column(n) for n in own[1:]))
            for p, part in enumerate(held):
                part.moved(moves[p])
                part.settle(x[:, p], books[p])
            if narrow is not None:
                out = [batch.column("ints"), *State.write([part.shortened(b) for part, b in zip(held, narrow, strict=True)])]
            else:
                error = sum(own_square(x[:, p], books[p][part.code]) for p, part in enumerate(held))
                out = [State.write(held)[0], pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + out, names=schema.names)

    return _tasks(state, run, schema)


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries as componentwise floors of their parts' means; entries without a part stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), np.int32, batch.num_rows, parts * width).reshape(-1, parts, width)
            code = unpacked(batch.column(1), np.uint8, batch.num_rows, parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                for d in range(width):  # sums of one batch are integers far below 2**53
                    total[p, :, d] += np.bincount(code[:, p], weights=x[:, p, d], minlength=entries).astype(np.int64)
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["p", "e", "n", "total"])

    sums = _tasks(state.select("ints", "code"), run, "p int, e int, n long, total array<long>")
    new = books.copy()
    for r in sums.groupBy("p", "e").agg(F.sum("n"), *(F.sum(F.col("total")[d]) for d in range(width))).collect():
        new[r[0], r[1]] = [s // r[2] for s in r[3:]]
    return new


def depths(state: DataFrame, widths: list[int], moves: np.ndarray) -> np.ndarray:
    """How many parts of each position (row) must look how deep (column) after a move; the last used column of a row counts full searches."""
    most = max(widths, default=0) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, n = State(widths), np.zeros((len(widths), most), dtype=np.int64)
        for batch in batches:
            for p, part in enumerate(layout.read(*batch.columns)):
                part.moved(moves[p])
                n[p] += np.bincount(part.depth(), minlength=most)
        p, z = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(z, pa.int32()), pa.array(n[p, z], pa.int64())], names=["p", "z", "n"])

    out = np.zeros((len(widths), most), dtype=np.int64)
    for r in _tasks(state.select("code", "up", "near", "low"), run, "p int, z int, n long").groupBy("p", "z").agg(F.sum("n")).collect():
        out[r[0], r[1]] = r[2]
    return out


def adapted(counts: np.ndarray, widths: list[int]) -> list[int]:
    """The list length of each part position that would have served ``COVER`` of the parts that a list of the present length serves; at least 1."""
    out = []
    for row, b in zip(counts, widths, strict=True):
        served = np.cumsum(row[1 : b + 1])
        out.append(max(1, int(np.searchsorted(served, COVER * served[-1]) + 1)) if b and served[-1] else min(1, b))
    return out


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``(id, *carry, code binary, error long)`` for each sound vector, and the codebooks ``(parts, entries, width)``."""
    if not 0 < entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries must be 1 to 256, parts 1 or more, rounds 0 or more")
    own = [F.col(id_col).alias("id"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry))]
    rows = vectors.where(sound(F.col(vector_col), parts)).select(*own, F.col(vector_col).alias("vector"))
    books = first_codebooks(rows, parts, entries)
    width = books.shape[2]
    back = [F.col("id").alias(id_col), *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)), "code", "error"]
    if not books.shape[1]:
        empty = T.StructType([f for f in rows.schema.fields if f.name != "vector"] + [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
        return vectors.sparkSession.createDataFrame([], empty).select(*back), books
    b = min(START, books.shape[1] - 1)
    widths, moves = [b] * parts, np.zeros(books.shape[:2])
    state = common.cut(_opened(rows.where(F.size("vector") == parts * width), books, b), "codes", compression="zstd")
    for k in range(rounds):
        new = _means(state, books)
        books, moves = new, np.sqrt(own_square(new, books).astype(np.float64))
        if k + 1 < rounds:
            narrow = adapted(depths(state, widths, moves), widths)
            after = common.cut(_settled(state, widths, books, moves, narrow), "codes", compression="zstd")
            common.drop(state)
            state, widths = after, narrow
    return _settled(state, widths, books, moves, None).select(*back), books


def reconstruct(coded: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """``coded`` with a column ``vector array<float>``: the components of the entries that the codes name; null codes give null."""
    name = common.unused([c for c in coded.columns if c != "vector"], "vector")
    kept = [c for c in coded.columns if c != name]
    schema = T.StructType([coded.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [None if c is None else np.frombuffer(c, dtype=np.uint8) for c in batch.column(code_col).to_pylist()]
            found = [None if c is None else (books[np.arange(len(c)), c].ravel() / SCALE).astype(np.float32) for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(found, pa.list_(pa.float32()))], names=schema.names)

    return _tasks(coded.select(*kept), run, schema)


def fingerprint(books: np.ndarray) -> str:
    """The SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def by_label(coded: DataFrame, label: str, name: str) -> DataFrame:
    """``coded`` with the sum of ``error`` over equal labels, nulls together, in column ``name``."""
    key, n = common.unused([*coded.columns, name], "label_key"), common.unused([*coded.columns, name], "label_n")
    rows = coded.withColumn(key, F.struct(F.col(label).alias("x")))
    sums = rows.groupBy(key).agg(F.sum("error").alias(name), F.count("*").alias(n))
    return common.join_counted(rows, common.cut(sums, "labels"), key, n).drop(key, n)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for all sound embeddings."""
    coded, books = compress(common.read(spark, sf_dir, "embeddings"), carry=("label",))
    coded = by_label(common.cut(coded, "coded"), "label", "label_error")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}
_SQUARE = " + ".join(f"(p.x{d} - b.x{d}) * (p.x{d} - b.x{d})" for d in (1, 2, 3, 4))


def _nearest(k: int) -> str:
    return f"a{k} AS MATERIALIZED (SELECT p.r, p.part, min(64 * ({_SQUARE}) + b.entry) AS best FROM p JOIN b{k} b ON p.part = b.part GROUP BY p.r, p.part)"


def _mean(k: int) -> str:
    means = ", ".join(f"floor(sum(p.x{d}) / count(*))::BIGINT AS x{d}" for d in (1, 2, 3, 4))
    kept = ", ".join(f"coalesce(m.x{d}, b.x{d}) AS x{d}" for d in (1, 2, 3, 4))
    return f"""m{k} AS (SELECT p.part, a.best % 64 AS entry, {means} FROM p JOIN a{k} a USING (r, part) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, {kept} FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""


#: For vectors of 64 components, as the table has: every part against every entry.
ORACLE = {
    "op11_vector_codes": f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, row_number() OVER (ORDER BY vec_id, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, g AS part, q[4 * g + 1] AS x1, q[4 * g + 2] AS x2, q[4 * g + 3] AS x3, q[4 * g + 4] AS x4 FROM v, range(16) t(g)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x1, x2, x3, x4 FROM p WHERE r <= 64),
{_nearest(0)},
{_mean(0)},
{_nearest(1)},
{_mean(1)},
{_nearest(2)},
c AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r),
s AS (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (r), s"""
}
