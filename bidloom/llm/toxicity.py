"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is its letter runs, lower-cased, in windows of ``WINDOW`` words that start every ``STRIDE`` words, so
that all of it is scored, neighbouring windows overlap, and every passage of up to ``WINDOW - STRIDE + 1`` words stands whole in one. A word's input is the sum of a hashed word
vector and the mean of its hashed character 4-gram vectors. Two gated recurrent layers read the window
in either direction, a learned query weighs their states by softmax, and a linear unit gives the window's
score. A document scores as its highest window.

Learning is by multiple instances: in each epoch the present network picks every training document's
highest window, the first time by log odds of its words, and Adam steps fit those windows to the
documents' labels. The sample is bounded (parameters): about ``TRAIN_POS`` and ``TRAIN_NEG`` labelled
documents chosen by a hash, of each the ``INSTANCES`` windows of highest log odds. Texts of the sample stay in tasks: what reaches the
driver are counts of ``BUCKETS`` buckets and those windows, of at most ``WINDOW`` words of at most ``LETTERS`` letters. Everything else
covers whole texts and all rows. Training is seeded; of rows that repeat a labelled id the least text is learnt from.

Defined results: null texts and texts without letters score the share of label 1 among the labels learnt
from; with no label, or labels of one kind, every text scores that share (0 without labels); repeated
rows give equal rows; an empty table gives no rows; extra columns are ignored. A letter run of over
``LETTERS`` letters is read as several words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common
from bidloom.llm.langid import fold

TRAIN_POS, TRAIN_NEG = 1500, 3000
INSTANCES = 8
WINDOW, STRIDE = 40, 20
LETTERS = 24
BUCKETS = 1 << 14
DIM, HIDDEN = 16, 16
EPOCHS, BATCH, RATE = 8, 32, 4e-3
#: Small samples are gone through more often, up to this many steps in all.
LEAST_STEPS = 400
SEED = 7
#: Pseudo-documents behind a log odds.
PRIOR = 8.0
#: Windows in one forward pass.
CHUNK = 2048
_WORDS = re.compile(r"[^\W\d_]{1,%d}" % LETTERS)


class Lexicon:
    """The distinct words of some texts as hash buckets, and the texts as word numbers."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        self.docs = [
            np.array([number.setdefault(w, len(number)) for w in _WORDS.findall(t.lower())] if t else [], dtype=np.int32)
            for t in texts
        ]
        self.n, self.words = len(number), list(number)
        points = np.array(self.words, dtype=f"U{LETTERS}").view(np.uint32).reshape(self.n, LETTERS).astype(np.uint64)
        size = (points != 0).sum(axis=1)
        # Marked ends: 1 before, 2 after the word.
        wide = np.zeros((self.n, LETTERS + 2), dtype=np.uint64)
        wide[:, 0], wide[:, 1:-1] = 1, points
        wide[np.arange(self.n), size + 1] = 2
        word = np.zeros(self.n, dtype=np.uint64)
        for k in range(LETTERS + 2):
            word = word * np.uint64(1_000_003) + wide[:, k]
        self.word = self._bucket(word)
        grams = [wide[:, k : LETTERS - 1 + k] for k in range(4)]
        h = grams[0]
        for g in grams[1:]:
            h = h * np.uint64(1_000_003) + g
        self.gram = self._bucket(h)
        # A gram must end within the marked word; a word of one letter keeps its first gram.
        self.has = np.arange(LETTERS - 1)[None, :] < np.maximum(size - 1, 1)[:, None]

    @staticmethod
    def _bucket(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int32)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers with ``n`` as padding, document of each window); documents without words have none."""
        own, of = [], []
        for d, ids in enumerate(self.docs):
            if len(ids):
                starts = range(0, max(1, len(ids) - (WINDOW - STRIDE)), STRIDE)
                padded = np.full(starts[-1] + WINDOW, self.n, dtype=np.int32)
                padded[: len(ids)] = ids
                own.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
                of.append(np.full(len(starts), d))
        if not own:
            return np.zeros((0, WINDOW), dtype=np.int32), np.zeros(0, dtype=np.int64)
        return np.concatenate(own), np.concatenate(of)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    def __init__(self, rng: np.random.Generator):
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "word": (0.05 * rng.standard_normal((BUCKETS, DIM))).astype(np.float32),
            "gram": (0.05 * rng.standard_normal((BUCKETS, DIM))).astype(np.float32),
            "query": f(2 * HIDDEN), "out": f(2 * HIDDEN), "bias": np.zeros(1, dtype=np.float32),
        }
        for d in "fb":
            self.p |= {f"w{d}": f(DIM, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}

    def embed(self, lex: Lexicon, some: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of the words, or of some of them."""
        word, gram, has = (x if some is None else x[some] for x in (lex.word, lex.gram, lex.has))
        out = self.p["word"][word]
        for lo in range(0, len(word), 8192):
            g, h = gram[lo : lo + 8192], has[lo : lo + 8192]
            wide = int(h.sum(axis=1).max())
            mean = (self.p["gram"][g[:, :wide]] * h[:, :wide, None]).sum(axis=1)
            out[lo : lo + 8192] += mean / h.sum(axis=1, dtype=np.float32)[:, None]
        return out

    def _run(self, d: str, x: np.ndarray, idx: np.ndarray, real: np.ndarray, keep: list | None) -> np.ndarray:
        """States (T, B, H) of one direction. x: projected inputs of the words, one more row for padding."""
        h = np.zeros((len(idx), HIDDEN), dtype=np.float32)
        out = np.empty((idx.shape[1], len(idx), HIDDEN), dtype=np.float32)
        for t in range(idx.shape[1]) if d == "f" else range(idx.shape[1] - 1, -1, -1):
            a, g = x[idx[:, t]], h @ self.p[f"u{d}"]
            zr = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN] * real[:, t, None], zr[:, HIDDEN:]  # padding leaves the state
            c = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, c, g[:, 2 * HIDDEN :]))
            h = h + z * (c - h)
            out[t] = h
        return out

    def forward(self, x: dict[str, np.ndarray], idx: np.ndarray, pad: int, keep: dict | None = None) -> np.ndarray:
        """Scores (logits) of windows."""
        real = (idx != pad).astype(np.float32)
        both = np.concatenate([self._run(d, x[d], idx, real, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
        score = both @ self.p["query"] + np.where(real.T > 0, np.float32(0), np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        ctx = (both * weight[:, :, None]).sum(axis=0)
        if keep is not None:
            keep |= {"both": both, "weight": weight, "ctx": ctx, "real": real}
        return ctx @ self.p["out"] + self.p["bias"][0]

    def project(self, e: np.ndarray) -> dict[str, np.ndarray]:
        e = np.concatenate([e, np.zeros((1, DIM), dtype=np.float32)])
        return {d: e @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def logits(self, lex: Lexicon, idx: np.ndarray) -> np.ndarray:
        x = self.project(self.embed(lex))
        parts = [self.forward(x, idx[i : i + CHUNK], lex.n) for i in range(0, len(idx), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)

    def gradients(self, lex: Lexicon, idx: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of windows."""
        words, at = np.unique(idx, return_inverse=True)
        pad = len(words) - 1 if words[-1] == lex.n else len(words)
        words = words[:pad] if pad < len(words) else words
        local = at.reshape(idx.shape).astype(np.int32)
        e, keep = self.embed(lex, words), {}
        x = self.project(e)
        s = self.forward(x, local, len(words), keep)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        ds = ((_sigmoid(s) - y) / len(y)).astype(np.float32)
        g["bias"][0], g["out"] = ds.sum(), keep["ctx"].T @ ds
        dctx = ds[:, None] * self.p["out"]
        both, weight = keep["both"], keep["weight"]
        dweight = (both * dctx).sum(axis=2)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["query"] = np.einsum("tbh,tb->h", both, dscore)
        dboth = weight[:, :, None] * dctx + dscore[:, :, None] * self.p["query"]
        de = np.zeros((len(words) + 1, DIM), dtype=np.float32)
        e1 = np.concatenate([e, np.zeros((1, DIM), dtype=np.float32)])
        for k, d in enumerate("fb"):
            dx, dh = np.zeros_like(x[d]), np.zeros((len(idx), HIDDEN), dtype=np.float32)
            u = self.p[f"u{d}"]
            for t, h, z, r, c, gc in reversed(keep[d]):
                dh = dh + dboth[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dh * z * (1 - c * c)
                on = keep["real"][:, t, None]
                dz = dh * (c - h) * z * (on - z)
                dr = dc * gc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"u{d}"] += h.T @ dg
                np.add.at(dx, local[:, t], da)
                dh = dh * (1 - z) + dg @ u.T
            dx[len(words)] = 0
            g[f"w{d}"], g[f"c{d}"] = e1.T @ dx, dx.sum(axis=0)
            de += dx @ self.p[f"w{d}"].T
        de = de[:-1]
        np.add.at(g["word"], lex.word[words], de)
        has = lex.has[words]
        share = de / has.sum(axis=1, dtype=np.float32)[:, None]
        w, k = np.nonzero(has)
        np.add.at(g["gram"], lex.gram[words][w, k], share[w])
        return g


def presence(texts: list[str | None], labels: list[int]) -> np.ndarray:
    """How many texts, and how many of label 1, hold each bucket: ``[word or gram, all or label 1, bucket]``."""
    lex, out = Lexicon(texts), np.zeros((2, 2, BUCKETS), dtype=np.int64)
    for ids, y in zip(lex.docs, labels, strict=True):
        own = np.unique(ids)
        for k, buckets in enumerate((lex.word[own], lex.gram[own][lex.has[own]])):
            some = np.unique(buckets)
            out[k, 0, some] += 1
            out[k, 1, some] += y
    return out


def log_odds(held: np.ndarray, prior: float) -> np.ndarray:
    """How much a bucket's presence in a document raises the log odds of label 1: ``[word or gram, bucket]``."""
    p = (held[:, 1] + PRIOR * prior) / (held[:, 0] + PRIOR)
    return np.log(p / (1 - p)) - np.log(prior / (1 - prior))


def _first_scores(lex: Lexicon, idx: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Windows by the log odds of their highest word."""
    word = odds[0][lex.word] + np.where(lex.has, odds[1][lex.gram], -9).max(axis=1) if lex.n else np.zeros(0)
    return np.concatenate([word, [-9.0]])[idx].max(axis=1)


def instances(texts: list[str | None], odds: np.ndarray) -> list[list[str]]:
    """Each text's ``INSTANCES`` windows of highest log odds, in their order."""
    lex = Lexicon(texts)
    idx, of = lex.windows()
    score, words = _first_scores(lex, idx, odds), np.array([*lex.words, ""], dtype=object)
    out: list[list[str]] = [[] for _ in texts]
    for d in np.unique(of):
        own = np.nonzero(of == d)[0]
        for k in sorted(own[np.argsort(-score[own], kind="stable")[:INSTANCES]]):
            out[d].append(" ".join(words[idx[k]]).rstrip())
    return out


def train(windows: list[list[str]], labels: list[int], odds: np.ndarray, epochs: int = EPOCHS, informed: bool = True) -> Network | None:
    """A network for documents given as windows; None unless both labels have documents with windows.

    ``informed``: whether the log odds of words and grams are a first value of their vectors.
    """
    y = np.array(labels, dtype=np.float32)
    of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    some = np.unique(of)
    if len(some) == 0 or len(set(y[some].tolist())) < 2:
        return None
    lex = Lexicon([w for own in windows for w in own])
    idx, _ = lex.windows()
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    if informed:
        net.p["word"][:, 0], net.p["gram"][:, 0] = 0.5 * odds
    score = _first_scores(lex, idx, odds)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step, epochs = 0, max(epochs, -(-LEAST_STEPS // -(-len(some) // BATCH)))
    for epoch in range(epochs):
        if epoch and epoch % max(1, epochs // EPOCHS) == 0:
            score = net.logits(lex, idx)
        order = np.lexsort((-score, of))
        top = order[np.unique(of[order], return_index=True)[1]]  # each document's highest window
        picked = rng.permutation(top)
        rate = RATE * (1 - epoch / epochs)
        for lo in range(0, len(picked), BATCH):
            own = picked[lo : lo + BATCH]
            step += 1
            for k, g in net.gradients(lex, idx[own], y[of[own]]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, float]:
    """The bounded training sample ``(key, y, text)`` of the labelled documents, and the share of label 1 among all labels."""
    own = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y"))
    own = own.where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    n = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, TRAIN_POS / max(1, n.get(1, 0))).otherwise(TRAIN_NEG / max(1, n.get(0, 0)))
    own = own.where((F.pmod(F.xxhash64("key"), F.lit(1_000_000)) + 0.5) / 1_000_000 < share)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where("key is not null and text is not null")
    # The sample has a fixed expected size, so its side of the join is safe to broadcast.
    rows = texts.join(F.broadcast(own), "key").groupBy("key", "y").agg(F.min("text").alias("text"))
    return common.cut(rows, "sample"), n.get(1, 0) / max(1, sum(n.values()))


def fit(docs: DataFrame, labels: DataFrame, informed: bool = True) -> tuple[Network | None, float]:
    """A network learnt from a sample, and the share of label 1."""
    rows, prior = sample(docs, labels)
    common.small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sum(presence(b.column(2).to_pylist(), b.column(1).to_pylist()) for b in batches)
        if isinstance(held, np.ndarray):
            kind, bucket = np.nonzero(held[:, 0])
            cols = [kind, bucket, held[kind, 0, bucket], held[kind, 1, bucket]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "bucket", "n", "one"])

    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < ones < n:
        return None, prior
    held = np.zeros((2, 2, BUCKETS), dtype=np.int64)
    counts = rows.select("key", "y", "text").mapInArrow(count, "kind long, bucket long, n long, one long")
    for r in counts.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("one").alias("one")).collect():  # 2 * BUCKETS rows at most
        held[r.kind, :, r.bucket] = r.n, r.one
    odds = rows.sparkSession.sparkContext.broadcast(log_odds(held, ones / n))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(instances(b.column(2).to_pylist(), odds.value), pa.list_(pa.string()))], names=["key", "y", "windows"])

    picked = rows.select(F.col("key").cast("string").alias("key"), "y", "text").mapInArrow(pick, "key string, y int, windows array<string>").collect()
    picked.sort(key=lambda r: r.key)
    return train([r.windows for r in picked], [r.y for r in picked], odds.value, informed=informed), prior


def score(docs: DataFrame, net: Network | None, prior: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``: a row for each row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast((net.p if net else None, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p, base = held.value
        for b in batches:
            found = scores(own if own.p else None, base, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, net: Network | None, prior: float, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast((net.p if net else None, prior))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p, base = held.value
        for b in batches:
            yield b.filter(pa.array(scores(own if own.p else None, base, b.column(at).to_pylist()) < limit))

    return docs.mapInArrow(run, docs.schema)


def scores(net: Network | None, prior: float, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), -np.inf)
    if net:
        lex = Lexicon(texts)
        idx, of = lex.windows()
        np.maximum.at(out, of, net.logits(lex, idx))
    return np.where(np.isinf(out), prior, 1 / (1 + np.exp(-np.clip(out, -500, 500))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents; learnt outside the held-out fold."""
    docs = common.read(spark, sf_dir, "documents")
    net, prior = fit(docs, common.read(spark, sf_dir, "labels").where(fold(5) > 0))
    found = score(docs, net, prior)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
