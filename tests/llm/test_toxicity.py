from __future__ import annotations

import math
import os
import random
import re
import zlib

import numpy as np

from bidloom.llm import toxicity as tox


def made(n, seed):
    rng = random.Random(seed)
    syl = "ba be bi bo ka ke ki ko ma me mi mo ta te ti to".split()
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for i in range(n):
        w, bad = [word() for _ in range(rng.randint(5, 160))], i % 4 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grumf", "xyl" + word()]))
        texts.append(" ".join(w)), labels.append(int(bad))
    return texts, labels


def trained(texts, labels, **more):
    odds = tox.log_odds(tox.presence(texts, labels), float(np.mean(labels)))
    return tox.train(tox.instances(texts, odds), labels, odds, **more)


def test_held_out_accuracy():
    net = trained(*made(1200, 1))
    texts, labels = made(300, 2)
    got = tox.scores(net, 0.2, texts) >= 0.5
    assert (got == np.array(labels)).mean() > 0.9


def test_gradients_against_differences():
    texts, labels = made(8, 3)
    lex = tox.Lexicon(texts)
    idx, of = lex.windows()
    y = np.array(labels, dtype=np.float32)[of]
    net = tox.Network(np.random.default_rng(0))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        s = net.forward(net.project(net.embed(lex)), idx, lex.n).astype(np.float64)
        return np.mean(np.log1p(np.exp(-np.where(y > 0, s, -s))))

    g = net.gradients(lex, idx, y)
    for k in net.p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, eps = net.p[k][at], 2e-3
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_windows_cover_every_word_and_overlap():
    for n in (1, 5, 39, 40, 41, 70, 71, 100, 1000):
        lex = tox.Lexicon([None, "", "12", " ".join("w" + chr(97 + i % 26) * (i % 20 + 1) for i in range(n))])
        idx, of = lex.windows()
        assert set(of) == {3}
        seen = [idx[k][j] for k in range(len(idx)) for j in range(tox.WINDOW) if idx[k][j] != lex.n]
        assert set(seen) == set(lex.docs[3])
        starts = range(0, len(idx) * tox.STRIDE, tox.STRIDE)
        assert starts[-1] + tox.WINDOW >= n and all(b - a < tox.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_batches_do_not_change_scores():
    net = trained(*made(200, 4), epochs=2)
    texts, _ = made(20, 5)
    assert np.allclose(tox.scores(net, 0.1, texts), [tox.scores(net, 0.1, [t])[0] for t in texts], atol=1e-5)


def test_spark_edges(spark, tiny):
    got = tox.op2_toxicity(spark, tiny).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    rows = [(1, None, "a"), (2, "", "b"), (3, "1 2", "c"), (None, "ba grumf", "d"), (4, "ba be", "e"), (4, "ba be", "e"), (5, "be " * 100_000, "f"), (6, "a" * 5000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, None, 0), (4, None, 0), (None, 1, 1), (5, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    net, prior = tox.fit(docs, labels)
    assert prior == 0.5 and net is not None
    got = {r.doc_id: r.score for r in tox.score(docs, net, prior).collect()}
    assert got[1] == got[2] == got[3] == 0.5 and len(got) == 7
    for none in (labels.limit(0), labels.where("toxic = 0")):
        net, prior = tox.fit(docs, none)
        assert net is None and {r.score for r in tox.score(docs, net, prior).collect()} == {0.0}
    assert tox.score(docs.limit(0), None, 0.1).count() == 0


def slow_score(net, text):
    """The highest window's score, word by word and unit by unit."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    words = re.findall(r"[^\W\d_]{1,%d}" % tox.LETTERS, text.lower())
    sig = lambda x: 1 / (1 + math.exp(-x))

    def bucket(points):
        h = 0
        for x in points:
            h = (h * 1_000_003 + x) % 2**64
        return (h * 0x9E3779B97F4A7C15) % 2**64 >> 50

    def vector(w):
        marked = [1, *map(ord, w), 2]
        grams = [bucket((marked + [0] * 4)[i : i + 4]) for i in range(max(1, len(w) - 1))]
        return [p["word"][bucket(marked + [0] * (tox.LETTERS - len(w)))][k] + sum(p["gram"][g][k] for g in grams) / len(grams) for k in range(tox.DIM)]

    def states(d, xs):
        h, out, n = [0.0] * tox.HIDDEN, [], tox.HIDDEN
        for x in xs:
            a = [sum(x[i] * p[f"w{d}"][i][j] for i in range(tox.DIM)) + p[f"c{d}"][j] for j in range(3 * n)]
            g = [sum(h[i] * p[f"u{d}"][i][j] for i in range(n)) for j in range(3 * n)]
            z, r = [sig(a[j] + g[j]) for j in range(n)], [sig(a[n + j] + g[n + j]) for j in range(n)]
            c = [math.tanh(a[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
            h = [h[j] + z[j] * (c[j] - h[j]) for j in range(n)]
            out.append(h)
        return out

    best, at = -math.inf, 0
    while True:
        xs = [vector(w) for w in words[at : at + tox.WINDOW]]
        both = [f + b for f, b in zip(states("f", xs), reversed(states("b", xs[::-1])), strict=True)]
        e = [math.exp(sum(x * q for x, q in zip(h, p["query"], strict=True))) for h in both]
        ctx = [sum(w * h[k] for w, h in zip(e, both, strict=True)) / sum(e) for k in range(2 * tox.HIDDEN)]
        best = max(best, sum(x * o for x, o in zip(ctx, p["out"], strict=True)) + p["bias"][0])
        if at + tox.WINDOW >= len(words):
            return sig(best)
        at += tox.STRIDE


def test_scores_against_plain_loops():
    net = trained(*made(200, 4), epochs=2)
    texts = [*made(6, 6)[0], "a", "ab Ü", "x" * 60]
    assert np.allclose(tox.scores(net, 0.1, texts), [slow_score(net, t) for t in texts], atol=1e-4)


def test_held_out_documents(spark):
    at = f"{os.environ.get('BIDLOOM_DATA', '/root/testdata')}/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = [r for r in tox.op2_toxicity(spark, at).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(got) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.93


def test_repeated_ids_and_long_texts_learn_alike(spark):
    texts, labels = made(60, 8)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "zz " * 50_000), (1, None), (2, "zz"), (2, "zz")]
    lab = spark.createDataFrame([(i, 0, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    one, two = (tox.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(k), lab)[0] for k, x in ((1, rows), (3, rows[::-1])))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)
