from __future__ import annotations

import math
import re
from collections import Counter

import regex
import xxhash

from bidloom.llm import common, quality


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup, seen = dup + (line in seen), seen | {line}
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def h(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed)
    return seed


def plain_buckets(text):
    tokens = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]", text or "")
    hs = [h([t.encode()]) for t in tokens]
    raw = [x.to_bytes(8, "little") for x in hs]
    return [x % quality.BUCKETS for x in hs] + [h([a, b]) % quality.BUCKETS for a, b in zip(raw, raw[1:], strict=False)]


def test_tiny_table_against_plain_counts(spark, tiny):
    docs = common.read(spark, tiny, "documents").collect()
    good = {r.doc_id for r in common.read(spark, tiny, "labels").collect() if r.quality == 1}
    raw, target = Counter(), Counter()
    for d in docs:
        b = plain_buckets(d.text)
        raw.update(b)
        if d.doc_id in good:
            target.update(b)
    n, g, k = sum(raw.values()), sum(target.values()), quality.BUCKETS
    ratio = lambda b: math.log((target[b] / ((raw[b] + 1) / (n + k)) + k) / (g + k))
    got = {r.doc_id: r for r in quality.op8_quality_llr(spark, tiny).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, base, b = got[d.doc_id], plain_base(d.text), plain_buckets(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        score = sum(map(ratio, b)) / len(b) if b else 0.0
        assert abs(r.score - score) < 1e-9 and r.kept == (not base[-1] and r.score >= quality.THRESHOLD)


def test_edges(spark):
    texts = [None, "", " \t\n", "a", "a b", "a b c a b c", "x\n\nx\n x\nx\n", "é😀 # |", "\x0bq\x0cw\re ", "a b c d a b c x b c d", "w " * 30_000, "the cat sat " * 20, "a b c"]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)] + [(0, None, 1, "q"), (None, "a b", 1, "q")], "doc_id long, text string, words int, score string")
    got = quality.rate(df, df.select("doc_id").where("doc_id > 100")).collect()
    assert len(got) == len(texts) + 2 and all(r.score == 0 for r in got)
    for r in got:
        text = "a b" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(text), text
    assert quality.rate(df.limit(0), df.select("doc_id")).count() == 0


def test_no_python_in_the_plan(spark, tiny):
    plan = quality.op8_quality_llr(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
