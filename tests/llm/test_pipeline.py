from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipe
from bidloom.llm import bpe, common, decontaminate, pii, simhash, toxicity
from tests.llm.test_simhash import slow_fingerprint


def five_word_shingles(text):
    words = re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).strip(" ").split(" ")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words != [""] else set()


def slow_classes(docs):
    """Classes by all pairs: fingerprints of at most three differing bits, or five-word Jaccard of at least 0.8; each document's least id."""
    fps, sets, root = {i: slow_fingerprint(t) for i, t in docs.items()}, {i: five_word_shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in docs:
        for y in docs:
            if x < y and (bin(fps[x] ^ fps[y]).count("1") <= 3 or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) > 0):
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in docs}


@pytest.fixture(scope="module")
def brute(spark, tiny):
    """The rows that each stage should leave, by plain Python on the tiny tables."""
    docs = {r.doc_id: r.text for r in common.read(spark, tiny, "documents").collect()}
    net, prior = toxicity.fit(common.read(spark, tiny, "documents"), common.read(spark, tiny, "labels"))
    clean = {i: t for i, t in docs.items() if toxicity.scores(net, prior, [t])[0] < 0.5}
    root = slow_classes(clean)
    heads = {i: t for i, t in clean.items() if root[i] == i}
    items = [decontaminate.normal(r.text) for r in common.read(spark, tiny, "benchmark").collect()]
    apart = {i: t for i, t in heads.items() if not any(f" {x} " in f" {decontaminate.normal(t)} " for x in items)}
    private = {i: pii.replace(t, pii.DEMO_KEY, lambda k, v: 0)[0] for i, t in apart.items()}
    return docs, clean, heads, apart, private


def test_stages_against_brute_force(spark, tiny, brute):
    docs, _, heads, apart, private = brute
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in pipe.run(spark, tiny).collect()}
    assert set(got) == set(private) and len(apart) < len(heads) < len(docs)
    for i, t in private.items():
        ids = library.encode_ordinary(t)
        assert got[i].ids == ids and got[i].decoded == t and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_columns_and_take_edges(spark, tiny):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, fp string"
    rows = [(1, None, None, None, None, 1, "a"), (2, "", "en", "s", 0, 1, "b"), (None, "some text of its own", "en", "s", 20, 1, "c"), (4, "word " * 100_000, "en", "s", 9, 1, "d"), (5, "mail a.1@b.example.com now", "en", "s", 9, 1, "e"), (5, "mail a.1@b.example.com now", "en", "s", 9, 1, "e")]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in pipe.STAGES[:-1]:
            out = stage(spark, docs, tiny)
            assert out.columns == docs.columns, name
            docs = common.cut(out, name)
        last = pipe.STAGES[-1][1](spark, docs, tiny)
        assert last.count() == (4 if some else 0)


def test_deduplicate_keeps_one_row(spark):
    schema = "doc_id long, text string, component_id int"
    rows = [(3, "a b c d", 1), (3, "a b c d", 1), (7, "a b c d", 1), (None, "a b c d", 1), (None, "q r s t u", 1), (9, "zz yy xx ww vv", 1)]
    got = simhash.deduplicate(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "q r s t u"), (3, "a b c d"), (9, "zz yy xx ww vv")]
