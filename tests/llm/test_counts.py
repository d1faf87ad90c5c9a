from __future__ import annotations

import json
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bidloom.llm import common, counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return counts.Counter(counts.Vocabulary(counts.load(PATH)))


def sizes(library, texts):
    return [len(e) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def hard():
    rng = random.Random(4)
    fixed = [None, "", " ", "\n\n  a", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "日本語 テキスト😀", "a" * 3000, "a" * 256, "a" * 257, "aaa", "ab" * 400, "!?" * 700 + "x"]
    fixed += ["\u0000\u0001", "é" * 256, "don't we'll  ", "1234567890" * 90, " 　 x", "ſ'S 'T"]
    return fixed + ["".join(rng.choice(["a", "b", "the", " ", "é", "1", "\n", "ing"]) for _ in range(rng.randint(1, 500))) for _ in range(200)]


def test_tiny_table_against_the_library(spark, tiny, library):
    rows = common.read(spark, tiny, "documents").collect()
    want = {r.doc_id: (len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, sizes(library, [r.text for r in rows]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts.op13_token_counts(spark, tiny).collect()} == want
    assert len(set(w[2] for w in want.values())) == 2


def test_edge_texts(spark, library):
    texts = hard()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "two words", "x", 1)], "doc_id long, text string, n_tokens string, n_bytes int")
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(df, PATH, 512).collect()}
    assert got == {**dict(enumerate(sizes(library, texts))), None: 2}
    assert counts.count_tokens(df.limit(0), PATH, 512).count() == 0


def test_flat_and_indexed_merging_agree(counter):
    pieces = [t.encode() for t in hard() if t]
    assert counter.merge(pieces).tolist() == [counter.merge_long(p) for p in pieces]


def test_every_character_splits_as_in_the_library(counter, library):
    texts = [f"a{c}b1{c}{c} {c}!{c} " for c in map(chr, range(0x3000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    assert counter.count(texts) == sizes(library, texts)


def test_one_giant_word_takes_linear_time(counter, library):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    began = time.perf_counter()
    n = counter.count([word])[0]
    assert time.perf_counter() - began < 20 and n == sizes(library, [word])[0]


def test_forgetting_and_blocks_do_not_change_counts(library, monkeypatch):
    monkeypatch.setattr(counts, "MEMORY", 3)
    monkeypatch.setattr(counts, "FLAT", 40)
    counter, texts = counts.Counter(counts.Vocabulary(counts.load(PATH))), hard()
    assert [counter.count([t])[0] for t in texts] == sizes(library, texts)


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
        {"added_tokens": [{"content": "x", "single_word": True, "lstrip": False, "rstrip": False, "normalized": False}]},
    ],
)
def test_files_that_count_otherwise_are_refused(change):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    with pytest.raises(ValueError, match="counted"):
        counts.Vocabulary(json.dumps(file | change))


def test_merges_in_a_wrong_order_are_refused():
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["merges"].reverse()
    with pytest.raises(ValueError, match="before"):
        counts.Vocabulary(json.dumps(file))
