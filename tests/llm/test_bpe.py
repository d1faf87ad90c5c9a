from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from bidloom.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


def test_tiny_table_against_the_library(spark, tiny, library):
    want = {}
    for r in common.read(spark, tiny, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10_byte_bpe(spark, tiny).collect()}
    assert got == want


def test_edge_texts(spark, library):
    texts = [None, "", " ", "\n\n  a", "<|endoftext|>", "日本語 テキスト😀", "a" * 3000, "ab" * 400, "!?" * 700 + "x", "\u0000\u0001", "x" * 513, "é" * 256, "don't we'll  "]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    got = {r.doc_id: r for r in bpe.encode(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(t or ""), i
        assert got[i].decoded == (t or "")
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_heap_and_matrix_agree(codec, library):
    for p in (b"antidisestablishmentarianism", b"aaaaaaaaaaaaaaaa", b"thththehehe" * 9, "ñandúes".encode()):
        assert codec.merge_long(p) == codec.encode_pieces([p])[0] == library.encode_ordinary(p.decode())


def test_two_vocabularies_of_one_size(spark, tmp_path):
    tokens = bpe.load_ranks(PATH)
    a, b = tokens.index(b" the"), tokens.index(b" and")
    tokens[a], tokens[b] = tokens[b], tokens[a]
    other = tmp_path / "other.tiktoken"
    other.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    df = spark.createDataFrame([(1, "x the y and")], "doc_id long, text string").coalesce(1)
    one, two = (bpe.encode(df, p, public_tokenizers.PATTERN).first() for p in (PATH, str(other)))
    swap = {a: b, b: a}
    assert two.ids == [swap.get(i, i) for i in one.ids] != one.ids and one.decoded == two.decoded == "x the y and"


def test_forgetting_does_not_change_ids(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    for text in ("one two three", "four five six", "one six", "seven one"):
        pieces = codec.split.findall(text)
        codec.learn(set(pieces))
        ids, before = codec.gather(pieces)
        assert ids.tolist() == library.encode_ordinary(text) and before[-1] == len(ids)
