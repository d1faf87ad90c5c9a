from __future__ import annotations

import random

import pytest

from bidloom import shared
from bidloom.operators import linkage as L


def sets(seed, n, words="abcdefghijkl", tags=("t1", "t2", "t3")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tokens = rng.sample(words, rng.randint(1, 6)) + rng.choices(words[:2], k=rng.randint(0, 1))
        rows.append((i + 1000 * seed, tokens, rng.sample(tags, rng.choice((0, 0, 1, 1, 2)))))
    return rows


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least,cell", [(0.6, 3), (0.75, 20_000)])
def test_all_similar_pairs_are_found(spark, monkeypatch, least, cell):
    monkeypatch.setattr(L, "CELL", cell)
    items, offers = sets(1, 90), sets(2, 120)
    items += [(7001, ["hot", "a"], []), (7002, None, ["t1"]), (7003, [], None), (7004, ["lone"], ["nowhere"])]
    offers += [(8000 + i, ["hot", "a"] + (["b"] if i % 2 else []), ["t1"] * (i % 3 > 0)) for i in range(30)]
    schema = "id long, tokens array<string>, tags array<string>"
    a, b = spark.createDataFrame(items, schema), spark.createDataFrame(offers, schema)
    left, right = shared.cut(L.classes(a, "id"), "a"), shared.cut(L.classes(b, "id"), "b")
    got = {(r.item, r.offer): (r.common, round(r.similarity, 9)) for r in L.candidates(left, right, least).collect()}
    rep = {}
    for rows in (items, offers):
        own = {}
        for i, t, g in rows:
            if t:
                own.setdefault((frozenset(t), frozenset(g or ())), []).append(i)
        rep |= {min(ids): k for k, ids in own.items()}
        known = {r.id: r.rep for r in L.members(spark.createDataFrame(rows, schema), "id").collect()}
        assert known == {i: min(ids) for ids in own.values() for i in ids}
    want = {}
    for i, (x, xt) in rep.items():
        for o, (y, yt) in rep.items():
            mine, theirs = any(r[0] == i for r in items), any(r[0] == o for r in offers)
            if mine and theirs and xt <= yt and jaccard(x, y) >= least:
                want[i, o] = (len(x & y), round(jaccard(x, y), 9))
    assert got == want and len(want) > 5
    with pytest.raises(ValueError, match="0.5"):
        L.candidates(left, right, 0.5)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, tokens array<string>, tags array<string>")
    some = spark.createDataFrame([(1, ["a", "b"], [])], none.schema)
    for a, b in ((none, some), (some, none), (none, none)):
        assert L.candidates(L.classes(a, "id"), L.classes(b, "id")).count() == 0
    assert L.members(none, "id").count() == 0


def near(a, b):
    return abs(len(a) - len(b)) <= 2 and (set(a) <= set(b) or set(b) <= set(a))


@pytest.mark.parametrize("letters", ["钢管热镀锌埋地灯", "ab"])
def test_near_bags_are_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    names = {"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(150)} | {"地埋灯", "埋地灯", "aaaa", "abcdef", "a" * 13}
    df = spark.createDataFrame([(n,) for n in sorted(names)] * 2 + [(None,), ("",)], "name string")
    found = shared.cut(L.character_sets(df), "sets")
    reps = {}
    for n in sorted(names):
        if 2 <= len(n) <= 12:
            reps.setdefault("".join(sorted(n)), n)
    assert {r.rep for r in found.collect()} == set(reps.values())
    names = sorted(reps.values())
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if near(a, b)}
    assert {(r.rep_a, r.rep_b) for r in L.near_bags(found).collect()} == want and want


def test_names_agree_with_the_gate_rule(spark):
    """The bags that are near are those that the rule for product names takes as one, bar containment of the texts themselves."""
    from pyspark.sql import functions as F

    from bidloom.functions import text as T

    names = ["热镀锌钢管", "镀锌钢管", "钢管热镀", "地埋灯", "埋地灯", "冷却塔", "塔机", "管钢", "蝶阀门", "阀门蝶"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")
    rule = {(r.a, r.b) for r in pairs.where(T.soft_same_product(F.col("a"), F.col("b"))).collect()}
    sets_ = shared.cut(L.character_sets(spark.createDataFrame([(n,) for n in names], "name string")), "sets")
    reps = {"".join(sorted(r.rep)): r.rep for r in sets_.collect()}
    near_ = {(r.rep_a, r.rep_b) for r in L.near_bags(sets_).collect()}
    for a, b in {(a, b) for a in names for b in names if a < b}:
        x, y = sorted((reps["".join(sorted(a))], reps["".join(sorted(b))]))
        assert (x == y or (x, y) in near_) == near(a, b)
        if near(a, b):
            assert (a, b) in rule


@pytest.mark.parametrize("sent", [200_000, 0])
def test_words_in_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(L, "SENT_WORDS", sent)
    rng = random.Random(9)
    words = ["a", "ab", "abc", "abcd", "bca", "北京", "北", "海南省", "%_", "", None, ".*"] + ["".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(40)]
    texts = ["".join(rng.choices("abcx 北京", k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "a", "x.*y%_", "abc" * 20_000 + "海南省"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, word int")
    got = {(r.id, r.word): r["at"] for r in L.found_words(df, spark.createDataFrame([(w,) for w in words + words], "word string"), "id", "text").collect()}
    assert got == {(i, w): t.index(w) + 1 for i, t in enumerate(texts) if t for w in set(words) if w and w in t}
    assert L.found_words(df, spark.createDataFrame([], "word string"), "id", "text").count() == 0


def test_words_in_texts_by_hashes_are_those_of_plain_search(monkeypatch):
    import random

    import pyarrow as pa

    rng = random.Random(2)
    words = {"".join(rng.choice("abé𝒳 ") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"ab" * 20}
    texts = [None, "", "a", *("".join(rng.choice("abé𝒳 ") for _ in range(rng.randrange(200))) for _ in range(200)), "b" * 150 + "ab" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    want = {(i, w, t.find(w) + 1) for i, t in enumerate(texts) if t for w in words if w in t}
    # Small blocks, and hashes of which many are equal.
    for name, value in ((None, None), ("HASHED", 64), ("MULTIPLIER", L.np.uint64(1 << 60))):
        if name:
            monkeypatch.setattr(L, name, value)
        got = [tuple(r.values()) for b in L._finder(sorted(words))(iter([batch])) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
