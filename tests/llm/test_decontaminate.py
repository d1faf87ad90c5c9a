from __future__ import annotations

import random
import time

from bidloom.llm import common, decontaminate

BENCH = "item_id long, text string, doc_id int"
DOCS = "doc_id long, text string, item_id int"


def least(pattern, text):
    """Least edit distance of pattern to any part of text from one word's border to another, by full tables."""
    best = len(pattern) + 1
    for start in range(len(text)):
        if start and text[start - 1] != " " and text[start] != " ":
            continue
        row = list(range(len(pattern) + 1))
        for at, c in enumerate(text[start : start + len(pattern) + len(pattern) // 5 + 2], start):
            new = [row[0] + 1]
            for j, p in enumerate(pattern, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
            row = new
            if at + 1 == len(text) or text[at] == " " or text[at + 1] == " ":
                best = min(best, row[-1])
    return best


def test_against_full_tables(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(3, 14))) for _ in range(12)]
    docs = []
    for _ in range(60):
        x = list(rng.choice(items))
        for _ in range(rng.randrange(0, len(x) // 7 + 2)):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q r", "Y"])
        docs.append(" ".join(word() for _ in range(20)) + " " + "".join(x) + "! " + " ".join(word() for _ in range(9)))
    want = set()
    for d, t in enumerate(docs):
        for i, item in enumerate(items):
            x = least(decontaminate.normal(item), decontaminate.normal(t))
            if x <= int(0.1 * len(decontaminate.normal(item))):
                want.add((d, i, x))
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], BENCH)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], DOCS)
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(df, bench).collect()}
    assert got == want and len(want) > 20
    clean = {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()}
    assert clean == set(range(60)) - {d for d, _, _ in want}


def test_tiny_table_finds_every_verbatim_item(spark, tiny):
    docs, bench = (common.read(spark, tiny, t).collect() for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if f" {decontaminate.normal(b.text)} " in f" {decontaminate.normal(d.text)} "}
    got = decontaminate.op3_benchmark_decontamination(spark, tiny).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 0} == want and want


def test_edges(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, None, 0), (4, "", 0), (5, "?!", 0), (None, item, 0)], BENCH)
    docs = spark.createDataFrame([(1, item.upper().replace(" ", "\n--"), 0), (1, item, 0), (2, None, 0), (3, "", 0), (None, item, 0), (4, item[:30], 0), (5, "x " * 300_000 + item, 0)], DOCS)
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in decontaminate.matches(docs, bench).collect())
    assert got == sorted((d, i) for d in (1, 1, -1, 5) for i in (1, 2, -1))
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 7
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_short_items_stand_at_words_borders(spark):
    bench = spark.createDataFrame([(1, "no", 0), (2, "a", 0), (3, "paris", 0), (4, "the answer is", 0), (5, "東京", 0)], BENCH)
    texts = ["I have another idea", "No, thanks", "parish of Comparis", "In Paris.", "lethe answer isnt", "the anwser is 42", "今日は東京です", "a"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS)
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(1, 1), (3, 3), (6, 5), (7, 2)}
    close = decontaminate.matches(docs, bench, rate=0.2).where("item_id = 4").collect()
    assert [(r.doc_id, r.distance) for r in close] == [(5, 2)]


def test_items_without_ids_still_count(spark):
    bench = spark.createDataFrame([(None, "one item without any id", 0)], BENCH)
    docs = spark.createDataFrame([(1, "It has one item, without any ID, inside", 0), (2, "it has none", 0)], DOCS)
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()] == [(1, None)]
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [2]


def test_items_of_one_stem_are_looked_at_together():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    stem = "which of the following statements about the"
    items = [(i, f"{stem} {' '.join(word() for _ in range(rng.randint(2, 8)))}") for i in range(400)]
    text = " ".join(f"{stem} {word()} {word()}" for _ in range(100)) + " " + items[7][1] + " and " + items[33][1][:-1] + "x"
    matcher = decontaminate.Matcher(items, 0.1)
    began = time.perf_counter()
    found = matcher.find(text)
    assert time.perf_counter() - began < 5
    assert {i for i, *_ in found} >= {7, 33}
    one = {i for i, t in items if decontaminate.Matcher([(i, t)], 0.1).find(text)}
    assert {i for i, *_ in found} == one


def test_groups_and_single_items_find_the_same(monkeypatch):
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("ab c") for _ in range(rng.randint(20, 60)))) for i in range(60)] + [(100 + i, "abc abc " * 3 + "abcdefgh"[i]) for i in range(8)]
    texts = ["".join(rng.choice("ab c") for _ in range(300)) for _ in range(20)] + [items[k][1][:10] + "b" + items[k][1][11:] for k in range(20)]
    together = [decontaminate.Matcher(items, 0.2).find(t) for t in texts]
    monkeypatch.setattr(decontaminate, "GROUP", 10**9)
    monkeypatch.setattr(decontaminate, "KNOWN", 1)
    assert together == [decontaminate.Matcher(items, 0.2).find(t) for t in texts] and any(together)
