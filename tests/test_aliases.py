from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bidloom import shared
from bidloom.operators import aliases as A
from bidloom.operators import history as H


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "a string, b string")


def closure(pairs):
    label = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label


def clusters(df):
    return {r.name: r.cluster for r in df.collect()}


@pytest.mark.parametrize("seed,sent", [(1, 500_000), (2, 0)])
def test_updates_equal_a_new_start(spark, monkeypatch, seed, sent):
    monkeypatch.setattr(A, "SENT", sent)
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(60):02}"
    pairs = {tuple(sorted((name(), name()))) for _ in range(45)}
    pairs = {p for p in pairs if p[0] != p[1]}
    added = {tuple(sorted((name(), name()))) for _ in range(8)} | {("new1", "new2"), ("n01", "new2")}
    removed = set(rng.sample(sorted(pairs), 9)) | {("n00", "never")}
    held = shared.cut(H.clusters(frame(spark, pairs)), "held")
    after = (pairs | {p for p in added if p[0] != p[1]}) - removed
    args = (frame(spark, [(b, a) for a, b in added] + [(None, "x"), ("y", "y")]), frame(spark, removed))
    assert clusters(A.updated(held, frame(spark, pairs), *args)) == closure(after)
    assert {tuple(r) for r in A.changed(frame(spark, pairs), *args).collect()} == after
    assert clusters(A.updated(held, frame(spark, pairs))) == closure(pairs)


def test_a_removed_bridge_splits_its_cluster_only(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("q", "r"), ("p", "r")]
    held = shared.cut(H.clusters(frame(spark, pairs)), "held")
    assert clusters(A.updated(held, frame(spark, pairs), None, frame(spark, [("c", "b"), ("q", "p")]))) == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x", "y": "x", "p": "p", "q": "p", "r": "p"}
    assert clusters(A.updated(held, frame(spark, pairs), frame(spark, [("d", "x"), ("y", "0")]))) == closure(pairs + [("d", "x"), ("y", "0")])
    none = frame(spark, [])
    assert clusters(A.updated(none.toDF("name", "cluster"), none, frame(spark, [("k", "j")]))) == {"j": "j", "k": "j"}


def test_contradicted_denials(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "y")]
    held = shared.cut(H.clusters(frame(spark, pairs)), "held")
    denied = frame(spark, [("c", "a"), ("a", "f"), ("a", "x"), ("y", "x"), ("a", "unknown")])
    found = A.contradictions(held, denied)
    assert {tuple(r) for r in found.collect()} == {("a", "c", "a"), ("a", "f", "a"), ("x", "y", "x")}
    assert {tuple(r) for r in A.between(frame(spark, pairs), found.select("a", "b"), 4).collect()} == {("a", "c", 2), ("a", "f", None), ("x", "y", 1)}
    assert {tuple(r) for r in A.between(frame(spark, pairs), found.select("a", "b"), 6).collect()} == {("a", "c", 2), ("a", "f", 5), ("x", "y", 1)}


def test_growing_tables_are_not_sent_whole(spark, monkeypatch):
    monkeypatch.setattr(shared, "SENT", 2, raising=False)
    pairs = frame(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    held, denied = shared.cut(H.clusters(pairs), "held"), frame(spark, [("c", "a"), ("x", "y")])
    for df in (A.contradictions(held, denied), A.between(pairs, denied, 2), A.changed(pairs, None, denied)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count()
    table = shared.cut(held.groupBy("cluster").count(), "table").union(spark.createDataFrame([("k", 1), ("l", 1)], "cluster string, count long"))
    joined = shared.join_counted(held, table, "cluster", "count")
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in joined.collect()) == [("a", "a", 3), ("a", "b", 3), ("a", "c", 3), ("x", "x", 2), ("x", "y", 2)]


def test_an_update_sends_no_stored_pairs(spark, monkeypatch):
    pairs, removed, plans, own = shared.cut(frame(spark, [("a", "b"), ("x", "y")]), "pairs"), shared.cut(frame(spark, [("a", "y")]), "gone"), [], shared.cut
    held = spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "x"), ("y", "x")], "name string, cluster string")
    monkeypatch.setattr(shared, "cut", lambda df, *name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, *name))
    assert clusters(A.updated(held, pairs, frame(spark, [("b", "a")]), removed)) == {"a": "a", "b": "a", "x": "x", "y": "x"}
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans)


def test_many_changed_labels_are_shuffled(spark, monkeypatch):
    labels = shared.cut(spark.range(120_000).select(F.col("id").cast("string").alias("old"), F.lit("0").alias("new")), "labels")
    rows, plans, own = spark.createDataFrame([("a", "7"), ("b", "119999"), ("c", "120000")], "name string, cluster string"), [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df, *name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, *name))
    assert clusters(A.relabelled(rows, labels, "cluster")) == {"a": "0", "b": "0", "c": "120000"}
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
