from __future__ import annotations

import os
import shutil

import pytest

from bidloom.streaming.store import Store

SCHEMA = "id long, ts long, name string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), SCHEMA, ("id",), ("ts",))


def frame(spark, rows, op=False):
    return spark.createDataFrame(rows, SCHEMA + (", op string" if op else ""))


def now(store):
    return sorted(map(tuple, store.read().collect()))


def test_upserts_deletes_and_late_rows(spark, store):
    assert now(store) == []
    assert store.merge(frame(spark, [(1, 10, "a"), (1, 12, "b"), (2, 10, "c"), (3, 9, "x")]), 0)
    assert store.merge(frame(spark, [(1, 11, "late", "upsert"), (2, 20, None, "delete"), (3, 9, "y", None)], True), 1)
    assert now(store) == [(1, 12, "b"), (3, 9, "y")]  # equal order: the later batch holds
    assert store.merge(frame(spark, [(2, 15, "before its deletion"), (4, 1, "d")]), 2)
    assert now(store) == [(1, 12, "b"), (3, 9, "y"), (4, 1, "d")]
    assert store.merge(frame(spark, [(2, 21, "again")]), 3) and (2, 21, "again") in now(store)


def test_a_replayed_batch_changes_nothing(spark, store):
    rows = frame(spark, [(1, 1, "a"), (2, 1, "b")])
    assert store.merge(rows, 0) and not store.merge(frame(spark, [(9, 9, "other")]), 0)
    assert now(store) == [(1, 1, "a"), (2, 1, "b")]
    os.remove(f"{store.at}/batch/n=0/_SUCCESS")  # as if the driver had been lost while it wrote
    assert now(store) == [] and store.merge(rows, 0) and now(store) == [(1, 1, "a"), (2, 1, "b")]


def test_compaction(spark, store):
    for n in range(3):
        store.merge(frame(spark, [(n, n, f"r{n}", "upsert"), (0, n + 1, None, "delete" if n == 1 else "upsert")], True), n)
    before = now(store)
    assert store.compact() == 2 and store.compact() is None and now(store) == before
    assert store.batches() == [] and not store.merge(frame(spark, [(7, 7, "old batch")]), 1)
    store.merge(frame(spark, [(0, 2, "at the time of the deletion"), (5, 5, "new")]), 3)
    assert store.compact() == 3 and (5, 5, "new") in now(store)
    assert sorted(os.listdir(f"{store.at}/base")) == ["n=2", "n=3"] and sorted(os.listdir(f"{store.at}/batch")) == ["n=3"]
    store.merge(frame(spark, [(6, 6, "x")]), 4)
    half = f"{store.at}/base/n=4"
    assert store.compact() == 4 and os.path.isdir(half)
    held = now(store)
    os.remove(f"{half}/_SUCCESS")  # a compaction that was cut short: the base before and its batches hold
    assert store.base() == 3 and now(store) == held


def test_deleted_keys_do_not_come_back_after_a_compaction(spark, store):
    store.merge(frame(spark, [(1, 5, "a")]), 0)
    store.merge(frame(spark, [(1, 9, None, "delete")], True), 1)
    store.compact()
    store.merge(frame(spark, [(1, 7, "late")]), 2)
    assert now(store) == []


def test_without_an_order_the_last_batch_holds(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, ("id",))
    store.merge(frame(spark, [(1, 9, "a")]), 0)
    store.merge(frame(spark, [(1, 1, "b"), (None, 1, "no key")]), 1)
    assert sorted(map(tuple, store.read().collect()), key=repr) == [(1, 1, "b"), (None, 1, "no key")]
    store.merge(frame(spark, [(1, 0, None, "delete")], True), 2)
    store.compact()
    assert now(store) == [(None, 1, "no key")]


def test_a_query_that_fails_between_write_and_checkpoint(spark, tmp_path, store):
    for n in range(4):
        frame(spark, [(n, n, "a"), (0, n, f"v{n}")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge, calls = store.merge, []

    def failing(rows, batch):
        calls.append(batch)
        done = merge(rows, batch)
        if batch == 2 and calls.count(2) == 1:
            raise RuntimeError("lost after the write, before Spark notes the batch")
        return done

    store.merge = failing
    q = store.write(stream(), str(tmp_path / "state"), compact_every=2)
    with pytest.raises(Exception, match="lost after the write"):
        q.awaitTermination()
    store.write(stream(), str(tmp_path / "state"), compact_every=2).awaitTermination()
    assert calls == [0, 1, 2, 2, 3] and now(store) == [(0, 3, "v3"), (1, 1, "a"), (2, 2, "a"), (3, 3, "a")]
    shutil.rmtree(tmp_path / "in")
