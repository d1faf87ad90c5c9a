from __future__ import annotations

import json
import os

import pytest

from bidloom.sources import arrivals, sink
from bidloom.sources import workbook as W
from bidloom.streaming.store import Store

SCHEMA = "file string, version long, item_id string, name string, spec string, unit string, qty double"


def book(at, file, *names):
    cells = [["材料名称", "规格型号", "单位", "数量"], *[[n, "DN100", "m", "2"] for n in names]]
    with open(at / file, "wb") as f:
        f.write(W.packed([("安装", iter(cells))]))


def run(spark, stream, one, state):
    seen = []

    def batch(df, n):
        seen.append((n, sorted({r.file for r in df.select("file").collect()})))
        if one:
            one(df, n)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
    return [s for s in seen if s[1]]


def test_each_run_reads_what_is_new_or_changed(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    log, state = str(tmp_path / "log"), tmp_path / "state"
    store = Store(spark, str(tmp_path / "store"), SCHEMA, ("file", "item_id"), ("version",))
    go = lambda: run(spark, arrivals.stream(spark, str(inbox), log), lambda df, n: store.merge(arrivals.items(df), n), state)
    now = lambda: sorted((r.file, r.version, r.item_id, r.name) for r in arrivals.current(store.read()).collect())
    book(inbox, "a.xlsx", "钢管", "阀门")
    book(inbox, "b.xlsx", "电缆")
    (inbox / "broken.xlsx").write_bytes(b"not a zip")
    (inbox / "notes.txt").write_text("not a workbook")
    assert [f for _, f in go()] == [["a.xlsx", "b.xlsx", "broken.xlsx"]]
    assert now() == [("a.xlsx", 1, "安装|2", "钢管"), ("a.xlsx", 1, "安装|3", "阀门"), ("b.xlsx", 1, "安装|2", "电缆")]
    assert go() == []
    book(inbox, "c.xlsx", "灯")
    book(inbox, "a.xlsx", "钢管改")
    os.utime(inbox / "a.xlsx", ns=(1, os.stat(inbox / "b.xlsx").st_mtime_ns + 5))
    assert [f for _, f in go()] == [["a.xlsx", "c.xlsx"]]
    assert now() == [("a.xlsx", 2, "安装|2", "钢管改"), ("b.xlsx", 1, "安装|2", "电缆"), ("c.xlsx", 2, "安装|2", "灯")]
    want = [("a.xlsx", "钢管改"), ("b.xlsx", "电缆"), ("c.xlsx", "灯")]  # the batch twin: everything read anew
    from bidloom.sources import xlsx

    (inbox / "broken.xlsx").unlink()
    assert sorted((r.file, r.name) for r in xlsx.items(xlsx.read_binary(spark, str(inbox))).collect()) == want == [(f, n) for f, _, _, n in now()]


def test_broken_workbooks_are_told_of(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"no")
    told = []
    stream = arrivals.stream(spark, str(tmp_path), str(tmp_path / "log"))
    run(spark, stream, lambda df, n: told.extend(df.select("file", "row", "error").collect()), tmp_path / "state")
    assert [(r.file, r.row) for r in told] == [("x.xlsx", None)] and "BadZipFile" in told[0].error


def test_stored_responses_come_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from bidloom.sources import responses

    (tmp_path / "in").mkdir()
    rows = []
    for k in range(3):
        (tmp_path / "in" / f"{k}.html").write_text(f"<html><body><h3 class='t'><a href='http://x/{k}'>管 {k}</a></h3></body></html>", encoding="utf-8")
    stream = arrivals.stream(spark, str(tmp_path / "in"), str(tmp_path / "log"), pattern="*.html", rows="content")
    run(spark, stream, lambda df, n: rows.extend(df.select("file", "version", F.decode("content", "utf-8").alias("html")).collect()), tmp_path / "state")
    assert sorted((r.file, r.version, f"http://x/{r.file[0]}" in r.html) for r in rows) == [(f"{k}.html", 1, True) for k in range(3)] and responses
    with pytest.raises(Exception, match="cells or content"):
        arrivals.stream(spark, str(tmp_path), str(tmp_path / "log2"), rows="x")


def test_listings_go_on_from_a_summary(tmp_path):
    (tmp_path / "in").mkdir()
    make = lambda: arrivals.Listings(str(tmp_path / "in"), str(tmp_path / "log"), "*.json")
    for n in range(1, 13):
        (tmp_path / "in" / f"{n}.json").write_text("x" * n)
        assert make().refresh() == n and make().refresh() == n
    assert os.path.exists(tmp_path / "log" / "all-10.json")
    held = make()
    assert held.last == 12 and len(held.known) == 12
    assert [x[0] for x in held.between(9, 12)] == ["10.json", "11.json", "12.json"]
    (tmp_path / "in" / "3.json").write_text("changed")
    assert held.refresh() == 13 and [(x[0], x[3]) for x in held.between(0, 13) if x[0] == "3.json"] == [("3.json", 13)]
    assert json.loads((tmp_path / "log" / "13.json").read_text())[0][0] == "3.json"


def test_files_are_dealt_to_tasks_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "TASK_BYTES", 1000)
    monkeypatch.setattr(arrivals, "FILE_BYTES", 100)
    for n in range(25):
        (tmp_path / f"{n:02}.xlsx").write_bytes(b"x" * (5000 if n == 7 else 10))
    source = arrivals.Arrivals({"path": str(tmp_path), "log": str(tmp_path / "log")})
    tasks = [[f for f, *_ in p.value] for p in source.partitions(source.initialOffset(), source.latestOffset())]
    assert sum(map(len, tasks)) == 25 and max(map(len, tasks)) == 10 and all(len(t) <= 10 for t in tasks) and sink


def test_workbooks_of_a_batch_are_parsed_once_and_by_several_tasks(spark, tmp_path, monkeypatch):
    for n in range(8):
        (tmp_path / f"{n}.xlsx").write_bytes(b"x" * 400_000)
    source = arrivals.Arrivals({"path": str(tmp_path), "log": str(tmp_path / "log")})
    assert [len(p.value) for p in source.partitions(source.initialOffset(), source.latestOffset())] == [2, 2, 2, 2]
    read, own = [], arrivals.items
    monkeypatch.setattr(arrivals, "items", lambda held: read.append(held.inputFiles()) or own(held))
    cells = [("材料名称", "规格型号", "单位", "数量"), ("钢管", "DN100", "m", "2")]
    batch = spark.createDataFrame([("a.xlsx", 1, "安装", k, list(c), 1, None) for k, c in enumerate(cells, 1)], arrivals.CELLS)
    store = Store(spark, str(tmp_path / "store"), SCHEMA, ("file", "item_id"), ("version",))
    assert arrivals.merge(store, batch, 0) and not arrivals.merge(store, batch, 0)
    assert read[0] and [(r.item_id, r.name) for r in store.read().collect()] == [("安装|2", "钢管")]
