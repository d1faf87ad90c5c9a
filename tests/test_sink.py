from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from bidloom.sources import sink, xlsx
from bidloom.sources import workbook as W

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CELLS = "file string, sheet_no int, sheet string, ord string, cells array<string>"


def names(folder):
    return sorted(x for x in os.listdir(folder) if not x.startswith("."))


def frame(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def grid(spark, at):
    return sorted((r.file, r.sheet_no, r.row, r.cells) for r in xlsx.read_binary(spark, at).collect())


def test_rows_become_workbooks_page_by_page(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = [("a.xlsx", 1, "s", "0", ["head"])] + [("a.xlsx", 1, "s", f"{i:05}", [f"x{i}"]) for i in range(1, 24)]
    rows += [("a.xlsx", 2, "t", "0", ["second"]), ("a.xlsx", 2, "t", "1", ["y"]), ("b.xlsx", 1, "s", "0", ["head"])]
    assert sink.save_rows(frame(spark, rows).repartition(5), at, most=10) == {"files": 4, "rows": 24 + 2 + 2 + 1}
    assert names(at) == ["_SUCCESS", "a-0001.xlsx", "a-0002.xlsx", "a-0003.xlsx", "b.xlsx"]
    want = [(f"a-000{p + 1}.xlsx", 1, 1, ["head"]) for p in range(3)] + [(f"a-000{(i - 1) // 10 + 1}.xlsx", 1, (i - 1) % 10 + 2, [f"x{i}"]) for i in range(1, 24)]
    want += [("a-0001.xlsx", 2, 1, ["second"]), ("a-0001.xlsx", 2, 2, ["y"]), ("b.xlsx", 1, 1, ["head"])]
    assert grid(spark, at) == sorted(want)
    assert sink.save_rows(frame(spark, []), str(tmp_path / "none")) == {"files": 0, "rows": 0}


def test_modes(spark, tmp_path):
    at = str(tmp_path)
    sink.write(frame(spark, [("a.xlsx", 1, "s", "1", ["1"]), ("b.xlsx", 1, "s", "1", ["2"])]).coalesce(1), at)
    with pytest.raises(Exception, match="already there"):
        sink.write(frame(spark, [("a.xlsx", 1, "s", "1", ["3"])]), at, existing="error")
    assert names(at) == ["_SUCCESS", "a.xlsx", "b.xlsx"] and grid(spark, at)[0][3] == ["1"]
    sink.write(frame(spark, [("a.xlsx", 1, "s", "1", ["3"])]), at)
    assert grid(spark, at) == [("a.xlsx", 1, 1, ["3"]), ("b.xlsx", 1, 1, ["2"])]
    sink.write(frame(spark, [("c.xlsx", 1, "s", "1", ["4"])]), at, overwrite=True)
    assert names(at) == ["_SUCCESS", "c.xlsx"]


@pytest.mark.parametrize(
    "rows,parts,why",
    [
        ([("a.xlsx", 1, "s", "1", ["1"]), ("b.xlsx", 1, "s", "1", []), ("a.xlsx", 1, "s", "2", ["2"])], 1, "do not lie together"),
        ([("a.xlsx", 1, "s", "2", ["1"]), ("a.xlsx", 1, "s", "1", ["2"])], 1, "not in order"),
        ([("../a.xlsx", 1, "s", "2", ["1"])], 1, "not a name"),
        ([("a.xlsx", 1, "s", "1", ["1"]), ("a.xlsx", 1, "s", "2", ["2"])], 2, "several tasks"),
    ],
)
def test_wrong_rows_leave_nothing(spark, tmp_path, rows, parts, why):
    at = str(tmp_path / "out")
    df = frame(spark, rows).coalesce(1) if parts == 1 else frame(spark, rows).repartitionByRange(2, "ord")
    with pytest.raises(Exception, match=why):
        sink.write(df, at)
    assert not os.path.isdir(at) or names(at) == []


def test_a_lost_driver_is_recovered(spark, tmp_path):
    at = str(tmp_path)
    writer = sink.BookWriter(at, frame(spark, []).schema, overwrite=False)
    staging = tmp_path / f"{sink.STAGING}{writer.job}" / "0-7"
    staging.mkdir(parents=True)
    (staging / "a.xlsx").write_bytes(W.packed([("s", iter([["1"]]))]))
    (tmp_path / "b.xlsx").write_bytes(W.packed([("s", iter([["2"]]))]))  # renamed before the driver was lost
    (tmp_path / f"{sink.STAGING}other").mkdir()  # of a job that never committed
    plan = {"job": writer.job, "moves": [["0-7/a.xlsx", "a.xlsx"], ["0-7/b.xlsx", "b.xlsx"]], "stale": [], "done": {"files": 2, "rows": 2}}
    (tmp_path / f"{sink.RECORD}{writer.job}.json").write_text(json.dumps(plan))
    assert sink.recover(at) == 1 and names(at) == ["_SUCCESS", "a.xlsx", "b.xlsx"]
    assert sink.recover(at) == 0 and grid(spark, at) == [("a.xlsx", 1, 1, ["1"]), ("b.xlsx", 1, 1, ["2"])]


FAILING = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from bidloom.sources import sink, xlsx
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
at, marks = sys.argv[1], sys.argv[2]
def flaky(batches):
    once = True
    for b in batches:
        yield b
        if once and not os.path.exists(f"{marks}/{TaskContext.get().partitionId()}"):
            open(f"{marks}/{TaskContext.get().partitionId()}", "w").close()
            raise RuntimeError("the task is lost after its first rows")
        once = False
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "false")
rows = spark.range(400).selectExpr("concat('b', id % 5, '.xlsx') as file", "1 as sheet_no", "'s' as sheet", "lpad(id, 5, '0') as ord", "array(cast(id as string)) as cells")
lost = sink.clustered(rows).mapInArrow(flaky, rows.schema)
print("DONE", sink.write(lost, at))
print("ROWS", sorted((r.file, r.row, r.cells[0]) for r in xlsx.read_binary(spark, at).collect()) == sorted((f"b{i % 5}.xlsx", i // 5 + 1, str(i)) for i in range(400)))
print("LEFT", sorted(x for x in os.listdir(at) if not x.startswith(".")), len(os.listdir(marks)))
"""


def test_failed_tasks_are_repeated_without_a_trace(tmp_path):
    (tmp_path / "marks").mkdir()
    done = subprocess.run([sys.executable, "-c", FAILING, str(tmp_path / "out"), str(tmp_path / "marks")], capture_output=True, text=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT})
    said = done.stdout
    assert "DONE {'files': 5, 'rows': 400}" in said and "ROWS True" in said, done.stderr[-2000:]
    assert "LEFT ['_SUCCESS', 'b0.xlsx', 'b1.xlsx', 'b2.xlsx', 'b3.xlsx', 'b4.xlsx']" in said and not said.rstrip().endswith(" 0")
