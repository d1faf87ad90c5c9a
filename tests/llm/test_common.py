from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from bidloom.llm import common

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_folders_can_be_cleared(spark):
    held = common.cut(spark.range(3).toDF("x"), "one")
    at = spark._bidloom_scratch[-1].removeprefix("file://")
    assert held.count() == 3 and os.path.isdir(at)
    assert common.clear(spark) >= 1 and not os.path.exists(at) and common.clear(spark) == 0


def test_a_batch_size_of_the_user_stays(spark):
    own = spark.newSession()
    own.conf.set(KEY, "77")
    common.small_batches(own)
    assert own.conf.get(KEY) == "77"
    own.conf.unset(KEY)
    common.small_batches(own)
    assert own.conf.get(KEY) == str(common.ARROW_ROWS)


def test_a_shared_folder_is_asked_for_off_one_machine():
    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")


def test_hot_and_other_keys_are_joined_alike(spark):
    rows = spark.range(5000).selectExpr("if(id < 2000, 7L, id) as k", "id as v")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k % 2 = 1")
    got = sorted(common.join_counted(rows, table, "k", "n").collect())
    want = sorted(rows.join(table, "k").collect())
    assert got == want and len(got) == 3500
    assert common.join_counted(rows, table, "k", "n", "left").count() == 5000
    assert common.unused(["row", "ROW_"], "Row") == "Row__"
