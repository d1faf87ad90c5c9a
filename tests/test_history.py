from __future__ import annotations

from bidloom.operators import history as H


def test_upsert_delete_hydrate(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, src string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", None)], "id int, name string, src string")
    merged = H.upsert(base, new, "id")
    assert sorted(map(tuple, merged.collect())) == [(1, "a", None), (2, "c", "y"), (3, "d", None)]
    assert sorted(r.id for r in H.delete(merged, spark.createDataFrame([(3,), (9,)], "id int"), "id").collect()) == [1, 2]
    ev = spark.createDataFrame([(1, "e"), (2, "f")], "id int, src string")
    assert sorted((r.id, r.src) for r in H.hydrated(merged, ev, "id", "src").where("id < 3").collect()) == [(1, "e"), (2, "y")]


def test_clusters(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z", "y"), ("y", "z"), ("q", "q"), (None, "x")]
    got = {r.name: r.cluster for r in H.clusters(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(61)} | {"y": "y", "z": "y", "q": "q"}
    assert H.clusters(spark.createDataFrame([], "a string, b string")).count() == 0


def test_hits_are_an_ordered_fold(spark):
    hits = [("https://a.com/p1", "One"), ("https://a.com/p1#x", "Other"), ("http://b.com/1", "one"), ("http://b.com/1", "Two"), ("https://zhidao.baidu.com/q", "Q"), ("https://c.gov.cn/", "Three")]
    df = spark.createDataFrame([(hits,), ([],)], "h array<struct<url:string,title:string>>")
    got = [[tuple(x) for x in r.x] for r in df.select(H.kept_hits(df.h).alias("x")).collect()]
    assert got == [[("https://c.gov.cn/", "Three"), ("https://a.com/p1", "One"), ("http://b.com/1", "Two")], []]
