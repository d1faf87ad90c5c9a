from __future__ import annotations

import json

from pyspark.sql import functions as F

from bidloom.operators import runs as R

JOB = "id int, item_results array<struct<name:string,web_list:array<struct<price:double,url:string>>,supplier_list:array<struct<supplier:string,phone:string,contact:string,detail_url:string,url:string,title:string>>,message:string>>"


def test_stored_jobs_show_sound_sources_only(spark):
    lead = lambda supplier=None, phone=None, url=None, detail=None: (supplier, phone, None, detail, url, "t")
    rows = [
        (1, [("a", [(0.0, "u"), (None, "u"), (0.05, "u"), (0.06, "u"), None], [lead("S"), lead(" "), lead(None, "138"), lead("S", None, "https://zhidao.baidu.com/q"), lead("S", None, "https://zhidao.baidu.com/q", "https://ok.com/1"), None], "完成；供应商线索 9 条；好")]),
        (2, [("b", None, [lead()], "供应商线索3条"), ("c", [], None, None)]),
        (3, None),
    ]
    got = {r.id: r.item_results for r in R.sound_jobs(spark.createDataFrame(rows, JOB)).collect()}
    a = got[1][0]
    assert [q.price for q in a.web_list] == [0.06] and [(q.supplier, q.phone) for q in a.supplier_list] == [("S", None), (None, "138"), ("S", None)]
    assert a.message == "完成；供应商线索3条；好" and a.name == "a"
    assert (got[2][0].supplier_list, got[2][0].message, got[2][1].message) == ([], "", "") and got[3] == []


def test_counts_by_sheet(spark):
    rows = [("s", "full_k"), ("s", "partial"), ("s", "error"), ("s", "skipped"), (None, "no_match"), (" ", "need_review"), ("t", "unknown")]
    got = {r.sheet: tuple(r)[1:] for r in R.counts_by_sheet(spark.createDataFrame(rows, "sheet string, status string")).collect()}
    assert got == {"s": (4, 1, 1, 0, 2), "（未命名表）": (2, 0, 0, 1, 1), "t": (1, 0, 0, 0, 0)}


def test_sections_come_first_and_limits_depend_on_the_list(spark):
    schema = "item_id int, platform string, name string, spec string, title string, spec_seen string, score double, inline boolean, n_quotes int, sku string"
    rows = [(1, "jd", "消声器", "1250X400", f"t{i}", "1250×400" if i == 7 else "1250" if i == 5 else "", float(i % 5), i < 3, 0, f"k{i}") for i in range(10)]
    rows += [(2, "jd", "管", "DN100", "t", "", float(i), False, i % 2 * 0 + 1, f"k{i}") for i in range(4)]
    rows += [(3, "jd", "管", None, "t", None, None, None, None, f"k{i}") for i in range(4)] + [(4, "x", "管", "2x3 30*40", "t", "30 40", 1.0, False, 2, f"k{i}") for i in range(4)]
    got = {}
    for r in sorted(R.sections_first(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.item_id, r.place)):
        got.setdefault(r.item_id, []).append((r.sku, r.section_hits))
    assert got[1] == [("k7", 2), ("k5", 1), ("k4", 0), ("k9", 0), ("k3", 0), ("k8", 0), ("k2", 0), ("k1", 0)]
    assert got[2] == [("k3", 0)] and [k for k, _ in got[3]] == ["k0", "k1"] and got[4] == [("k0", 2), ("k1", 2)]


def test_target_region_by_priority(spark):
    region = "struct<province:string,city:string,district:string,province_code:string,city_code:string>"
    none, own = None, lambda **x: tuple(x.get(k) for k in ("province", "city", "district", "province_code", "city_code"))
    rows = [
        (1, own(city="甲市"), "广州", own(city="乙市"), own(city="丙市"), "national_reference"),
        (2, own(city=" "), "广州", own(city="乙市"), none, "ALLOW_PROVINCE "),
        (3, none, " ", own(province_code="440000", province="广东省"), own(city="丙市"), "nonsense"),
        (4, none, None, own(), own(district="丁区"), None),
        (5, none, None, none, none, "strict_city"),
    ]
    df = spark.createDataFrame(rows, f"i int, item {region}, raw string, task {region}, own {region}, s string")
    got = {r.i: tuple(r.r) for r in df.select("i", R.target_region(df.item, df.raw, df.task, df.own, df.s).alias("r")).collect()}
    assert got == {
        1: ("", "甲市", "", "excel_row", "national_reference"), 2: ("广东省", "广州市", "", "excel_row", "allow_province"), 3: ("广东省", "", "", "task", "strict_city"),
        4: ("", "", "丁区", "user_default", "strict_city"), 5: ("", "", "", "unspecified", "strict_city"),
    }


def test_words_that_must_be_shown(spark):
    rows = [
        ("热镀锌 钢管", "DN100 1.6MPa 国产优质", ["热镀锌钢管"], ["DN100", "1.6MPa", "国产优质"]), ("LED线型灯", "DC24V 18W", ["线型灯", "线形灯"], ["24V", "18W"]), ("XZP100型片式消声器", "XZP100", None, ["XZP100"]),
        ("阀", "特制", None, ["特制"]), ("", "", [], []), (None, None, [], []), ("摄像机", "DS-2CD3T45 DS-2CD3T45", ["摄像机"], ["DS-2CD3T45"]),
    ]
    df = spark.createDataFrame([(i, n, s) for i, (n, s, *_) in enumerate(rows)], "i int, name string, spec string")
    got = {r.i: r for r in df.select("i", R.name_words(df.name).alias("w"), R.required_tokens(df.spec, df.name).alias("t"), R.name_must(df.name, df.spec).alias("m")).collect()}
    for i, (_, _, words, tokens) in enumerate(rows):
        assert words is None or got[i].w == words, (i, got[i])
        assert got[i].t[: len(tokens)] == tokens, (i, got[i])
        assert got[i].m == (got[i].w + got[i].t[:4])[:8] or (not got[i].w and not got[i].t)


def test_run_meta_and_cleared_history(spark, tmp_path):
    funnel = spark.createDataFrame([(5, 3)], "items_total int, searched int")
    stats = spark.createDataFrame([("jd", 2), ("yize", 4)], "platform string, queries int")
    meta = json.loads(R.run_meta(spark, "r1", "in.xlsx", ["jd"], 5, "strict", F.lit("2024-05-06 07:08:09").cast("timestamp"), funnel, stats, {"note": "x"}).first().meta)
    assert meta == {"run_id": "r1", "input_path": "in.xlsx", "platforms": ["jd"], "k": 5, "mode": "strict", "created_at": "2024-05-06T07:08:09", "funnel": {"items_total": 5, "searched": 3}, "platform_stats": {"jd": {"queries": 2}, "yize": {"queries": 4}}, "note": "x"}
    bare = json.loads(R.run_meta(spark, "r", None, [], None, None, funnel=funnel.where("false").groupBy().agg(F.count("*").alias("n")), stats=stats.where("false")).first().meta)
    assert bare["k"] == 3 and bare["mode"] == "practical" and bare["platforms"] == [] and "platform_stats" not in bare
    history = spark.createDataFrame([(1, "a.xlsx", None), (2, "a.xlsx", "b.json"), (3, "", None)], "id int, result_path string, evidence_path string")
    left, files = R.cleared(history)
    assert left.count() == 0 and left.columns == history.columns and sorted(r.path for r in files.collect()) == ["a.xlsx", "b.json"]
    R.save_items(history, str(tmp_path / "items"))
    assert sorted(map(tuple, spark.read.schema(history.schema).json(str(tmp_path / "items")).collect()), key=str) == sorted(map(tuple, history.collect()), key=str)
