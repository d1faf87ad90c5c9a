from __future__ import annotations

import zipfile

from bidloom.sources import schema as S
from bidloom.sources import workbook as W
from bidloom.sources import xlsx

ROWS = "file string, sheet string, row int, cells array<string>, sheet_no int"


def sheets(spark):
    head = ["序号", "材料\n名称", "规格型号", "单位", "单价", "单价(元)", None]
    rows = [("a.xlsx", " 安装 ", 1, ["某项目表"], 1), ("a.xlsx", " 安装 ", 3, head, 1), ("a.xlsx", " 安装 ", 4, ["1", "钢管", "DN50", "m", "8"], 1), ("a.xlsx", "空", 1, ["", None], 2)]
    rows += [("b.xlsx", " 安装 ", 1, ["某项目表"], 1), ("b.xlsx", " 安装 ", 3, head, 1), ("b.xlsx", " 安装 ", 90, ["2", "阀", "", "个", "9"], 1), ("b.xlsx", "核价汇总", 1, ["x"], 2)]
    return spark.createDataFrame(rows + [("c.xlsx", "s", 2, ["甲", "乙"], 1)], ROWS)


def test_roles_and_confidence(spark):
    got = {r.file: r for r in S.sheet_schemas(sheets(spark)).collect()}
    assert set(got) == {"a.xlsx", "b.xlsx"}
    a = got["a.xlsx"]
    assert (a.sheet, a.header_row, a.data_start_row) == ("安装", 3, 4)
    assert [(c.col, c.role) for c in a.columns] == [(1, "unknown"), (2, "name"), (3, "spec"), (4, "unit"), (5, "submit_price"), (6, "ignore")]
    cells = S.scored(S.header_cells(sheets(spark))).where("row = 3 and file = 'a.xlsx'").collect()
    score = {c.text: (c.role, round(c.score, 4)) for c in cells}
    assert score["材料名称"] == ("name", 1.0) and score["单价(元)"] == ("submit_price", 0.575) and score["序号"] == (None, 0.0)
    assert abs(a.confidence - min(1.0, (5 * 1.0 - 1 + 0.575 + 1.5 + 0.8 + 0.8) / 6)) < 1e-6
    assert S.sheet_schemas(sheets(spark).limit(0)).count() == 0


def test_fingerprints_survive_data_and_caches_are_used(spark, tmp_path):
    prints = {r.file: r.fingerprint for r in S.fingerprints(sheets(spark).where("row <= 3")).collect()}
    assert prints["a.xlsx"] == prints["b.xlsx"] != prints["c.xlsx"] and all(len(x) == 24 for x in prints.values())
    own = sheets(spark).where("row <> 4 and file <> 'c.xlsx'")
    found = S.detect(own.where("file = 'a.xlsx'"))
    assert [r.source for r in found.collect()] == ["rule"]
    S.save_cache(found, str(tmp_path / "cache"))
    again = {r.file: r for r in S.detect(sheets(spark).where("row <> 4"), S.load_cache(spark, str(tmp_path / "cache"))).collect()}
    assert {f: r.source for f, r in again.items()} == {"a.xlsx": "cache", "b.xlsx": "cache", "c.xlsx": "none"}
    assert again["b.xlsx"].sheets == found.first().sheets
    S.save_preview(found, str(tmp_path / "preview"))
    assert spark.read.json(str(tmp_path / "preview")).count() == 1
    corner = S.preview(sheets(spark), chars=2).where("file = 'a.xlsx'").orderBy("row").collect()
    assert [r.cells[0] for r in corner] == ["某项", "序号", "1"]


def test_the_inquiry_among_files(spark):
    files = [("询价表.xlsx", 5), ("result 询价.xlsx", 9), ("~$询价表.xlsx", 10), (".x.xlsx", 10), ("x.txt", 10), ("plain.xlsm", 7)]
    df = spark.createDataFrame(files, "file string, modified int")
    scores = spark.createDataFrame([("result 询价.xlsx", 112), ("plain.xlsm", 112)], "file string, content_score int")
    assert S.chosen_inquiry(df, scores).first().file == "plain.xlsm"
    assert S.chosen_inquiry(df.where("file like '.%'"), scores).count() == 0
    rows = spark.createDataFrame([("f", "s", 2, ["报送单价", "规格型号", "数量 单位"], 1), ("f", "s", 13, ["报送单价"], 1), ("f", "t", 1, ["审定单价"], 9)], ROWS)
    assert S.inquiry_scores(rows).first().content_score == 112


def test_workbooks_can_be_written_and_read_again(spark, tmp_path):
    cells = [("r.xlsx", 2, "b/c", "1", ["<x> & \"y\"", None, "12.5", "007", "a\x01b"]), ("r.xlsx", 1, "一", "2", ["second"]), ("r.xlsx", 1, "一", "1", ["first"]), ("s.xlsx", 1, "q", "1", [])]
    df = spark.createDataFrame(cells, "file string, sheet_no int, sheet string, ord string, cells array<string>")
    assert W.save(W.books(df), str(tmp_path / "out")) == 2
    got = sorted((r.file, r.sheet_no, r.sheet, r.row, r.cells) for r in xlsx.read_binary(spark, str(tmp_path / "out")).collect())
    assert got == [("r.xlsx", 1, "一", 1, ["first"]), ("r.xlsx", 1, "一", 2, ["second"]), ("r.xlsx", 2, "b c", 1, ["<x> & \"y\"", "", "12.5", "007", "ab"])]
    with zipfile.ZipFile(tmp_path / "out" / "r.xlsx") as z:
        assert b"<v>12.5</v>" in z.read("xl/worksheets/sheet2.xml") and b"<v>007" not in z.read("xl/worksheets/sheet2.xml")
    raw = W.packed([("s", iter([["1"], ["2"], ["3"]]))], most_rows=2)
    assert [(s, n, c) for s, n, c, _ in xlsx.rows(raw)] == [("s", 1, ["1"]), ("s", 2, ["2"]), ("s_2", 1, ["3"])]


def test_result_and_open_sheets(spark, tmp_path):
    items = spark.createDataFrame([(1, "安装", 4, "钢管", "full_k", 2, 80.0, 79.5), (2, "安装", 5, "阀", "need_review", 0, None, None), (3, "安装", 12, "灯", "no_match", 0, 1e7, None)], "item_id int, sheet string, row int, name string, status string, n_quotes int, submit double, audit double")
    best = spark.createDataFrame([(1, 1, 90.0, 79.6460177, "jd"), (1, 2, 91.0, None, "yize")], "item_id int, rank int, price double, ex double, platform string")
    reviews = spark.createDataFrame([(2, 2, 7.0, "b"), (2, 1, 6.0, "a")], "item_id int, rank int, price double, platform string")
    rows = W.result_rows(items, best, reviews, 2)
    assert W.save(W.books(rows), str(tmp_path / "out")) == 1
    got = xlsx.read_binary(spark, str(tmp_path / "out")).orderBy("sheet_no", "row").collect()
    first = [r.cells for r in got if r.sheet_no == 1]
    assert [c[2] for c in first] == ["材料名称", "钢管", "阀", "灯"] and [c[9] for c in first[1:]] == ["已凑满2价", "候选待核(2条)·请人工采用", "没查到"]
    assert first[1][12:16] == ["90", "79.646", "", "jd"] and first[1][30] == "91" and first[2][48:50] == ["6", "a"] and first[3][7] == "10000000"
    assert [r.cells[:2] for r in got if r.sheet_no == 2] == [["item_id", "rank"], ["2", "1"], ["2", "2"]]
    todo = W.open_rows(items, 2).orderBy("ord").collect()
    assert [r.cells[2] for r in todo] == ["材料名称", "阀", "灯"]
