from __future__ import annotations

import zipfile

import pytest

from bidloom.operators import quotes as Q
from bidloom.operators import views as V
from bidloom.sources import evidence, pages, schema, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
GRID = [
    (1, ["某项目安装材料表"]),
    (3, ["序号", "材料设备名称", "规格及型号", "计量单位", "工程量", "承包人报价(不含税)", "产地品牌"]),
    (4, ["1", "热镀锌钢管", "DN100", "m", "120", "85.5", "国产"]),
    (5, ["2", "海康威视 DS-KH6320-C1 室内机", "", "台", "2", "1,200", ""]),
    (7, ["", "", "合计"]),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    shared = sorted({c for _, cs in GRID for c in cs if c})
    cell = lambda r, i, c: f'<c r="{chr(65 + i)}{r}" t="s"><v>{shared.index(c)}</v></c>' if c else ""
    body = "".join(f'<row r="{r}">' + "".join(cell(r, i, c) for i, c in enumerate(cs)) + "</row>" for r, cs in GRID)
    for n in ("a.xlsx", "b.xlsx"):
        with zipfile.ZipFile(at / n, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="安装" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
    return str(at)


def test_workbooks_become_items(spark, folder):
    xlsx.register(spark)
    read = spark.read.format("bidloom_xlsx").load(folder)
    assert read.rdd.getNumPartitions() == 2 and read.count() == 10
    assert sorted(read.collect()) == sorted(xlsx.read_binary(spark, folder).collect())
    head = schema.sheet_schemas(read).collect()
    roles = ((1, "unknown"), (2, "name"), (3, "spec"), (4, "unit"), (5, "qty"), (6, "submit_price"), (7, "brand"))
    assert {(h.header_row, tuple((c.col, c.role) for c in h.columns)) for h in head} == {(3, roles)}
    got = {r.item_id: r for r in xlsx.items(read).where("file = 'a.xlsx'").collect()}
    assert set(got) == {"安装|4", "安装|5"}
    a, b = got["安装|4"], got["安装|5"]
    assert (a.name, a.spec, a.unit, a.qty, a.submit, a.brand) == ("热镀锌钢管", "DN100", "m", 120.0, 85.5, "国产")
    assert (b.name, b.spec, b.qty, b.submit) == ("海康威视 室内机", "DS-KH6320-C1", 2.0, 1200.0)


def test_evidence_round_trip(spark, tiny, tmp_path):
    r = Q.with_relation(V.offers(spark, tiny), V.items(spark, tiny))
    best = Q.top_k(r)
    status = Q.statuses(V.items(spark, tiny), best, Q.reviews(r)).select("item_id", "status")
    evidence.write(evidence.documents(status, best), str(tmp_path / "e"))
    back = evidence.read(spark, str(tmp_path / "e"))
    assert sorted(back.select("item_id", "status").collect()) == sorted(status.collect())
    flat = back.selectExpr("item_id", "inline(quotes)").select("item_id", "rank", "sku", "price")
    assert sorted(flat.collect()) == sorted(best.select("item_id", "rank", "sku", "price").collect())


def test_pages(spark):
    html = '<html><head><title>A &amp; B</title><script>var x="</p>";</script></head><body><!-- c --><a class="x" href="/p?q=1">t&nbsp;u</a> <p>￥1,143.17 电话 13800150123 联系人：张三</p></body></html>'
    df = spark.createDataFrame([(1, "https://www.A.example.com:81/x?page=2", html), (2, None, None)], "page_id int, url string, html string")
    r = df.select("page_id", pages.title(df.html).alias("t"), pages.text(df.html).alias("x"), pages.domain(df.url).alias("d"), pages.quality(df.url).alias("q"), pages.visible_price(df.html).alias("p"), pages.contacts(df.html).alias("c")).collect()
    assert r[0].t == "A &amp; B" and "t u" in r[0].x and "var" not in r[0].x and r[0].d == "a.example.com:81" and r[0].q == "medium"  # the port is no part of the ending
    assert r[0].p == 1143.17 and r[0].c.phone == "13800150123" and r[0].c.contact == "张三"
    assert pages.links(df).collect()[0].href == "/p?q=1"


def test_links_in_all_quotings_and_schemes_in_any_case(spark):
    html = """<a href="/1">x</a><a class=c HREF='/2?a="b"'>y</a><a href=/3>z</a><a data-href="/no">n</a><abbr href="/no"></abbr>"""
    df = spark.createDataFrame([(1, "HTTPS://WWW.Example.COM/Login", html), (2, "Http://shop.example.com:8443/p", None)], "page_id int, url string, html string")
    assert [r.href for r in pages.links(df).orderBy("pos").collect()] == ["/1", '/2?a="b"', "/3"]
    assert [(r[0], r[1]) for r in df.orderBy("page_id").select(pages.domain(df.url), pages.quality(df.url)).collect()] == [("example.com", "block"), ("shop.example.com:8443", "medium")]


def test_labelled_contacts(spark):
    rows = [("供应商：甲建材商行 联系人：李四\n电话 010-88886666", "规格型号：DN50，好"), ("生产厂家：乙阀门有限公司，销售：王五；手机：138 0015 0123", ""), ("丙电气有限公司 经理 赵六", None), (None, None), ("店铺：小店\n供应商：丁", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, title string")
    got = {r.i: (tuple(r.h), tuple(r.d)) for r in df.select("i", pages.contacts(df.t).alias("h"), pages.detail_contacts(df.t, df.title).alias("d")).collect()}
    assert got[0][0] == ("010-88886666", "李四", "甲建材商行 联系人：李四") and got[0][1] == ("010-88886666", "李四", "甲建材商行 联系人：李四", "DN50，好")
    assert got[1][1][:3] == ("13800150123", "王五", "乙阀门有限公司") and got[2][0] == ("", "赵六", "丙电气有限公司")
    assert got[3] == (("", "", ""), ("", "", "", "")) and got[4][1][2] == "小店"
