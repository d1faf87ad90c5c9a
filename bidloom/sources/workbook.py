"""Workbooks out of rows: the result sheet, the sheet of open inquiries, and the writer behind both.

``books`` turns cell rows ``(file, sheet_no, sheet, ord, cells)`` into one row ``(file, content)`` a workbook, and ``save`` writes those from
the tasks that made them, by the commit of ``sink``. A workbook is one file and hence the work of one task; ``sink.save_rows`` writes cell rows without
holding a workbook in memory, and deals long sheets to several files. A
sheet of more rows than the format holds goes on in a further sheet. Cells are texts; those that are plain numbers are written as numbers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1_048_576
RESULT_SHEET, OPEN_SHEET = "询价比价结果", "待询价"
# Headers of the result sheet (items, each quote, the first candidate to review, notes) and of the sheet of open inquiries.
ITEM_HEADERS = ("专业/Sheet", "行号", "材料名称", "规格型号", "品牌", "单位", "数量", "报送单价", "目标地区", "名称规格匹配状态", "市场报价条数", "参考审定不含税")
QUOTE_HEADERS = (
    "市场价格", "不含税", "税口径", "平台", "标题", "厂家", "联系人", "电话", "计价单位", "起订量", "价格证据", "名称规格匹配", "与报送关系", "相对报送偏差%",
    "异常提示", "详情链接", "价格适用地区", "地区匹配",
)
REVIEW_HEADERS = (
    "待核候选价", "候选平台", "来源品名", "来源规格", "来源单位", "来源厂家", "来源联系人", "来源电话", "来源价格原文", "来源报价行位置", "未满足规格", "证据类型",
    "外部证据链接",
)
OPEN_HEADERS = ("专业", "行号", "材料名称", "规格型号", "品牌", "单位", "数量", "报送单价", "状态", "已有价条数", "备注")
# Which field of a quote stands under which header.
QUOTE_FIELDS = {
    "市场价格": "price", "不含税": "ex", "税口径": "tax_mode", "平台": "platform", "标题": "title", "厂家": "supplier", "联系人": "contact", "电话": "phone",
    "计价单位": "unit", "起订量": "least", "价格证据": "shown", "名称规格匹配": "match", "与报送关系": "vs", "异常提示": "hint", "详情链接": "url",
    "价格适用地区": "region", "地区匹配": "region_match",
}
REVIEW_FIELDS = {
    "待核候选价": "price", "候选平台": "platform", "来源品名": "title", "来源规格": "spec_seen", "来源单位": "unit", "来源厂家": "supplier", "来源联系人": "contact",
    "来源电话": "phone", "来源价格原文": "shown", "来源报价行位置": "place", "未满足规格": "missing", "证据类型": "evidence", "外部证据链接": "url",
}
_NUMBER = re.compile(r"-?(?:0|[1-9]\d{0,14})(?:\.\d{1,10})?\Z")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def column_name(n: int) -> str:
    """A, B, ..., Z, AA, ... for 1, 2, ..."""
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _cell(ref: str, text: str) -> str:
    if _NUMBER.match(text):
        return f'<c r="{ref}"><v>{text}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", text))}</t></is></c>'


def pack(out: BinaryIO, sheets: Iterable[tuple[str, Iterator[list[str | None]]]], most_rows: int = MOST_ROWS) -> None:
    """Writes a workbook of these sheets; rows are taken and written one by one."""
    names: list[str] = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in sheets:
            rows, more, part = iter(rows), True, 0
            while more:
                part += 1
                own = re.sub(r"[\[\]:*?/\\]", " ", name)[: 31 if part == 1 else 27] + (f"_{part}" if part > 1 else "")
                names.append(own)
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                    f.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    for n in range(1, most_rows + 1):
                        if (cells := next(rows, None)) is None:
                            more = False
                            break
                        body = "".join(_cell(f"{column_name(i)}{n}", c) for i, c in enumerate(cells, 1) if c not in (None, ""))
                        f.write(f'<row r="{n}">{body}</row>'.encode())
                    f.write(b"</sheetData></worksheet>")
        each = range(1, len(names) + 1)
        tabs = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in zip(each, names, strict=True))
        z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{tabs}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each)
        z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in each)
        kinds += f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
        defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        z.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types">{defaults}{kinds}</Types>')


def packed(sheets: Iterable[tuple[str, Iterator[list[str | None]]]], most_rows: int = MOST_ROWS) -> bytes:
    """The bytes of a workbook of these sheets."""
    out = io.BytesIO()
    pack(out, sheets, most_rows)
    return out.getvalue()


def books(rows: DataFrame) -> DataFrame:
    """``(file, content)`` of rows ``(file, sheet_no, sheet, ord, cells)``: sheets by number, rows by ``ord``; null cells are empty."""

    def make(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sheet_no", "ord"], kind="stable")
        sheets = [(str(g["sheet"].iloc[0]), (list(c) for c in g["cells"])) for _, g in pdf.groupby("sheet_no", sort=True)]
        return pd.DataFrame({"file": [key[0]], "content": [packed(sheets)]})

    return rows.select("file", "sheet_no", "sheet", "ord", "cells").groupBy("file").applyInPandas(make, "file string, content binary")


def save(made: DataFrame, folder: str) -> int:
    """Writes each workbook of ``books`` under ``folder`` in place of one of its name, by the sink's commit; the number of files."""
    from bidloom.sources import sink

    return sink.write(made, folder)["files"]


def _text(c: Column | str) -> Column:
    """A cell's text: numbers without an exponent and trailing zeros, nulls empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def _amount(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.format_number(c, 4), F.lit("")), ",|\\.?0+$", "") if c is not None else F.lit("")


def status_label(status: Column, n_quotes: Column, n_reviews: Column, k: int) -> Column:
    """What the result sheet says of an item."""
    n, r = n_quotes.cast("string"), n_reviews.cast("string")
    return (
        F.when(status == "full_k", f"已凑满{k}价").when(status == "partial", F.concat(F.lit("部分命中("), n, F.lit(f"/{k})")))
        .when(status == "need_review", F.concat(F.lit("候选待核("), r, F.lit("条)·请人工采用"))).when(status == "no_match", "没查到").otherwise(status)
    )


def _fields(table: DataFrame, fields: dict[str, str]) -> list[Column]:
    """The cells of a quote, for what its table has; amounts as plain numbers."""
    has = set(table.columns)
    return [(_amount(F.col(f)) if f in ("price", "ex") else _text(f)) if (f := fields.get(h)) in has else F.lit("") for h in fields]


def result_rows(items: DataFrame, best: DataFrame, reviews: DataFrame, k: int, file: str = "result.xlsx") -> DataFrame:
    """Cell rows of the result workbook: one row an item on the first sheet, one a candidate to review on the second.

    items: ``(item_id, sheet, row, name, spec, brand, unit, qty, submit, region, status, audit, note)``, of which all but ``item_id``, ``name`` and
    ``status`` may be missing; best and reviews: quotes with ``item_id`` and ``rank``.
    """
    quote = F.array(*[F.lit("") if h not in QUOTE_FIELDS else c for h, c in zip(QUOTE_HEADERS, _aligned(best, QUOTE_HEADERS, QUOTE_FIELDS), strict=True)])
    per = best.where(F.col("rank") <= k).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", quote))).alias("quotes"), F.count("*").alias("n_quotes"))
    review = F.array(*_aligned(reviews, REVIEW_HEADERS, REVIEW_FIELDS))
    rev = reviews.groupBy("item_id").agg(F.min_by(review, "rank").alias("review"), F.count("*").alias("n_reviews"))
    for name in ("sheet", "row", "spec", "brand", "unit", "qty", "submit", "region", "audit", "note"):
        items = items if name in items.columns else items.withColumn(name, F.lit(None).cast("double" if name in ("qty", "submit", "audit") else "string"))
    own = items.select("item_id", "sheet", "row", "name", "spec", "brand", "unit", "qty", "submit", "region", "status", "audit", "note")
    j = own.join(per, "item_id", "left").join(rev, "item_id", "left")
    n, r = F.coalesce("n_quotes", F.lit(0)), F.coalesce("n_reviews", F.lit(0))
    note = F.when(_text("note") != "", _text("note")).when((n == 0) & (r > 0), "有候选价待人工确认（非严格合格价）").when(n == 0, "无合格价且无候选").otherwise("")
    own = F.array(
        _text("sheet"), _text("row"), _text("name"), _text("spec"), _text("brand"), _text("unit"), _amount(F.col("qty")), _amount(F.col("submit")), _text("region"),
        status_label(F.col("status"), n, r, k), n.cast("string"), _amount(F.col("audit")),
    )
    blank = lambda m: F.array_repeat(F.lit(""), m)
    quotes = [F.coalesce(F.try_element_at("quotes", F.lit(i)), blank(len(QUOTE_HEADERS))) for i in range(1, k + 1)]
    cells = F.concat(own, *quotes, F.coalesce("review", blank(len(REVIEW_HEADERS))), F.array(note))
    order = F.struct(F.lit(1).alias("part"), _text("sheet").alias("a"), F.coalesce(F.col("row").try_cast("long"), F.lit(0)).alias("b"), _text("item_id").alias("c"))
    heads = [*ITEM_HEADERS, *[f"价{i}{h}" for i in range(1, k + 1) for h in QUOTE_HEADERS], *REVIEW_HEADERS, "解析备注"]
    body = j.select(order.alias("o"), cells.alias("cells"))
    extra = F.struct(F.lit(1).alias("part"), F.lit("").alias("a"), F.col("rank").cast("long").alias("b"), _text("item_id").alias("c"))
    listed = reviews.select(extra.alias("o"), F.concat(F.array(_text("item_id"), _text("rank")), review).alias("cells"))
    return _sheet(body, file, 1, RESULT_SHEET, heads).unionByName(_sheet(listed, file, 2, "待审核候选明细", ["item_id", "rank", *REVIEW_HEADERS]))


def _aligned(table: DataFrame, headers: tuple[str, ...], fields: dict[str, str]) -> list[Column]:
    cells = dict(zip(fields, _fields(table, fields), strict=True))
    return [cells.get(h, F.lit("")) for h in headers]


def _sheet(body: DataFrame, file: str, no: int, name: str, heads: list[str]) -> DataFrame:
    """Rows ``(o, cells)`` under a header row as cell rows of one sheet; ``ord`` is the order as text that sorts like it."""
    order = F.concat_ws("\x1f", F.col("o.part").cast("string"), F.col("o.a"), F.lpad(F.col("o.b").cast("string"), 20, "0"), F.col("o.c"))
    spark = body.sparkSession
    head = spark.range(1).select(F.lit("0").alias("ord"), F.array(*map(F.lit, heads)).alias("cells"))
    both = head.unionByName(body.select(order.alias("ord"), "cells"))
    return both.select(F.lit(file).alias("file"), F.lit(no).alias("sheet_no"), F.lit(name).alias("sheet"), "ord", "cells")


def split(rows: DataFrame, file: Column) -> DataFrame:
    """Cell rows of one workbook dealt to several by ``file``, a name from the columns of the rows; each sheet of each has the header again."""
    body = rows.where("ord <> '0'").withColumn("file", file)
    heads = rows.where("ord = '0'").drop("file")  # one row a sheet
    heads = body.select("file", "sheet_no").distinct().join(F.broadcast(heads), "sheet_no")
    return body.unionByName(heads)


def open_rows(items: DataFrame, k: int, file: str = "rfq.xlsx") -> DataFrame:
    """Cell rows of the items that still need quotes: those that are not ``full_k`` with k quotes."""
    for name in ("sheet", "row", "spec", "brand", "unit", "qty", "submit", "note"):
        items = items if name in items.columns else items.withColumn(name, F.lit(None).cast("double" if name in ("qty", "submit") else "string"))
    left = items.where(~((F.col("status") == "full_k") & (F.coalesce("n_quotes", F.lit(0)) >= k)))
    cells = F.array(
        _text("sheet"), _text("row"), _text("name"), _text("spec"), _text("brand"), _text("unit"), _amount(F.col("qty")), _amount(F.col("submit")), _text("status"),
        F.coalesce(F.col("n_quotes"), F.lit(0)).cast("string"), _text("note"),
    )
    order = F.struct(F.lit(1).alias("part"), _text("sheet").alias("a"), F.coalesce(F.col("row").try_cast("long"), F.lit(0)).alias("b"), _text("item_id").alias("c"))
    return _sheet(left.select(order.alias("o"), cells.alias("cells")), file, 1, OPEN_SHEET, list(OPEN_HEADERS))
