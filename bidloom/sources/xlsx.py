"""Workbooks as a Spark data source: one row a sheet row, cells as texts.

``spark.read.format("bidloom_xlsx").load(path)`` gives ``(file, sheet, row, cells array<string>, sheet_no)``. Each
file of a folder is a partition of its own, so a folder of workbooks is read by as many tasks. The files must be
reachable by every executor under the given path; sources in other stores are read with
``read_binary`` from Spark's ``binaryFile`` rows, which reaches whatever Spark reaches.

The same name is a sink for workbooks (``sink``).

A cell is shared text, inline text, a formula's last value, a number's text, or empty. Rows without cells are not
given; ``row`` is the number that the sheet shows.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from bidloom.sources import schema

SCHEMA = "file string, sheet string, row int, cells array<string>, sheet_no int"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def rows(raw: bytes) -> Iterator[tuple[str, int, list[str], int]]:
    """(sheet, row, cells, number of the sheet) of one workbook; sheets are parsed as streams."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot():
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for no, s in enumerate(ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet"), 1):
            at = targets[s.get(_REL)].lstrip("/")
            with z.open(at if at.startswith("xl/") else f"xl/{at}") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag != f"{_MAIN}row":
                        continue
                    cells: list[str] = []
                    for c in e.iter(f"{_MAIN}c"):
                        k = column_number(c.get("r")) if c.get("r") else len(cells) + 1
                        cells += [""] * (k - len(cells))
                        v = c.find(f"{_MAIN}v")
                        if c.get("t") == "s" and v is not None:
                            cells[k - 1] = shared[int(v.text)]
                        elif c.get("t") == "inlineStr":
                            cells[k - 1] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                        else:
                            cells[k - 1] = "" if v is None else v.text or ""
                    if cells:
                        yield s.get("name"), int(e.get("r")), cells, no
                    e.clear()


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.path):
            return [InputPartition(self.path)]
        found = sorted(x for x in os.listdir(self.path) if x.lower().endswith((".xlsx", ".xlsm")) and not x.startswith("~"))
        return [InputPartition(os.path.join(self.path, x)) for x in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            raw = f.read()
        for sheet, n, cells, no in rows(raw):
            yield os.path.basename(partition.value), sheet, n, cells, no


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bidloom_xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        from bidloom.sources import sink

        return sink.BookWriter(self.options["path"], schema, overwrite, self.options.get("existing", "error"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from any store that Spark reads, one workbook at a time in a task."""
    types = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("sheet_no", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = [{"file": path.rpartition("/")[2], "sheet": s, "row": n, "cells": c, "sheet_no": no} for s, n, c, no in rows(raw.as_py())]
                yield pa.RecordBatch.from_pylist(own, schema=types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def items(sheet_rows: DataFrame) -> DataFrame:
    """Items of the rows below each sheet's header that have a name: ``item_id`` is ``sheet|row``.

    A schema is one row a sheet and meets the sheet's rows by the trimmed name, in a shuffle: the rows may lie in small files and be too many to send.
    """
    found = schema.sheet_schemas(sheet_rows)
    roles = F.map_from_entries(F.transform(F.filter("columns", lambda c: ~c["role"].isin("unknown", "ignore", "sum_price")), lambda c: F.struct(c["role"], c["col"])))
    held = sheet_rows.withColumn("sheet", F.trim("sheet"))
    j = held.join(found.select("file", "sheet", "header_row", roles.alias("cols")).hint("merge"), ["file", "sheet"]).where("row > header_row")
    cell = lambda role: F.trim(F.coalesce(F.try_element_at("cells", F.try_element_at("cols", F.lit(role))), F.lit("")))
    number = lambda c: F.regexp_extract(F.regexp_replace(c, "[,，¥￥]", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    out = j.select(
        "file", F.concat_ws("|", "sheet", F.col("row").cast("string")).alias("item_id"), "sheet", "row",
        cell("name").alias("name"), cell("spec").alias("spec"), cell("brand").alias("brand"), cell("unit").alias("unit"),
        number(cell("qty")).alias("qty"), number(cell("submit_price")).alias("submit"),
    )
    # A model glued to the name moves to an empty specification.
    glued = r"^(.*?)\s+([A-Za-z0-9]+-[A-Za-z0-9./-]+)\s*(.*)$"
    split = (F.col("spec") == "") & F.col("name").rlike(glued)
    spec = F.when(split, F.regexp_extract("name", glued, 2)).otherwise(F.col("spec"))
    name = F.when(split, F.trim(F.concat_ws(" ", F.regexp_extract("name", glued, 1), F.regexp_extract("name", glued, 3)))).otherwise(F.col("name"))
    return out.withColumns({"spec": spec, "name": name}).where("name <> ''")
