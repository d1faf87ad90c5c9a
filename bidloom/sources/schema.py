"""Which column of a workbook is what: header rows, roles, structure fingerprints and a cache of what was found.

Input are sheet rows as ``sources.xlsx`` gives them: ``(file, sheet, row, cells)``, and ``sheet_no`` where the order of sheets
counts. Everything is joins and aggregations over melted header cells, so a folder of workbooks is one job; a sheet's header is at most
``SCAN_ROWS`` by ``SCAN_COLS`` cells, whatever the sheet's size. A workbook that cannot be read gives no rows and hence no schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCAN_ROWS, SCAN_COLS = 15, 24
LEAST_SCORE, LEAST_CELL, FULL_SCORE = 1.2, 0.55, 6.0
PRINT_ROWS, PRINT_COLS, PRINT_SHEETS = 12, 22, 12
# Header words of each role, and how specific a role is.
HINTS = {
    "name": ("材料名称", "设备名称", "材料设备名称", "材料及设备名称", "名称", "品名", "项目名称", "材料设备", "物资名称", "商品名称", "清单名称", "工程材料"),
    "spec": ("规格、型号", "规格型号", "规格及型号", "规格", "型号", "技术参数", "规格参数", "特征描述", "项目特征", "材质规格"),
    "brand": ("产地、品牌及特殊要求", "产地品牌及特殊要求", "产地、品牌", "品牌产地", "品牌", "产地", "厂家", "生产厂家", "厂商", "特殊要求"),
    "unit": ("计量单位", "单位", "单位名称"),
    "qty": ("工程量", "数量", "清单工程量", "申报数量", "合同数量"),
    "submit_price": (
        "报送不含税单价", "报送单价", "投标单价", "承包人报价", "承包人申报单价", "报审单价", "申报单价", "报出单价", "不含税单价", "含税单价", "单价",
        "综合单价", "材料单价", "设备单价", "市场单价", "信息价",
    ),
    "audit_price": ("审定不含税单价", "审定单价", "核定单价", "审核单价", "批准单价", "认定单价"),
    "sum_price": ("合价", "报送合价", "审定合价", "金额", "总价"),
    "remark": ("备注", "说明", "附注", "注释"),
    "region": ("地区", "所在地区", "项目地区", "工程所在地", "工程地点", "建设地点", "省市", "城市", "区域", "适用地区", "项目城市", "地区名称"),
}
PRIORITY = {"submit_price": 50, "audit_price": 45, "name": 40, "spec": 38, "brand": 30, "qty": 28, "unit": 26, "region": 24, "sum_price": 20, "remark": 10}
# Sheets that hold results, and what a file name hints at.
RESULT_SHEETS = ("实抓汇总", "询价比价结果", "核价汇总", "说明", "README")
INQUIRY_NAMES = ("询价", "材料", "设备", "安装", "核价", "认价", "inquiry", "price", "audit")
OUTPUT_NAMES = ("result", "rfq", "证据", "核价完成", "审定核价", "output")
# Words of a row and what they say for an inquiry; the last needs both.
ROW_HINTS = ((100, ("报送不含税单价", "报送单价", "投标单价")), (20, ("审定不含税单价", "审定单价")), (8, ("材料名称", "设备名称", "规格、型号", "规格型号")))
COLUMN = "struct<col:int,role:string,header_text:string,confidence:double>"


def cell_text(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\n\r]", ""))


def header_cells(sheet_rows: DataFrame, rows: int = SCAN_ROWS, cols: int = SCAN_COLS) -> DataFrame:
    """``(file, sheet, row, col, text)`` of the cells in a sheet's first rows and columns; columns count from 1."""
    head = sheet_rows.where(F.col("row") <= rows).select("file", "sheet", "row", F.posexplode(F.slice("cells", 1, cols)).alias("pos", "cell"))
    return head.select("file", "sheet", "row", (F.col("pos") + 1).alias("col"), cell_text(F.col("cell")).alias("text"))


def vocabulary(spark: SparkSession) -> DataFrame:
    """The header words as a table of fixed size: ``(ord, role, hint, priority)``."""
    rows = [(role, hint, PRIORITY[role]) for role, hints in HINTS.items() for hint in hints]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, role string, hint string, priority int")


def scored(cells: DataFrame) -> DataFrame:
    """``cells`` with the ``role`` whose words are nearest to the text, and its ``score``; null and 0 where none is.

    A word that is the text counts 1, one in the other 0.85; a bare 单价 or 名称 inside a longer text counts less. Specific
    roles get up to 0.025 more; of equal ones the first word of the vocabulary counts.
    """
    texts = cells.select("text").distinct().where((F.col("text") != "") & (F.length("text") <= 40))
    met = texts.join(F.broadcast(vocabulary(cells.sparkSession)), F.contains("text", F.col("hint")) | F.contains("hint", F.col("text")))
    longer = F.col("hint") != F.col("text")
    own = F.when(~longer, 1.0).otherwise(0.85)
    own = F.when(longer & (F.col("hint") == "单价"), 0.55).when(longer & (F.col("hint") == "名称") & ~F.col("text").rlike("材料|设备|项目"), F.least(own, F.lit(0.7))).otherwise(own)
    best = met.groupBy("text").agg(F.max(F.struct((own + F.col("priority") / 2000).alias("score"), (-F.col("ord")).alias("ord"), "role")).alias("b"))
    best = best.select("text", F.col("b.role").alias("role"), F.least(F.lit(1.0), F.col("b.score")).alias("score"))
    return cells.join(best, "text", "left").select(*cells.columns, "role", F.coalesce("score", F.lit(0.0)).alias("score"))


def header_rows(cells: DataFrame) -> DataFrame:
    """``(file, sheet, header_row, row_score)``: of scored cells, the row of each sheet that looks most like a header; sheets without one are left out."""
    good = F.col("score") >= LEAST_CELL
    has = lambda *roles: F.bool_or(good & F.col("role").isin(*roles)).cast("double")
    rows = cells.groupBy("file", "sheet", "row").agg((F.sum(F.when(good, F.col("score")).otherwise(0.0)) + 1.5 * has("name") + 0.8 * has("spec") + 0.8 * has("submit_price", "unit")).alias("s"))
    # Sums in any order agree to nine digits.
    top = rows.groupBy("file", "sheet").agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("row")).alias("row"))).alias("t"))
    return top.select("file", "sheet", (-F.col("t.row")).alias("header_row"), F.col("t.s").alias("row_score")).where(F.col("row_score") >= LEAST_SCORE)


def sheet_schemas(sheet_rows: DataFrame) -> DataFrame:
    """``(file, sheet, header_row, data_start_row, columns, confidence)`` of each sheet that has a header.

    Roles go to columns by confidence, one column a role (sums may have more); the others of a role are ``ignore``, columns that
    name no role ``unknown``. Without a name, the first column of no role is one, else the second column.
    """
    cells = scored(header_cells(sheet_rows))
    head = header_rows(cells)
    own = cells.join(head, ["file", "sheet"]).where((F.col("row") == F.col("header_row")) & (F.col("text") != ""))
    rank = F.col("score") + F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("role")), F.lit(0)) / 1000
    own = own.withColumn("candidate", F.col("score") >= LEAST_CELL).withColumn("rank", rank)
    place = F.row_number().over(W.partitionBy("file", "sheet", "candidate", "role").orderBy(F.desc("rank"), F.desc("col")))
    own = own.withColumn("place", place)
    taken = (F.col("place") == 1) | (F.col("role") == "sum_price")
    role = F.when(~F.col("candidate"), "unknown").when(taken, F.col("role")).otherwise("ignore")
    sure = F.when(~F.col("candidate"), 0.3).when(taken, F.col("rank")).otherwise(F.col("rank") * 0.5)
    column = F.struct(F.col("col").cast("int").alias("col"), role.alias("role"), F.col("text").alias("header_text"), sure.alias("confidence"))
    out = own.groupBy("file", "sheet", "header_row", "row_score").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    free = F.filter("columns", lambda c: c["role"] == "unknown")
    second = F.filter("columns", lambda c: c["col"] == 2)
    named = lambda col, text, sure: F.array(F.struct(col.alias("col"), F.lit("name").alias("role"), text.alias("header_text"), F.lit(sure).alias("confidence")))
    guess = F.when(F.size(free) > 0, named(free[0]["col"], free[0]["header_text"], 0.4)).otherwise(named(F.lit(2), F.coalesce(F.get(second, F.lit(0))["header_text"], F.lit("")), 0.35))
    columns = F.when(F.exists("columns", lambda c: c["role"] == "name"), F.col("columns")).otherwise(F.concat("columns", guess))
    return out.select(
        "file", F.trim("sheet").alias("sheet"), "header_row", (F.col("header_row") + 1).alias("data_start_row"), columns.cast(f"array<{COLUMN}>").alias("columns"),
        F.least(F.lit(1.0), F.col("row_score") / FULL_SCORE).alias("confidence"),
    )


def fingerprints(sheet_rows: DataFrame) -> DataFrame:
    """``(file, fingerprint)``: what stays equal while only data change, 24 hex digits of the header rows of a file's first sheets."""
    head = sheet_rows.where((F.col("sheet_no") <= PRINT_SHEETS) & (F.col("row") <= PRINT_ROWS) & ~F.trim("sheet").isin(*RESULT_SHEETS))
    # Cells beyond the last one given are empty; so that equal sheets agree, trailing ones do not count.
    cells = F.transform(F.slice("cells", 1, PRINT_COLS), cell_text)
    line = F.regexp_replace(F.array_join(cells, "|"), r"\|+$", "")
    lines = head.select("file", "sheet_no", "sheet", "row", line.alias("line")).where("line <> ''")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", "row", "sheet", "line"))), lambda x: F.concat_ws("\x1f", x["sheet"], x["row"].cast("string"), x["line"])), "\n")
    return lines.groupBy("file").agg(F.substring(F.sha2(text.cast("binary"), 256), 1, 24).alias("fingerprint"))


def detect(sheet_rows: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """``(file, fingerprint, sheets, source)``: each workbook's sheets, from the ``cache`` where it knows the structure, else found anew.

    ``sheets`` is an array of ``(sheet, header_row, data_start_row, columns, confidence)`` by name.
    """
    prints = fingerprints(sheet_rows)
    sheet = F.struct("sheet", "header_row", "data_start_row", "columns", "confidence")
    if cache is None:
        found = sheet_schemas(sheet_rows)
        known = prints.withColumns({"cached": F.lit(None)})
    else:
        one = cache.groupBy("fingerprint").agg(F.first("sheets").alias("cached"))
        known = prints.join(one, "fingerprint", "left")
        found = sheet_schemas(sheet_rows.join(known.where("cached is null").select("file"), "file", "left_semi"))
    own = found.groupBy("file").agg(F.sort_array(F.collect_list(sheet)).alias("sheets"))
    out = known.join(own, "file", "left")
    sheets = F.coalesce("cached", "sheets") if cache is not None else F.col("sheets")
    return out.select("file", "fingerprint", sheets.alias("sheets"), F.when(F.col("cached").isNotNull(), "cache").when(F.col("sheets").isNotNull(), "rule").otherwise("none").alias("source"))


def save_cache(found: DataFrame, to: str) -> None:
    """Adds the structures found to a cache in JSON, one a fingerprint."""
    new = found.where("source = 'rule'").groupBy("fingerprint").agg(F.first("sheets").alias("sheets"))
    new.write.mode("append").json(to)


def load_cache(spark: SparkSession, at: str) -> DataFrame:
    sheet = f"struct<sheet:string,header_row:int,data_start_row:int,columns:array<{COLUMN}>,confidence:double>"
    return spark.read.schema(f"fingerprint string, sheets array<{sheet}>").json(at)


def save_preview(found: DataFrame, to: str) -> None:
    """What was found, as JSON for people to read."""
    found.write.mode("overwrite").option("ignoreNullFields", "false").json(to)


def preview(sheet_rows: DataFrame, rows: int = 18, cols: int = 18, chars: int = 40) -> DataFrame:
    """``(file, sheet, row, cells)``: the upper left corner of each sheet, cells cut short, empty rows left out."""
    cells = F.transform(F.slice("cells", 1, cols), lambda c: F.substring(cell_text(c), 1, chars))
    return sheet_rows.where(F.col("row") <= rows).select("file", "sheet", "row", cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))


def inquiry_scores(sheet_rows: DataFrame) -> DataFrame:
    """``(file, content_score)``: how much the first rows of a workbook's first eight sheets look like an inquiry."""
    text = F.array_join(F.transform(F.slice("cells", 1, PRINT_COLS), lambda c: F.coalesce(c, F.lit(""))), " ")
    own = sum((F.when(text.rlike("|".join(words)), points).otherwise(0) for points, words in ROW_HINTS), F.lit(0))
    own = own + F.when(F.contains(text, F.lit("数量")) & F.contains(text, F.lit("单位")), 4).otherwise(0)
    near = (F.col("row") <= PRINT_ROWS) & (F.col("sheet_no") <= 8)
    return sheet_rows.groupBy("file").agg(F.sum(F.when(near, own).otherwise(0)).alias("content_score"))


def chosen_inquiry(files: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: of ``files (file, modified)`` the workbook that looks most like an inquiry by content and name, the newest of equal ones.

    Lock files, hidden files and files of other kinds do not count.
    """
    low = F.lower("file")
    hits = lambda words, points: sum((F.when(F.contains(low, F.lit(w)), points).otherwise(0) for w in words), F.lit(0))
    fit = low.rlike(r"\.(xlsx|xlsm)$") & ~F.startswith("file", F.lit("~$")) & ~F.startswith("file", F.lit("."))
    own = files.where(fit).join(scores, "file", "left")
    points = F.coalesce("content_score", F.lit(0)) + hits(INQUIRY_NAMES, 3) - hits(OUTPUT_NAMES, 15)
    top = own.agg(F.max(F.struct(points.alias("points"), "modified", "file")).alias("t")).where("t is not null")
    return top.select("t.file", "t.points", "t.modified")
