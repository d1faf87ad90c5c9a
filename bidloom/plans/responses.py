"""Registered queries over stored responses, each with its SQL: pages and rows are put together from suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom import shared
from bidloom.operators import views as V
from bidloom.sources import responses as R


def _pages(spark, d):
    """A list page a supplier: a head row, a priced row, and a row that shows its price to members only."""
    s = shared.dealt(V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.col("s_suppkey").cast("string").alias("n")), "page_id")
    html = F.concat(
        F.lit("<table><tr><td>材料名称及规格型号</td><td>除税市场价</td></tr>"),
        F.lit('<tr class="flex flex-row"><td><a href="/shichangjia/info_'), "n", F.lit('" class="material-title">阀</a><span>原始名称：</span><span>闸阀'), "n",
        F.lit("</span><span>规格型号：</span><span>DN100</span><i>台</i><span>供应商名称：</span><span>甲"), "n", F.lit("公司</span>市场价：￥"), "n", F.lit(".5</td></tr>"),
        F.lit('<tr class="flex flex-row"><td><a href="/shichangjia/info_0" class="material-title">球阀</a><u>牌号 Q2</u><u>乙某商行</u>查看价格</td></tr></table>'),
    )
    return s.select("page_id", html.alias("html"))


def list_pages(spark, d):
    return R.list_rows(_pages(spark, d)).select("page_id", "index", "name", "spec", "unit", "supplier", "href", "price", "tax_mode")


def list_candidates(spark, d):
    rows = R.list_rows(_pages(spark, d))
    return R.candidates(rows, "page_id", F.array(F.lit("闸阀")), "zaojiatong", filtered_by_site=False, name=F.lit("球阀")).select("page_id", "place", "title", "score", "needs_detail")


def table_responses(spark, d):
    n = F.col("item_id")
    text = F.when(n % 4 == 0, "名称 规格型号").when(n % 4 == 1, F.concat(F.lit("球阀 除税价 "), (n + 1).cast("string"), F.lit(" 含税价 9 单位：个 丙厂家公司"))).when(n % 4 == 2, "蝶阀 DN80").otherwise("信息价：¥7 泵")
    rows = V.items(spark, d).select("item_id", text.alias("text"), F.lit(None).cast("string").alias("name"), F.when(n % 4 == 2, "含税 12元").alias("cell_price"), F.lit("").alias("unit"), F.lit("").alias("supplier"), F.col("brand"), F.lit("").alias("href"))
    return R.table_rows(rows).select("item_id", "name", "price", "tax_mode", "unit", "supplier", "brand")


def member_responses(spark, d):
    n = F.col("item_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("分控器 价格因子 含税价：¥"), (n + 1).cast("string"), F.lit("/台 查看联系方式 张三 成都某某公司 报价时间"))).otherwise("灯 单位：套")
    rows = V.items(spark, d).select("item_id", text.alias("text"), F.lit("").alias("name"), F.when(n % 3 == 1, "80 元").otherwise("80").alias("cell_price"), F.lit(True).alias("has_price"), F.lit("").alias("href"))
    return R.member_rows(rows).select("item_id", "name", "price", "tax_mode", "unit", "supplier")


def shop_responses(spark, d):
    i = V.items(spark, d)
    goods = i.select("item_id", "name", F.when(F.col("item_id") % 5 != 0, F.concat(F.lit("https://item.example.com/"), F.col("item_id").cast("string"), F.lit("?from=list"))).alias("href"), F.when(F.col("item_id") % 7 != 0, F.col("submit").cast("string")).otherwise("议价").alias("cell_price"))
    return R.shop_candidates(goods, F.slice(F.split("name", " "), 1, 1), "jd").select("item_id", "url", "price", "score", "tax_mode")


def detail_responses(spark, d):
    """Titles of stored pages, and the prices that a text added to each shows."""
    p = V.read(spark, d, "pages").select("page_id", F.concat(F.lit("<p>含税价："), (F.col("page_id") + 1).cast("string"), F.lit("</p>"), "html").alias("html"))
    return R.detail_pages(p).select("page_id", "price", "tax_mode")


def search_responses(spark, d):
    one = lambda at, url: F.concat(F.lit(f'<div class="result c-container"><h3><a href="{url}'), F.col("n"), F.lit(f'">T{at} <em>x</em></a></h3><span class="c-abstract">s&amp;{at}</span></div>'))
    s = shared.dealt(V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.col("s_suppkey").cast("string").alias("n")), "page_id")
    html = F.concat(one(1, "http://www.baidu.com/link?url=https%3A%2F%2Fa.example.com%2F"), one(2, "https://zhidao.baidu.com/q"), one(3, "https://b.example.com/"))
    return R.search_hits(s.select("page_id", html.alias("html")))


QUERIES = {f.__name__: f for f in (list_pages, list_candidates, table_responses, member_responses, shop_responses, detail_responses, search_responses)}
ORACLE = {
    "list_pages": """SELECT s_suppkey AS page_id, CAST(0 AS INTEGER) AS index, '闸阀' || s_suppkey AS name, 'DN100' AS spec, '台' AS unit, '甲' || s_suppkey || '公司' AS supplier, 'https://gd.zjtcn.com/shichangjia/info_' || s_suppkey AS href,
  CASE WHEN s_suppkey < 5000000 THEN s_suppkey + 0.5::DOUBLE END AS price, 'tax_incl' AS tax_mode FROM supplier
UNION ALL SELECT s_suppkey, 1, '球阀', '牌号 Q2', '', '乙某商行', 'https://gd.zjtcn.com/shichangjia/info_0', NULL, 'unknown' FROM supplier""",
    "list_candidates": """SELECT s_suppkey AS page_id, CAST(1 AS INTEGER) AS place, '闸阀' || s_suppkey AS title, CAST(1 AS INTEGER) AS score, false AS needs_detail FROM supplier
UNION ALL SELECT s_suppkey, 2, '球阀', 1, true FROM supplier""",
    "table_responses": f"""WITH {V.ITEMS}, i AS (SELECT *, item_id % 4 AS k FROM items WHERE item_id % 4 <> 0)
SELECT item_id, CASE k WHEN 1 THEN '球阀 除税价 ' || (item_id + 1) || ' 含税价 9 单位：个 丙厂家公司' WHEN 2 THEN '蝶阀 DN80' ELSE '信息价：¥7 泵' END AS name, CASE k WHEN 1 THEN item_id + 1 WHEN 2 THEN 12 ELSE 7 END::DOUBLE AS price,
  CASE k WHEN 1 THEN 'tax_excl' WHEN 2 THEN 'tax_incl' ELSE 'unknown' END AS tax_mode, CASE k WHEN 1 THEN '个' ELSE '' END AS unit, CASE k WHEN 1 THEN '丙厂家公司' ELSE '' END AS supplier, brand FROM i""",
    "member_responses": f"""WITH {V.ITEMS}, i AS (SELECT item_id, item_id % 3 AS k FROM items)
SELECT item_id, CASE k WHEN 0 THEN '分控器' ELSE '灯 单位：套' END AS name, CASE k WHEN 0 THEN item_id + 1 WHEN 1 THEN 80 END::DOUBLE AS price, CASE k WHEN 0 THEN 'tax_incl' ELSE 'unknown' END AS tax_mode,
  CASE k WHEN 0 THEN '台' ELSE '套' END AS unit, CASE k WHEN 0 THEN '成都某某公司' ELSE '' END AS supplier FROM i""",
    "shop_responses": f"WITH {V.ITEMS} SELECT item_id, 'https://item.example.com/' || item_id AS url, submit AS price, CAST(1 AS INTEGER) AS score, 'tax_incl' AS tax_mode FROM items WHERE item_id % 5 <> 0 AND item_id % 7 <> 0",
    "detail_responses": "SELECT page_id, CAST(page_id + 1 AS DOUBLE) AS price, 'tax_incl' AS tax_mode FROM pages",
    "search_responses": """SELECT s_suppkey AS page_id, CAST(1 AS INTEGER) AS place, 'https://a.example.com/' || s_suppkey AS url, 'T1 x' AS title, 's&1' AS snippet FROM supplier
UNION ALL SELECT s_suppkey, 2, 'https://b.example.com/' || s_suppkey, 'T3 x', 's&3' FROM supplier""",
}
