from __future__ import annotations

from bidloom.operators import quotes as Q
from bidloom.operators import ranking as R

OFFER = "item_id int, platform_no int, platform string, supplier_id int, sku string, price double, tax_mode string, score double, seen_at date, submit double, name string, spec string, title string, spec_seen string, url string"


def ranks(spark, offers, name="热镀锌钢管", spec="DN100 AC220V 9W"):
    rows = [(1, 1, "jd", 1, sku, price, "tax_excl", score, None, 100.0, name, spec, title, seen, url) for sku, title, seen, price, score, url in offers]
    out = Q.rule_ranked(spark.createDataFrame(rows, OFFER)).collect()
    return [r.sku for r in sorted(out, key=lambda r: r.rank)], {r.sku: r for r in out}


def test_the_specification_comes_before_the_price(spark):
    offers = [
        ("cheap", "热镀锌钢管", "DN50", 1.0, 9.0, "u"),
        ("exact", "热镀锌钢管", "DN100 220V", 99.0, 0.0, "u"),
        ("full", "热镀锌钢管", "DN100 AC220V 9 W", 500.0, 0.0, "u"),
        ("other", "镀铜板", "DN100 AC220V 9W", 1.0, 9.0, "u"),
        ("silent", "热镀锌钢管", "", 50.0, 9.0, "u"),
        ("unlinked", "热镀锌钢管", "", 40.0, 9.0, None),
        ("scored", "热镀锌钢管", "", 60.0, 9.5, "u"),
        ("over", "热镀锌钢管", "", 200.0, 9.0, "u"),
    ]
    order, by = ranks(spark, offers)
    assert order == ["full", "exact", "scored", "silent", "over", "unlinked", "cheap", "other"]
    assert (by["full"].id_hits, by["full"].hard_cover, by["exact"].id_hits, by["exact"].hard_cover) == (2, 2, 2, 0)
    assert by["cheap"].wrong_size == 1 and by["other"].name_miss == 1 and by["silent"].evidence == 2 and by["unlinked"].evidence == 1


def test_sections_models_and_long_bores(spark):
    offers = [("a", "消声器 XZP100A", "1250×400×1500", 5.0, 0.0, "u"), ("b", "消声器", "800x400", 5.0, 0.0, "u"), ("c", "消声器", "无", 5.0, 0.0, "u")]
    order, by = ranks(spark, offers, "消声器", "XZP100A 1250X400")
    assert order == ["a", "c", "b"] and by["a"].id_hits == 2 and by["b"].wrong_size == 1
    order, by = ranks(spark, [("x", "钢管", "DN1200", 9.0, 0.0, "u"), ("y", "钢管", "DN120", 1.0, 0.0, "u")], "钢管", "DN1200")
    assert order == ["x", "y"] and (by["x"].wrong_size, by["y"].wrong_size) == (0, 1)


def test_nothing_to_go_by(spark):
    rows = [(1, 1, "jd", 1, f"s{i}", p, "tax_excl", None, None, None, None, None, None, None, None) for i, p in enumerate((3.0, None, 1.0, 2.0))]
    out = Q.rule_ranked(spark.createDataFrame(rows, OFFER), 3).collect()
    assert [r.sku for r in sorted(out, key=lambda r: r.rank)] == ["s2", "s3", "s0"] and {r.flag for r in out} == {"unknown"}
