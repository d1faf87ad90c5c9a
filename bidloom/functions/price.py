"""Price, tax and submit-price columns. All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAX_DIVISOR = 1.13
#: Platforms whose unmarked prices exclude tax.
COST_PLATFORMS = ("guangcai", "lingcai", "huixun", "yize", "zaojiatong")


def parse_price(text: Column) -> Column:
    """The first unsigned decimal of a text without commas; null outside (0.01, 5,000,000)."""
    v = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when((v > 0.01) & (v < 5_000_000), v)


def lenient_number(text: Column) -> Column:
    """The first signed decimal of a text without commas and currency marks, or null."""
    clean = F.regexp_replace(text, "[,，¥￥]", "")
    return F.regexp_extract(clean, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def valid_price(price: Column) -> Column:
    """Whether a number is a real price: no sentinel and within (0.05, 5,000,000); null is not."""
    return F.coalesce((price > 0.05) & (price < 5_000_000) & ~F.isnan(price), F.lit(False))


def ex_tax(price: Column, tax_mode: Column, platform: Column, divisor: float = TAX_DIVISOR) -> Column:
    """The price without tax; null up to 0.05."""
    mode = F.lower(F.coalesce(tax_mode, F.lit("unknown")))
    less = price / F.lit(max(1.01, divisor))
    whole = (mode == "tax_excl") | ((mode != "tax_incl") & F.coalesce(platform.isin(*COST_PLATFORMS), F.lit(False)))
    return F.when(price > 0.05, F.when(whole, price).otherwise(less))


def ex_tax_for_rank(price: Column, tax_mode: Column, platform: Column, divisor: float = TAX_DIVISOR) -> Column:
    """As ``ex_tax``, for ranking: prices above 0 count, and more spellings of the mode."""
    mode = F.lower(F.coalesce(tax_mode, F.lit("unknown")))
    div = divisor if divisor and divisor > 1 else TAX_DIVISOR
    whole = mode.isin("tax_excl", "excl", "不含税") | (~mode.isin("tax_incl", "incl", "含税") & F.coalesce(platform.isin(*COST_PLATFORMS), F.lit(False)))
    return F.when(price > 0, F.when(whole, price).otherwise(price / F.lit(div)))


def vs_submit(ex: Column, submit: Column) -> Column:
    """Relation of a price without tax to the submitted price."""
    known = (submit > 0) & ex.isNotNull()
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown")
        .when(ex < submit * 0.25, "suspicious_low")
        .when(ex <= submit * 1.02, "below_submit")
        .when(ex <= submit * 1.10, "near_submit")
        .otherwise("above_submit")
    )


def under_submit(ex: Column, submit: Column) -> Column:
    """The ranking's own bands, whose ``near`` reaches 15 %."""
    known = F.coalesce((submit > 0) & ex.isNotNull(), F.lit(False))
    return F.when(~known, "unknown").when(ex <= submit * 1.02, "under").when(ex <= submit * 1.15, "near").otherwise("over")


def anomaly_hint(vs: Column, submit: Column) -> Column:
    """A note for prices far below or above the submitted one, else the empty text."""
    shown = F.when(F.coalesce(submit, F.lit(0.0)) != 0, F.concat(F.lit("（报送"), F.format_string("%.2f", submit), F.lit("）"))).otherwise("")
    return (
        F.when(vs == "suspicious_low", F.concat(F.lit("远低于报送"), shown, F.lit("·请核对规格/单位/是否错品")))
        .when(vs == "above_submit", F.concat(F.lit("高于报送"), shown, F.lit("·市场价如实收录，审定请人工取舍")))
        .otherwise("")
    )


def r2(value: Column) -> Column:
    return F.round(value + F.lit(1e-12), 2)


def audit_price(best_ex: Column, submit: Column, cap: bool = False) -> Column:
    """The least valid price without tax, at most the submitted one if ``cap``."""
    return F.when(best_ex.isNotNull(), F.when(F.lit(cap) & (submit > 0), F.least(best_ex, submit)).otherwise(best_ex))
