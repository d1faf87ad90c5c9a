"""The bucket of a candidate: formal, candidate or discard, by match, unit, price and mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names a hard specification in a conflict's text.
HARD = "功率 电压 直径 通径 DN φ Φ 防护 IP 色温 型号 压力 PN 尺寸 截面 规格冲突".split()


def hard_conflict(conflicts: Column) -> Column:
    """Whether a list of conflict texts names a hard specification."""
    return F.exists(F.coalesce(conflicts, F.array().cast("array<string>")), lambda x: x.rlike("|".join(HARD)))


def name_missed(detail: Column, conflicts: Column) -> Column:
    inside = F.exists(F.coalesce(conflicts, F.array().cast("array<string>")), lambda x: F.contains(x, F.lit("名称未命中")))
    return inside | F.contains(F.coalesce(detail, F.lit("")), F.lit("名称未命中"))


def decide(ok: Column, outcome: Column, missed: Column, unit_ok: Column, ambiguous: Column, mode: Column) -> Column:
    """``struct(bucket, outcome)``; unknown modes count as practical."""
    def b(bucket: str, out: str | Column) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), (F.lit(out) if isinstance(out, str) else out).alias("outcome"))

    strict, loose = mode == "strict", mode == "loose"
    unsure = F.when(missed & ~loose, b("discard", "reject")).when(strict, b("discard", "review")).otherwise(b("candidate", "review"))
    units = F.when(strict | missed, b("discard", "reject")).otherwise(b("candidate", "review"))
    by_strict = F.when(outcome == "review", b("candidate", "review")).otherwise(b("discard", F.coalesce(F.nullif(outcome, F.lit("")), F.lit("reject"))))
    return (
        F.when(ambiguous, unsure)
        .when(F.coalesce(~unit_ok, F.lit(False)), units)
        .when(ok, b("formal", "accept"))
        .when(strict, by_strict)
        .when(missed & ~loose, b("discard", "reject"))
        .when(missed, b("candidate", "review"))
        .when(outcome == "review", b("candidate", "review"))
        .when(outcome == "reject", F.when(loose, b("candidate", "review")).otherwise(b("discard", "reject")))
        .otherwise(b("candidate", "review"))
    )
