"""Labelled evaluation: confusion matrices, flips between two runs, and the gate's counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = {"strict": ("malicious",), "screening": ("malicious", "suspicious")}


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(judged: DataFrame, positive: tuple[str, ...], by: str | None = None) -> DataFrame:
    """Counts and ratios of ``judged(label, verdict)`` by a column, or over all; a ratio over nothing is null. Labels other than
    benign and malicious are excluded and counted."""
    risk, bad, good = F.col("verdict").isin(*positive), F.col("label") == "malicious", F.col("label") == "benign"
    known = F.coalesce(bad | good, F.lit(False))
    key = F.coalesce(F.col(by).cast("string"), F.lit("unspecified")) if by else F.lit("all")
    counted = judged.groupBy(key.alias("grp")).agg(
        F.count_if(bad & risk).alias("tp"), F.count_if(good & risk).alias("fp"), F.count_if(good & ~risk).alias("tn"), F.count_if(bad & ~risk).alias("fn"), F.count_if(~known).alias("excluded")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counted.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "false_positive_rate": _ratio(fp, fp + tn), "f2": _ratio(5 * tp, 5 * tp + 4 * fn + fp)})


def flips(judged: DataFrame, positive: tuple[str, ...]) -> DataFrame:
    """(skill_id, change) of packages whose side changed between the verdicts ``old`` and ``new``."""
    was, now = F.col("old").isin(*positive), F.col("new").isin(*positive)
    change = (
        F.when(F.col("label") == "malicious", F.when(now, "fixed_false_negatives").otherwise("new_false_negatives"))
        .when(F.col("label") == "benign", F.when(now, "new_false_positives").otherwise("fixed_false_positives"))
    )
    return judged.where(was != now).select("skill_id", change.alias("change")).where("change IS NOT NULL")


def gate(results: DataFrame, policy: str = "malicious") -> DataFrame:
    """Counts by verdict and whether the policy (malicious, suspicious or never) blocks."""
    blocked = {"malicious": ("malicious",), "suspicious": ("malicious", "suspicious"), "never": ()}[policy]
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("malicious", "suspicious", "benign")]
    hit = F.count_if(F.col("verdict").isin(*blocked)) > 0 if blocked else F.lit(False)
    return results.agg(*counts, hit.alias("blocked"))
