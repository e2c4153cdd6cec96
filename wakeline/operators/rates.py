"""Rates over scored rows: flag rates, false-alarm rates by stratum, curves, gaps, matrices, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables

THIN = 20


def thin_label(n: str, least: int = THIN) -> Column:
    return F.when(F.col(n) < least, "thin-n")


def flag_rates(rows: DataFrame, by: Sequence[str], action: str = "action", control: str | None = "negative_control", least: int = THIN) -> DataFrame:
    """n (flag or pass), n_flag, n_abstain, n_total, rate (NULL without a scored row) and thin_n. Controls do not count."""
    if control and control in rows.columns:
        rows = rows.where(~F.coalesce(F.col(control), F.lit(False)))
    a = F.col(action)
    out = rows.groupBy(*by).agg(F.count_if(a.isin("flag", "pass")).alias("n"), F.count_if(a == "flag").alias("n_flag"), F.count_if(a == "abstain").alias("n_abstain"), F.count("*").alias("n_total"))
    return out.withColumn("rate", F.try_divide("n_flag", "n")).withColumn("thin_n", thin_label("n", least))


def gaps(rates: DataFrame, comparator: DataFrame, on: Sequence[str]) -> DataFrame:
    """rates with the comparator's rate and the difference; NULL if either is."""
    other = comparator.select(*on, F.col("rate").alias("comparator_rate"), F.col("n").alias("comparator_n"))
    return rates.join(other, list(on), "left").withColumn("gap", F.col("rate") - F.col("comparator_rate"))


def far_by(rows: DataFrame, by: Sequence[str], flag: str = "flag") -> DataFrame:
    """False-alarm rate; rows without a flag do not count."""
    return rows.groupBy(*by).agg(F.count(flag).alias("n"), F.count_if(F.col(flag)).alias("n_flag")).withColumn("far", F.try_divide("n_flag", "n"))


def overall(rates: DataFrame, excluded: Column | None = None) -> DataFrame:
    """n-weighted mean rate over the groups of far_by."""
    rates = rates.where(~excluded) if excluded is not None else rates
    return rates.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("far") * F.col("n")), F.sum("n")).alias("far"))


def far_curve(rows: DataFrame, by: Sequence[str], targets: Sequence[float], score: str = "score") -> DataFrame:
    """Per group and target: its own percentile as threshold, and the share of scores strictly above.

    One pass for the thresholds, one for the counts.
    """
    rows = rows.where(F.col(score).isNotNull())
    cuts = tables.exact_quantiles(rows, by, score, [1 - t for t in targets]).withColumnRenamed("cuts", "_c")
    joined = rows.join(tables.small(cuts), list(by))
    counts = joined.groupBy(*by).agg(F.count("*").alias("n"), F.first("_c").alias("_c"), F.array(*[F.count_if(F.col(score) > F.col("_c").getItem(i)) for i in range(len(targets))]).alias("_n"))
    p = F.explode(F.arrays_zip(F.array(*[F.lit(float(t)) for t in targets]).alias("far_target"), F.col("_c").alias("threshold"), F.col("_n").alias("n_above")))
    return counts.select(*by, "n", p.alias("_p")).select(*by, "n", "_p.far_target", "_p.threshold", (F.col("_p.n_above") / F.col("n")).alias("realized"))


def matrix(rates: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    return rates.groupBy(row).pivot(column, list(values)).agg(F.first(value))


def control_ceiling(rate: str, far: float, factor: float = 2.0, slack: float = 0.05) -> Column:
    """Whether a negative control stays under factor * far + slack; no rate passes."""
    return F.coalesce(F.col(rate) <= far * factor + slack, F.lit(True))


def gate(far: str, target: float, complete: str) -> Column:
    return F.when(~F.col(complete) | F.col(far).isNull(), "INCOMPLETE").when(F.col(far) <= target, "PASS").otherwise("FAIL")


def success_rates(rows: DataFrame, by: Sequence[str], eligible: str, success: str, attributable: str) -> DataFrame:
    """Success over eligible rows, and over those that are attributable as well."""
    e, s, a = (F.coalesce(F.col(c), F.lit(False)) for c in (eligible, success, attributable))
    out = rows.groupBy(*by).agg(F.count_if(e).alias("n_eligible"), F.count_if(e & s).alias("n_success"), F.count_if(e & a).alias("n_attributable"), F.count_if(e & a & s).alias("n_attributable_success"))
    return out.withColumn("rate", F.try_divide("n_success", "n_eligible")).withColumn("attributable_rate", F.try_divide("n_attributable_success", "n_attributable"))
