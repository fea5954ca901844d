"""Partly missing treatment: derivation, imputation design, scoring over draws, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.functions.scalar import (
    bernoulli_logit_lpmf,
    either,
    if_else_strict,
    inv_logit,
    log1m_inv_logit,
    log_either_inv_logit,
)
from tidewave.operators import index, sizing, stats

UNIT = ["id", "school", "school_involvement"]
CELL = ["kk_slot", "school_involvement", "y11", "y12", "m11", "m12", "y11_c", "y12_c", "sep"]


def treatment(rows: DataFrame) -> DataFrame:
    """One row per student: participation in the two late waves and over both.

    Students without a late wave stay, with unknown participation, because every student
    row feeds the one aggregate.
    """
    wide = rows.groupBy(*UNIT).agg(
        stats.pick_by("year", 11, "sep").alias("y11"), stats.pick_by("year", 12, "sep").alias("y12")
    )
    y11, y12 = F.col("y11"), F.col("y12")
    sep = F.when(y11 + y12 == 0, 0).when(y11 == 1, 1).when(y12 == 1, 1)
    return wide.withColumn("sep", sep)


def units_without_late_wave(rows: DataFrame, first_late: int = 11) -> DataFrame:
    """Students that have no row from the late waves on."""
    late = rows.where(F.col("year") >= first_late).select("id").distinct()
    return rows.select(*UNIT).distinct().join(late, "id", "left_anti")


def design(treated: DataFrame, bound: int | None = None) -> DataFrame:
    """Indices, centred values, missing flags and the -1 placeholder of the model input."""
    # means and indices read the students again: write them once
    treated = sizing.cut_lineage(treated)
    indexed = index.dense_index(treated, "id", "jj", bound=bound)
    indexed = index.dense_index(indexed, "school", "kk", bound=bound)
    centred = stats.center(indexed, ["y11", "y12"])

    def flag(c: str) -> Column:
        return if_else_strict(F.col(c) == -1, F.lit(1), F.lit(0))

    filled = centred.withColumns(
        {
            "y11_c": F.coalesce("y11_c", F.lit(-1.0)),
            "y12_c": F.coalesce("y12_c", F.lit(-1.0)),
            "y11": F.coalesce("y11", F.lit(-1)),
            "y12": F.coalesce("y12", F.lit(-1)),
        }
    )
    return filled.select(
        "id", "jj", "kk", "y11_c", "y12_c", "y11", "y12",
        flag("y11").alias("m11"), flag("y12").alias("m12"), "school_involvement", "sep",
    )


def design_cells(units: DataFrame) -> DataFrame:
    """Students with equal model input as one weighted cell: they score alike in any draw."""
    return units.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def linear_predictor(df: DataFrame) -> DataFrame:
    """l11 and l12 for rows (cell or student) x draw."""

    def one(own: str, other: str) -> Column:
        a, sigma = F.col(f"a{own}"), F.col(f"sigma{own}")
        school = F.col(f"b{own}_k")[F.col("kk_slot") - 1]
        missing = F.col(f"m{other}")
        seen = (F.col(f"b{own}_y{other}") + school[1] * sigma[1]) * (1 - missing)
        unseen = (F.col(f"b{own}_m{other}") + school[2] * sigma[2]) * missing
        level = F.col(f"b{own}_sep")[F.col("school_involvement") - 1]
        return a + school[0] * sigma[0] + seen * F.col(f"y{other}_c") + unseen + level

    return df.withColumns({"l11": one("11", "12"), "l12": one("12", "11")})


def score(df: DataFrame) -> DataFrame:
    """Participation probabilities with the observed waves put in, and log-likelihoods."""
    y11, y12 = F.nullif(F.col("y11"), F.lit(-1)), F.nullif(F.col("y12"), F.lit(-1))
    df = df.withColumns(
        {
            "p11": F.coalesce(y11.cast("double"), inv_logit("l11")),
            "p12": F.coalesce(y12.cast("double"), inv_logit("l12")),
            "llk11": bernoulli_logit_lpmf(y11, "l11"),
            "llk12": bernoulli_logit_lpmf(y12, "l12"),
        }
    )
    return df.withColumn("sep_draw", either("p11", "p12"))


def sep_loglik(df: DataFrame) -> DataFrame:
    """Log-likelihood of the known treatment, finite for any finite logits; the rows stay long."""
    neither = log1m_inv_logit("l11") + log1m_inv_logit("l12")
    llk = F.when(F.col("sep") == 1, log_either_inv_logit("l11", "l12")).when(F.col("sep") == 0, neither)
    return df.where(F.col("sep").isNotNull()).withColumn("sep_llk", llk)


def merge_fitted(fitted: DataFrame, units: DataFrame, panel: DataFrame, key: str) -> DataFrame:
    """Fitted beta shapes and observed treatment, attached to every panel row."""
    known = fitted.join(units.select("id", key, "sep"), key, "full_outer")
    rows = panel.drop("sep").join(known.where(F.col("id").isNotNull()), "id", "left")
    items = [c for c in panel.columns if c not in ("id", "year", "sep") and not c.startswith("school")]
    schools = [c for c in panel.columns if c.startswith("school")]
    return rows.select("id", "year", *schools, "sep", "sep_alpha", "sep_beta", *items)
