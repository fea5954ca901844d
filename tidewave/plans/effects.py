"""Estimated means and standardised adjusted differences from predicted probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.functions.scalar import same_sign
from tidewave.operators import reshape, stats
from tidewave.sources.schema import OUTCOME_LABELS

# Labels of waves and arms.
COMPARISONS = {
    "d_10": "Year 10", "d_11": "Year 11 (adjusted)", "d_12": "Year 12 (adjusted)",
}
STUDENT_ARMS = {1: "Yes", 0: "No"}
SCHOOL_ARMS = {3: "Current involvement", 2: "Past involvement", 1: "No involvement"}
# Fixed values end.

MEAN_KEYS = ["outcome", "draw", "x_sep", "x_time"]


def expected_mean(ps_p: DataFrame, keys: list[str] = MEAN_KEYS) -> DataFrame:
    """Expected category per draw, arm and wave from rows (keys, y, p)."""
    return ps_p.groupBy(*keys).agg(F.sum(F.col("y") * F.col("p")).alias("m"))


def expected_mean_vector(grid: DataFrame, n_cat: int) -> DataFrame:
    """The same from a probability vector per row: in place, no shuffle."""
    total = F.col("p")[0]
    for i in range(1, n_cat):
        total = total + F.col("p")[i] * F.lit(float(i + 1))
    return grid.select(*MEAN_KEYS, total.alias("m"))


def mean_interval(means: DataFrame, arms: dict[int, str], bound: int | None = None) -> DataFrame:
    """Median and interval per arm, wave and outcome, with report labels."""
    out = stats.interval_by(means, ["outcome", "x_sep", "x_time"], "m", "m_est", bound=bound)
    out = reshape.recode(out, "outcome", OUTCOME_LABELS, "name")
    out = reshape.recode(out, "x_sep", arms, "arm")
    return out.withColumn("year", F.col("x_time") + 8).drop("x_time")


def baseline_sd(rows: DataFrame, year: int = 10) -> DataFrame:
    """Standard deviation over students of their mean response at the baseline wave."""
    base = rows.where((F.col("year") == year) & F.col("response").isNotNull())
    means = base.groupBy("outcome", "id").agg(F.avg("response").alias("mean"))
    return means.groupBy("outcome").agg(F.stddev_samp("mean").alias("sd"))


def differences(means: DataFrame, contrasts: dict[str, tuple[int, int]], waves=(2, 3, 4)) -> DataFrame:
    """Arm differences per draw: at the first wave, later ones less the first.

    ``contrasts`` maps a label to (arm, reference arm). One aggregate per draw.
    """

    def at(arm: int, wave: int) -> Column:
        hit = (F.col("x_sep") == arm) & (F.col("x_time") == wave)
        return F.max(F.when(hit, F.col("m")))

    gaps, rows = [], []
    for label, (arm, ref) in contrasts.items():
        for t in waves:
            gaps.append((at(arm, t) - at(ref, t)).alias(f"{label}_{t}"))
        first = F.col(f"{label}_{waves[0]}")
        for t in waves:
            d = first if t == waves[0] else F.col(f"{label}_{t}") - first
            rows.append(
                F.struct(F.lit(label).alias("contrast"), F.lit(f"d_{t + 8}").alias("comparison"),
                         d.alias("d"))
            )
    wide = means.groupBy("outcome", "draw").agg(*gaps)
    return wide.select("outcome", "draw", F.inline(F.array(*rows)))


def cohens_d(
    means: DataFrame, sds: DataFrame, contrasts: dict[str, tuple[int, int]], bound: int | None = None
) -> DataFrame:
    """Standardised adjusted differences: median, interval, and whether it excludes zero."""
    gaps = differences(means, contrasts).join(sds, "outcome", "left")
    gaps = gaps.withColumn("d", F.try_divide(F.col("d"), F.col("sd")))
    keys = ["outcome", "contrast", "comparison"]
    out = stats.interval_by(gaps, keys, "d", "d_est", bound=bound)
    out = reshape.recode(out, "outcome", OUTCOME_LABELS, "name")
    out = reshape.recode(out, "comparison", COMPARISONS, "label")
    return out.withColumn("p", same_sign("lower", "upper"))
