"""Scale scores, within- and next-wave correlations, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions.scalar import fmt2, fmt_corr
from tidewave.operators import reshape
from tidewave.operators.stats import m_sd, safe_corr, strict_mean

KEYS = ["id", "school", "year"]


def scale_scores(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean response per student, wave and outcome."""
    return (
        rows.where(F.col("response").isNotNull())
        .groupBy(*keys, "outcome")
        .agg(F.avg("response").alias("score"))
    )


def wide_scores(rows: DataFrame, outcomes: list[str], keys: list[str] = KEYS) -> DataFrame:
    """The same with one column per outcome, in one aggregate."""
    means = [F.avg(F.when(F.col("outcome") == o, F.col("response"))).alias(o) for o in outcomes]
    return rows.where(F.col("response").isNotNull()).groupBy(*keys).agg(*means)


def _by_pair(wide: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(x_outcome, y_outcome, r): correlation per wave of the listed column pairs, averaged.

    Each row unfolds into its fixed list of column pairs, which the aggregate reduces to
    one row per wave and pair before the shuffle.
    """
    rows = [
        F.struct(F.lit(x).alias("x_outcome"), F.lit(y).alias("y_outcome"),
                 F.col(x).alias("x"), F.col(c).alias("y"))
        for x, y, c in pairs
    ]
    cells = wide.select("year", F.inline(F.array(*rows)))
    waves = cells.groupBy("year", "x_outcome", "y_outcome").agg(safe_corr("x", "y").alias("r"))
    return waves.groupBy("x_outcome", "y_outcome").agg(strict_mean("r").alias("r"))


def within(wide: DataFrame, outcomes: list[str]) -> DataFrame:
    """Correlation of every two outcomes in the same wave, averaged over waves.

    The outcomes of a student-wave stand in one row, so there is no self join; the upper
    half of the matrix is computed and mirrored.
    """
    pairs = [(x, y, y) for i, x in enumerate(outcomes) for y in outcomes[i:]]
    half = _by_pair(wide, pairs)
    x, y = F.col("x_outcome"), F.col("y_outcome")
    both = F.when(x == y, F.array(F.struct(x.alias("a"), y.alias("b")))).otherwise(
        F.array(F.struct(x.alias("a"), y.alias("b")), F.struct(y.alias("a"), x.alias("b")))
    )
    full = half.select(F.inline(both), "r")
    return full.select(F.col("a").alias("x_outcome"), F.col("b").alias("y_outcome"), "r")


def between(
    wide: DataFrame, outcomes: list[str], unit: list[str] = ("id", "school"), last: int = 12
) -> DataFrame:
    """Correlation of each outcome with each outcome one wave later, averaged over waves."""
    w = W.partitionBy(*unit).orderBy("year")
    follows = F.lead("year").over(w) == F.col("year") + 1
    nxt = {f"next_{o}": F.when(follows, F.lead(o).over(w)) for o in outcomes}
    rows = wide.withColumns(nxt).where(F.col("year") < last)
    return _by_pair(rows, [(x, y, f"next_{y}") for x in outcomes for y in outcomes])


def matrix(r: DataFrame, outcomes: list[str]) -> DataFrame:
    return reshape.to_wide(r, ["x_outcome"], ["y_outcome"], outcomes, "r")


def format_matrix(wide: DataFrame, outcomes: list[str]) -> DataFrame:
    """Report form of a correlation matrix, rows in report order."""
    levels = {o: o for o in outcomes}
    text = wide.withColumns({o: fmt_corr(o) for o in outcomes})
    ordered = reshape.recode(text, "x_outcome", levels, "_row").orderBy("_row_level")
    return ordered.select("x_outcome", *outcomes)


def m_sd_by_wave(rows: DataFrame) -> DataFrame:
    """Mean and standard deviation of the student scores per wave and outcome."""
    return m_sd(scale_scores(rows), ["year", "outcome"], "score")


def m_sd_table(summary: DataFrame, outcomes: list[str]) -> DataFrame:
    """'M,SD' text per wave (rows) and outcome (columns)."""
    text = F.concat_ws(",", fmt2(F.round("mean", 2)), fmt2(F.round("sd", 2)))
    cells = summary.withColumn("cell", text)
    return reshape.to_wide(cells, ["year"], ["outcome"], outcomes, "cell").orderBy("year")
