"""Does attrition depend on the outcomes: panel, lagged design, scoring, odds ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import draws as D
from tidewave.operators import index, panel, reshape, sizing, stats
from tidewave.plans import fit
from tidewave.sources.schema import (
    DROPOUT_PREDICTORS,
    DROPOUT_REPORT_ORDER,
    ITEM_COUNTS,
    ITEMS,
    OUTCOME_LABELS,
    WAVES,
)

SCORES = DROPOUT_PREDICTORS


def missing_grid(rows: DataFrame) -> DataFrame:
    """All waves of every student, flagged where no item was answered."""
    grid = panel.expand_grid(rows.select("id", "school", "year", *ITEMS), ["id"], ["school"], WAVES)
    return grid.withColumn("missing", panel.all_missing(ITEMS))


def dropout_panel(rows: DataFrame, bound: int | None = None) -> DataFrame:
    """Standardised scores per wave from the first response on, carried forward."""
    scored = panel.scale_scores(missing_grid(rows), ITEM_COUNTS).select(
        "id", "school", "year", "missing", *SCORES
    )
    # the whole-table moments and the indices below read this again: write it once
    scored = stats.zscore(sizing.cut_lineage(scored), SCORES)
    kept = panel.trim_leading(scored, "id", "year", "missing")
    filled = panel.locf(kept, "id", "year", SCORES)
    # a student has one row per wave, so this window is as small as the two before it
    filled = index.row_index(filled, ["id"], ["year"], "ii", bound=len(WAVES))
    filled = sizing.cut_lineage(filled)
    filled = index.dense_index(filled, "id", "jj", bound=bound)
    filled = index.dense_index(filled, "school", "kk", bound=bound)
    return filled.select(
        "id", "school", "year", "missing", *SCORES, "ii", "jj", "kk",
        F.col("missing").cast("int").alias("y"),
    )


def design(rows: DataFrame) -> DataFrame:
    """Rows after a student's first, with the wave before: y_prev and x_prev."""
    prev = panel.previous_wave(rows, "id", "year", ["y", *SCORES])
    return prev.where(F.col("ii") > 1).select(
        "id", "year", "jj", "kk", "y", "y_prev", *[f"{s}_prev" for s in SCORES]
    )


def fit_logit(rows: DataFrame, penalty: float = 0.001) -> fit.LogitFit:
    """Point-estimate replacement for the dropout model: pooled penalised regression on the
    lagged design with wave dummies. Not a posterior."""
    gated = rows.withColumns(
        {s: (1 - F.col("y_prev")) * F.col(f"{s}_prev") for s in SCORES}
        | {f"wave_{w}": (F.col("year") == w).cast("double") for w in WAVES[2:]}
        | {"y": F.col("y").cast("double")}
    )
    # every step reads its input again: give it a written table
    gated = sizing.cut_lineage(gated)
    return fit.fit_penalised_logit(gated, "y", ["y_prev", *SCORES, *[f"wave_{w}" for w in WAVES[2:]]], penalty=penalty)


def odds_ratios(b_x: DataFrame, bound: int | None = None) -> DataFrame:
    """exp(b_x) per predictor: label, median and interval."""
    long = D.spread(D.to_long(b_x), ["b_x"], "x").withColumn("odds", F.exp("b_x"))
    out = stats.interval_by(long, ["x"], "odds", "odds_ratio", bound=bound)
    labels = {i: OUTCOME_LABELS[o] for i, o in enumerate(DROPOUT_PREDICTORS, start=1)}
    return reshape.recode(out, "x", {i: labels[i] for i in DROPOUT_REPORT_ORDER}, "name")
