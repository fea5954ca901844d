"""Model input of the outcome models, all outcomes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import index, sizing


def indexed_responses(rows: DataFrame, bound: int | None = None, limit: int | None = None) -> DataFrame:
    """Answered items with the row, student and school index of their outcome."""
    # the three indices read the responses again: write them once
    known = sizing.cut_lineage(rows.where(F.col("response").isNotNull()))
    by = ["outcome"]
    out = index.row_index(known, by, ["id", "year", "item"], "ii", bound=bound, limit=limit)
    out = index.dense_index(out, "id", "jj", by, bound=bound, limit=limit)
    return index.dense_index(out, "school", "kk", by, bound=bound, limit=limit)


def sizes(indexed: DataFrame) -> DataFrame:
    """Numbers of rows, categories, students and schools per outcome."""
    return indexed.groupBy("outcome").agg(
        F.max("ii").alias("n"), F.max("response").alias("m"),
        F.max("jj").alias("j"), F.max("kk").alias("k"),
    )


def schools(indexed: DataFrame) -> DataFrame:
    """Responses of the school model: indices, wave from zero, category."""
    return indexed.select(
        "outcome", "ii", "jj", "kk", (F.col("year") - 8).alias("x_time"), F.col("response").alias("y")
    )


def school_levels(indexed: DataFrame) -> DataFrame:
    """Involvement level per school index."""
    return indexed.select("outcome", "kk", F.col("school_involvement").alias("x_sep")).distinct()


def students(indexed: DataFrame, treated: DataFrame) -> DataFrame:
    """Responses of the student model with their treatment and its missing flag."""
    rows = indexed.join(treated.select("id", "sep"), "id", "left")
    return rows.select(
        "outcome", "ii", "jj", "kk", (F.col("year") - 8).alias("x_time"),
        F.col("response").alias("y"), "item", "sep", F.col("sep").isNull().cast("int").alias("mis"),
    )


def student_units(indexed: DataFrame, treated: DataFrame) -> DataFrame:
    """One row per student index: observed treatment, -1 where it is unknown."""
    units = indexed.select("outcome", "jj", "id").distinct()
    rows = units.join(treated.select("id", "sep"), "id", "left")
    return rows.select(
        "outcome", "jj", F.coalesce("sep", F.lit(-1)).alias("sep_obs"),
        F.col("sep").isNull().cast("int").alias("mis"),
    )


def student_shapes(indexed: DataFrame, fitted: DataFrame) -> DataFrame:
    """Student index with observed treatment and, where that is unknown, the shapes of its distribution."""
    units = indexed.select("outcome", "jj", "id").distinct()
    rows = units.join(fitted.select("id", "sep", "sep_alpha", "sep_beta"), "id", "left")
    unknown = F.col("sep").isNull()
    return rows.select(
        "outcome", "jj", F.coalesce("sep", F.lit(-1)).alias("sep_obs"), unknown.cast("int").alias("mis"),
        *[F.when(unknown, F.col(c)).alias(c) for c in ("sep_alpha", "sep_beta")],
    )


def student_sizes(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Counts of rows and students with known and unknown treatment."""
    n = rows.groupBy("outcome").agg(
        F.sum("mis").alias("n_mis"), F.sum(1 - F.col("mis")).alias("n_obs")
    )
    j = units.groupBy("outcome").agg(
        F.sum("mis").alias("j_mis"), F.sum(1 - F.col("mis")).alias("j_obs")
    )
    return n.join(j, "outcome")
