"""Longitudinal steps inside a unit: grid, missing waves, lags, carried values, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions.scalar import row_mean_strict


def all_missing(items: list[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in items]).isNull()


def expand_grid(
    df: DataFrame, unit: list[str], attributes: list[str], waves: list[int]
) -> DataFrame:
    """One row per unit and wave, unit attributes filled in, data attached where present.

    Rows of the same unit and year become one before the shuffle (the largest as a whole, field by field from the left), so a
    unit arrives as its few years however often they repeat, and unfolds over the waves in place.
    Years outside ``waves`` keep their rows. (unit, year) is a key of the panel; a unit with
    two attribute values is reported by the design checks, not multiplied here.
    """
    data = [c for c in df.columns if c not in unit + attributes + ["year"]]
    years = df.groupBy(*unit, "year").agg(
        *[F.max(a).alias(a) for a in attributes], F.max(F.struct(*([F.lit(0).alias("_row")] + [F.col(c) for c in data]))).alias("_data")
    )
    units = years.groupBy(*unit).agg(
        *[F.max(a).alias(a) for a in attributes], F.collect_list(F.struct("year", "_data")).alias("_rows")
    )
    kind = df.schema["year"].dataType
    every = F.array(*[F.lit(w).cast(kind) for w in waves])
    years = F.array_union(every, F.transform("_rows", lambda r: r["year"]))
    grid = units.withColumn("year", F.explode(years))
    own = F.filter("_rows", lambda r: r["year"].eqNullSafe(F.col("year")))
    grid = grid.withColumn("_own", F.get(own, F.lit(0))["_data"])
    return grid.select(*unit, *attributes, "year", *[F.col("_own")[c].alias(c) for c in data])


def scale_scores(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Mean of the items of each outcome, null if any item is null; items dropped."""
    scores = {
        o: row_mean_strict([f"{o}_{i}" for i in range(1, n + 1)]) for o, n in counts.items()
    }
    items = [f"{o}_{i}" for o, n in counts.items() for i in range(1, n + 1)]
    return df.withColumns(scores).drop(*items)


def lags(df: DataFrame, unit: str, order: str, cols: list[str], depth: int) -> DataFrame:
    """Values of the 1..depth previous waves as new columns ``x_lag1`` ..."""
    w = W.partitionBy(unit).orderBy(order)
    return df.withColumns(
        {f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in range(1, depth + 1)}
    )


def trim_leading(df: DataFrame, unit: str, order: str, missing: str) -> DataFrame:
    """Drop the rows of a unit before its first wave with a response."""
    w = W.partitionBy(unit).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    seen = F.min(F.col(missing).cast("int")).over(w) == 0
    return df.withColumn("_seen", seen).where("_seen").drop("_seen")


def locf(df: DataFrame, unit: str, order: str, cols: list[str], empty=0.0) -> DataFrame:
    """Carry the last value forward inside a unit; ``empty`` before the first value."""
    w = W.partitionBy(unit).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(empty)) for c in cols}
    )


def previous_wave(df: DataFrame, unit: str, order: str, cols: list[str]) -> DataFrame:
    """Value in the row before inside a unit, null on the first row."""
    w = W.partitionBy(unit).orderBy(order)
    return df.withColumns({f"{c}_prev": F.lag(c).over(w) for c in cols})
