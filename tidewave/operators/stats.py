"""Grouped summaries with the null and quantile rules of the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions.scalar import col
from tidewave.operators import index, sizing


def mean_by(df: DataFrame, keys: list[str], value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def m_sd(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sample standard deviation; the deviation is null for one value."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def strict_mean(x) -> Column:
    """Aggregate mean that is null as soon as one value of the group is null."""
    x = col(x)
    return F.when(F.count(F.lit(1)) == F.count(x), F.avg(x))


def safe_corr(x, y) -> Column:
    """Pearson correlation on complete pairs; null for fewer than two pairs or no variance."""
    x, y = col(x).cast("double"), col(y).cast("double")
    sx = F.stddev_samp(F.when(y.isNotNull(), x))
    sy = F.stddev_samp(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_samp(x, y), sx * sy)


def pick_by(key: str, level, value: str) -> Column:
    """The value found at one level of a key, as an order-free aggregate."""
    return F.max(F.when(F.col(key) == F.lit(level), F.col(value)))


def whole_table(df: DataFrame, *aggs: Column) -> Column:
    """One row of whole-table aggregates as a scalar subquery (a struct column)."""
    return df.agg(F.struct(*aggs).alias("s")).scalar()


def center(df: DataFrame, cols: list[str], suffix: str = "_c") -> DataFrame:
    means = whole_table(df, *[F.avg(c).alias(c) for c in cols])
    out = df.withColumn("_s", means)
    return out.withColumns({c + suffix: F.col(c) - F.col("_s").getField(c) for c in cols}).drop("_s")


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace columns by (x - mean) / sd over the whole table."""
    aggs = [F.avg(c).alias(c + "_m") for c in cols]
    aggs += [F.stddev_samp(c).alias(c + "_s") for c in cols]
    out, s = df.withColumn("_s", whole_table(df, *aggs)), F.col("_s")
    return out.withColumns(
        {c: F.try_divide(F.col(c) - s.getField(c + "_m"), s.getField(c + "_s")) for c in cols}
    ).drop("_s")


def quantiles_by(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    names: list[str],
    bound: int | None = None,
    limit: int | None = None,
    slots: int | None = None,
    repeats: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per group, linear between neighbouring order statistics.

    ``repeats`` says that values repeat a lot: they are counted before the percentile.
    ``weight`` names a column with the number of times a row's value stands for.

    Groups within the checked bound use the built-in exact percentile. Larger ones are
    selected by rank: count each distinct value (combined before the shuffle), place the
    values in range order, find the slots that hold the wanted ranks from the slot totals,
    and run cumulative counts in those slots only.
    """
    times = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), times.alias("_k"))
    if sizing.fits_one_task(rows, keys, bound, limit):
        at = F.array(*[F.lit(p) for p in probs])
        qs = F.percentile("_v", at)
        if repeats or weight:
            rows = rows.groupBy(*keys, "_v").agg(F.sum("_k").alias("_c"))
            qs = F.percentile("_v", at, F.col("_c"))
        out = rows.groupBy(*keys).agg(qs.alias("_q"))
        return out.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    by = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    counted = rows.groupBy(*by, "_v").agg(F.sum("_k").alias("_c"))
    placed = index.in_order(counted, by, ["_v"], slots)
    totals = placed.groupBy(*by, "_slot").agg(F.sum("_c").alias("_n"))
    running = W.partitionBy(*by).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    totals = totals.select(
        *by,
        "_slot",
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
        F.sum("_n").over(running).alias("_upto"),
        F.sum("_n").over(whole).alias("_total"),
    )
    # zero-based rank below each quantile; the element above it shares or follows its slot
    low = [F.floor((F.col("_total") - 1) * F.lit(p)) for p in probs]
    wanted = None
    for r in low:
        for rank in (r, F.least(r + 1, F.col("_total") - 1)):
            here = (rank >= F.col("_before")) & (rank < F.col("_upto"))
            wanted = here if wanted is None else wanted | here
    near = placed.join(totals.where(wanted), by + ["_slot"])
    inside = W.partitionBy(*by, "_slot").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_cum", F.col("_before") + F.sum("_c").over(inside))
    aggs = [F.max("_total").alias("_total")]
    for i, r in enumerate(low):
        above = F.least(r + 1, F.col("_total") - 1)
        aggs.append(F.min(F.when(F.col("_cum") > r, F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_cum") > above, F.col("_v"))).alias(f"_hi{i}"))
    found = near.groupBy(*by).agg(*aggs)
    cols = []
    for i, (p, n) in enumerate(zip(probs, names)):
        h = (F.col("_total") - 1) * F.lit(p)
        part = h - F.floor(h)
        cols.append((F.col(f"_lo{i}") * (1 - part) + F.col(f"_hi{i}") * part).alias(n))
    return found.select(*keys, *cols)


def interval_by(
    df: DataFrame,
    keys: list[str],
    value: str,
    name: str = "median",
    bound: int | None = None,
    limit: int | None = None,
    repeats: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Median with the central 95 % interval over draws."""
    return quantiles_by(
        df, keys, value, [0.5, 0.025, 0.975], [name, "lower", "upper"],
        bound=bound, limit=limit, repeats=repeats, weight=weight,
    )


def logsumexp_by(
    df: DataFrame, keys: list[str], value: str, name: str = "lse", sums: dict[str, Column] | None = None
) -> DataFrame:
    """log(sum(exp(x))) per group in one pass, without overflow.

    Values are summed inside steps of width 32 on the log scale (a small number of
    partial sums per group), then the steps are combined relative to the highest.
    ``sums`` names further columns to add up in the same pass. Infinite values count: a
    group with one at the top is infinite, those at the bottom add nothing; only nulls are left out.
    """
    sums = sums or {}
    x = F.col(value)
    far = 1 << 40
    step = F.when(x == float("inf"), F.lit(far)).when(x == float("-inf"), F.lit(-far)).otherwise(F.floor(x / 32))
    part = F.when(F.abs(x) == float("inf"), F.when(x > 0, x).otherwise(0.0)).otherwise(F.exp(x - F.col("_step") * 32))
    parts = (
        df.where(x.isNotNull())
        .withColumn("_step", step)
        .groupBy(*keys, "_step")
        .agg(
            F.sum(part).alias("_s"),
            *[F.sum(c).alias(n) for n, c in sums.items()],
        )
    )
    top = W.partitionBy(*keys)
    parts = parts.withColumn("_top", F.max("_step").over(top))
    scaled = F.col("_s") * F.exp((F.col("_step") - F.col("_top")) * 32.0)
    lse = F.when(F.sum(scaled) == 0, float("-inf")).otherwise(F.log(F.sum(scaled)) + F.max("_top") * 32.0)
    return parts.groupBy(*keys).agg(lse.alias(name), *[F.sum(n).alias(n) for n in sums])
