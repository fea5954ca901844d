"""Posterior-draw tables: from wide parameter columns to tidy tables, and derived effects."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["chain", "iteration", "draw"]
NAME = re.compile(r"^(.+?)\[([0-9,]+)\]$")


def column(name: str) -> Column:
    """Reference to a column whose name holds brackets or commas."""
    return F.col("`" + name + "`")


def present(df: DataFrame, keys: list[str]) -> list[str]:
    return [k for k in keys if k in df.columns]


def split_name(name: str) -> tuple[str, tuple[int, ...]]:
    """Base name and indices of a parameter column; no indices for a scalar."""
    hit = NAME.match(name)
    if not hit:
        return name, ()
    return hit.group(1), tuple(int(i) for i in hit.group(2).split(","))


def select_params(wide: DataFrame, bases: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Keep the keys and the columns of the named parameters."""
    cols = [c for c in wide.columns if split_name(c)[0] in bases]
    return wide.select(*present(wide, keys), *[column(c) for c in cols])


def add_draw_id(df: DataFrame, n_iter: int) -> DataFrame:
    """Draw number from chain and iteration (chains one after the other)."""
    number = (F.col("chain") - 1) * F.lit(n_iter) + F.col("iteration")
    return df.withColumn("draw", number.cast("int"))


def to_long(wide: DataFrame, keys: list[str] = KEYS, n_index: int = 1) -> DataFrame:
    """(keys, parameter, i1.., estimate) for the columns with ``n_index`` indices."""
    ids = present(wide, keys)
    cols = [c for c in wide.columns if c not in ids and len(split_name(c)[1]) == n_index]
    long = wide.unpivot([F.col(k) for k in ids], [column(c) for c in cols], "_name", "estimate")
    pattern = r"^(.+)\[" + ",".join([r"(\d+)"] * n_index) + r"\]$"
    found = [
        F.regexp_extract("_name", pattern, i + 1).cast("int").alias(f"i{i}")
        for i in range(1, n_index + 1)
    ]
    return long.select(
        *ids, F.regexp_extract("_name", pattern, 1).alias("parameter"), *found, "estimate"
    )


def spread(long: DataFrame, params: list[str], index: str, keys: list[str] = KEYS) -> DataFrame:
    """One column per parameter, one row per draw and index, from a long draws table."""
    ids = present(long, keys)
    picks = [F.max(F.when(F.col("parameter") == p, F.col("estimate"))).alias(p) for p in params]
    rows = long.where(F.col("parameter").isin(params))
    return rows.groupBy(*ids, F.col("i1").alias(index)).agg(*picks)


def gather(
    wide: DataFrame, bases: list[str], index: list[str], keys: list[str] = KEYS
) -> DataFrame:
    """As ``to_long`` and ``spread`` together, straight from the wide columns.

    The names of the columns tell which ones share an index, so each draw row unfolds in
    place and nothing is shuffled.
    """
    ids = present(wide, keys)
    by_index: dict[tuple[int, ...], dict[str, str]] = {}
    for c in wide.columns:
        base, idx = split_name(c)
        if base in bases and len(idx) == len(index):
            by_index.setdefault(idx, {})[base] = c
    rows = []
    for idx in sorted(by_index):
        have = by_index[idx]
        values = [
            (column(have[b]) if b in have else F.lit(None)).cast("double").alias(b) for b in bases
        ]
        rows.append(F.struct(*[F.lit(i).alias(n) for i, n in zip(idx, index)], *values))
    return wide.select(*ids, F.inline(F.array(*rows)))


def to_array(long: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Vector per key in index order; a parameter vector has a short, fixed length."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda e: e[value]).alias(name))


def array_of(wide: DataFrame, base: str) -> Column:
    """The entries of a vector parameter of a wide table, in index order."""
    cols = sorted((split_name(c)[1], c) for c in wide.columns if split_name(c)[0] == base)
    return F.array(*[column(c) for _, c in cols])


# -- tidy tables per outcome -------------------------------------------------------------

OUTCOME_KEYS = ["outcome", "draw"]


def ps_y(wide: DataFrame, with_time: bool) -> DataFrame:
    """Threshold below each category, null for the first; students add the time effect."""
    n = sum(1 for c in wide.columns if split_name(c)[0] == "c")
    extra = ["b_time"] if with_time else []
    values = [F.struct(F.lit(1).alias("y"), F.lit(None).cast("double").alias("c"))]
    for i in range(1, n + 1):
        values.append(F.struct(F.lit(i + 1).alias("y"), column(f"c[{i}]").alias("c")))
    return wide.select(*OUTCOME_KEYS, *extra, F.inline(F.array(*values)))


def ps_x_students(wide: DataFrame) -> DataFrame:
    """Participation effect per wave with the simplex entry of the wave before it."""
    n = sum(1 for c in wide.columns if split_name(c)[0] == "b_sep")
    rows = []
    for i in range(1, n + 1):
        z = column(f"z_time[{i - 1}]") if i > 1 else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(i - 1).alias("x_time"),
                column(f"b_sep[{i}]").alias("b_sep"),
                z.alias("z_time"),
            )
        )
    return wide.select(*OUTCOME_KEYS, F.inline(F.array(*rows)))


def ps_x_time_schools(wide: DataFrame) -> DataFrame:
    """Simplex entries at waves 1.., completed with a null wave 0."""
    n = sum(1 for c in wide.columns if split_name(c)[0] == "z_time")
    rows = [F.struct(F.lit(0).alias("x_time"), F.lit(None).cast("double").alias("z_time"))]
    for i in range(1, n + 1):
        rows.append(F.struct(F.lit(i).alias("x_time"), column(f"z_time[{i}]").alias("z_time")))
    return wide.select(*OUTCOME_KEYS, F.inline(F.array(*rows)))


def ps_x_sep(wide: DataFrame) -> DataFrame:
    return gather(wide, ["b_sep", "b_sep_time"], ["x_sep"], OUTCOME_KEYS)


def ps_unit(wide: DataFrame, params: list[str], index: str) -> DataFrame:
    return gather(wide, params, [index], OUTCOME_KEYS)


def ps_p(wide: DataFrame, arms_from_zero: bool) -> DataFrame:
    """Predicted probabilities p[arm, wave, category]; the wave counts from 0, and for the
    student model the arm does too."""
    p = gather(wide, ["p"], ["x_sep", "x_time", "y"], OUTCOME_KEYS)
    shift = 1 if arms_from_zero else 0
    return p.withColumns({"x_sep": F.col("x_sep") - shift, "x_time": F.col("x_time") - 1})


def add_reference_level(free: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Put a reference level with effect 0 before the free levels (which move up by one)."""
    zero = free.select(*keys).distinct().withColumns({index: F.lit(1), value: F.lit(0.0)})
    moved = free.withColumn(index, F.col(index) + 1)
    return moved.select(*keys, index, value).unionByName(zero)


# -- derived effects ---------------------------------------------------------------------


def varying_effects(
    sigma: list[Column], chol: list[list[Column]], z: list[Column]
) -> list[Column]:
    """diag(sigma) L z for one unit, row by row; L is lower triangular."""
    rows = []
    for i, s in enumerate(sigma):
        terms = [chol[i][k] * z[k] for k in range(i + 1)]
        rows.append(s * reduce(lambda a, b: a + b, terms))
    return rows


def corr_from_chol(rows: DataFrame, keys: list[str]) -> DataFrame:
    """L L' per draw from a (keys, i, k, v) table, by joining rows on the shared column."""
    left = rows.select(*keys, "k", "i", F.col("v").alias("a"))
    right = rows.select(*keys, "k", F.col("i").alias("j"), F.col("v").alias("b"))
    return (
        left.join(right, keys + ["k"])
        .groupBy(*keys, "i", "j")
        .agg(F.sum(F.col("a") * F.col("b")).alias("r"))
    )


def covariance(corr: DataFrame, sigma: DataFrame, keys: list[str]) -> DataFrame:
    """sigma_i r_ij sigma_j from (keys, i, j, r) and (keys, i, sigma)."""
    si = sigma.select(*keys, "i", F.col("sigma").alias("_si"))
    sj = sigma.select(*keys, F.col("i").alias("j"), F.col("sigma").alias("_sj"))
    out = corr.join(si, keys + ["i"]).join(sj, keys + ["j"])
    return out.select(
        *keys, "i", "j", (F.col("_si") * F.col("r") * F.col("_sj")).alias("cov")
    )


def mo_table(ps_x: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Monotonic effect at every wave of a (keys, x_time, z_time) table."""
    w = W.partitionBy(*keys).orderBy("x_time").rowsBetween(W.unboundedPreceding, 0)
    run = F.sum(F.coalesce(F.col("z_time"), F.lit(0.0))).over(w)
    return ps_x.withColumn("mo", F.lit(float(n)) * run)
