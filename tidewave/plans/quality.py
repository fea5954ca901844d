"""Checks of declared bounds and shapes, as small report tables (rule, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions.scalar import add_all
from tidewave.operators.draws import column, split_name


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count the rows that break each rule, all rules in one pass; null does not break one."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    rows = [
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules
    ]
    return counts.select(F.inline(F.array(*rows)))


def outside(c: str, low, high) -> Column:
    return ~F.col(c).between(low, high)


def one_value_per(df: DataFrame, key: str, value: str, rule: str) -> DataFrame:
    """How many keys have more than one value."""
    spread = df.groupBy(key).agg((F.min(value) != F.max(value)).alias("bad"))
    return report(spread, {rule: F.col("bad")})


def check_design(rows: DataFrame, n_cat: int) -> DataFrame:
    """Bounds of the model input and dependence of school on student, level on school."""
    bounds = report(
        rows,
        {
            "y_in_range": outside("y", 1, n_cat),
            "year_in_range": outside("year", 8, 12),
            "involvement_in_range": outside("school_involvement", 1, 3),
            "item_in_range": outside("item", 1, 5),
            "id_known": F.col("id").isNull(),
            "y_known": F.col("y").isNull(),
        },
    )
    school = one_value_per(rows, "id", "school", "one_school_per_id")
    level = one_value_per(rows, "school", "school_involvement", "one_level_per_school")
    keys = rows.groupBy("id", "year", "outcome", "item").agg(F.count(F.lit(1)).alias("c"))
    unique = report(keys, {"key_is_unique": F.col("c") > 1})
    return bounds.unionByName(school).unionByName(level).unionByName(unique)


def check_imputation(units: DataFrame) -> DataFrame:
    """Bounds of the imputation design."""
    return report(
        units,
        {
            "y11_in_range": outside("y11", -1, 1),
            "y12_in_range": outside("y12", -1, 1),
            "m11_is_flag": outside("m11", 0, 1),
            "m12_is_flag": outside("m12", 0, 1),
            "y11_c_in_range": outside("y11_c", -1.0, 1.0),
            "y12_c_in_range": outside("y12_c", -1.0, 1.0),
            "m11_matches_y11": (F.col("m11") == 1) != (F.col("y11") == -1),
            "m12_matches_y12": (F.col("m12") == 1) != (F.col("y12") == -1),
        },
    )


def check_dropout(rows: DataFrame) -> DataFrame:
    """Bounds of the dropout design."""
    return report(
        rows,
        {
            "ii_in_range": outside("ii", 1, 5),
            "year_in_range": outside("year", 8, 12),
            "y_is_flag": outside("y", 0, 1),
            "jj_positive": F.col("jj") < 1,
            "kk_positive": F.col("kk") < 1,
        },
    )


def check_threshold_rows(ps_y: DataFrame) -> DataFrame:
    """Thresholds ascend with the category inside each draw."""
    w = W.partitionBy("outcome", "draw").orderBy("y")
    rows = ps_y.withColumn("_before", F.lag("c").over(w))
    return report(rows, {"thresholds_ascend": F.col("c") < F.col("_before")})


def check_draws(wide: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Constraints of a wide draws table of either outcome model, in one pass.

    The rules follow from the parameter names: thresholds ``c`` ascend, simplexes ``z_*`` are not
    negative and sum to one, scales ``sigma*`` are positive, rows of Cholesky factors ``Lcorr_*`` have unit
    norm and start with 1; sizes are those found.
    """
    found: dict[str, list[tuple[tuple[int, ...], Column]]] = {}
    for name in wide.columns:
        base, at = split_name(name)
        found.setdefault(base, []).append((at, column(name)))
    held = {base: [c for _, c in sorted(parts, key=lambda x: x[0])] for base, parts in found.items()}

    def any_of(rules: list[Column]) -> Column:
        return reduce(lambda x, y: x | y, rules, F.lit(False))

    simplexes = [v for base, v in held.items() if base.startswith("z_")]
    scales = [c for base, v in held.items() if base.startswith("sigma") for c in v]
    factors = [dict(parts) for base, parts in found.items() if base.startswith("Lcorr_")]
    norms = []
    for factor in factors:
        for i in {at[0] for at in factor}:
            norms.append(add_all([c * c for at, c in sorted(factor.items(), key=lambda x: x[0]) if at[0] == i]))
    return report(
        wide,
        {
            "thresholds_ascend": any_of([x > y for x, y in zip(held.get("c", []), held.get("c", [])[1:])]),
            "simplex_sums_to_one": any_of([F.abs(add_all(v) - 1) > tolerance for v in simplexes]),
            "simplex_not_negative": any_of([c < 0 for v in simplexes for c in v]),
            "scales_positive": any_of([c <= 0 for c in scales]),
            "cholesky_rows_unit_norm": any_of([F.abs(n - 1) > tolerance for n in norms]),
            "cholesky_first_row": any_of([f[1, 1] != 1 for f in factors]),
        },
    )


def check_vector_draws(df: DataFrame, sizes: dict[str, int], positive: list[str]) -> DataFrame:
    """Array parameters of the imputation and dropout models: sizes, no null entry, positive scales."""
    rules = {f"{c}_has_{n}": F.size(c) != n for c, n in sizes.items()}
    rules |= {f"{c}_positive": F.exists(c, lambda v: v <= 0) for c in positive}
    rules["entries_known"] = reduce(lambda x, y: x | y, [F.exists(c, lambda v: v.isNull()) for c in sizes])
    return report(df, rules)


def check_student_input(rows: DataFrame, units: DataFrame, n_cat: int) -> DataFrame:
    """Bounds of the indexed student input and of the shapes of unknown treatment."""
    bounds = report(
        rows,
        {
            "y_in_range": outside("y", 1, n_cat), "x_time_in_range": outside("x_time", 0, 4),
            "jj_positive": F.col("jj") < 1, "kk_positive": F.col("kk") < 1,
            "mis_matches_sep": (F.col("mis") == 1) != F.col("sep").isNull(),
        },
    )
    shapes = report(
        units,
        {
            "sep_obs_in_range": outside("sep_obs", -1, 1),
            "mis_matches_sep_obs": (F.col("mis") == 1) != (F.col("sep_obs") == -1),
            "shapes_positive": (F.col("sep_alpha") <= 0) | (F.col("sep_beta") <= 0),
        },
    )
    return bounds.unionByName(shapes)


def check_unit_interval(df: DataFrame, c: str, rule: str) -> DataFrame:
    return report(df, {rule: outside(c, 0.0, 1.0)})
