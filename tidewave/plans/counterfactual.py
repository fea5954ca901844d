"""Change probabilities of simulated students with and without participation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.functions.scalar import add_all, box_muller, hash_uniform
from tidewave.operators import stats
from tidewave.operators.draws import column, varying_effects
from tidewave.operators.reshape import seq_table
from tidewave.operators.sizing import spread_out
from tidewave.plans.ordinal import category_probs, chol2

Uniform = Callable[..., Column]


def draw_columns(wide: DataFrame, waves: tuple[int, int]) -> DataFrame:
    """The parameters one simulated student needs, one row per draw."""
    z = [column(f"z_time[{i}]") for i in range(1, 5)]
    mo = {w: F.lit(4.0) * add_all(z[:w]) for w in waves}
    keys = [c for c in ("outcome", "draw") if c in wide.columns]
    return wide.select(
        *keys,
        F.array(*[column(f"c[{i}]") for i in range(1, 5)]).alias("c"),
        "b_time",
        *[mo[w].alias(f"mo_{w}") for w in waves],
        *[column(f"b_sep[{w + 1}]").alias(f"b_sep_{w}") for w in waves],
        column("sigma_j[1]"), column("sigma_j[2]"), "sigma_k",
        *[column(f"Lcorr_j[{i},{k}]") for i in (1, 2) for k in (1, 2)],
    )


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("outcome", "draw") if c in df.columns]


def effects_table(
    draws: DataFrame, n_students: int, n_schools: int, seed: int, uniform: Uniform = hash_uniform
) -> DataFrame:
    """Random students and schools for every draw, seeded by keys; the outcomes share them.

    A school's effect is a function of (draw, school) and a student's of (draw, student),
    so both are computed where they are needed: no join, and the same values under any
    partitioning or re-run.
    """
    rows = seq_table(spread_out(draws, _keys(draws)), "jj", 1, n_students)
    school = F.floor(uniform("jj", seed=seed) * n_schools).cast("int") + 1
    rows = rows.withColumn("kk", school)
    z1, z2 = box_muller(
        uniform("draw", "jj", seed=seed + 1), uniform("draw", "jj", seed=seed + 2)
    )
    zk, _ = box_muller(
        uniform("draw", "kk", seed=seed + 3), uniform("draw", "kk", seed=seed + 4)
    )
    rows = rows.withColumns({"_z1": z1, "_z2": z2, "_zk": zk})
    sigma = [column("sigma_j[1]"), column("sigma_j[2]")]
    b1, b2 = varying_effects(sigma, chol2("Lcorr_j"), [F.col("_z1"), F.col("_z2")])
    return rows.withColumns(
        {"b_j_1": b1, "b_j_2": b2, "b_k_1": F.col("sigma_k") * F.col("_zk")}
    ).drop("_z1", "_z2", "_zk")


def probs(effects: DataFrame, waves: tuple[int, int], n_cat: int = 5) -> DataFrame:
    """Category probabilities ``p_arm_wave`` of both waves under both arms."""
    cuts = [F.col("c")[i] for i in range(n_cat - 1)]
    eta = {
        f"_eta_{w}": F.col("b_j_1") + F.col("b_k_1")
        + (F.col("b_time") + F.col("b_j_2")) * F.col(f"mo_{w}")
        for w in waves
    }
    rows = effects.withColumns(eta)
    out = {}
    for arm in (0, 1):
        for w in waves:
            e = F.col(f"_eta_{w}") + F.lit(float(arm)) * F.col(f"b_sep_{w}")
            out[f"p_{arm}_{w}"] = F.array(*category_probs(e, cuts))
    return rows.select(*_keys(rows), "jj", "kk", *[p.alias(n) for n, p in out.items()])


def change(p: str, q: str, n_cat: int = 5) -> tuple[Column, Column, Column]:
    """(higher, same, lower): how the second of two independent categories compares."""
    a, b = [F.col(p)[i] for i in range(n_cat)], [F.col(q)[i] for i in range(n_cat)]
    same = add_all([a[i] * b[i] for i in range(n_cat)])
    higher = add_all([a[i] * add_all(b[i + 1 :]) for i in range(n_cat - 1)])
    lower = add_all([a[i] * add_all(b[:i]) for i in range(1, n_cat)])
    return higher, same, lower


def changes(p: DataFrame, waves: tuple[int, int]) -> DataFrame:
    """Change probabilities of each student under each arm, one row per student and draw."""
    cols = {}
    for arm in (0, 1):
        parts = change(f"p_{arm}_{waves[0]}", f"p_{arm}_{waves[1]}")
        cols |= {f"{n}_{arm}": v for n, v in zip(("higher", "same", "lower"), parts)}
    return p.select(*_keys(p), "jj", "kk", *[v.alias(n) for n, v in cols.items()])


def compare_arms(c: DataFrame) -> DataFrame:
    """How a student's change with participation compares with the change without."""
    h1, s1, l1 = F.col("higher_1"), F.col("same_1"), F.col("lower_1")
    h0, s0, l0 = F.col("higher_0"), F.col("same_0"), F.col("lower_0")
    rows = c.select(
        *_keys(c), "jj", "kk",
        (h1 * (s0 + l0) + s1 * l0).alias("higher"),
        (h1 * h0 + s1 * s0 + l1 * l0).alias("same"),
        (l1 * (s0 + h0) + s1 * h0).alias("lower"),
    )
    return rows.withColumn("improved", F.col("higher") - F.col("lower"))


OUTPUTS = ["higher", "same", "lower", "improved"]


def mean_by_draw(compared: DataFrame) -> DataFrame:
    return compared.groupBy(*_keys(compared)).agg(*[F.avg(c).alias(c) for c in OUTPUTS])


def summary(by_draw: DataFrame, bound: int | None = None) -> DataFrame:
    """Median and interval over draws, per thousand students and rounded up."""
    keys = [k for k in _keys(by_draw) if k != "draw"] + ["counterfactual"]
    long = by_draw.unpivot(_keys(by_draw), OUTPUTS, "counterfactual", "estimate")
    out = stats.interval_by(long, keys, "estimate", "d_est", bound=bound)
    return out.select(
        *keys,
        *[F.ceil(F.col(c) * 1000).cast("double").alias(c) for c in ("d_est", "lower", "upper")],
    )
