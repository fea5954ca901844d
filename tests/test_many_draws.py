"""Draws beyond the broadcast limits: sums per task, few copies, cells with counts by category."""

import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewave.operators import blocks, sizing
from tidewave.plans import kernels, ordinal
from tidewave.sources import survey_tables as S


def student_rows(spark):
    cells = [("a", 1 + i % 2, 1, i % 3, s, [i % 4, 2, 0, i % 3, 1]) for i in range(6) for s in (None, 0, 1)]
    cells = spark.createDataFrame([(o, j, k, t, s, sum(n), *n) for o, j, k, t, s, n in cells],
                                  "outcome string, jj_slot int, kk_slot int, x_time int, sep int, n long, n_1 long, n_2 long, n_3 long, n_4 long, n_5 long")
    rng = np.random.default_rng(5)
    # the last draw has tied thresholds: no room for the third category, which nobody chose; another one has null effects
    draws = [("a", d, [-1.0, 0.2, 0.2 if d == 6 else 0.9, 2.0], 0.3, [0.0, 0.5, 1.0], [0.1, -0.4, 2.0],
              [None if d == 3 else float(rng.normal()), 0.4], [0.2, float(rng.normal())], [0.0 if d == 5 else 0.7, 1.0], [0.3])
             for d in range(7)]
    draws = spark.createDataFrame(draws, "outcome string, draw int, c array<double>, b_time double, mo array<double>, b_sep array<double>,"
                                  " b_j_1 array<double>, b_j_2 array<double>, x_sep array<double>, b_k_1 array<double>")
    rows = ordinal.linear_predictor(ordinal.with_gaps(draws, 5).join(cells, "outcome"))
    return ordinal.merge_sep(rows, F.col("x_sep")[F.col("jj_slot") - 1])


def of_each_category(rows):
    counts = F.array(*[F.struct(F.lit(y).alias("y"), F.col(f"n_{y}").alias("_n")) for y in range(1, 6)])
    return rows.select("*", F.inline(counts)).where("_n > 0")


KEYS = ["outcome", "jj_slot", "kk_slot", "x_time", "sep", "draw"]


@pytest.mark.parametrize("known", [True, False])
def test_a_cell_with_counts_is_the_sum_of_its_responses(spark, known):
    rows = student_rows(spark)
    if known:
        rows = rows.withColumn("eta", F.col("eta_1"))
    score = ordinal.loglik_known if known else ordinal.loglik
    want = score(of_each_category(rows)).groupBy(*KEYS).agg(F.sum(F.col("_n") * F.col("llk")).alias("llk"))
    got, want = ({tuple(r[k] for k in KEYS): r.llk for r in df.collect()} for df in (score(rows, 5), want))
    assert got.keys() == want.keys() and sum(v is None for v in got.values()) == 9
    assert all(got[k] == (None if v is None else pytest.approx(v, rel=1e-12)) for k, v in want.items())


@pytest.mark.parametrize("score", [ordinal.loglik, lambda rows, n_cat: ordinal.loglik_known(rows.withColumn("eta", F.col("eta_1")), n_cat)])
def test_scoring_is_compiled(spark, capsys, score):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        score(student_rows(spark), 5).groupBy("outcome").agg(F.sum("llk"), F.sum("n")).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    # before: 12 kB in one function of loglik; the JVM interprets functions of more than 8,000 bytes
    assert sizes and max(sizes) < 7000


def test_arms_without_weight_or_room(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(-1.0, -2.0), (-1.0, None), (None, -2.0), (None, None), (-inf, -2.0), (-1.0, -inf), (-inf, -inf), (-inf, None), (None, -inf), (nan, -1.0), (-800.0, -801.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double")
    got = [r.x for r in df.orderBy("i").select(ordinal._either(F.col("a"), F.col("b")).alias("x")).collect()]
    want = [np.logaddexp(-1, -2), -1.0, -2.0, None, -2.0, -1.0, -inf, -inf, -inf, nan, np.logaddexp(-800, -801)]
    assert all(g is None if w is None else g == pytest.approx(w, rel=1e-14, nan_ok=True) for g, w in zip(got, want))


def test_few_units_are_broadcast_to_many_draws(spark):
    units = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(10)], "u int, o string")
    draws = spark.createDataFrame([(d, o) for d in range(300) for o in "ab"], "draw int, of string")
    for args in ({"on": ("o", "of")}, {}):
        of = draws if args else draws.where("of = 'a'")
        got = sizing.with_every_draw(units, of, 300, ["u"], broadcast_limit=100, **args)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "_block" not in plan and "_tile" not in plan
        assert got.count() == 3000 and got.select("u", "draw").distinct().count() == 3000


def test_one_row_by_draw_from_each_task(spark):
    units = spark.range(0, 40_000, 1, 2).select(F.col("id").alias("u"), (F.col("id") * 1.0).alias("x"))
    draws = spark.range(3000).select(F.col("id").cast("int").alias("draw"), (F.col("id") / 3000).alias("z"))

    def by_draw(some, held):
        return {"draw": held["draw"], "s": held["z"] * some["x"].sum(), "n": np.full(len(held["z"]), len(some["x"]))}

    def by_unit(some, held):
        return {"u": some["u"], "s": some["x"] * held["z"].sum(), "n": np.full(len(some["x"]), len(held["z"]))}

    for limits in ({}, {"broadcast_bytes": 0, "tile_rows": 15_000, "block_draws": 1100}):
        parts = blocks.over_draws(units, draws, by_draw, "draw int, s double, n bigint", sums=["s", "n"], by="draw", **limits).cache()
        # before: a row for each draw and for every 83 units
        assert parts.count() == 3000 * (3 if limits else 2)
        got = parts.groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        assert all(r.n == 40_000 and r.s == pytest.approx(r.draw / 3000 * 40_000 * 39_999 / 2) for r in got)
        parts = blocks.over_draws(units, draws, by_unit, "u bigint, s double, n bigint", sums=["s", "n"], by="unit", **limits)
        got = parts.groupBy("u").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("parts")).collect()
        assert len(got) == 40_000 and {r.n for r in got} == {3000} and {r.parts for r in got} == {3 if limits else 1}
        assert all(r.s == pytest.approx(r.u * 2999 / 2) for r in got)


def test_blocks_are_sized_by_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sizing, "numbers", lambda n, plain=sizing.numbers: seen.append(n) or plain(n))
    units = spark.range(10).select(F.col("id").alias("u"))
    draws = spark.range(50_000).select(F.col("id").cast("int").alias("draw"))
    parts = blocks.over_draws(units, draws, lambda some, held: {"draw": held["draw"], "n": np.full(len(held["draw"]), len(some["u"]))},
                              "draw int, n bigint", broadcast_bytes=0, sums=["n"], by="draw")
    assert parts.agg(F.sum("n")).first()[0] == 500_000
    # before: 64 draws a block, and a copy of each unit for each of 782 blocks
    assert seen[0] == 4 * sizing.slots_of(spark)


def test_tasks_of_the_panel_stay_within_their_rows(spark, monkeypatch):
    want = sorted(map(tuple, S.panel_long(spark, SF).collect()))
    lines = S.rows_of(spark, SF, "lineitem")
    monkeypatch.setattr(sizing, "GROUP_ROWS", lines // 20)
    panel = S.panel_long(spark, SF)
    # before: as many tasks as the session has slots, however many the rows
    assert panel.rdd.getNumPartitions() > 2 * sizing.slots_of(spark)
    assert sorted(map(tuple, panel.collect())) == want


def test_grouped_cells_are_spread_over_all_slots(spark):
    cells = spark.range(1000).groupBy((F.col("id") % 200).alias("k"), (F.col("id") % 3).alias("j")).count()
    # before: the shuffle was taken for the one of the grouping and merged into one task
    assert sizing.spread_out(cells, ["k", "j"]).rdd.getNumPartitions() == sizing.slots_of(spark)


def test_softplus_sums():
    x = np.array([[-800.0, -3.0, 0.0, 2.5, 800.0] * 300])
    assert kernels.softplus_sums(x)[0] == pytest.approx(kernels.softplus(x).sum(), rel=1e-14)
