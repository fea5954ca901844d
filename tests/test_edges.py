"""Cases at the edge: extreme logits, tied thresholds, unlisted levels, large numbers."""

import math

import pytest
from pyspark.sql import functions as F

from tidewave.functions.scalar import log1m_exp, plain_uniform
from tidewave.operators import index, panel, reshape, sizing, stats
from tidewave.plans import impute, loo, ordinal


def exact_either(a, b):
    """log of the chance of either event, from both logits, with plain logs of sums."""
    li = lambda x: -math.log1p(math.exp(-x)) if x > -700 else x
    l0 = lambda x: -math.log1p(math.exp(x)) if x < 700 else -x
    x, y = li(a), l0(a) + li(b)
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


@pytest.mark.parametrize("a, b", [(-40.0, -40.0), (-36.0, -40.0), (-800.0, -800.0), (40.0, -40.0), (800.0, 800.0), (0.3, -1.2)])
def test_known_treatment_at_extreme_logits(spark, a, b):
    rows = spark.createDataFrame([(a, b, 1), (a, b, 0), (a, b, None)], "l11 double, l12 double, sep int")
    got = {r.sep: r.sep_llk for r in impute.sep_loglik(rows).collect()}
    assert got[1] == pytest.approx(exact_either(a, b), rel=1e-12, abs=1e-300)
    assert set(got) == {0, 1} and all(v is not None and not math.isnan(v) for v in got.values())


def test_no_draw_is_lost_in_leave_one_out(spark):
    rows = spark.createDataFrame([("u", i, a, a, 1) for i, a in enumerate([-40.0, -2.0, 0.5])], "k string, draw int, l11 double, l12 double, sep int")
    got = loo.is_loo(impute.sep_loglik(rows), ["k"], "sep_llk").first().elpd_loo
    values = [exact_either(a, a) for a in (-40.0, -2.0, 0.5)]
    assert got == pytest.approx(math.log(3) - math.log(sum(math.exp(-v) for v in values)))


def test_log1m_exp(spark):
    xs = [-1e-300, -1e-17, -1e-9, -0.5, -0.7, -40.0, -800.0, 0.0, float("-inf"), 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log1m_exp("x")).collect()]
    want = [math.log(-math.expm1(x)) if x < 0 else float("-inf") for x in xs[:-1]]
    assert got[:-1] == pytest.approx(want, rel=1e-12) and got[-1] is None


def test_tied_thresholds(spark):
    rows = spark.createDataFrame([(2, [0.0, 0.0, 1.0, 2.0], 0.3, None), (2, [0.0, 1e-12, 1.0, 2.0], 0.3, None), (1, [0.0, 0.0, 1.0, 2.0], 0.3, 1)], "y int, c array<double>, eta_0 double, sep int")
    rows = rows.withColumns({"eta": F.col("eta_0"), "eta_1": F.col("eta_0") + 0.1, "x_sep_merged": F.lit(0.4)})
    known = [r.llk for r in ordinal.loglik_known(rows).collect()]
    mixed = [r.llk for r in ordinal.loglik(rows).collect()]
    for got in (known, mixed):
        assert got[0] == float("-inf") and math.isfinite(got[1]) and math.isfinite(got[2])
    density = math.exp(-0.3) / (1 + math.exp(-0.3)) ** 2
    assert known[1] == pytest.approx(math.log(1e-12 * density), rel=1e-3)


def test_log_sum_exp_keeps_infinite_values(spark):
    inf = float("inf")
    rows = [("a", -inf), ("a", 1.0), ("b", inf), ("b", 2.0), ("c", -inf), ("d", None), ("d", 0.0)]
    got = {r.k: (r.lse, r.n) for r in stats.logsumexp_by(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", sums={"n": F.lit(1)}).collect()}
    assert got["a"] == (pytest.approx(1.0), 2) and got["b"] == (inf, 2) and got["c"] == (-inf, 1) and got["d"] == (pytest.approx(0.0), 1)


def test_rows_outside_the_listed_levels_stay(spark):
    df = spark.createDataFrame([(1, 8, 0), (1, 13, 1)], "id int, year int, sep int")
    got = sorted(tuple(r) for r in reshape.complete(df, ["id"], year=[8, 9]).collect())
    assert got == [(1, 8, 0), (1, 9, None), (1, 13, 1)]
    rows = spark.createDataFrame([(1, "s", 8, 5), (1, "s", 13, 6)], "id int, school string, year int, x int")
    got = sorted(tuple(r) for r in panel.expand_grid(rows, ["id"], ["school"], [8, 9]).collect())
    assert got == [(1, "s", 8, 5), (1, "s", 9, None), (1, "s", 13, 6)]


def test_grid_combines_repeated_rows_before_the_shuffle(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("int")).otherwise(F.col("id") % 100).alias("id"),
                                   F.lit("s").alias("school"), F.when(F.col("id") % 3 == 0, 8).otherwise(F.col("id") % 5 + 8).cast("int").alias("year"),
                                   F.col("id").alias("x"))
    grid = panel.expand_grid(hot, ["id"], ["school"], [8, 9, 10, 11, 12])
    plan = grid._jdf.queryExecution().executedPlan().toString()
    first = plan.rindex("Exchange")
    # the year is unfolded at the end, and below the first exchange rows of a unit and year are one already
    assert plan.count("Exchange") == 2 and "partial_max" in plan[first:] and "collect" not in plan[first:] and "Generate" not in plan[first:]
    got = {(r.id, r.year): r.x for r in grid.collect()}
    assert len(got) == 5 * hot.select("id").distinct().count() and got[None, 8] == 2997 and got[None, 9] is None


def test_indices_are_wide_integers_and_lookups_are_broadcast(spark):
    df = spark.range(200).select(F.lit("o").alias("g"), (F.col("id") % 7).alias("k"), "id")
    for limit in (None, 0):
        got = index.row_index(df, ["g"], ["id"], limit=limit)
        assert dict(got.dtypes)["ii"] == "bigint" and got.agg(F.max("ii")).first()[0] == 200
    dense = index.dense_index(df, "k", "kk", ["g"])
    assert dict(dense.dtypes)["kk"] == "bigint"
    assert "BroadcastHashJoin" in dense._jdf.queryExecution().sparkPlan().toString()


def test_slots_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sizing, "GROUP_ROWS", 10)
    placed = index.in_order(spark.range(400).select(F.lit(1).alias("g"), "id"), ["g"], ["id"])
    assert placed.select("_slot").distinct().count() > sizing.slots_of(spark)


def test_uniform_of_large_keys(spark):
    keys = [5, 2**31 - 2, 2**31 + 5, 2**40 + 5, 2**62, -3]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(plain_uniform("k", seed=3)).collect()]
    assert len(set(got)) == len(keys) and all(0 < x < 1 for x in got)


def test_units_with_every_draw_on_a_common_key(spark):
    units = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "u int, o string")
    draws = spark.createDataFrame([(d, o) for d in range(130) for o in "ab"], "draw int, of string")
    for limit in (None, 0):
        got = sizing.with_every_draw(units, draws, 130, ["u"], ("o", "of"), broadcast_limit=limit, units_per_tile=7)
        assert got.count() == 13_000 and got.select("u", "draw").distinct().count() == 13_000
