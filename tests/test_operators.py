"""Edge cases and properties on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import scalar as sc
from tidewave.operators import draws as D
from tidewave.operators import index, panel, reshape, sizing, stats
from tidewave.plans import corr, counterfactual, diag, fit, impute, loo, ordinal, predict, quality


def value(df):
    return df.first()[0]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_links_stay_finite(spark):
    got = one(spark, sc.inv_logit(F.lit(800.0)), sc.inv_logit(F.lit(-800.0)),
              sc.softplus(F.lit(800.0)), sc.log_inv_logit(F.lit(-800.0)))
    assert list(got) == [1.0, 0.0, 800.0, -800.0]


def test_if_else_is_null_for_null_condition(spark):
    cond = F.lit(None).cast("boolean")
    assert one(spark, sc.if_else_strict(cond, F.lit(1), F.lit(0)))[0] is None


def test_row_mean_is_null_strict(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(sc.row_mean_strict(["a", "b"])).collect()] == [1.5, None]


def test_monotonic_effect(spark):
    z = F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)])
    got = one(spark, *[sc.mo(z, F.lit(t)) for t in range(5)])
    assert np.allclose(list(got), [0, 0.4, 1.2, 2.4, 4.0])


def test_formats(spark):
    got = one(spark, *[sc.fmt_corr(F.lit(x)) for x in (1.0, 0.381, -0.129, -0.001)])
    assert list(got) == ["-", ".38", "-.13", "-.00"]


@pytest.mark.parametrize("uniform", [sc.hash_uniform, sc.plain_uniform])
def test_uniforms_look_uniform(spark, uniform):
    rows = spark.range(1, 401).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(100))))
    df = rows.select("id", "k", uniform("id", "k", seed=7).alias("u")).toPandas()
    u = df.sort_values(["id", "k"])["u"].to_numpy()
    assert 0 < u.min() and u.max() < 1
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02


def test_safe_corr_edge_cases(spark):
    df = spark.createDataFrame(
        [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("none", None, 1.0),
         ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", 3.0, None)], "g string, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(stats.safe_corr("x", "y").alias("r")).collect()}
    assert got["one"] is None and got["flat"] is None and got["none"] is None
    assert math.isclose(got["ok"], 1.0)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_rank_selection_equals_percentile(spark, partitions):
    rng = np.random.default_rng(3)
    rows = [("big", float(x)) for x in rng.normal(size=500)]
    rows += [("ties", float(x)) for x in rng.integers(0, 4, 301)]
    rows += [("single", 2.5), ("pair", 1.0), ("pair", 4.0), ("null", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(partitions)
    small = {r.g: tuple(r)[1:] for r in stats.interval_by(df, ["g"], "x", bound=1000).collect()}
    large = {r.g: tuple(r)[1:] for r in
             stats.quantiles_by(df, ["g"], "x", [0.5, 0.025, 0.975], ["a", "b", "c"], limit=0,
                                slots=5).collect()}
    counted = {r.g: tuple(r)[1:] for r in
               stats.interval_by(df, ["g"], "x", bound=1000, repeats=True).collect()}
    assert set(small) == set(large) == set(counted) == {"big", "ties", "single", "pair"}
    for g in small:
        assert np.allclose(small[g], large[g], atol=1e-12)
        assert np.allclose(small[g], counted[g], atol=1e-12)
        x = np.array([v for k, v in rows if k == g])
        assert np.allclose(small[g], np.quantile(x, [0.5, 0.025, 0.975]))


def test_ranged_row_index_with_a_hot_group(spark):
    rows = [("hot", i) for i in range(700)] + [(f"g{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    for by in (["g"], []):
        got = index.row_index(df, by, ["g", "v"] if not by else ["v"], "n", limit=0, slots=7)
        pdf = got.toPandas().sort_values(["g", "v"])
        want = pdf.groupby("g").cumcount() + 1 if by else np.arange(1, len(pdf) + 1)
        assert (pdf["n"].to_numpy() == np.asarray(want)).all()


def test_dense_index_keeps_null(spark):
    df = spark.createDataFrame([(5,), (None,), (2,), (5,)], "k int")
    got = {r.k: r.n for r in index.dense_index(df, "k", "n", limit=0).collect()}
    assert got == {2: 1, 5: 2, None: None}


def test_previous_row_over_block_borders(spark):
    df = spark.range(1, 24).select(F.lit(1).alias("c"), F.col("id").alias("p"),
                                   (F.col("id") * 10).alias("v"))
    got = index.previous_row(df, ["c"], "p", "v", "before", block=5).orderBy("p").collect()
    assert [r.before for r in got] == [None] + [10 * i for i in range(1, 23)]


def test_trim_and_carry_for_every_missing_pattern(spark):
    rows, kept, filled = [], {}, {}
    for u, pattern in enumerate(itertools.product([True, False], repeat=5)):
        rows += [(u, 8 + i, m, None if m else float(i + 1)) for i, m in enumerate(pattern)]
        first = pattern.index(False) if False in pattern else 5
        kept[u] = list(range(8 + first, 13))
        last, out = 0.0, []
        for i in range(5):
            last = last if pattern[i] else float(i + 1)
            out.append(last)
        filled[u] = out
    df = spark.createDataFrame(rows, "id int, year int, missing boolean, x double")
    trimmed = panel.trim_leading(df, "id", "year", "missing").toPandas()
    for u in kept:
        assert sorted(trimmed[trimmed.id == u].year) == kept[u]
    carried = panel.locf(df, "id", "year", ["x"]).toPandas().sort_values(["id", "year"])
    for u in filled:
        assert list(carried[carried.id == u].x) == filled[u]


def test_expand_grid(spark):
    df = spark.createDataFrame([(1, 7, 8, 5), (1, 7, 10, None), (2, 9, 12, 3)],
                               "id int, school int, year int, a int")
    got = panel.expand_grid(df, ["id"], ["school"], [8, 9, 10, 11, 12]).toPandas()
    assert len(got) == 10 and set(got[got.id == 2].school) == {9}
    assert got.a.notna().sum() == 2


@pytest.mark.parametrize("limit", [10, 0])
def test_every_unit_meets_every_draw_once(spark, limit):
    units = spark.range(1, 41).withColumnRenamed("id", "u")
    draws = spark.range(1, 201).withColumnRenamed("id", "draw")
    got = sizing.with_every_draw(units, draws, 200, ["u"], broadcast_limit=1000 if limit else 0,
                                 units_per_tile=7)
    assert got.count() == 8000 and got.distinct().count() == 8000


def test_recode_and_stack(spark):
    df = spark.createDataFrame([(1,), (3,)], "x int")
    got = {r.x: (r.n, r.n_level) for r in reshape.recode(df, "x", {1: "a", 2: "b"}, "n").collect()}
    assert got == {1: ("a", 1), 3: (None, None)}
    both = reshape.stack(df, df.withColumn("y", F.lit(2)))
    assert both.columns == ["x", "y"] and both.where("y is null").count() == 2


def test_logsumexp(spark):
    rows = [("a", 1000.0), ("a", 999.0), ("b", -1000.0), ("b", -1000.0), ("c", 5.0), ("c", -700.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.lse for r in stats.logsumexp_by(df, ["g"], "x").collect()}
    assert math.isclose(got["a"], 1000 + math.log1p(math.exp(-1)))
    assert math.isclose(got["b"], -1000 + math.log(2)) and math.isclose(got["c"], 5.0)


def test_category_probabilities_sum_to_one(spark):
    eta, cuts = F.lit(0.3), [F.lit(c) for c in (-1.0, 0.0, 0.5, 2.0)]
    p = np.array(list(one(spark, *ordinal.category_probs(eta, cuts))))
    assert (p > 0).all() and math.isclose(p.sum(), 1.0)
    df = spark.range(1).select(F.array(*cuts).alias("c"), F.lit(0.3).alias("eta"),
                               F.explode(F.sequence(F.lit(1), F.lit(5))).alias("y"))
    llk = [r.llk for r in ordinal.loglik_known(df).orderBy("y").collect()]
    assert np.allclose(np.exp(llk), p)


def test_change_probabilities(spark):
    p, q = np.array([0.1, 0.2, 0.3, 0.25, 0.15]), np.array([0.3, 0.3, 0.2, 0.1, 0.1])
    df = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    got = list(df.select(*counterfactual.change("p", "q")).first())
    both = np.outer(p, q)
    want = [np.triu(both, 1).sum(), np.trace(both), np.tril(both, -1).sum()]
    assert np.allclose(got, want) and math.isclose(sum(got), 1.0)


def test_cholesky_product_has_unit_diagonal(spark):
    r = 0.6
    rows = [(1, 1, 1, 1.0), (1, 1, 2, 0.0), (1, 2, 1, r), (1, 2, 2, math.sqrt(1 - r * r))]
    df = spark.createDataFrame(rows, "draw int, i int, k int, v double")
    got = {(x.i, x.j): x.r for x in D.corr_from_chol(df, ["draw"]).collect()}
    assert math.isclose(got[1, 1], 1) and math.isclose(got[2, 2], 1) and math.isclose(got[1, 2], r)


def test_sampled_categories_follow_probabilities(spark):
    p = [0.1, 0.2, 0.3, 0.25, 0.15]
    rows = spark.range(20000).select("id", F.posexplode(F.array(*[F.lit(x) for x in p])))
    rows = rows.select("id", (F.col("pos") + 1).alias("y"), F.col("col").alias("p"))
    got = predict.sample_rows(rows, ["id"], sc.hash_uniform("id", seed=1)).groupBy("y_pred").count()
    share = {r.y_pred: r["count"] / 20000 for r in got.collect()}
    assert all(abs(share[i + 1] - x) < 0.015 for i, x in enumerate(p))


def test_treatment_rules(spark):
    rows = [(1, 11, 0), (1, 12, 0), (2, 11, 1), (3, 12, 0), (4, 9, 1), (5, 11, None), (5, 12, 1)]
    df = spark.createDataFrame(rows, "id int, year int, sep int").withColumns(
        {"school": F.lit(1), "school_involvement": F.lit(1)})
    got = {r.id: r.sep for r in impute.treatment(df).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None, 5: 1}
    assert [r.id for r in impute.units_without_late_wave(df).collect()] == [4]


def test_beta_fit_recovers_shapes(spark):
    rng = np.random.default_rng(5)
    shapes = {1: (2.0, 5.0), 2: (0.7, 0.9)}
    rows = [(k, float(x)) for k, (a, b) in shapes.items() for x in rng.beta(a, b, 4000)]
    rows += [(3, 0.5), (4, 0.0), (4, 1.0), (5, 0.25), (5, 0.25)]
    df = spark.createDataFrame(rows, "g int, p double")
    found = fit.beta_by_group(df, ["g"], "p").collect()
    got = {r.g: (r.sep_alpha, r.sep_beta) for r in found}
    reasons = {r.g: r.reason for r in found}
    assert reasons == {1: None, 2: None, 3: "fewer than two draws inside", 4: "fewer than two draws inside", 5: "no spread"}
    assert all(got[g] == (None, None) for g in (3, 4, 5))
    for k, want in shapes.items():
        assert np.allclose(got[k], want, rtol=0.1)
        x = np.array([v for g, v in rows if g == k])
        psi = fit._digamma_pair(np.array([got[k][0], got[k][1], sum(got[k])]))[0]
        assert abs(psi[0] - psi[2] - np.log(x).mean()) < 1e-9


def ess_by_hand(x):
    """x: chains x iterations."""
    m, n = x.shape
    c = x - x.mean(axis=1, keepdims=True)
    acov = np.array([(c[:, : n - t] * c[:, t:]).sum(axis=1).mean() / n for t in range(n)])
    plus = acov[0] + (x.mean(axis=1).var(ddof=1) if m > 1 else 0)
    rho = 1 - (acov[0] * n / (n - 1) - acov) / plus
    rho[0] = 1
    total, low, k = 0.0, math.inf, 0
    while 2 * k + 1 < n and rho[2 * k] + rho[2 * k + 1] > 0:
        low = min(low, rho[2 * k] + rho[2 * k + 1])
        total += low
        k += 1
    end = max(rho[2 * k], 0) if 2 * k + 1 < n else 0
    return m * n / max(-1 + 2 * total + end, 1 / math.log10(m * n))


def test_effective_size_for_short_blocks_and_few_lags(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.zeros((2, 300))
    for t in range(1, 300):
        x[:, t] = 0.8 * x[:, t - 1] + rng.normal(size=2)
    rows = [("a", c + 1, t + 1, float(x[c, t])) for c in range(2) for t in range(300)]
    df = spark.createDataFrame(rows, "p string, chain int, iteration int, estimate double")
    want = ess_by_hand(x)
    monkeypatch.setattr(diag, "LAG_BLOCK", 37)
    assert math.isclose(value(diag.effective_size(df, ["p"], 300, 2).select("n_eff")), want, rel_tol=1e-6)
    few = diag.effective_size(df, ["p"], 300, 2, first_lags=4)
    assert math.isclose(value(few.select("n_eff")), want, rel_tol=1e-6)
    cut = diag.autocovariance(df, ["p"], "estimate", 300, 50, block=37).orderBy("lag").collect()
    c = x - x.mean(axis=1, keepdims=True)
    for r in cut:
        assert math.isclose(r.acov, (c[:, : 300 - r.lag] * c[:, r.lag:]).sum() / 600, abs_tol=1e-9)


def test_psis_is_close_to_the_closed_form(spark):
    rng = np.random.default_rng(11)
    y = rng.normal(size=12)
    n, s = len(y), 4000
    post = rng.normal(y.sum() / (n + 1), math.sqrt(1 / (n + 1)), s)
    llk = -0.5 * math.log(2 * math.pi) - 0.5 * (y[:, None] - post[None, :]) ** 2
    rows = [(i, d, float(llk[i, d])) for i in range(n) for d in range(s)]
    df = spark.createDataFrame(rows, "unit int, draw int, llk double")
    got = {r.unit: r for r in loo.psis_loo(df, ["unit"], s).collect()}
    # parts handed on early, and a table whose units lie in all tasks, merge to the same
    spread = df.repartition(7, "draw")
    for r in loo.psis_loo(spread, ["unit"], s, held=50).collect():
        assert math.isclose(r.elpd_loo, got[r.unit].elpd_loo, rel_tol=1e-12) and math.isclose(r.pareto_k, got[r.unit].pareto_k, rel_tol=1e-9)
    plan = loo.psis_loo(df, ["unit"], s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    plain = {r.unit: r.elpd_loo for r in loo.is_loo(df, ["unit"]).collect()}
    for i in range(n):
        rest = np.delete(y, i)
        mean, var = rest.sum() / n, 1 / n + 1
        want = -0.5 * math.log(2 * math.pi * var) - 0.5 * (y[i] - mean) ** 2 / var
        assert abs(got[i].elpd_loo - want) < 0.05 and got[i].pareto_k < 0.7
        assert math.isclose(plain[i], -math.log(np.exp(-llk[i]).mean()), rel_tol=1e-9)


def test_confusion_and_scores(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (0.0, 1), (1.0, 0)], "p double, sep int")
    cells = loo.confusion(df, "p", "sep")
    got = loo.prf(cells).first()
    assert math.isclose(got.precision, 1.0) and math.isclose(got.recall, 2 / 3)
    assert math.isclose(got.f1, 0.8)


def test_between_skips_wave_gaps(spark):
    rows = [(i, 1, 8, "a", i) for i in range(1, 6)] + [(i, 1, 10, "a", 6 - i) for i in range(1, 6)]
    rows += [(i, 1, 11, "a", 6 - i) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "id int, school int, year int, outcome string, response int")
    wide = corr.wide_scores(df, ["a"])
    # wave 8 has no next wave, so its correlation, and with it the mean, is null
    assert corr.between(wide, ["a"]).first().r is None
    late = corr.between(wide.where("year >= 10"), ["a"], last=11).first().r
    assert math.isclose(late, 1.0)


def test_design_check_reports_two_schools(spark):
    rows = [(1, 1, 1, 8, "oa", 1, 3), (1, 2, 2, 9, "oa", 1, 6)]
    df = spark.createDataFrame(
        rows, "id int, school int, school_involvement int, year int, outcome string, item int, y int")
    got = {r.rule: r.violations for r in quality.check_design(df, 5).collect()}
    assert got["one_school_per_id"] == 1 and got["y_in_range"] == 1 and got["key_is_unique"] == 0


def test_offsets_of_ranged_slots_are_broadcast(spark):
    """Rows whose number nobody reads are not dealt once more, whatever Spark thinks of the sizes."""
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = index.row_index(df, ["g"], ["id"], "n", limit=0, slots=7)
        plan = rows.drop("n")._jdf.queryExecution().executedPlan().toString()
        got = {(r.g, r.id): r.n for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got == {(i % 2, i): i // 2 + 1 for i in range(3000)}
