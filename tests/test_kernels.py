"""Matrix kernels, fits, chains of unequal length and workspaces."""

import os

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewave.functions.scalar import MODULI, plain_uniform
from tidewave.operators import blocks
from tidewave.plans import diag, fit, kernels, predict
from tidewave.queries import QUERIES
from tidewave.sources import io


def test_both_ways_to_meet_the_draws(spark):
    units = spark.createDataFrame([(u, "ab"[u % 2], float(u)) for u in range(50)], "u int, o string, x double")
    draws = spark.createDataFrame([(d, o, [float(d), 1.0 if o == "a" else 2.0]) for d in range(30) for o in "abc"], "draw int, o string, e array<double>")

    def kernel(some, held):
        value = np.outer(held["e"][:, 0] * held["e"][:, 1], some["x"])
        return {"o": np.full(len(held["draw"]), some["o"][0], object), "draw": held["draw"], "s": value.sum(axis=1), "n": np.full(len(value), value.shape[1])}

    want = {(o, d): d * (1 if o == "a" else 2) * sum(u for u in range(50) if "ab"[u % 2] == o) for d in range(30) for o in "ab"}
    for limits in ({}, {"broadcast_bytes": 0, "tile_rows": 8, "block_draws": 7}):
        parts = blocks.over_draws(units, draws, kernel, "o string, draw int, s double, n bigint", on="o", **limits)
        got = {(r.o, r.draw): (r.s, r.n) for r in parts.groupBy("o", "draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
        assert {k: v[0] for k, v in got.items()} == want and {v[1] for v in got.values()} == {25}
        empty = blocks.over_draws(units.limit(0), draws, kernel, "o string, draw int, s double, n bigint", on="o", **limits)
        assert empty.count() == 0


def test_bytes_of_a_draws_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [[1.0], [2.0, 3.0]])] * 4, "draw int, a array<double>, b array<array<double>>")
    assert blocks.rows_and_bytes(df) == (4, 4 * 8 * 6)


def test_uniforms_are_those_of_the_column_function(spark):
    draws, keys = [1, 2, 2000, 2**31 + 5], [1, 7, 2**31 - 2, 2**40 + 5, 2**62]
    rows = spark.createDataFrame([(d, k) for d in draws for k in keys], "d long, k long")
    want = {(r.d, r.k): r.u for r in rows.select("d", "k", plain_uniform("d", "k", seed=20).alias("u")).collect()}
    got = kernels.plain_uniforms(np.array(draws), np.array(keys), 20)
    assert all(got[i, j] == want[d, k] for i, d in enumerate(draws) for j, k in enumerate(keys))


def random_students(rng, n, d):
    draws = {"draw": np.arange(d), "c": np.sort(rng.normal(size=(d, 4)), axis=1), "b_time": rng.normal(size=d), "mo": rng.random((d, 5)),
             "b_sep": rng.normal(size=(d, 5)), "b_j_1": rng.normal(size=(d, 6)), "b_j_2": rng.normal(size=(d, 6)), "x_sep": rng.random((d, 6)), "b_k_1": rng.normal(size=(d, 3))}
    units = {"jj_slot": rng.integers(1, 7, n), "kk_slot": rng.integers(1, 4, n), "x_time": rng.integers(0, 5, n)}
    return units, draws


def logistic(x):
    return 1 / (1 + np.exp(-x))


def category_probs(units, draws, u, d, sep):
    j, k, t = units["jj_slot"][u] - 1, units["kk_slot"][u] - 1, units["x_time"][u]
    eta = draws["b_j_1"][d, j] + draws["b_k_1"][d, k] + (draws["b_time"][d] + draws["b_j_2"][d, j]) * draws["mo"][d, t]
    w = draws["x_sep"][d, j] if sep is None else sep
    def probs(x):
        above = [1.0, *logistic(x - draws["c"][d]), 0.0]
        return np.array(above[:-1]) - np.array(above[1:])
    return w * probs(eta + draws["b_sep"][d, t]) + (1 - w) * probs(eta)


def test_likelihood_of_cells():
    rng = np.random.default_rng(4)
    units, draws = random_students(rng, 9, 5)
    for y in range(1, 6):
        for s in "01u":
            units[f"n_{y}_{s}"] = rng.integers(0, 3, 9)
    draws["x_sep"][0, 0], draws["x_sep"][1, 0] = 0.0, 1.0
    got = kernels.student_loglik(units, draws)
    for d in range(5):
        want = sum(units[f"n_{y}_{s}"][u] * np.log(category_probs(units, draws, u, d, known)[y - 1])
                   for u in range(9) for y in range(1, 6) for s, known in (("0", 0), ("1", 1), ("u", None)))
        assert got["llk"][d] == pytest.approx(want, rel=1e-9)
    # tied thresholds leave the second category no room: only where somebody chose it
    draws["c"][0, 1] = draws["c"][0, 0]
    assert kernels.student_loglik(units, draws)["llk"][0] == -np.inf
    for s in "01u":
        units[f"n_2_{s}"][:] = 0
    assert np.isfinite(kernels.student_loglik(units, draws)["llk"]).all()


def test_predictive_counts_against_single_draws():
    rng = np.random.default_rng(6)
    units, draws = random_students(rng, 12, 40)
    units |= {"jj": np.arange(12), "sep": np.array([None, 0.0, 1.0] * 4, object), "_ii": np.array([np.arange(3 * u, 3 * u + 1 + u % 3) for u in range(12)], object)}
    got = kernels.predictive_counts(["jj"], seed=20)(units, draws)
    found = {(int(j), int(t)): int(n) for j, t, n in zip(got["jj"], got["total"], got["n"])}
    want = {}
    for u in range(12):
        uniforms = kernels.plain_uniforms(draws["draw"], units["_ii"][u], 20)
        for d in range(40):
            run = np.cumsum(category_probs(units, draws, u, d, units["sep"][u]))[:4]
            total = sum(1 + int((run < x).sum()) for x in uniforms[d])
            want[u, total] = want.get((u, total), 0) + 1
    assert found == want


def test_whole_numbers_compare_as_their_uniforms_do():
    rng = np.random.default_rng(7)
    h = np.concatenate([[0, 1, MODULI[3] - 2, MODULI[3] - 1], rng.integers(0, MODULI[3], 5000)])
    u = kernels.uniform_of(h)
    # a category is passed where its probability is below the uniform, not at it
    assert (kernels.first_above(u) == h + 1).all() and (kernels.first_above(np.nextafter(u, 0)) == h).all()
    assert (kernels.first_above(np.nextafter(u, 1)) == h + 1).all()
    assert kernels.first_above(np.array([0.0, 1.0, 1.5, np.nan])).tolist() == [0, MODULI[3], MODULI[3], MODULI[3]]


def test_predictive_counts_of_many_draws_and_sizes():
    rng = np.random.default_rng(8)
    sizes = [1, 1, 2, 5, 15, 16, 17, 64, 70, 1, 3, 2]
    units, draws = random_students(rng, len(sizes), 2500)
    draws["x_sep"][3:9] = np.nan
    draws["b_j_1"][::50] = 800.0
    starts = np.array([0, 5, 2**31 - 10, 2**40, 9, 100, 300, 2**62, 1000, -4, 77, 88])
    lists = np.empty(len(sizes), object)
    lists[:] = [np.arange(a, a + n) for a, n in zip(starts, sizes)]
    units |= {"jj": np.arange(len(sizes)), "sep": np.array([None, 0.0, 1.0] * 4, object), "_ii": lists}
    got = kernels.predictive_counts(["jj"], seed=20)(units, draws)
    found = {(int(j), int(t)): int(n) for j, t, n in zip(got["jj"], got["total"], got["n"])}
    assert len(found) == len(got["n"]) and (got["n_items"] == np.array(sizes)[got["jj"]]).all()
    want = {}
    for u in range(len(sizes)):
        eta_0, eta_1, share = (x[:, 0] for x in kernels.student_predictors({k: units[k][u:u + 1] for k in ("jj_slot", "kk_slot", "x_time")}, draws))
        w = share if units["sep"][u] is None else units["sep"][u]
        uniforms = kernels.plain_uniforms(draws["draw"], lists[u], 20)
        total = np.full(len(eta_0), sizes[u])
        for c in draws["c"].T:
            total += ((w * kernels.inv_logit(c - eta_1) + (1 - w) * kernels.inv_logit(c - eta_0))[:, None] < uniforms).sum(axis=1)
        for t, n in zip(*np.unique(total, return_counts=True)):
            want[u, int(t)] = int(n)
    assert found == want


def test_probabilities_are_worked_out_once_a_design(monkeypatch):
    seen = []
    plain = kernels.student_predictors
    monkeypatch.setattr(kernels, "student_predictors", lambda some, draws: seen.append(len(some["x_time"]) * len(draws["draw"])) or plain(some, draws))
    rng = np.random.default_rng(3)
    units, draws = random_students(rng, 600, 5000)
    units = pa.table({k: pa.array(v % 2 + 1) for k, v in units.items()} | {"sep": pa.array([None, 0.0, 1.0] * 200), "jj": pa.array(range(600)), "_ii": pa.array([[u] for u in range(600)])})
    kinds = pa.schema({"jj": pa.int64(), "n_items": pa.int32(), "total": pa.int32(), "n": pa.int64()})
    parts = blocks.run_kernel(kernels.predictive_counts(["jj"], 20), iter([(None, units, draws)]), kinds.names, kinds, None, None, predict.UNITS_AT_ONCE)
    assert sum(sum(p["n"].to_pylist()) for p in parts) == 600 * 5000
    # before: anew for every 50 units, 12 times as often
    assert sum(seen) == 24 * 5000


def test_predictive_check_in_tiles_and_blocks(spark, monkeypatch):
    want = sorted(map(tuple, QUERIES["posterior_predictive_cases"](spark, SF).collect()), key=str)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300_000)
    got = QUERIES["posterior_predictive_cases"](spark, SF)
    assert "CoGroup" in got._jdf.queryExecution().optimizedPlan().toString()
    assert want and sorted(map(tuple, got.collect()), key=str) == want


def test_dropout_kernels_agree_with_a_loop():
    rng = np.random.default_rng(9)
    names = ["a", "b"]
    units = {"id": np.arange(7), "year": rng.integers(9, 13, 7), "jj_slot": rng.integers(1, 4, 7), "kk_slot": rng.integers(1, 3, 7),
             "y": rng.integers(0, 2, 7), "y_prev": rng.integers(0, 2, 7), "a_prev": rng.normal(size=7), "b_prev": rng.normal(size=7)}
    draws = {"draw": np.arange(5), "b_0": rng.normal(size=5), "b_1": rng.normal(size=5), "b_x": rng.normal(size=(5, 2)),
             "b_year": rng.normal(size=(5, 4)), "b_j": rng.normal(size=(5, 3)), "b_k": rng.normal(size=(5, 2, 4))}
    alpha = np.array([[draws["b_0"][d] + draws["b_j"][d, units["jj_slot"][u] - 1] + draws["b_year"][d, units["year"][u] - 9]
                       + draws["b_k"][d, units["kk_slot"][u] - 1, units["year"][u] - 9] + draws["b_1"][d] * units["y_prev"][u]
                       + sum(draws["b_x"][d, i] * units[f"{n}_prev"][u] for i, n in enumerate(names)) * (1 - units["y_prev"][u])
                       for u in range(7)] for d in range(5)])
    llk = units["y"] * np.log(logistic(alpha)) + (1 - units["y"]) * np.log(1 - logistic(alpha))
    assert np.allclose(kernels.dropout_by_draw(names)(units, draws)["llk"], llk.sum(axis=1))
    rows = kernels.dropout_by_row(names)(units, draws)
    assert np.allclose(rows["p"], logistic(alpha).sum(axis=0)) and np.allclose(rows["alpha"], alpha.sum(axis=0))


def test_draws_never_unfold_with_the_units(spark):
    for name in ("loglik_students", "dropout_loglik_by_draw", "dropout_risk_by_row", "posterior_predictive_summary"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "_block" not in plan and "CartesianProduct" not in plan


def test_penalised_logit(spark):
    rng = np.random.default_rng(2)
    n = 600
    x, g, w = rng.normal(size=n), rng.integers(1, 4, n), rng.integers(1, 5, n)
    y = (rng.random(n) < logistic(0.4 + 1.3 * x - 0.5 * (g == 2))).astype(float)
    rows = [(float(a), int(b), float(c), int(d)) for a, b, c, d in zip(x, g, y, w)] + [(None, 1, 1.0, 1), (1.0, 2, None, 1)]
    df = spark.createDataFrame(rows, "x double, g int, y double, w int").repartition(5)
    found = fit.fit_penalised_logit(df, "y", ["x"], "g", "w", 0.01)
    assert found.terms == ["intercept", "x", "g=1", "g=2", "g=3"] and np.abs(found.score).max() < 1e-10
    z = np.stack([np.ones(n), x, g == 1, g == 2, g == 3], 1).astype(float)
    beta = np.zeros(5)
    for _ in range(20000):
        beta += 1.0 * (z.T @ (w * (y - logistic(z @ beta))) / w.sum() - np.array([0, 0.01, 0.01, 0.01, 0.01]) * beta)
    assert np.allclose(found.beta, beta, atol=1e-6)
    scored = df.where("x is not null").withColumn("eta", found.predictor()).collect()
    assert all(r.eta == pytest.approx(found.beta[0] + found.beta[1] * r.x + found.beta[1 + r.g]) for r in scored)
    unseen = spark.createDataFrame([(0.0, 9)], "x double, g int").select(found.predictor().alias("eta")).first().eta
    assert unseen == pytest.approx(found.beta[0])
    # separated outcomes have an optimum because of the penalty
    split = spark.createDataFrame([(float(v), 1.0 if v > 0 else 0.0) for v in range(-5, 6)], "x double, y double")
    assert np.abs(fit.fit_penalised_logit(split, "y", ["x"], penalty=0.001).score).max() < 1e-9
    with pytest.raises(ValueError):
        fit.fit_penalised_logit(split.limit(0), "y", ["x"])


def test_chains_of_unequal_length(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=(4, 501)), axis=1) * 0.1 + rng.normal(size=(4, 501))
    lengths = (501, 501, 500, 501)
    rows = [("a", c + 1, t + 1, float(x[c, t])) for c in range(4) for t in range(lengths[c])]
    df = spark.createDataFrame(rows, "p string, chain int, iteration int, estimate double")
    shape = diag.chain_shape(df)
    assert shape == (500, 4)
    same = df.where("iteration <= 500")
    for f in (lambda d: diag.effective_size(d, ["p"], *shape), lambda d: diag.rhat(d, ["p"], shape[0])):
        assert f(df).collect() == f(same).collect()
    whole = diag.summary(df, ["p"], *shape).first()
    assert whole["mean"] == pytest.approx(np.mean([r[3] for r in rows]))
    with pytest.raises(ValueError):
        diag.chain_shape(df.where("not (chain = 2 and iteration = 17)"))


def files_in(folder):
    folder = folder.removeprefix("file:")
    return [f for _, _, names in os.walk(folder) for f in names] if os.path.isdir(folder) else []


def test_workspace_leaves_the_shared_folder_empty(spark):
    with io.workspace(spark):
        base = io.shared_folder(spark)
        with io.workspace(spark) as inner:
            assert QUERIES["is_loo"](spark, SF).count() > 0 and QUERIES["io_draws_all"](spark, SF).count() > 0
            assert files_in(inner)
        assert not files_in(base) and not os.path.exists(inner.removeprefix("file:"))
        for _ in range(3):
            with pytest.raises(ZeroDivisionError), io.workspace(spark) as inner:
                assert io.new_folder(spark, "x").startswith(io.shared_folder(spark))
                spark.range(5).write.parquet(io.new_folder(spark, "x"))
                1 / 0
            assert not files_in(base)
        assert io.shared_folder(spark).count("/") <= base.count("/") + 1
    assert not files_in(base)
