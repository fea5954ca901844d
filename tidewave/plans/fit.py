"""Maximum-likelihood and penalised fits that run as Spark aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import sizing


def _digamma_pair(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digamma and trigamma: recurrence up to 8, then the asymptotic series."""
    x = x.astype(float).copy()
    psi, tri = np.zeros_like(x), np.zeros_like(x)
    while (low := x < 8).any():
        psi[low] -= 1 / x[low]
        tri[low] += 1 / x[low] ** 2
        x[low] += 1
    r = 1 / (x * x)
    psi += np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))
    tri += 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))
    return psi, tri


def beta_newton(g1: np.ndarray, g2: np.ndarray, mean: np.ndarray, var: np.ndarray):
    """Solve the two score equations of the beta likelihood for many units at once.

    Also tells which units have converged.
    """
    size = np.maximum(mean * (1 - mean) / var - 1, 1e-3)
    a, b = mean * size, (1 - mean) * size
    for _ in range(200):
        pa, ta = _digamma_pair(a)
        pb, tb = _digamma_pair(b)
        ps, ts = _digamma_pair(a + b)
        fa, fb = pa - ps - g1, pb - ps - g2
        det = (ta - ts) * (tb - ts) - ts * ts
        da = (fa * (tb - ts) + fb * ts) / det
        db = (fb * (ta - ts) + fa * ts) / det
        na, nb = np.where(da < a, a - da, a / 2), np.where(db < b, b - db, b / 2)
        done = (np.abs(na - a) <= 1e-12 * a) & (np.abs(nb - b) <= 1e-12 * b)
        a, b = na, nb
        if done.all():
            break
    return a, b, done


def beta_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sufficient statistics and moments of the draws strictly between 0 and 1.

    Every unit stays; ``reason`` says why one cannot be fitted, and is null for the others.
    """
    x = F.when((F.col(value) > 0) & (F.col(value) < 1), F.col(value))
    moments = df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(F.log(x)).alias("g1"),
        F.avg(F.log1p(-x)).alias("g2"),
        F.avg(x).alias("mean"),
        F.var_samp(x).alias("var"),
    )
    reason = F.when(F.col("n") < 2, F.lit("fewer than two draws inside")).when(
        F.col("var") <= 1e-12, F.lit("no spread")
    )
    return moments.withColumn("reason", reason)


def beta_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Beta shapes per unit by moments, where the likelihood fit starts; null with a reason."""
    m, v = F.col("mean"), F.col("var")
    size = F.try_divide(m * (1 - m), v) - 1
    fits = F.col("reason").isNull()
    return beta_stats(df, keys, value).select(
        *keys, F.when(fits, m * size).alias("sep_alpha"), F.when(fits, (1 - m) * size).alias("sep_beta"), "reason"
    )


def beta_by_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Beta shapes per unit from the draws strictly between 0 and 1.

    Spark reduces each unit to its sufficient statistics; the score equations are solved
    on that one-row-per-unit table. Units without a fit keep null shapes and the reason.
    """
    stats = beta_stats(df, keys, value)
    kinds = dict(stats.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sep_alpha double, sep_beta double, reason string"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                fits = pdf["reason"].isna().to_numpy()
                a, b = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
                reason = pdf["reason"].to_numpy(object)
                if fits.any():
                    cols = [pdf[c].to_numpy(float)[fits] for c in ("g1", "g2", "mean", "var")]
                    a[fits], b[fits], done = beta_newton(*cols)
                    reason[fits] = np.where(done, None, "not converged")
                yield pdf[keys].assign(sep_alpha=a, sep_beta=b, reason=reason)

    fitted = stats.mapInPandas(solve, schema)
    return fitted.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("sep_alpha", "sep_beta")})


def design_matrix(table: pa.Table, features: list[str], category: str | None, levels: list) -> np.ndarray:
    """Columns: intercept, features, one indicator per level of the category."""
    columns = [np.ones(table.num_rows), *(np.asarray(table[c].to_numpy(zero_copy_only=False), float) for c in features)]
    if category:
        held = table[category].to_numpy(zero_copy_only=False)
        columns += [(held == v).astype(float) for v in levels]
    return np.stack(columns, 1)


@dataclass(frozen=True)
class LogitFit:
    """A penalised logistic regression: coefficients by term, and the score that is left at them."""

    terms: list[str]
    beta: np.ndarray
    score: np.ndarray
    features: list[str]
    category: str | None
    levels: list

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, float(b), float(g)) for t, b, g in zip(self.terms, self.beta, self.score)]
        return spark.createDataFrame(rows, "term string, estimate double, score double")

    def predictor(self) -> Column:
        """The linear predictor; a level that was not learned from has no effect."""
        value = F.lit(float(self.beta[0]))
        for name, b in zip(self.features, self.beta[1:]):
            value = value + F.lit(float(b)) * F.col(name)
        if self.category:
            effects = self.beta[1 + len(self.features):]
            pairs = [F.lit(x) for v, b in zip(self.levels, effects) for x in (v, float(b))]
            value = value + F.coalesce(F.create_map(*pairs)[F.col(self.category)], F.lit(0.0))
        return value


def step_sums(rows: DataFrame, beta: np.ndarray, label: str, features: list[str], category: str | None, levels: list, weight: str | None) -> np.ndarray:
    """Weight, score and information of the likelihood at ``beta``, as one aggregate over the rows.

    Tasks turn each batch into its few sums (terms squared), which Spark adds up place by place.
    """
    p = len(beta)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + p + p * p)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x = design_matrix(table, features, category, levels)
            y = np.asarray(table[label].to_numpy(zero_copy_only=False), float)
            w = np.asarray(table[weight].to_numpy(zero_copy_only=False), float) if weight else np.ones(len(y))
            eta = x @ beta
            mu = np.where(eta >= 0, 1 / (1 + np.exp(-np.abs(eta))), np.exp(-np.abs(eta)) / (1 + np.exp(-np.abs(eta))))
            total += np.concatenate([[w.sum()], x.T @ (w * (y - mu)), (x.T * (w * mu * (1 - mu)) @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    columns = [*dict.fromkeys([label, *features, *([category] if category else []), *([weight] if weight else [])])]
    parts = rows.select(*columns).mapInArrow(sums, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(1 + p + p * p)
    for at, value in parts.collect():
        out[at] = value
    return out


def fit_penalised_logit(
    rows: DataFrame, label: str, features: list[str], category: str | None = None, weight: str | None = None,
    penalty: float = 0.01, steps: int = 50, tolerance: float = 1e-12,
) -> LogitFit:
    """Iteratively reweighted least squares for mean log-loss + penalty / 2 * |beta|^2, the intercept free.

    A step is one Spark aggregate; only sums over terms reach the driver, and the number of terms (features and levels
    of the category, which are listed first) is what one machine has to hold squared. Rows with a null in label, feature or weight are left
    out. A step that would raise the score's size is halved, so separated data end at the penalised optimum as well.
    """
    used = [label, *features, *([category] if category else []), *([weight] if weight else [])]
    rows = rows.dropna(subset=list(dict.fromkeys(used)))
    levels = sorted(r[0] for r in rows.select(category).distinct().collect()) if category else []
    terms = ["intercept", *features, *(f"{category}={v}" for v in levels)]
    p = len(terms)
    ridge = np.full(p, penalty)
    ridge[0] = 0.0

    def at(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = step_sums(rows, beta, label, features, category, levels, weight)
        if sums[0] <= 0:
            raise ValueError("no rows to fit")
        score = sums[1:1 + p] / sums[0] - ridge * beta
        return score, sums[1 + p:].reshape(p, p) / sums[0] + np.diag(ridge)

    beta = np.zeros(p)
    score, information = at(beta)
    for _ in range(steps):
        if np.abs(score).max() < tolerance:
            break
        # the intercept has no penalty: with one outcome only its curvature may vanish
        move = np.linalg.solve(information + 1e-12 * np.eye(p), score)
        before = np.abs(score).max()
        for _ in range(8):
            new_score, new_information = at(beta + move)
            if np.abs(new_score).max() <= before or before < 1e-10:
                break
            move = move / 2
        beta, score, information = beta + move, new_score, new_information
        if np.abs(move).max() < tolerance:
            break
    return LogitFit(terms, beta, score, list(features), category, levels)


def imputation_fits(cells: DataFrame, penalty: float = 0.01) -> tuple[DataFrame, dict[str, LogitFit]]:
    """The gated cells and one regression per late wave, on the other wave (gated by its missing flag),
    involvement and school. Reads as many rows as there are distinct designs."""
    gated = cells.withColumns(
        {
            "_y12": (1 - F.col("m12")) * F.col("y12_c"),
            "_y11": (1 - F.col("m11")) * F.col("y11_c"),
            "_s2": (F.col("school_involvement") == 2).cast("double"),
            "_s3": (F.col("school_involvement") == 3).cast("double"),
        }
    )
    # every step reads its input again: give it a written table
    gated = sizing.cut_lineage(gated)
    fits = {}
    for own, other in (("11", "12"), ("12", "11")):
        known = gated.where(F.col(f"m{own}") == 0).withColumn("_y", F.col(f"y{own}").cast("double"))
        fits[own] = fit_penalised_logit(known, "_y", [f"_y{other}", f"m{other}", "_s2", "_s3"], "kk_slot", "n", penalty)
    return gated, fits


def fit_logit(cells: DataFrame, penalty: float = 0.01) -> DataFrame:
    """Point-estimate replacement for the imputation model: one l11 and l12 per weighted design cell. Not a posterior."""
    gated, fits = imputation_fits(cells, penalty)
    return gated.withColumns({f"l{own}": f.predictor() for own, f in fits.items()}).select(*cells.columns, "l11", "l12")


def fit_scores(cells: DataFrame, penalty: float = 0.01) -> DataFrame:
    """(wave, term, score): the penalised score at the estimates, which is zero at the optimum."""
    _, fits = imputation_fits(cells, penalty)
    tables = [f.table(cells.sparkSession).withColumn("wave", F.lit(int(own))) for own, f in fits.items()]
    return tables[0].unionByName(tables[1]).select("wave", "term", "score")
