"""Leave-one-out accuracy from pointwise log-likelihood draws, and what follows from it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import sizing, stats
from tidewave.operators.reshape import crossing, to_wide

# Log-ratios that a task holds before it hands its partial results on.
HELD_VALUES = 1_000_000


def is_loo(llk: DataFrame, keys: list[str], value: str = "llk") -> DataFrame:
    """Importance-sampling elpd per unit: log S minus log-sum-exp of the negated values."""
    neg = llk.withColumn("_neg", -F.col(value))
    out = stats.logsumexp_by(neg, keys, "_neg", "_lse", {"_n": F.lit(1)})
    return out.select(*keys, (F.log("_n") - F.col("_lse")).alias("elpd_loo"))


def gpd_fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto for sorted exceedances (Zhang & Stephens,
    2009), the shape drawn weakly to 0.5 as if ten more values had been seen."""
    n = len(x)
    grid = 30 + int(math.sqrt(n))
    quartile = x[int(n / 4 + 0.5) - 1]
    at = np.arange(1, grid + 1) - 0.5
    theta = 1.0 / x[-1] + (1.0 - np.sqrt(grid / at)) / (3.0 * quartile)
    shape = np.log1p(-theta[:, None] * x[None, :]).mean(axis=1)
    profile = n * (np.log(-theta / shape) - shape - 1.0)
    weight = np.exp(profile - profile.max())
    best = float((theta * weight).sum() / weight.sum())
    k = float(np.log1p(-best * x).mean())
    sigma = -k / best
    return (k * n + 5.0) / (n + 10.0), sigma


def smooth_tail(log_ratio: np.ndarray, cutoff: float) -> tuple[np.ndarray, float]:
    """Replace the sorted tail by expected order statistics of the fitted distribution."""
    top, m = log_ratio[-1], len(log_ratio)
    base = math.exp(cutoff - top)
    excess = np.exp(log_ratio - top) - base
    if m < 5 or log_ratio[0] == log_ratio[-1] or excess[int(m / 4 + 0.5) - 1] <= 0:
        return log_ratio, math.inf
    k, sigma = gpd_fit(excess)
    if not math.isfinite(k):
        return log_ratio, math.inf
    at = (np.arange(1, m + 1) - 0.5) / m
    spread = -np.log1p(-at) if k == 0 else np.expm1(-k * np.log1p(-at)) / k
    return np.minimum(np.log(base + sigma * spread), 0.0) + top, k


def tail_length(s: float, r_eff: float) -> int:
    return math.ceil(min(0.2 * s, 3 * math.sqrt(s / r_eff)))


def log_sum(x: np.ndarray) -> float:
    top = x.max(initial=-math.inf)
    return float(top + np.log(np.exp(x - top).sum())) if math.isfinite(top) else float(top)


def smoothed_elpd(values: np.ndarray, rest: float, n_rest: int, r_eff: float) -> tuple[float, float]:
    """elpd and shape k from the highest log-ratios of a unit and the log-sum of the others."""
    s = len(values) + n_rest
    values, m = np.sort(values), tail_length(s, r_eff)
    at = len(values) - m
    if at < 1 or not math.isfinite(values[-1]):
        return math.log(s) - np.logaddexp(log_sum(values), rest), math.inf
    body, tail = values[:at], values[at:]
    lw, k = smooth_tail(tail, float(body[-1]))
    top = np.logaddexp(math.log(s - m), log_sum(lw - tail))
    return float(top - np.logaddexp(np.logaddexp(rest, log_sum(body)), log_sum(lw))), k


def psis_loo(
    llk: DataFrame, keys: list[str], n_draws: int, r_eff: DataFrame | None = None, held: int = HELD_VALUES
) -> DataFrame:
    """Pareto-smoothed elpd and shape k per unit (Vehtari, Gelman & Gabry, 2017).

    ``llk`` has (keys, llk), a row per draw and no more than ``n_draws`` of a unit; ``r_eff`` has (keys, r_eff), 1 without it. Only the
    highest ratios of a unit are needed one by one, and of the others the log of their sum. Each task reduces its rows to that pair,
    pairs of a unit merge by keeping the highest again, and the unit x draw rows are read once.
    """
    rows = llk.select(*keys, (-F.col("llk")).alias("lr")).where("lr is not null")
    least = 1.0
    if r_eff is not None:
        # read for its minimum and by the units: written once
        r_eff = sizing.small(r_eff.select(*keys, "r_eff"))
        least = r_eff.agg(F.min("r_eff")).first()[0] or 1.0
    longest = tail_length(n_draws, least) + 1
    kinds = dict(llk.dtypes)
    key_part = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def reduced(values: np.ndarray, rest: float, n_rest: int) -> tuple[np.ndarray, float, int]:
        if len(values) <= longest:
            return values, rest, n_rest
        cut = len(values) - longest
        parted = np.partition(values, cut)
        return parted[cut:], float(np.logaddexp(rest, log_sum(parted[:cut]))), n_rest + cut

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units: dict[tuple, tuple[np.ndarray, float, int]] = {}

        def out() -> pd.DataFrame:
            made = [(*k, v.tolist(), rest, n) for k, (v, rest, n) in units.items()]
            return pd.DataFrame(made, columns=[*keys, "top", "rest", "n"])

        size = 0
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            lr = pdf["lr"].to_numpy()
            for at in pdf.groupby(keys, dropna=False, sort=False).indices.values():
                key = tuple(None if x is None or x != x else x for x in pdf.loc[at[0], keys].tolist())
                before = units.get(key, (np.empty(0), -math.inf, 0))
                units[key] = reduced(np.concatenate([before[0], lr[at]]), before[1], before[2])
                size += len(units[key][0]) - len(before[0])
            if size > held:
                yield out()
                units, size = {}, 0
        if units:
            yield out()

    partial = rows.mapInPandas(parts, f"{key_part}, top array<double>, rest double, n bigint")
    partial = partial.withColumn("r_eff", F.lit(1.0)) if r_eff is None else partial.join(r_eff, keys)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        state = np.empty(0), -math.inf, 0
        for top, rest, n in zip(pdf["top"], pdf["rest"], pdf["n"]):
            state = reduced(np.concatenate([state[0], top]), float(np.logaddexp(state[1], rest)), state[2] + int(n))
        elpd, k = smoothed_elpd(*state, float(pdf["r_eff"].iloc[0]))
        return pdf[keys].head(1).assign(elpd_loo=elpd, pareto_k=k)

    return partial.groupBy(*keys).applyInPandas(finish, f"{key_part}, elpd_loo double, pareto_k double")


def confusion(units: DataFrame, p: str, observed: str, weight: str | None = None) -> DataFrame:
    """Expected 2 x 2 table: each unit counts p towards its class and 1 - p to the other."""
    w = F.col(weight) if weight else F.lit(1)
    both = crossing(units, predicted=[0, 1])
    share = F.when(F.col("predicted") == F.col(observed), F.col(p)).when(
        F.col("predicted") != F.col(observed), 1 - F.col(p)
    )
    cells = both.groupBy("predicted", F.col(observed).alias("observed")).agg(
        F.sum(share * w).alias("n")
    )
    return to_wide(cells, ["predicted"], ["observed"], [0, 1], "n", prefix="observed_")


def prf(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class from a confusion table."""
    hit = F.sum(F.when(F.col("predicted") == 1, F.col("observed_1")))
    called = F.sum(F.when(F.col("predicted") == 1, F.col("observed_0") + F.col("observed_1")))
    actual = F.sum("observed_1")
    out = cells.agg(
        F.try_divide(hit, called).alias("precision"), F.try_divide(hit, actual).alias("recall")
    )
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), both))
