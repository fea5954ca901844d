"""Sampler diagnostics as tables: summaries, R-hat, effective size, sampler health."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators import index, sizing, stats

LAG_BLOCK = 65_536
FIRST_LAGS = 512


def chain_shape(draws: DataFrame) -> tuple[int, int]:
    """(iterations, chains) that the diagnostics use: all chains, as long as the shortest.

    The diagnostics compare chains position by position, so a longer chain is cut: they leave out every row with a
    later iteration. Means and quantiles of ``summary`` take all rows. Iterations have to be numbered from 1 without gaps in
    every chain, for a gap would shift all lags behind it; anything else raises.
    """
    chains = draws.groupBy("chain").agg(
        F.count_distinct("iteration").alias("n"), F.min("iteration").alias("first"), F.max("iteration").alias("last")
    ).collect()
    bad = sorted(r.chain for r in chains if r.first != 1 or r.last != r.n)
    if bad:
        raise ValueError(f"iterations of chains {bad} are not numbered 1, 2, ...")
    return min((r.n for r in chains), default=0), len(chains)


def even(long: DataFrame, n_iter: int) -> DataFrame:
    """The rows that every chain has."""
    return long.where(F.col("iteration") <= n_iter)


def rhat(long: DataFrame, keys: list[str], n_iter: int, value: str = "estimate") -> DataFrame:
    """Potential scale reduction over half chains, from two small aggregates."""
    long = even(long, n_iter)
    half = F.col("chain") * 2 + (F.col("iteration") > n_iter // 2).cast("int")
    chains = long.groupBy(*keys, half.alias("_half")).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_samp(value).alias("_v")
    )
    agg = chains.groupBy(*keys).agg(
        F.avg("_n").alias("n"), F.avg("_v").alias("w"), F.var_samp("_m").alias("b")
    )
    plus = F.col("w") * (F.col("n") - 1) / F.col("n") + F.coalesce("b", F.lit(0.0))
    return agg.select(*keys, F.sqrt(F.try_divide(plus, F.col("w"))).alias("rhat"))


def autocovariance(
    long: DataFrame, keys: list[str], value: str, n_iter: int, max_lag: int, block: int = LAG_BLOCK
) -> DataFrame:
    """Autocovariance per unit and lag below ``max_lag``, averaged over chains.

    Chains are cut into blocks of iterations. A block also receives the ``max_lag`` rows
    after it, so a task holds one block and its overlap, not a whole long chain, and the
    lag products add up over blocks.
    """
    means = long.groupBy(*keys, "chain").agg(F.avg(value).alias("_mean"))
    centred = long.join(means, keys + ["chain"]).withColumn("_x", F.col(value) - F.col("_mean"))
    own = F.floor((F.col("iteration") - 1) / block)
    first = F.greatest(F.floor((F.col("iteration") - max_lag) / block), F.lit(0))
    homes = F.explode(F.sequence(first, own)).alias("_block")
    cut = centred.select(*keys, "chain", "iteration", "_x", homes)
    kinds = dict(long.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", chain int, lag int, s double"

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("iteration")
        x = pdf["_x"].to_numpy()
        first = (int(pdf["iteration"].iloc[0]) - 1) // block
        n_own = int(((pdf["iteration"].to_numpy() - 1) // block == first).sum())
        size = 1 << int(np.ceil(np.log2(len(x) + max_lag + 1)))
        head = np.fft.rfft(x[:n_own], size)
        s = np.fft.irfft(np.conj(head) * np.fft.rfft(x, size), size)[: min(max_lag, len(x))]
        out = pd.DataFrame({"lag": np.arange(len(s), dtype=np.int32), "s": s})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out.assign(chain=np.int32(pdf["chain"].iloc[0]))[[*keys, "chain", "lag", "s"]]

    sums = cut.groupBy(*keys, "chain", "_block").applyInPandas(products, schema)
    per_chain = sums.groupBy(*keys, "chain", "lag").agg((F.sum("s") / n_iter).alias("acov"))
    acov = per_chain.groupBy(*keys, "lag").agg(F.avg("acov").alias("acov"))
    between = means.groupBy(*keys).agg(F.coalesce(F.var_samp("_mean"), F.lit(0.0)).alias("between"))
    return acov.join(between, keys)


def _pairs(acov: DataFrame, keys: list[str], n_iter: int) -> DataFrame:
    """Sums of neighbouring autocorrelations, with the flag that none so far is negative."""
    within = F.col("acov0") * n_iter / (n_iter - 1)
    plus = F.col("acov0") + F.col("between")
    zero = acov.where("lag = 0").select(*keys, F.col("acov").alias("acov0"))
    rho = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(
        1 - F.try_divide(within - F.col("acov"), plus)
    )
    by_lag = acov.join(zero, keys).select(*keys, "lag", rho.alias("rho"))
    pairs = by_lag.groupBy(*keys, F.floor(F.col("lag") / 2).alias("k")).agg(
        F.max(F.when(F.col("lag") % 2 == 0, F.col("rho"))).alias("even"),
        F.sum("rho").alias("pair"),
        F.count("rho").alias("c"),
    )
    run = W.partitionBy(*keys).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return pairs.where("c = 2").withColumns(
        {"ok": F.min((F.col("pair") > 0).cast("int")).over(run), "mono": F.min("pair").over(run)}
    )


def effective_size(
    long: DataFrame, keys: list[str], n_iter: int, n_chains: int, value: str = "estimate",
    first_lags: int = FIRST_LAGS,
) -> DataFrame:
    """Effective sample size per unit by the initial monotone sequence (Geyer, 1992).

    Lags are taken up to a limit that doubles until the sequence of every unit has ended,
    so the result is that of all lags.
    """
    long = even(long, n_iter)
    lags = min(n_iter, first_lags)
    while True:
        # the lag products are read twice: write them once
        acov = sizing.cut_lineage(autocovariance(long, keys, value, n_iter, lags))
        pairs = _pairs(acov, keys, n_iter)
        if lags >= n_iter:
            break
        pairs = sizing.cut_lineage(pairs)
        open_units = pairs.groupBy(*keys).agg(F.min("ok").alias("ok")).where("ok = 1")
        if open_units.isEmpty():
            break
        lags = min(n_iter, lags * 2)
    s = float(n_iter * n_chains)
    ends = pairs.groupBy(*keys).agg(
        F.sum(F.when(F.col("ok") == 1, F.col("mono"))).alias("total"),
        F.min_by("even", F.when(F.col("ok") == 0, F.col("k"))).alias("next"),
    )
    tau = -1 + 2 * F.coalesce("total", F.lit(0.0)) + F.greatest(
        F.coalesce("next", F.lit(0.0)), F.lit(0.0)
    )
    tau = F.greatest(tau, 1 / F.log10(F.lit(s)))
    return ends.select(*keys, (F.lit(s) / tau).alias("n_eff"))


def relative_eff(
    draws: DataFrame, keys: list[str], n_iter: int, n_chains: int, value: str, scale: str = "loglik"
) -> DataFrame:
    """Effective size over draws; ``scale='lik'`` exponentiates log-likelihoods first."""
    x = F.exp(F.col(value)) if scale == "lik" else F.col(value)
    long = draws.select(*keys, "chain", "iteration", x.alias("estimate"))
    size = effective_size(long, keys, n_iter, n_chains)
    return size.select(*keys, (F.col("n_eff") / float(n_iter * n_chains)).alias("r_eff"))


def summary(
    long: DataFrame, keys: list[str], n_iter: int, n_chains: int, bound: int | None = None
) -> DataFrame:
    """Mean, sd, quantiles, effective size and R-hat per parameter."""
    moments = long.groupBy(*keys).agg(
        F.avg("estimate").alias("mean"), F.stddev_samp("estimate").alias("sd")
    )
    probs = [0.025, 0.25, 0.5, 0.75, 0.975]
    names = ["q2_5", "q25", "q50", "q75", "q97_5"]
    qs = stats.quantiles_by(long, keys, "estimate", probs, names, bound=bound)
    return (
        moments.join(qs, keys)
        .join(effective_size(long, keys, n_iter, n_chains), keys)
        .join(rhat(long, keys, n_iter), keys)
    )


def sampler_health(params: DataFrame, max_depth: int = 10) -> DataFrame:
    """Divergences, saturated tree depth and energy mixing per chain.

    ``params`` has (chain, iteration, divergent, treedepth, energy), iterations numbered
    without gaps inside each chain.
    """
    steps = index.previous_row(params, ["chain"], "iteration", "energy", "_before")
    jump = F.col("energy") - F.col("_before")
    return steps.groupBy("chain").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("divergent").alias("divergent"),
        F.count_if(F.col("treedepth") >= max_depth).alias("saturated"),
        F.try_divide(F.sum(jump * jump), F.count("energy") * F.var_pop("energy")).alias("e_bfmi"),
    )
