"""Scalar functions on columns: links, likelihoods, formats and hash-seeded uniforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def inv_logit(x) -> Column:
    """Logistic function; finite for any finite input."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def softplus(x) -> Column:
    """log(1 + exp(x)) without overflow."""
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_inv_logit(x) -> Column:
    return -softplus(-col(x))


def log1m_inv_logit(x) -> Column:
    return -softplus(col(x))


def log_add_exp(a, b) -> Column:
    """log(exp(a) + exp(b)) without overflow or loss of the smaller term."""
    a, b = col(a), col(b)
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_either_inv_logit(a, b) -> Column:
    """log of the probability that at least one of two events, given as logits, occurs."""
    return log_add_exp(log_inv_logit(a), log1m_inv_logit(a) + log_inv_logit(b))


def log1m_exp(x) -> Column:
    """log(1 - exp(x)) for x <= 0 to full precision; minus infinity at 0, null above."""
    x = col(x)
    near = F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(-F.expm1(x)))
    return F.when(x > -0.6931471805599453, near).otherwise(F.log1p(-F.exp(x)))


def bernoulli_logit_lpmf(y, logit) -> Column:
    """Log-likelihood of a 0/1 value under a logit; null where the value is null."""
    return col(y) * col(logit) - softplus(logit)


def either(p, q) -> Column:
    """Probability that at least one of two independent events occurs."""
    return F.lit(1.0) - (F.lit(1.0) - col(p)) * (F.lit(1.0) - col(q))


def if_else_strict(cond, a, b) -> Column:
    """Two-way choice that stays null when the condition is null."""
    return F.when(cond, a).when(~cond, b)


def add_all(cols) -> Column:
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def row_mean_strict(cols) -> Column:
    """Mean across columns, null as soon as one of them is null."""
    cols = list(cols)
    return add_all([col(c).cast("double") for c in cols]) / F.lit(float(len(cols)))


def mo(z, t) -> Column:
    """Monotonic effect: length of the simplex times the sum of its first t entries."""
    z, t = col(z), col(t)
    head = F.aggregate(F.slice(z, F.lit(1), t), F.lit(0.0), lambda a, v: a + v)
    return F.size(z) * head


def mo_steps(z, n: int) -> list[Column]:
    """The monotonic effect at 0..n for a simplex held as n separate columns."""
    parts = [col(c) for c in z]
    steps = [F.lit(0.0)]
    for i in range(1, n + 1):
        steps.append(F.lit(float(n)) * add_all(parts[:i]))
    return steps


def fmt2(x) -> Column:
    return F.format_string("%.2f", col(x))


def fmt_corr(x) -> Column:
    """Two decimals, 1.00 shown as '-', no zero before the point."""
    text = F.regexp_replace(fmt2(x), r"^1\.00$", "-")
    return F.regexp_replace(text, r"^(-?)0\.", "$1.")


def same_sign(a, b) -> Column:
    return F.signum(col(a)) == F.signum(col(b))


def hash_uniform(*keys, seed: int) -> Column:
    """Uniform in (0, 1) that depends on the key values only, not on partitioning."""
    bits = F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(seed)), F.lit(1 << 52))
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


# Multipliers and moduli of the integer generator, all below 2^31; free choices.
FACTORS = [1812433253, 1664525003, 1103515245, 1566083941]
MODULI = [2147483647, 2147483629, 2013265921, 2147483647]


def plain_uniform(*keys, seed: int) -> Column:
    """As hash_uniform for up to four integer keys, from integer arithmetic only.

    The keys are folded by multiply-and-reduce steps and mixed by two squarings. Nothing
    overflows and the expression stays small, so another engine can reproduce it.
    """
    h = F.lit(seed % MODULI[0]).cast("bigint")
    for k, factor in zip(keys, FACTORS):
        k = col(k).cast("bigint")
        low = F.when((k >= 0) & (k < MODULI[0]), k).otherwise(
            (F.pmod(k, F.lit(MODULI[0])) + F.pmod(F.shiftright(k, 31), F.lit(MODULI[0])) * 3) % F.lit(MODULI[0])
        )
        h = (h * F.lit(factor) + low * F.lit(factor)) % F.lit(MODULI[0])
    for i in (1, 2):
        squared = h * h % F.lit(MODULI[i])
        h = (squared * F.lit(FACTORS[i]) + F.lit(12345)) % F.lit(MODULI[i + 1])
    return (h.cast("double") + 0.5) / F.lit(float(MODULI[3]))


def box_muller(u1, u2) -> tuple[Column, Column]:
    """Two independent standard normals from two uniforms in (0, 1)."""
    r = F.sqrt(F.lit(-2.0) * F.log(col(u1)))
    angle = F.lit(6.283185307179586) * col(u2)
    return r * F.cos(angle), r * F.sin(angle)


def rnd(x, digits: int = 6) -> Column:
    """Round for reports; never minus zero."""
    return F.round(col(x), digits) + F.lit(0.0)
