"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z = 1.959963984540054


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """The bounds of the Wilson interval, within [0, 1]; null for no cases."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes / n
    den = 1 + Z * Z / n
    center = (p + Z * Z / (2 * n)) / den
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / den
    # greatest and least skip nulls
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), center - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), center + half))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.log(q) - F.log1p(-q)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1: Stirling's series ten steps up, and back."""
    y = x + 10.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    back = F.lit(0.0)
    for i in range(10):
        back = back + F.log(x + float(i))
    return series - back


def mcnemar(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial tail of the discordant pairs; 1 where there are none.

    Terms fall from the smaller count down; those more than 24 standard deviations away are below any precision, so
    that the sum grows with the square root of the counts only.
    """
    n, k = wins + losses, F.least(wins, losses)
    first = lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * F.log(F.lit(2.0))
    most = F.least(k, F.ceil(12 * F.sqrt(n)).cast("bigint") + 60)
    # term(i - 1) = term(i) * i / (n - i + 1); the state is (tail, log of the term)
    fold = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), most),
        F.struct(F.lit(0.0).alias("tail"), first.alias("term")),
        lambda s, j: F.struct((s["tail"] + F.exp(s["term"])).alias("tail"), (s["term"] + F.log(F.greatest(k - j, F.lit(1)) / (n - k + j + 1))).alias("term")),
        lambda s: F.least(F.lit(1.0), 2 * s["tail"]),
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(fold)
