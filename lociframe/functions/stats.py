"""Columns for evidence statistics: exact tests, likelihood ratios, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import let

#: Fixed value: error rate that chance alone explains.
BACKGROUND = 1e-4
#: ln Γ by the Lanczos sum; fixed values (g = 7, nine terms).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_factorial(n: Column) -> Column:
    """ln n! for n of 0 or more, for numbers of any size: Spark has no lgamma."""
    x = n.cast("double")
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (x + i)
    t = x + 7.5
    value = 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(total)
    return F.when(x <= 1, 0.0).otherwise(value)


def log_binom(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_log_pmf(k: Column, good: Column, bad: Column, drawn: Column) -> Column:
    return log_binom(good, k) + log_binom(bad, drawn - k) - log_binom(good + bad, drawn)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-tailed p of the table [[a, b], [c, d]]: all tables of these margins no likelier than it.

    Only the observed table and the first one are worked out in full; each next
    one follows from the one before by a ratio of four counts.
    """
    table = F.struct(*(x.cast("bigint").alias(n) for x, n in zip((a, b, c, d), "abcd")))

    def tables(t: Column) -> Column:
        row, col, n = t.a + t.b, t.a + t.c, t.a + t.b + t.c + t.d
        low, high = F.greatest(F.lit(0).cast("bigint"), row + col - n), F.least(row, col)
        pmf = lambda k: hypergeometric_log_pmf(k, col, n - col, row)

        def step(acc: Column, k: Column) -> Column:
            now = F.when(acc.lp <= acc.observed + 1e-10, F.exp(acc.lp)).otherwise(0.0)
            up = ((col - k) * (row - k)).cast("double") / ((k + 1) * (n - col - row + k + 1))
            return F.struct((acc.total + now).alias("total"), F.when(up > 0, acc.lp + F.log(up)).otherwise(acc.lp).alias("lp"), acc.observed.alias("observed"))

        start = F.struct(F.lit(0.0).alias("total"), pmf(low).alias("lp"), pmf(t.a).alias("observed"))
        return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(F.sequence(low, high), start, step, lambda acc: acc.total)))

    return let(table, tables)


def with_fisher(df: DataFrame, a: str, b: str, c: str, d: str, out: str) -> DataFrame:
    """``df`` with the p of each row's table; counts repeat a lot, so each distinct table is worked out once."""
    names = [f"__{x}" for x in "abcd"]
    keys = [F.coalesce(F.col(x).cast("bigint"), F.lit(0)) for x in (a, b, c, d)]
    df = df.withColumns(dict(zip(names, keys)))
    return df.join(df.select(*names).distinct().withColumn(out, fisher_exact(*map(F.col, names))), names).drop(*names)


def log_binomial_likelihood(k: Column, n: Column, p: Column) -> Column:
    """k ln p + (n - k) ln (1 - p), without the coefficient; certain at the ends."""
    k, n, p = k.cast("double"), n.cast("double"), p.cast("double")
    never = F.lit(float("-inf"))
    inner = k * F.log(p) + (n - k) * F.log(1 - p)
    return F.when(p <= 0, F.when(k == 0, 0.0).otherwise(never)).when(p >= 1, F.when(k == n, 0.0).otherwise(never)).otherwise(inner)


def confidence(k: Column, n: Column, background: float = BACKGROUND) -> Column:
    """Posterior odds of the observed share against the background, at even prior odds."""
    ratio = log_binomial_likelihood(k, n, k / n) - log_binomial_likelihood(k, n, F.lit(background))
    return F.when((k == 0) | (n == 0), 0.0).otherwise(1 / (1 + F.exp(-ratio)))


def beta_quantile(q, a, b):
    """Quantiles of Beta(a, b) for numpy arrays: bisection on the regularised incomplete beta."""
    import numpy as np

    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    scale = lgamma(a + b) - lgamma(a) - lgamma(b) if a.size else a

    def fraction(x, a, b):
        """Continued fraction by Lentz, for x below the mean."""
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        return h

    def cdf(x):
        front = np.exp(scale + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        left = front * fraction(np.where(low, x, 0.5), a, b) / a
        right = 1 - front * fraction(np.where(low, 0.5, 1 - x), b, a) / b
        return np.where(low, left, right)

    # Newton steps from the mean, kept within a bracket that halves where a step would leave it.
    lo, hi, x = np.zeros(a.shape), np.ones(a.shape), a / (a + b)
    for _ in range(60):
        miss = cdf(x) - q
        lo, hi = np.where(miss < 0, x, lo), np.where(miss < 0, hi, x)
        step = x - miss / np.exp(scale + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        if np.all(np.abs(new - x) <= 1e-15 + 1e-13 * x):
            return new
        x = new
    return x


def vaf_interval(k: Column, n: Column) -> Column:
    """struct<vaf, low, high>: share k / n with the 95 % interval of Beta(k + 1, n - k + 1).

    k counts up to n, and no molecules give zeros. Quantiles have no built-in
    expression; numpy works out a batch of them at a time.
    """

    @F.pandas_udf("struct<vaf double, low double, high double>")
    def interval(k, n):
        import numpy as np
        import pandas as pd

        n = n.to_numpy(float)
        k = np.minimum(k.to_numpy(float), n)
        some = n > 0
        low, high = (np.where(some, beta_quantile(q, np.where(some, k, 0) + 1, np.where(some, n - k, 0) + 1), 0.0) for q in (0.025, 0.975))
        return pd.DataFrame({"vaf": np.where(some, k / np.where(some, n, 1), 0.0), "low": low, "high": high})

    return interval(k, n)


def approx_vaf(alt: Column, mean_ref: Column) -> Column:
    return F.coalesce(F.try_divide(alt.cast("double"), alt + mean_ref), F.lit(0.0))


def umi_occupancy(n: Column, space: int = 524_800) -> Column:
    """Distinct UMI pairs to expect of n molecules."""
    return space * (1 - F.exp(-n / space))


def collision_probability(m: Column, space: int = 524_800) -> Column:
    return 1 - F.pow(F.lit(1 - 1 / space), m - 1)
