"""Raw summaries per period that stand beside fitted means."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.diagnostics import ranked_within
from panelweave.session import bounded_join


def zero_share(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.count_if(F.col(value) == 0).alias("n_zeros"),
        F.count("*").alias("n"),
        (F.count_if(F.col(value) == 0) / F.count("*")).alias("zero_fraction"),
    )


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def raw_log_summary(long: DataFrame, keys: list[str], n_keys: int, value: str = "value") -> DataFrame:
    """Log of mean, median and standard deviation; the log of zero is missing. There are at most ``n_keys`` groups.

    The median is picked by position, so no group is gathered in one task; a hash of the row deals equal values out.
    """
    keyed = long.withColumn("__key", F.to_json(F.struct(*keys)))  # never missing, unlike the keys
    known = keyed.filter(F.col(value).isNotNull()).select("__key", value, F.xxhash64(*long.columns).alias("__tie"))
    ranked = ranked_within(known, ["__key"], [value, "__tie"], n_keys)
    middle = F.col("rank").between(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    medians = ranked.filter(middle).groupBy("__key").agg(F.avg(value).alias("__median"))
    stats = keyed.groupBy(*keys, "__key").agg(_log(F.avg(value)).alias("log_mean"), _log(F.stddev_samp(value)).alias("log_sd"))
    joined = bounded_join(stats, medians, ["__key"], "left", rows=n_keys)
    return joined.select(*keys, "log_mean", _log(F.col("__median")).alias("log_median"), "log_sd")


def t_quantile(df: Column, level: float = 0.975) -> Column:
    """Student t quantile for whole degrees of freedom.

    Up to 200 degrees the value comes from a table computed from the exact distribution function, above from the
    normal quantile with an asymptotic correction that differs by less than 1e-9 there.
    """
    z = NormalDist().inv_cdf(level)
    z2 = z * z
    g = [
        z * (z2 + 1) / 4,
        z * (5 * z2**2 + 16 * z2 + 3) / 96,
        z * (3 * z2**3 + 19 * z2**2 + 17 * z2 - 15) / 384,
        z * (79 * z2**4 + 776 * z2**3 + 1482 * z2**2 - 1920 * z2 - 945) / 92160,
    ]
    guess = F.lit(z)
    for power, coefficient in enumerate(g, start=1):
        guess = guess + F.lit(coefficient) / F.pow(df, F.lit(float(power)))
    exact = {1: math.tan(math.pi * (level - 0.5)), 2: (2 * level - 1) / math.sqrt(2 * level * (1 - level))}
    table = {n: _t_quantile_exact(n, level) for n in range(3, 200)}
    table.update(exact)
    small = F.element_at(F.array(*[F.lit(table[n]) for n in range(1, 200)]), df.cast("int"))
    return F.when(df < 1, F.lit(None).cast("double")).when(df < 200, small).otherwise(guess)


def _t_quantile_exact(df: int, level: float) -> float:
    """Root of the t distribution function by bisection on its finite trigonometric sum."""

    def cdf(t: float) -> float:
        theta = math.atan(t / math.sqrt(df))
        c, s = math.cos(theta), math.sin(theta)
        if df % 2:
            term, total = c, 0.0
            for k in range(1, (df - 1) // 2 + 1):
                total += term
                term *= c * c * (2 * k) / (2 * k + 1)
            return 0.5 + (theta + s * total) / math.pi
        term, total = 1.0, 0.0
        for k in range(1, df // 2 + 1):
            total += term
            term *= c * c * (2 * k - 1) / (2 * k)
        return 0.5 + s * total / 2

    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < level else (low, mid)
    return (low + high) / 2


def raw_mean_interval(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean with 95% limits from normal theory (t quantile on n - 1 degrees of freedom)."""
    stats = long.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"), F.count(value).alias("n")
    )
    half = t_quantile(F.col("n") - 1) * F.col("__sd") / F.sqrt(F.col("n"))
    return stats.select(*keys, "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"), "n")
