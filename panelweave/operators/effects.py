"""Cell means, contrasts and draws from a fitted coefficient table.

Two paths: Wald limits from the covariance of the coefficients, and draws from their normal approximation.
Everything is a column expression over one row per key, so the cost follows the number of keys (times draws),
never the number of observations.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.links import inverse_link
from panelweave.operators.fit import Fit
from panelweave.session import bounded_join

Z = NormalDist().inv_cdf(0.975)

# The first primes; their square roots drive the arithmetic normal deviates.
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89]


# How a fit can end with an estimate.
FINISHED = ("ok", "period_unobserved", "no_overdispersion", "no_extra_zeros", "no_unit_variance")


def usable(fit: Fit) -> DataFrame:
    """Keys whose fit has ended; failed, unfinished and never-counted keys drop out here."""
    return fit.coef.filter(F.col("status").isin(*FINISHED))


def on_grid(fit: Fit, at: DataFrame | None, labels: list[str]) -> DataFrame:
    """Keys crossed with the periods, with ``x0`` (the scaled covariate to predict at, 0 by default)."""
    spec = fit.spec
    grid = fit.coef.sparkSession.createDataFrame(list(enumerate(spec.periods)), "d int, period string")
    keyed = usable(fit).select(*spec.keys, *labels, "beta", "cov", "sign", "shift")
    if at is not None:
        keyed = bounded_join(keyed, at, list(spec.keys), rows=fit.n_keys)
    else:
        keyed = keyed.withColumn("x0", F.lit(0.0))
    return keyed.crossJoin(F.broadcast(grid))


LABELS = ["mod", "name", "fam", "type", "zi"]


def _covariance(left: list[tuple[str, str]], right: list[tuple[str, str]], size: int) -> str:
    """SQL text of the covariance of two combinations; each is a list of (index, weight)."""
    return " + ".join(f"({wi}) * ({wj}) * cov[({i}) * {size} + ({j})]" for i, wi in left for j, wj in right)


def _wald_frame(fit: Fit, at: DataFrame | None) -> DataFrame:
    """Predictor of each period and of the first, their variances and covariance."""
    spec = fit.spec
    P, size = spec.n_periods, spec.size
    here, first = [("d", "1.0D")], [("0", "1.0D")]
    eta, eta1 = "beta[d]", "beta[0]"
    if spec.covariate:
        here, first = [*here, (f"d + {P}", "x0")], [*first, (f"{P}", "x0")]
        eta, eta1 = f"{eta} + x0 * beta[d + {P}]", f"{eta1} + x0 * beta[{P}]"
    return on_grid(fit, at, LABELS).selectExpr(
        *spec.keys, *LABELS, "d", "period", "sign",
        f"sign * ({eta}) + shift AS eta", f"sign * ({eta1}) + shift AS eta1",
        f"{_covariance(here, here, size)} AS v", f"{_covariance(first, first, size)} AS v1",
        f"{_covariance(here, first, size)} AS v01",
    )


def _response(fit: Fit, column: str):
    """Inverse link of a predictor: logit for proportions and for the successes form, else log."""
    eta = F.col(column)
    if fit.spec.trials:
        return inverse_link(eta, "logit")
    return F.when(F.col("sign") < 0, inverse_link(eta, "logit")).otherwise(inverse_link(eta, "log"))


def known(column):
    """NaN to missing."""
    return F.when(~F.isnan(column), column)


def cellmeans_wald(fit: Fit, at: DataFrame | None = None) -> DataFrame:
    """Mean per period with limits computed on the link scale."""
    frame = _wald_frame(fit, at).withColumns(
        {"low": F.col("eta") - Z * F.sqrt("v"), "high": F.col("eta") + Z * F.sqrt("v")}
    )
    return frame.select(
        *fit.spec.keys, *LABELS, "period", known(_response(fit, "eta")).alias("mean"),
        known(_response(fit, "low")).alias("lower"), known(_response(fit, "high")).alias("upper"),
    )


def contrasts_wald(fit: Fit, at: DataFrame | None = None) -> DataFrame:
    """Each later period against the first: ``Ratio`` (of means, or of odds on the logit scale) with limits
    on the link scale, and ``Values``, the difference of means with delta-method limits."""
    frame = _wald_frame(fit, at).filter("d > 0")
    se = F.sqrt(F.col("v") + F.col("v1") - 2 * F.col("v01"))
    change = F.col("eta") - F.col("eta1")
    keys = [*fit.spec.keys, *LABELS, "period"]
    ratio = frame.select(
        *keys, F.lit("Ratio").alias("variable"), known(F.exp(change)).alias("mean"),
        known(F.exp(change - Z * se)).alias("lower"), known(F.exp(change + Z * se)).alias("upper"),
    )
    frame = frame.withColumns({"m": _response(fit, "eta"), "m1": _response(fit, "eta1")})
    logit = F.lit(True) if fit.spec.trials else F.col("sign") < 0
    slope = F.when(logit, F.col("m") * (1 - F.col("m"))).otherwise(F.col("m"))
    slope1 = F.when(logit, F.col("m1") * (1 - F.col("m1"))).otherwise(F.col("m1"))
    spread = F.sqrt(slope * slope * F.col("v") + slope1 * slope1 * F.col("v1") - 2 * slope * slope1 * F.col("v01"))
    gap = F.col("m") - F.col("m1")
    values = frame.select(
        *keys, F.lit("Values").alias("variable"), known(gap).alias("mean"),
        known(gap - Z * spread).alias("lower"), known(gap + Z * spread).alias("upper"),
    )
    return ratio.unionByName(values)


def normal_deviate(i: str, j: int) -> str:
    """SQL text of the j-th standard normal of draw ``i``: Box-Muller on fractional parts of multiples of
    square roots. No random state, so any partitioning and any engine gives the same numbers."""
    a, b = math.sqrt(PRIMES[2 * j]), math.sqrt(PRIMES[2 * j + 1])
    u = f"({i} * {a!r}D - floor({i} * {a!r}D))"
    v = f"({i} * {b!r}D - floor({i} * {b!r}D))"
    return f"sqrt(-2.0D * ln({u})) * cos({2 * math.pi!r}D * {v})"


def draws_wide(fit: Fit, n: int = 1000) -> DataFrame:
    """Draws of the coefficients mapped to period means: one row per (key, draw) with an array over periods.

    The covariate sits at 0. A period without estimate is missing.
    """
    spec = fit.spec
    p = spec.size
    logit = "true" if spec.trials else "sign < 0"
    keyed = usable(fit).select(*spec.keys, *LABELS, "sign", "coef", "coef_chol")
    drawn = keyed.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    drawn = drawn.selectExpr("*", *[f"{normal_deviate('draw', j)} AS e{j}" for j in range(p)])

    def part(i: int) -> str:
        return " + ".join([f"coef[{i}]", *[f"coef_chol[{i * p + j}] * e{j}" for j in range(i + 1)]])

    drawn = drawn.selectExpr("*", *[f"{part(i)} AS b{i}" for i in range(spec.n_periods)])
    etas = ["b0"] + [f"b0 + b{i}" for i in range(1, spec.n_periods)]
    values = [
        f"CASE WHEN isnan({e}) THEN NULL WHEN {logit} THEN 1.0D / (1.0D + exp(-({e}))) ELSE exp({e}) END" for e in etas
    ]
    return drawn.selectExpr(*spec.keys, *LABELS, "draw", f"array({', '.join(values)}) AS v")


def posterior_draws(fit: Fit, n: int = 1000) -> DataFrame:
    """Long form: one row per (key, draw, period)."""
    labels = F.array(*[F.lit(p) for p in fit.spec.periods])
    wide = draws_wide(fit, n)
    return wide.select(*fit.spec.keys, *LABELS, "draw", F.posexplode("v").alias("d", "value")).select(
        *fit.spec.keys, *LABELS, "draw", labels[F.col("d")].alias("period"), "value"
    )


def cellmeans_draws(fit: Fit, n: int = 1000) -> DataFrame:
    draws = posterior_draws(fit, n).filter(F.col("value").isNotNull())
    return draws.groupBy(*fit.spec.keys, *LABELS, "period").agg(
        F.avg("value").alias("mean"),
        F.percentile("value", F.lit(0.025)).alias("lower"),
        F.percentile("value", F.lit(0.975)).alias("upper"),
    )


def draw_contrasts(fit: Fit, n: int = 1000) -> DataFrame:
    """Per draw, ratio and difference of each later period to the first (no shuffle: a draw is one row)."""
    labels = F.array(*[F.lit(p) for p in fit.spec.periods])
    rows = draws_wide(fit, n).select(
        *fit.spec.keys, *LABELS, "draw", F.col("v")[0].alias("v1"), F.posexplode("v").alias("d", "value")
    )
    later = rows.filter((F.col("d") > 0) & F.col("value").isNotNull() & F.col("v1").isNotNull())
    log_ratio = F.when(F.col("value") > 0, F.ln("value")) - F.when(F.col("v1") > 0, F.ln("v1"))
    return later.select(
        *fit.spec.keys, *LABELS, "draw", labels[F.col("d")].alias("period"),
        F.exp(log_ratio).alias("Ratio"), (F.col("value") - F.col("v1")).alias("Values"),
    )


def shortest_interval(df: DataFrame, keys: list[str], value: str, n: int, mass: float = 0.95) -> DataFrame:
    """Narrowest interval that holds ``mass`` of the ``n`` values of each key, the lowest one on ties."""
    reach = int(math.floor(n * mass + 1e-9))
    reach = min(reach, n - 1)
    order = Window.partitionBy(*keys).orderBy(value)
    spans = df.select(
        *keys, F.col(value).alias("low"), F.lead(value, reach).over(order).alias("high"),
        F.row_number().over(order).alias("rank"),
    ).filter(F.col("high").isNotNull())
    best = F.min(F.struct((F.col("high") - F.col("low")).alias("width"), "rank", "low", "high"))
    return spans.groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.low").alias("lower"), F.col("best.high").alias("upper")
    )


def draw_summary(fit: Fit, n: int = 1000) -> DataFrame:
    """Mean, shortest 95% interval and tail shares per period and measure."""
    long = draw_contrasts(fit, n).unpivot(
        [*fit.spec.keys, *LABELS, "draw", "period"], ["Ratio", "Values"], "variable", "value"
    )
    keys = [*fit.spec.keys, *LABELS, "period", "variable"]

    def share(condition):
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    stats = long.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        share(F.col("value") < 1).alias("pl1"), share(F.col("value") > 1).alias("pg1"),
        share(F.col("value") < 0).alias("pl0"), share(F.col("value") > 0).alias("pg0"),
    )
    return stats.join(shortest_interval(long, keys, "value", n), keys)


def linear_combination(fit: Fit, weights: list[float]) -> DataFrame:
    """Weighted sum of treatment-coded coefficients with its standard error."""
    p = fit.spec.size
    terms = [(i, w) for i, w in enumerate(weights) if w]
    estimate = " + ".join(f"{w}D * coef[{i}]" for i, w in terms)
    variance = " + ".join(f"{wi * wj}D * coef_cov[{i * p + j}]" for i, wi in terms for j, wj in terms)
    return usable(fit).selectExpr(*fit.spec.keys, *LABELS, f"{estimate} AS estimate", f"sqrt({variance}) AS se")
