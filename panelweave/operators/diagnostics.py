"""Residual checks and fit scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.effects import LABELS, cellmeans_draws, known, posterior_draws, usable
from panelweave.operators.fit import ETA_LIMIT, Fit, unit_effects
from panelweave.operators.laws import chances, log_chance
from panelweave.operators.levels import level_index
from panelweave.operators.likelihood import ZEROS
from panelweave.operators.panel import number_rows
from panelweave.session import bounded_join

GOLDEN = 0.6180339887498949


def fitted_rows(panel: DataFrame, fit: Fit, cand: int | DataFrame = 1) -> DataFrame:
    """Panel rows with ``fitted`` (the mean, or the share of hits), ``variance`` (of the count or the hits) and ``law``.

    ``cand`` is the number of a candidate, or a table with the keys and the ``cand`` of each. Rows of keys without a usable fit drop
    out. Covariate and unit effects are in the mean; a row that misses a unit name, or whose unit took no part, has none. A period
    that has no estimate, as nothing or everything was hit, has all its mass at that end.
    """
    spec = fit.spec
    P, keys = spec.n_periods, list(spec.keys)
    names = ["mod", "name", "zi"]
    table = usable(fit)
    if isinstance(cand, int):
        table = table.filter(F.col("cand") == cand)
    else:
        table = table.join(cand.select(*keys, "cand"), [*keys, "cand"])
    table = table.select(*keys, *names, "form", "zero", "logk", "zpar", "beta", "zbeta")
    of = F.col("trials") if spec.trials else F.col("rows")
    ends = fit.cells.select(*keys, F.col("d").alias("__d"), (F.col("total") / of).alias("__end"))
    place = level_index(spec.period, spec.periods) if spec.period else F.lit(0)
    rows = bounded_join(panel.withColumn("__d", place), ends, [*keys, "__d"], rows=fit.n_keys * P)
    inner = table.select(*keys, F.struct(*[c for c in table.columns if c not in keys]).alias("__fit"))
    rows = bounded_join(rows, inner, keys, rows=fit.n_keys)
    effect, zero_effect = F.lit(0.0), F.lit(0.0)
    if spec.levels:
        units = unit_effects(fit).select(
            *keys, *spec.levels, F.struct(*names).alias("__of"), F.struct("effect", "zero_effect").alias("__unit"))
        if isinstance(cand, int):
            of_one = fit.candidates[cand - 1]
            units = units.filter((F.col("__of.mod") == of_one.mod) & (F.col("__of.name") == of_one.name) & (F.col("__of.zi") == of_one.zi))
        rows = rows.withColumn("__of", F.struct(*[f"__fit.{n}" for n in names]))
        rows = rows.join(units, [*keys, *spec.levels, "__of"], "left")
        effect, zero_effect = (F.coalesce(f"__unit.{n}", F.lit(0.0)) for n in ("effect", "zero_effect"))
    d = F.col("__d")
    beta = known(F.col("__fit.beta")[d])
    eta = beta + effect
    if spec.covariate:
        eta = eta + F.nanvl(F.col("__fit.beta")[d + P], F.lit(0.0)) * F.col(spec.covariate)
    ez = F.nanvl(F.col("__fit.zbeta")[d], F.lit(0.0)) + zero_effect
    eta, ez = (F.greatest(F.least(v, F.lit(ETA_LIMIT)), F.lit(-ETA_LIMIT)) for v in (eta, ez))
    mean = 1.0 / (1.0 + F.exp(-eta)) if spec.trials else F.exp(eta)
    rows = rows.withColumn("__mu", F.when(beta.isNotNull(), mean).otherwise(F.col("__end")))
    mu, zero, zpar = F.col("__mu"), F.col("__fit.zero"), F.col("__fit.zpar")
    q = kept_share(mu, zero, zpar, ez)
    n = F.col(spec.trials).cast("double") if spec.trials else F.lit(None).cast("double")
    law = F.struct(n.alias("n"), mu.alias("mu"), q.alias("q"), F.col("__fit.form").alias("form"), zero.alias("zero"),
                   F.col("__fit.logk").alias("logk"))
    rows = rows.withColumn("law", law)
    fitted, variance = moments("law")
    return rows.withColumns({"fitted": fitted, "variance": variance}).drop("__d", "__end", "__fit", "__of", "__unit", "__mu")


def kept_share(mu: Column, zero: Column, zpar: Column, ez: Column) -> Column:
    """Chance that a count isn't a zero of the zero model; ``ez`` is the predictor of a zero regression."""
    return (
        F.when((zero == ZEROS["none"]) | (mu <= 0), 1.0)
        .when(zero == ZEROS["tied"], F.exp(-F.exp(zpar) * F.log1p(1.0 / mu)))
        .when(zero == ZEROS["regression"], 1.0 / (1.0 + F.exp(ez)))
        .otherwise(1.0 / (1.0 + F.exp(zpar)))
    )


def moments(law: str) -> tuple[Column, Column]:
    """Mean (the share of hits for proportions) and variance of a law, its zero model included."""
    n, mu, q, form, zero, logk = (F.col(f"{law}.{name}") for name in ("n", "mu", "q", "form", "zero", "logk"))
    k = F.exp(logk)
    plain = F.when(form == 1, mu * (1 + k)).when(form == 2, mu * (1 + k * mu)).otherwise(mu)
    log_zero = F.when(form == 1, -mu * F.log1p(k) / k).when(form == 2, -F.log1p(k * mu) / k).otherwise(-mu)
    positive = F.when((zero == ZEROS["hurdle"]) & (mu > 0), q / -F.expm1(log_zero)).otherwise(q)
    mean = positive * mu
    counts = positive * (plain + mu * mu) - mean * mean
    inflated = F.when(form == 2, 1.0 + (n - 1.0) * k / (1.0 + k)).otherwise(1.0)
    hits = n * mu * (1.0 - mu) * inflated
    return F.when(n.isNull(), mean).otherwise(mu), F.when(n.isNull(), counts).otherwise(hits)


def pit_residuals(rows: DataFrame, order: list[str], response: str = "value") -> DataFrame:
    """Residual on (0, 1): probability of a smaller count plus a fixed fraction of the mass at the count.

    ``rows`` come from ``fitted_rows``. The fraction comes from the observation number, so no counts are simulated. A missing count
    has no residual.
    """
    numbered = number_rows(rows, [F.col(c) for c in order], "obs")
    fraction = F.col("obs") * F.lit(GOLDEN) - F.floor(F.col("obs") * F.lit(GOLDEN))
    told = numbered.withColumn("__at", chances(F.col(response)))
    return told.withColumn("residual", known(F.col("__at.below") + fraction * F.col("__at.mass"))).drop("__at", "law", "variance")


def with_drawn_mean(rows: DataFrame, fit: Fit, draws: int = 1000) -> DataFrame:
    """Rows with the mean over draws as ``fitted``, for one candidate without covariate and units.

    Draws are averaged per key and period before they meet the rows. A key or period without draws has 0.
    """
    spec = fit.spec
    if spec.covariate or spec.levels or len(fit.candidates) != 1:
        raise ValueError("draws belong to periods of one candidate")
    means = cellmeans_draws(fit, draws).select(*spec.keys, "period", F.col("mean").alias("__drawn"))
    joined = bounded_join(rows, means, [*spec.keys, "period"], "left", rows=fit.n_keys * spec.n_periods)
    return joined.withColumn("fitted", F.coalesce("__drawn", F.lit(0.0))).drop("__drawn")


def ranked_within(df: DataFrame, keys: list[str], order: list[str], n_keys: int) -> DataFrame:
    """Rank inside each key and key size, by one global range sort (no key is gathered in one task)."""
    numbered = number_rows(df, [F.col(c) for c in [*keys, *order]], "__rank")
    spans = numbered.groupBy(*keys).agg(F.min("__rank").alias("__first"), F.count("*").alias("n"))
    joined = bounded_join(numbered, spans, keys, rows=n_keys)
    return joined.withColumn("rank", F.col("__rank") - F.col("__first") + 1).drop("__rank", "__first")


def uniformity_check(residuals: DataFrame, keys: list[str], n_keys: int) -> DataFrame:
    """Largest distance between the residuals' distribution and the uniform one, with its asymptotic p."""
    ranked = ranked_within(residuals, keys, ["residual", "obs"], n_keys)
    r, i, n = F.col("residual"), F.col("rank"), F.col("n")
    distance = ranked.groupBy(*keys, "n").agg(F.max(F.greatest(i / n - r, r - (i - 1) / n)).alias("distance"))
    scaled = F.sqrt("n") * F.col("distance")
    tail = F.lit(0.0)
    for k in range(1, 31):
        tail = tail + 2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * scaled * scaled)
    p = F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))
    return distance.withColumn("p_value", p)


def residual_trend(residuals: DataFrame, keys: list[str], n_keys: int, bins: int = 4) -> DataFrame:
    """Quartiles of the residuals in equal-count bins of the fitted value.

    They are picked by position from a second ranking inside the bins, so no bin is gathered in one task.
    """
    ranked = ranked_within(residuals, keys, ["fitted", "obs"], n_keys)
    part = F.floor((F.col("rank") - 1) * bins / F.col("n")) + 1
    placed = ranked.withColumn("bin", part).drop("rank", "n")
    placed = ranked_within(placed, [*keys, "bin"], ["residual", "obs"], n_keys * bins)

    def quantile(share: float) -> Column:
        at = 1.0 + (F.col("n") - 1) * share
        low = F.floor(at)
        weight = F.when(F.col("rank") == low, 1.0 - (at - low)).when(F.col("rank") == low + 1, at - low)
        return F.sum(weight * F.col("residual"))

    return placed.groupBy(*keys, "bin").agg(
        F.count("*").alias("count"), F.avg("fitted").alias("fitted"),
        quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"),
    ).withColumnRenamed("count", "n")


def dispersion_check(rows: DataFrame, keys: list[str], response: str = "value") -> DataFrame:
    """Observed over expected squared residual, and its score; the variance is that of each row's law. Rows of laws without
    variance and missing counts take no part."""
    gap = F.col(response) - F.col("fitted") * F.coalesce("law.n", F.lit(1.0))
    squared = F.when(F.col("variance") > 0, gap * gap / F.col("variance"))
    out = rows.groupBy(*keys).agg(F.sum(squared).alias("x2"), F.count(squared).alias("n"))
    return out.withColumns(
        {"ratio": F.col("x2") / F.col("n"), "score": (F.col("x2") - F.col("n")) / F.sqrt(2.0 * F.col("n"))}
    )


def fit_scores(panel: DataFrame, fit: Fit, draws: int = 1000, response: str = "value") -> DataFrame:
    """DIC, WAIC and the summed log predictive ordinate of every key of a period-only fit, whatever its family.

    Equal observations are counted first, so the draws multiply distinct (entity, period, count) cells and not rows. Averages of
    likelihoods are taken relative to the likelihood at the estimate, so long tails don't underflow. The parameters of the zero
    part and the dispersion stay at their estimates. Periods without estimate and missing counts take no part.
    """
    spec = fit.spec
    if spec.covariate or spec.levels or not spec.period:
        raise ValueError("scores need a fit by period without covariate and units")
    y, n = F.col("y"), F.col("n")
    trials = F.col(spec.trials) if spec.trials else F.lit(None)
    cells = panel.groupBy(*spec.keys, spec.period, F.col(response).alias("y"), trials.cast("double").alias("of")).agg(
        F.count("*").alias("n")).filter("y IS NOT NULL").withColumnRenamed(spec.period, "period")
    cells = cells.withColumn("d", level_index("period", spec.periods))
    keyed = usable(fit).select(*spec.keys, *LABELS, "form", "zero", "logk", "zpar", "beta", "zbeta", "sign", "shift")
    points = bounded_join(cells, keyed, list(spec.keys), rows=fit.n_keys)
    eta = F.col("beta")[F.col("d")]
    odds = 1.0 / (1.0 + F.exp(-eta)) if spec.trials else F.exp(eta)
    points = points.withColumn("mu", known(odds)).withColumn("ez", F.nanvl(F.col("zbeta")[F.col("d")], F.lit(0.0)))

    def law(mu: Column) -> Column:
        kept = kept_share(mu, F.col("zero"), F.col("zpar"), F.col("ez"))
        return F.struct(F.col("of").alias("n"), mu.alias("mu"), kept.alias("q"), "form", "zero", "logk")

    points = points.withColumn("law", law(F.col("mu"))).withColumn("ref", log_chance(y)).drop("law", "mu")
    sampled = posterior_draws(fit, draws).filter(F.col("value").isNotNull())
    joined = points.join(sampled, [*spec.keys, *LABELS, "period"])
    value = F.col("value")
    mu = value if spec.trials else F.when(F.col("sign") < 0, F.exp("shift") * (1.0 - value) / value).otherwise(value)
    joined = joined.withColumn("mu", mu).withColumn("law", law(F.col("mu"))).withColumn("ll", log_chance(y))
    fixed = ["of", "form", "zero", "logk", "zpar", "ez", "ref"]
    point = joined.groupBy(*spec.keys, *LABELS, "period", "y", "n", *fixed).agg(
        (F.ln(F.avg(F.exp(F.col("ll") - F.col("ref")))) + F.col("ref")).alias("lpd"),
        F.var_samp("ll").alias("spread"),
        F.avg("ll").alias("mean_ll"),
        (F.ln(F.avg(F.exp(F.col("ref") - F.col("ll")))) - F.col("ref")).alias("minus_log_cpo"),
        F.avg("mu").alias("mean_mu"),
    )
    at_mean = point.withColumn("law", law(F.col("mean_mu"))).withColumn("at_mean", log_chance(y))
    sums = at_mean.groupBy(*spec.keys, *LABELS).agg(
        F.sum(n * F.col("lpd")).alias("lppd"),
        F.sum(n * F.col("spread")).alias("p_waic"),
        F.sum(-2.0 * n * F.col("mean_ll")).alias("mean_deviance"),
        F.sum(-2.0 * n * F.col("at_mean")).alias("deviance_at_mean"),
        F.sum(n * F.col("minus_log_cpo")).alias("log_score"),
    )
    return sums.select(
        *spec.keys, *LABELS,
        (2 * F.col("mean_deviance") - F.col("deviance_at_mean")).alias("dic"),
        (-2 * (F.col("lppd") - F.col("p_waic"))).alias("waic"),
        "p_waic", "log_score",
    )
