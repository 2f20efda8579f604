"""Inverse link functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.special import norm_cdf

LINKS = (
    "identity", "log", "logm1", "log1p", "inverse", "sqrt", "1/mu^2", "tan_half", "logit",
    "probit", "cauchit", "cloglog", "probit_approx", "softplus",
)


def inverse_link(x: Column, link: str) -> Column:
    """Map a linear predictor to the response scale. Undefined values become NULL; unknown links raise."""
    if link == "identity":
        return x
    if link == "log":
        return F.exp(x)
    if link == "logm1":
        return F.exp(x) + 1.0
    if link == "log1p":
        return F.expm1(x)
    if link == "inverse":
        return F.try_divide(F.lit(1.0), x)
    if link == "sqrt":
        return x * x
    if link == "1/mu^2":
        return F.when(x > 0, F.try_divide(F.lit(1.0), F.sqrt(x)))
    if link == "tan_half":
        return 2.0 * F.atan(x)
    if link == "logit":
        return 1.0 / (1.0 + F.exp(-x))
    if link in ("probit", "probit_approx"):
        return norm_cdf(x)
    if link == "cauchit":
        return 0.5 + F.atan(x) / F.lit(math.pi)
    if link == "cloglog":
        return -F.expm1(-F.exp(x))
    if link == "softplus":
        return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    raise ValueError(f"link '{link}' not supported")
