"""Inline candidate tables: which likelihoods are fitted to every entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

DRAWS, WALD = "inla", "glmmTMB"  # engine labels as they appear in published tables


@dataclass(frozen=True)
class Candidate:
    mod: str
    name: str
    fam: str
    type: str
    zi: bool

    @property
    def variance(self) -> str:
        """Count variance: poisson, linear (proportional to the mean) or quadratic."""
        if "poisson" in self.name:
            return "poisson"
        return "linear" if self.name == "nbinom1" else "quadratic"

    @property
    def zero(self) -> str:
        if not self.zi:
            return "none"
        if self.mod == WALD:
            return "regression"
        return {"0": "hurdle", "1": "mixture", "2": "tied"}[self.type]

    @property
    def successes(self) -> bool:
        return self.mod == DRAWS and self.name == "nbinomial2"

    @property
    def restricted(self) -> bool:
        return self.mod == WALD


# Candidate tables in fitting order.
COUNT_CANDIDATES = [
    Candidate("inla", "zeroinflatednbinomial0", "Negative Binomial", "0", True),
    Candidate("inla", "zeroinflatednbinomial1", "Negative Binomial", "1", True),
    Candidate("inla", "zeroinflatednbinomial2", "Negative Binomial", "2", True),
    Candidate("inla", "zeroinflatedpoisson0", "Poisson", "0", True),
    Candidate("inla", "zeroinflatedpoisson1", "Poisson", "1", True),
    Candidate("inla", "nbinomial", "Negative Binomial", "", False),
    Candidate("inla", "nbinomial2", "Negative Binomial", "2", False),
    Candidate("inla", "poisson", "Poisson", "", False),
    Candidate("glmmTMB", "nbinom1", "Negative Binomial", "1", True),
    Candidate("glmmTMB", "nbinom2", "Negative Binomial", "2", True),
    Candidate("glmmTMB", "poisson", "Poisson", "", True),
    Candidate("glmmTMB", "nbinom1", "Negative Binomial", "1", False),
    Candidate("glmmTMB", "nbinom2", "Negative Binomial", "2", False),
    Candidate("glmmTMB", "poisson", "Poisson", "", False),
]
PROPORTION_CANDIDATES = [
    Candidate("inla", "binomial", "Binomial", "0", False),
    Candidate("inla", "betabinomial", "Beta-Binomial", "0", False),
    Candidate("glmmTMB", "binomial", "Binomial", "0", False),
    Candidate("glmmTMB", "betabinomial", "Beta-Binomial", "0", False),
]

# Orders in which families are tried until one fit succeeds.
FALLBACK_ORDER = ["zeroinflatednbinomial2", "zeroinflatednbinomial1", "zeroinflatedpoisson1", "nbinomial2"]
DRAFT_ORDER = ["zeroinflatednbinomial1", "zeroinflatednbinomial2", "zeroinflatedpoisson1", "nbinomial2"]


def candidate_table(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    rows = [(i + 1, c.mod, c.name, c.fam, c.type, c.zi) for i, c in enumerate(candidates)]
    return spark.createDataFrame(rows, "cand int, mod string, name string, fam string, type string, zi boolean")


def pick(mod: str, name: str, zi: bool, candidates: list[Candidate] | None = None) -> Candidate:
    for c in candidates or COUNT_CANDIDATES + PROPORTION_CANDIDATES:
        if (c.mod, c.name, c.zi) == (mod, name, zi):
            return c
    raise KeyError((mod, name, zi))
