"""Nested random intercepts by grouped elimination.

A linear system with weights, a design of p columns and random intercepts on nested units needs, per unit,
only the sums a = sum w, b = sum w x, c = sum w z, XX = sum w x x' and Xz = sum w x z. Eliminating a level
turns each unit's sums into adjusted ones that add up to the sums of the unit above, so every step is a
grouped sum with map-side partial sums and no unit is ever gathered in one place. Going down again, each
unit's effect follows from its own sums and the total effect above it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class System:
    """Column names of one linear system; ``name`` keeps systems of the same job apart."""

    name: str
    size: int

    def col(self, what: str) -> str:
        return f"{self.name}_{what}"

    def b(self, i: int) -> str:
        return f"{self.name}_b{i}"

    def xx(self, i: int, j: int) -> str:
        return f"{self.name}_xx{min(i, j)}_{max(i, j)}"

    def xz(self, i: int) -> str:
        return f"{self.name}_xz{i}"

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.size) for j in range(i, self.size)]

    @property
    def sums(self) -> list[str]:
        return [
            self.col("a"), self.col("c"), self.col("ld"),
            *[self.b(i) for i in range(self.size)],
            *[self.xz(i) for i in range(self.size)],
            *[self.xx(i, j) for i, j in self.pairs],
        ]


def eliminated(system: System) -> dict[str, str]:
    """Sums of the level above, contributed by one unit; ``<name>_k`` is 1 / (a + precision) and
    ``<name>_h`` the shrinkage precision / (a + precision)."""
    k, h = system.col("k"), system.col("h")
    a, c = system.col("a"), system.col("c")
    out = {a: f"{a} * {h}", c: f"{c} * {h}", system.col("ld"): f"{system.col('ld')} - ln({h})"}
    for i in range(system.size):
        out[system.b(i)] = f"{system.b(i)} * {h}"
        out[system.xz(i)] = f"{system.xz(i)} - {k} * {system.b(i)} * {c}"
    for i, j in system.pairs:
        out[system.xx(i, j)] = f"{system.xx(i, j)} - {k} * {system.b(i)} * {system.b(j)}"
    return out


def eliminate(df: DataFrame, keys: list[str], systems: dict[System, str], carry: list[str] = ()) -> DataFrame:
    """Eliminate the lowest level of ``df``, whose precision is given as SQL text, and sum to ``keys``;
    ``carry`` columns are just summed."""
    factors = []
    columns = {name: name for name in carry}
    for system, precision in systems.items():
        total = f"({system.col('a')} + {precision})"
        factors += [f"1.0D / {total} AS {system.col('k')}", f"{precision} / {total} AS {system.col('h')}"]
        columns.update(eliminated(system))
    sums = [F.expr(f"sum({text}) AS {name}") for name, text in columns.items()]
    return df.selectExpr("*", *factors).groupBy(*keys).agg(*sums)


def effects(
    system: System, precision: str, beta: str, cov: str | None, top: bool, restricted: str | None = None,
    cov_size: int = 0,
) -> list[dict[str, str]]:
    """Effect of a unit given the total above it, as SQL text in three stages.

    Reads ``<name>_o`` (total effect above), ``<name>_vo`` (its variance) and ``<name>_g<i>`` (its derivative
    in the coefficients); yields the same for the totals including this unit (suffix ``_new``), plus the
    effect ``u`` and its variance ``v``. With ``cov`` the variance includes the uncertainty of the
    coefficients (restricted likelihood) where ``restricted`` holds; it covers the first ``cov_size`` columns.
    """
    n = system.name
    a, c, k = system.col("a"), system.col("c"), system.col("k")
    above, above_v = ("0.0D", "0.0D") if top else (f"{n}_o", f"{n}_vo")
    fitted = " - ".join([f"{c} - {a} * {above}", *[f"{system.b(i)} * nanvl({beta}[{i}], 0.0D)" for i in range(system.size)]])
    effect = {f"{n}_u": f"{k} * ({fitted})"}
    variance = f"{k} + {k} * {a} * {k} * {a} * {above_v}"
    totals = {f"{n}_o_new": f"{above} + {n}_u", f"{n}_vo_new": f"{k} + {above_v} * (1.0D - {k} * {a}) * (1.0D - {k} * {a})"}
    if cov is not None:
        for i in range(cov_size):
            up = "0.0D" if top else f"{n}_g{i}"
            effect[f"{n}_d{i}"] = f"-{k} * ({system.b(i)} + {a} * {up})"
            totals[f"{n}_g{i}_new"] = f"{n}_d{i}" if top else f"{n}_g{i} + {n}_d{i}"
        spread = " + ".join(
            f"{1.0 if i == j else 2.0}D * {n}_d{i} * {n}_d{j} * nanvl({cov}[{i * cov_size + j}], 0.0D)"
            for i in range(cov_size) for j in range(i, cov_size)
        )
        variance = f"{variance} + CASE WHEN {restricted} THEN {spread} ELSE 0.0D END"
    return [{k: f"1.0D / ({a} + {precision})"}, effect, {**totals, f"{n}_v": variance}]


def with_effects(df: DataFrame, keys: list[str], systems: list[list[dict[str, str]]], totals_only: bool) -> DataFrame:
    """Evaluate the stages of all systems. Keeps effect, variance and total, and, unless ``totals_only``,
    what the level below needs."""
    keep = []
    for stages in systems:
        name = next(iter(stages[1])).removesuffix("_u")
        keep += [f"{name}_u", f"{name}_v", f"{name}_o_new AS {name}_o"]
        if not totals_only:
            keep += [f"{c} AS {c.removesuffix('_new')}" for c in stages[2] if c.endswith("_new") and c != f"{name}_o_new"]
    for stage in zip(*systems):
        df = df.selectExpr("*", *[f"{text} AS {name}" for part in stage for name, text in part.items()])
    return df.selectExpr(*keys, *keep)
