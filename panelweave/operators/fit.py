"""One distributed job that fits every candidate to every entity.

A key is (entity, candidate). Rows are laid out once, by their lowest sampling unit (without units, equal rows are
counted first and the fit works on the counts); each round joins the unit effects and the key's parameters to the rows, reduces them to grouped sums, solves one small system per
key, and walks back down the nesting to refresh the unit effects and variance components. Keys that have
converged leave the loop. Every round ends in a written table, so the plan never grows and a lost executor
costs one round at most. Where every entity has few rows, the keys are dealt to tasks instead, which run the same rounds (``rounds``).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.special import lgamma
from panelweave.operators import solve
from panelweave.operators.batches import Layout, make_effects, make_level_sums, make_row_sums
from panelweave.operators.levels import level_index
from panelweave.operators.likelihood import FORMS, ZEROS
from panelweave.operators.rounds import STATE, make_key_rounds
from panelweave.session import Ledger, bounded_join
from panelweave.sources.candidates import Candidate

ETA_LIMIT = 30.0
START_PRECISION = 4.0


@dataclass(frozen=True)
class FitSpec:
    """What to fit. ``levels`` lists the nested units from the outermost in; none means no random effects.

    ``period=None`` fits a single mean. ``trials`` switches to proportions. ``successes`` is the fixed count
    of the successes form. ``prior_mean`` and ``prior_sd`` give (intercept, other coefficients) of a Gaussian
    prior. A key with at most ``key_rows`` rows is fitted within a task, unless it has a hot unit.
    """

    periods: tuple[str, ...]
    keys: tuple[str, ...] = ("species",)
    response: str = "value"
    trials: str | None = None
    period: str | None = "period"
    covariate: str | None = "x"
    levels: tuple[str, ...] = ()
    successes: float = 1.0
    prior_mean: tuple[float, float] = (0.0, 0.0)
    prior_sd: tuple[float, float] | None = None
    max_iterations: int = 40
    tolerance: float = 1e-7
    variance_tolerance: float = 5e-3
    check_every: int = 3
    hot_unit_rows: int = 200_000
    key_rows: int = 20_000

    @property
    def n_periods(self) -> int:
        return len(self.periods)

    @property
    def size(self) -> int:
        return self.n_periods * (2 if self.covariate else 1)

    @property
    def key(self) -> list[str]:
        return [*self.keys, "cand"]


@dataclass
class Fit:
    """Result of a fit: ``coef`` has one row per key, ``state`` the total unit effects (None without levels)."""

    spec: FitSpec
    candidates: list[Candidate]
    coef: DataFrame
    rows: DataFrame
    state: DataFrame | None
    n_keys: int
    rounds: int
    cells: DataFrame
    units: DataFrame | None = None
    seconds: list[float] = field(default_factory=list)


# --- inputs ---------------------------------------------------------------------------------------------


def model_rows(panel: DataFrame, spec: FitSpec) -> DataFrame:
    """The columns a fit needs; rows without response or with an unlisted period do not take part."""
    d = level_index(spec.period, spec.periods) if spec.period else F.lit(0)
    y = F.col(spec.response).cast("double")
    n = F.col(spec.trials).cast("double") if spec.trials else F.lit(1.0)
    x = F.col(spec.covariate).cast("double") if spec.covariate else F.lit(0.0)
    constant = lgamma(n + 1.0) - lgamma(y + 1.0) - lgamma(n - y + 1.0) if spec.trials else lgamma(y + 1.0)
    rows = panel.select(
        *spec.keys, *spec.levels, d.alias("d"), x.alias("x"), y.alias("y"), n.alias("n"), constant.alias("lgy"),
        F.monotonically_increasing_id().alias("rid"),
    )
    return rows.filter(
        F.col("d").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("n").isNotNull()
    )


def period_cells(rows: DataFrame, spec: FitSpec) -> DataFrame:
    """Totals per (entity, period). In a period that isn't ``live`` nothing (or, for proportions, everything)
    was hit, so its own coefficient lies at the boundary unless a prior holds it. ``loose`` counts rows that
    miss a unit name."""
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in spec.levels], F.lit(False))
    cells = rows.groupBy(*spec.keys, "d").agg(
        F.count("*").alias("rows"), F.sum("y").alias("total"), F.sum("n").alias("trials"),
        F.count_if(F.col("y") == 0).alias("zeros"), F.count_if(missing).alias("loose"),
    )
    live = F.col("total") > 0
    if spec.trials:
        live = live & (F.col("total") < F.col("trials"))
    return cells.withColumn("live", live)


def starting_values(cells: DataFrame, entities: DataFrame, spec: FitSpec, candidates: list[Candidate]) -> DataFrame:
    """One row per key with starting parameters; ``kid`` numbers the keys."""
    spark = cells.sparkSession
    P = spec.n_periods
    used = F.lit(True) if spec.prior_sd else F.col("live")
    edge = F.when(F.col("live"), 0.0).otherwise(0.5)  # a start for periods that only the prior holds
    of = F.col("trials") if spec.trials else F.col("rows")
    mean = (F.col("total") + edge) / (of + 2.0 * edge)
    start = F.ln(mean / (1.0 - mean)) if spec.trials else F.ln(mean)
    zero_share = F.least(F.greatest(F.col("zeros") / F.col("rows"), F.lit(0.02)), F.lit(0.95))
    half = 0.5 * zero_share

    def by_period(value: Column, missing: float) -> Column:
        return F.array(*[
            F.coalesce(F.max(F.when((F.col("d") == i) & used, value)), F.lit(missing)) for i in range(P)
        ])

    slopes = F.array_repeat(F.lit(0.0), spec.size - P)
    entity = cells.groupBy(*spec.keys).agg(
        by_period(start, float("nan")).alias("levels_"),
        by_period(F.ln(half / (1.0 - half)), 0.0).alias("zbeta"),
        (F.sum(F.when(used, F.col("zeros"))) / F.sum(F.when(used, F.col("rows")))).alias("zero_share"),
        (F.sum("zeros") / F.sum("rows")).alias("hurdle_share"),
        F.sum("total").alias("total"),
        F.sum("rows").alias("n_rows"),
        F.sum("loose").alias("n_loose"),
        F.max(used).alias("any"),
        (F.count("*") < P).alias("gap"),
    ).filter("any")
    table = []
    for i, c in enumerate(candidates):
        form = {"binomial": 0, "betabinomial": 2}.get(c.name, FORMS[c.variance])
        table.append((i + 1, form, ZEROS[c.zero], c.successes, c.restricted))
    chosen = spark.createDataFrame(table, "cand int, form int, zero int, fixed boolean, restricted boolean")
    share = F.least(F.greatest(F.col("hurdle_share"), F.lit(1e-9)), F.lit(1 - 1e-9))
    half_all = F.least(F.greatest(0.5 * F.col("zero_share"), F.lit(0.01)), F.lit(0.9))
    size = spec.size
    start_k = F.lit(-3.0) if spec.trials else F.lit(-0.7)
    numbered = bounded_join(entity, entities, list(spec.keys))
    return numbered.crossJoin(F.broadcast(chosen)).select(
        (F.col("eid") * len(candidates) + F.col("cand") - 1).alias("kid"), "eid", *spec.key, "form", "zero", "fixed", "restricted",
        F.when(F.col("restricted"), F.col("n_rows") - F.col("n_loose")).otherwise(F.col("n_rows")).alias("n_rows"),
        F.when(F.col("restricted"), F.col("n_loose")).otherwise(F.lit(0)).alias("n_dropped"), "gap",
        F.concat("levels_", slopes).alias("beta"),
        F.array_repeat(F.lit(0.0), size + 2).alias("solution"),
        F.array_repeat(F.lit(float("nan")), size * size).alias("cov"),
        "zbeta",
        F.array_repeat(F.lit(float("nan")), P * P).alias("zcov"),
        F.when(F.col("fixed"), F.lit(-float(np.log(spec.successes)))).otherwise(start_k).alias("logk"),
        F.when(F.col("zero") == 1, F.ln(share / (1.0 - share)))
        .when(F.col("zero") == 2, F.ln(half_all / (1.0 - half_all)))
        .otherwise(F.lit(0.0)).alias("zpar"),
        F.array_repeat(F.lit(START_PRECISION), len(spec.levels)).alias("prec"),
        F.array_repeat(F.lit(START_PRECISION), len(spec.levels)).alias("zprec"),
        F.lit(0.0).alias("pen"),
        F.lit(float("nan")).alias("ll"),
        F.lit(0.0).alias("logdet"),
        F.lit(float("inf")).alias("delta"),
        F.lit(0).alias("iterations"),
        F.array().cast("array<double>").alias("trace"),
        F.array().cast("array<double>").alias("start"),
        F.lit("running").alias("status"),
    )


# --- layout ---------------------------------------------------------------------------------------------


def unit_ids(levels: int) -> list[str]:
    return [f"u{i + 1}" for i in range(levels)]


def number_units(rows: DataFrame, spec: FitSpec, ledger: Ledger) -> DataFrame:
    """Ids for the units of every level, nested: one row per lowest unit with the ids above it."""
    names = list(spec.levels)
    table = None
    for i in range(len(names)):
        distinct = rows.select("eid", *names[: i + 1]).distinct()
        numbered = distinct.withColumn(f"u{i + 1}", F.monotonically_increasing_id())
        if table is not None:
            numbered = numbered.join(table, ["eid", *names[:i]])
        table = ledger.keep(numbered, f"units{i + 1}")
    return table


def hot_units(rows: DataFrame, unit: list[str], limit: int) -> DataFrame:
    """Units with more rows than ``limit`` and the number of parts to split them into."""
    return (
        rows.groupBy(*unit).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit)
        .select(*unit, F.ceil(F.col("__n") / limit).cast("int").alias("parts"))
    )


def lay_out(rows: DataFrame, unit: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Hash rows by their lowest unit, once, so that later joins move only the unit table.

    Units above the row limit are split into parts; there are at most (rows / limit) of them. Returns the
    rows and the table of split units (None when there are none).
    """
    hot = hot_units(rows, [unit], limit)
    n_hot = hot.count()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n_hot == 0:
        return rows.repartition(partitions, unit).sortWithinPartitions(unit), None
    part = F.pmod(F.xxhash64("rid"), F.coalesce(F.col("parts"), F.lit(1)))  # the same part on every attempt
    laid = bounded_join(rows, hot, [unit], "left", rows=n_hot).withColumn("part", part.cast("int")).drop("parts")
    return laid.repartition(partitions, unit, "part").sortWithinPartitions(unit, "part"), hot


def collapsed(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number as ``weight``; counted within tasks before the shuffle."""
    values = [c for c in rows.columns if c != "rid"]
    return rows.groupBy(*values).agg(F.count("*").cast("double").alias("weight"))


def spread_state(state: DataFrame, hot: DataFrame | None, unit: str) -> DataFrame:
    """Repeat the effects of split units once per part."""
    if hot is None:
        return state
    joined = state.join(hot, unit, "left")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    return joined.withColumn("part", F.explode(parts)).drop("parts")


# --- one round ------------------------------------------------------------------------------------------

PARAMETERS = ["kid", "form", "zero", "restricted", "beta", "zbeta", "logk", "zpar"]


def linked_rows(rows: DataFrame, coef: DataFrame, state: DataFrame | None, hot: DataFrame | None,
                spec: FitSpec, n_keys: int, units: list[str]) -> DataFrame:
    """Rows with the parameters and linear predictors of every key.

    Rows of a period that isn't live say nothing about the mean without a prior; a hurdle's zero part needs them
    all the same.
    """
    P = spec.n_periods
    if state is None:
        linked = bounded_join(rows, coef.select("eid", *PARAMETERS), ["eid"], rows=n_keys)
        offset, zoffset = F.lit(0.0), F.lit(0.0)
    else:
        unit = unit_ids(len(spec.levels))[-1]
        spread = spread_state(state.select(unit, "kid", "o", "zo"), hot, unit)
        linked = rows.join(spread, [unit] + (["part"] if hot is not None else []))
        linked = bounded_join(linked, coef.select(*PARAMETERS), ["kid"], rows=n_keys)
        offset, zoffset = F.col("o"), F.col("zo")
    if not spec.prior_sd:
        linked = linked.filter(F.col("live") | (F.col("zero") == ZEROS["hurdle"]))
    d = F.col("d")
    eta = F.nanvl(F.col("beta")[d], F.lit(0.0)) + offset
    if spec.covariate:
        eta = eta + F.nanvl(F.col("beta")[d + P], F.lit(0.0)) * F.col("x")
    ez = F.nanvl(F.col("zbeta")[d], F.lit(0.0)) + zoffset

    def clipped(c: Column) -> Column:
        return F.greatest(F.least(c, F.lit(ETA_LIMIT)), F.lit(-ETA_LIMIT))

    return linked.select(
        "kid", *units, "d", "x", "y", "n", "lgy", "weight", clipped(eta).alias("eta"),
        clipped(ez).alias("ez"), "form", "zero", "restricted", "logk", "zpar",
    )


def sums_schema(layout: Layout, units: list[str]) -> T.StructType:
    ids = [T.StructField("kid", T.LongType()), T.StructField("slot", T.IntegerType())]
    ids += [T.StructField(u, T.LongType()) for u in units]
    return T.StructType(ids + [T.StructField(n, T.DoubleType()) for n in layout.names])


def summed(df: DataFrame, batch_function, layout: Layout, units: list[str]) -> DataFrame:
    """Apply a batch function and add its partial sums."""
    partial = df.mapInPandas(batch_function, sums_schema(layout, units))
    return partial.groupBy("kid", "slot", *units).agg(*[F.expr(f"sum({n}) AS {n}") for n in layout.names])


def packed_by_key(tables: list[DataFrame], layout: Layout) -> DataFrame:
    """Key-level slots of several tables as one vector per key (a fixed, small number of slots each)."""
    slots = [t.filter("slot > 0").select("kid", "slot", *layout.names) for t in tables]
    total = reduce(DataFrame.unionByName, slots).groupBy("kid", "slot").agg(
        *[F.expr(f"sum({n}) AS {n}") for n in layout.names]
    )
    vector = f"array({', '.join(layout.names)})"
    return total.groupBy("kid").agg(
        F.expr(f"flatten(transform(sort_array(collect_list(struct(slot, {vector} AS v))), r -> r.v)) AS packed")
    )


def prior_terms(spec: FitSpec):
    """Gaussian prior on treatment-coded coefficients as a penalty in per-period coding."""
    if spec.prior_sd is None:
        return None
    map_ = solve.treatment_map(spec.n_periods, spec.covariate is not None)
    sd = np.full(spec.size, spec.prior_sd[1])
    mean = np.full(spec.size, spec.prior_mean[1])
    sd[0], mean[0] = spec.prior_sd[0], spec.prior_mean[0]
    precision = map_.T @ np.diag(1 / sd**2) @ map_
    return precision, map_.T @ (mean / sd**2)


def per_key(packed: DataFrame, coef: DataFrame, function, n_keys: int) -> DataFrame:
    """Run a batch function on one row per key: its parameters and its packed sums."""
    joined = bounded_join(coef, packed, ["kid"], rows=n_keys)
    return joined.mapInPandas(solve.with_columns(function, coef.columns), coef.schema)


def climb(table: DataFrame, coef: DataFrame, spec: FitSpec, layout: Layout, ledger: Ledger, n_keys: int) -> list[DataFrame]:
    """Eliminate the levels from the lowest up. Returns the written table of each level, top first, after the
    key-level one."""
    out = [ledger.write(table, f"level{len(spec.levels)}")]
    for i in reversed(range(len(spec.levels))):
        precisions = coef.select("kid", F.col("prec")[i].alias("prec"), F.col("zprec")[i].alias("zprec"))
        units = bounded_join(out[0].filter("slot = 0"), precisions, ["kid"], rows=n_keys)
        above = unit_ids(i)
        sums = summed(units.select("kid", *above, *layout.names, "prec", "zprec"), make_level_sums(layout, above), layout, above)
        out.insert(0, ledger.write(sums, f"level{i}") if i else sums)
    return out


def descend(tables: list[DataFrame], coef: DataFrame, spec: FitSpec, layout: Layout, ledger: Ledger, n_keys: int) -> list[DataFrame]:
    """Unit effects of every level, top first; each table also holds its key-level sums."""
    out = []
    own = [f"v{i}" for i in range(layout.size + 4)]
    for i, table in enumerate(tables):
        units = unit_ids(i + 1)
        flat = [F.col("prec")[i].alias("prec"), F.col("zprec")[i].alias("zprec")]
        flat += [F.col("solution")[q].alias(f"s{q}") for q in range(layout.full)]
        flat += [F.col("zbeta")[q].alias(f"z{q}") for q in range(layout.periods)]
        linked = bounded_join(table.filter("slot = 0"), coef.select("kid", *flat), ["kid"], rows=n_keys)
        if out:
            above = out[-1].filter("slot = 0").select("kid", units[-2], *[F.col(v).alias(f"o{v[1:]}") for v in own])
            linked = linked.join(above, ["kid", units[-2]])
        slots = layout.slots(layout.effect_length)
        function = make_effects(layout, units, i, i * slots)
        out.append(ledger.write(linked.drop("slot").mapInPandas(function, sums_schema(layout, units)), f"effects{i + 1}"))
    return out


def most_rows(rows: DataFrame, loose: DataFrame | None) -> int:
    """Rows of the entity that has most of them."""
    whole = [t.groupBy("eid").agg(F.count("*").alias("n")) for t in (rows, loose) if t is not None]
    counted = reduce(DataFrame.unionByName, whole).groupBy("eid").agg(F.sum("n").alias("n"))
    return counted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def named_not_converged(coef: DataFrame) -> DataFrame:
    return coef.withColumn("status", F.when(F.col("status") == "running", "not_converged").otherwise(F.col("status")))


def fit_in_tasks(rows: DataFrame, loose: DataFrame | None, coef: DataFrame, spec: FitSpec, layout: Layout, ledger: Ledger,
                 n_keys: int) -> tuple[DataFrame, DataFrame | None, list[float]]:
    """The keys as they end, their unit effects and the time taken, each key with its rows in one task."""
    began = time.time()
    units = unit_ids(len(spec.levels))
    columns = ["eid", *units, "d", "x", "y", "n", "lgy", "live", "weight"]
    given = rows.select(*columns, F.lit(False).alias("loose"))
    if loose is not None:
        alone = loose.select(*[F.lit(0).cast("long").alias(c) if c in units else F.col(c) for c in columns], F.lit(True).alias("loose"))
        given = given.unionByName(alone)
    parts = max(1, min(n_keys, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ids = coef.select("eid", F.col("kid").alias("of"))
    keyed = bounded_join(given, ids, ["eid"], rows=n_keys).drop("eid").repartition(parts, "of")
    end = solve.make_round_end(layout, len(spec.levels), spec.variance_tolerance, spec.tolerance) if spec.levels else None
    run = make_key_rounds(
        layout, units, coef.columns, spec.trials is not None, spec.covariate is not None, spec.prior_sd is not None, ETA_LIMIT,
        solve.make_step(layout, prior_terms(spec), bool(spec.levels), spec.tolerance), end, spec.max_iterations, spec.check_every,
    )
    kinds = [T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType()), T.ArrayType(T.DoubleType())]
    schema = T.StructType([*coef.schema.fields, *[T.StructField(n, k) for n, k in zip(STATE, kinds)]])
    told = keyed.groupBy("of").cogroup(coef.repartition(parts, "kid").groupBy("kid")).applyInPandas(run, schema)
    done = ledger.keep(named_not_converged(told), "done")
    state = None
    if spec.levels:
        state = done.select("kid", F.explode(F.arrays_zip(*STATE)).alias("u")).select(
            "kid", F.col("u.state_unit").alias(units[-1]), F.col("u.state_o").alias("o"), F.col("u.state_zo").alias("zo")
        )
    return done.drop(*STATE), state, [time.time() - began]


def fit_in_rounds(rows: DataFrame, loose: DataFrame | None, hot: DataFrame | None, coef: DataFrame, spec: FitSpec, layout: Layout,
                  ledger: Ledger, n_keys: int) -> tuple[DataFrame, DataFrame | None, list[float]]:
    """The keys as they end, their unit effects and the time of each round, in rounds of jobs over all rows."""
    units = unit_ids(len(spec.levels))
    step = solve.make_step(layout, prior_terms(spec), bool(spec.levels), spec.tolerance)
    state: DataFrame | None = None
    finished: list[DataFrame] = []
    finished_state: list[DataFrame] = []
    seconds: list[float] = []
    rounds = 0
    while True:
        began = time.time()
        rounds += 1
        linked = linked_rows(rows, coef, state, hot, spec, n_keys, units)
        sums = summed(linked, make_row_sums(layout, units, spec.trials is not None, not spec.levels), layout, units)
        free = []
        if loose is not None:  # rows without a unit: no effect on the draws path, no part in the other one
            alone = linked_rows(loose, coef, None, None, spec, n_keys, []).filter("NOT restricted")
            free = [summed(alone, make_row_sums(layout, [], spec.trials is not None), layout, [])]
        if not spec.levels:
            coef = ledger.write(per_key(packed_by_key([sums], layout), coef, step, n_keys), "coef")
        else:
            tables = climb(sums, coef, spec, layout, ledger, n_keys)
            coef = ledger.write(per_key(packed_by_key(tables + free, layout), coef, step, n_keys), "step")
            effects = descend(tables[1:], coef, spec, layout, ledger, n_keys)
            end = solve.make_round_end(layout, len(spec.levels), spec.variance_tolerance, spec.tolerance)
            coef = ledger.write(per_key(packed_by_key(effects, layout), coef, end, n_keys), "coef")
            state = effects[-1].filter("slot = 0").select(
                "kid", units[-1], F.col("v0").alias("o"), F.col(f"v{layout.size + 2}").alias("zo")
            )
        last = rounds == spec.max_iterations
        if rounds % spec.check_every == 0 or last:
            statuses = {r["status"] for r in coef.select("status").distinct().collect()}
            if last or statuses - {"running"}:
                ended = "true" if last else "status != 'running'"
                done = ledger.keep(named_not_converged(coef.filter(ended)), "done")
                finished.append(done)
                coef = ledger.write(coef.filter(f"NOT ({ended})"), "coef")
                if state is not None:
                    ids = done.select("kid")
                    finished_state.append(ledger.keep(bounded_join(state, ids, ["kid"], "left_semi", rows=n_keys), "done_state"))
                    state = bounded_join(state, coef.select("kid"), ["kid"], "left_semi", rows=n_keys)
            if last or "running" not in statuses:
                break
        seconds.append(time.time() - began)
    whole_state = reduce(DataFrame.unionByName, finished_state) if finished_state else None
    return reduce(DataFrame.unionByName, finished), whole_state, seconds


def fit(panel: DataFrame, spec: FitSpec, candidates: list[Candidate]) -> Fit:
    """Fit all candidates to all entities. Never raises for a single key: see the status column."""
    spark = panel.sparkSession
    ledger = Ledger(spark)
    layout = Layout(spec.n_periods, spec.size, any(c.zero == "regression" for c in candidates))
    units = unit_ids(len(spec.levels))

    rows = ledger.keep(model_rows(panel, spec), "input")  # the panel is read once, not once per round
    cells = ledger.keep(period_cells(rows, spec), "cells")
    entities = ledger.keep(
        cells.select(*spec.keys).distinct().withColumn("eid", F.monotonically_increasing_id()), "entities"
    )
    n_entities = entities.count()
    n_keys = n_entities * len(candidates)
    live = bounded_join(cells.select(*spec.keys, "d", "live"), entities, list(spec.keys), rows=n_entities)
    rows = bounded_join(rows, live, [*spec.keys, "d"], rows=n_entities * spec.n_periods).drop(*spec.keys)
    hot, unit_table, loose = None, None, None
    if spec.levels:
        named = reduce(Column.__and__, [F.col(c).isNotNull() for c in spec.levels])
        if cells.agg(F.sum("loose")).first()[0]:
            loose = ledger.keep(collapsed(rows.filter(~named).drop(*spec.levels)), "loose")
        rows = rows.filter(named).withColumn("weight", F.lit(1.0))
        unit_table = number_units(rows, spec, ledger)
        n_units = unit_table.count()
        rows = bounded_join(rows, unit_table, ["eid", *spec.levels], rows=n_units).drop(*spec.levels)
        rows, hot = lay_out(rows, units[-1], spec.hot_unit_rows)
    else:
        rows = collapsed(rows)
    rows = rows.persist()
    coef = ledger.write(starting_values(cells, entities, spec, candidates), "coef")
    most = most_rows(rows, loose)
    if most <= min(spec.key_rows, spec.hot_unit_rows):
        ended, state, seconds = fit_in_tasks(rows, loose, coef, spec, layout, ledger, n_keys)
    else:
        ended, state, seconds = fit_in_rounds(rows, loose, hot, coef, spec, layout, ledger, n_keys)
    rows.unpersist()
    result = ledger.keep(finish(ended, cells, spec, candidates), "fit")
    rounds = result.agg(F.coalesce(F.max("iterations"), F.lit(0))).first()[0]
    ledger.clear()
    return Fit(spec, candidates, result, rows, state, n_keys, rounds, cells, unit_table, seconds)


def unit_effects(fitted: Fit) -> DataFrame:
    """Total effect of every lowest unit, on the link scale of the mean (and of the zero part)."""
    keys = fitted.coef.select("kid", *fitted.spec.key, "mod", "name", "zi").filter("kid IS NOT NULL")
    unit = unit_ids(len(fitted.spec.levels))[-1]
    named = fitted.state.join(fitted.units.select(unit, *fitted.spec.levels), unit)
    return bounded_join(named, keys, ["kid"], rows=fitted.n_keys).select(
        *fitted.spec.keys, "mod", "name", "zi", *fitted.spec.levels, F.col("o").alias("effect"), F.col("zo").alias("zero_effect")
    )


def named_end(spec: FitSpec) -> Column:
    """What a finished fit ended as, told apart from ``ok``.

    ``at_bound``: the dispersion or the zero part grew to its limit, so the estimates mean nothing. The others are
    usable limits: no over-dispersion, no extra zeros, no variance between units, or a period without rows.
    """
    dispersion = (F.col("form") > 0) & ~F.col("fixed")
    zeros = F.col("zero").isin(2, 3)
    (k_low, k_high), (z_low, z_high) = solve.LOGK_RANGE, solve.ZPAR_RANGE
    lost = (dispersion & (F.col("logk") > k_high - 1e-6)) | (zeros & (F.col("zpar") > z_high - 1e-6))
    top = float(np.exp(solve.LOG_PRECISION_RANGE[1]))
    still = F.exists("prec", lambda v: v > 0.999 * top) if spec.levels else F.lit(False)
    ended = (
        F.when(lost, "at_bound")
        .when(F.col("gap") & F.lit(spec.period is not None), "period_unobserved")
        .when(dispersion & (F.col("logk") < k_low + 1e-6), "no_overdispersion")
        .when(zeros & (F.col("zpar") < z_low + 1e-6), "no_extra_zeros")
        .when(still, "no_unit_variance")
        .otherwise("ok")
    )
    return F.when(F.col("status") == "ok", ended).otherwise(F.col("status"))


def finish(coef: DataFrame, cells: DataFrame, spec: FitSpec, candidates: list[Candidate]) -> DataFrame:
    """Add names and treatment coding; entities that were never counted appear with status ``all_zero``."""
    spark = coef.sparkSession
    names = spark.createDataFrame(
        [(i + 1, c.mod, c.name, c.fam, c.type, c.zi, -1.0 if c.successes else 1.0,
          float(np.log(spec.successes)) if c.successes else 0.0) for i, c in enumerate(candidates)],
        "cand int, mod string, name string, fam string, type string, zi boolean, sign double, shift double",
    )
    named = coef.join(F.broadcast(names), "cand").withColumn("status", named_end(spec))
    schema = T.StructType([
        *named.schema.fields,
        *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("coef", "coef_cov", "coef_chol")],
    ])
    full = named.mapInPandas(solve.make_recode(spec.n_periods, spec.covariate is not None), schema)
    held = F.max("live") if not spec.prior_sd else F.lit(True)
    empty = cells.groupBy(*spec.keys).agg(held.alias("any")).filter(~F.col("any")).drop("any")
    missing = empty.crossJoin(F.broadcast(names)).withColumn("status", F.lit("all_zero"))
    return full.unionByName(missing, allowMissingColumns=True)
