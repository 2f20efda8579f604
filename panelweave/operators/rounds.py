"""All rounds of a key within one task, for keys of few rows.

A round over few rows costs little but the jobs it takes. Keys are independent, so Spark deals them to tasks (key by key, with the
key's rows), and each task runs the batch functions of a round on its keys until they end.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from panelweave.operators.batches import Layout, make_effects, make_level_sums, make_row_sums
from panelweave.operators.likelihood import ZEROS

# Ship these functions with the job, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a key's fit tells of its lowest units: id, total effect and total effect of the zero part.
STATE = ["state_unit", "state_o", "state_zo"]


def _parts(frames, layout: Layout) -> tuple[np.ndarray, pd.DataFrame | None]:
    """Packed sums of the key and the unit rows from what a batch function yields for one batch of one key."""
    vector, units = np.zeros(0), None
    for frame in frames:
        if frame["slot"].iloc[0] > 0:
            vector = frame[layout.names].to_numpy().ravel()
        else:
            units = frame
    return vector, units


def _total(vectors: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(max(map(len, vectors)))
    for v in vectors:
        total[: len(v)] += v
    return total


def make_key_rounds(
    layout: Layout, units: list[str], columns: list[str], proportions: bool, covariate: bool, held: bool, limit: float,
    step: Callable, end: Callable | None, rounds: int, check_every: int,
):
    """A function of a key's rows and its one row of parameters: that row as its fit ends, with its unit effects.

    ``held``: a prior holds periods in which nothing was counted. ``limit`` bounds predictors. A key ends as in rounds over whole tables: where
    its status is looked at, every ``check_every`` rounds.
    """
    P, L = layout.periods, len(units)
    of_rows = make_row_sums(layout, units, proportions, not units)
    of_loose = make_row_sums(layout, [], proportions)
    of_levels = [make_level_sums(layout, units[:i]) for i in range(L)]
    slots = layout.slots(layout.effect_length)
    of_effects = [make_effects(layout, units[: i + 1], i, i * slots) for i in range(L)]
    none = pd.DataFrame(columns=[*columns, *STATE])

    def linked(rows: pd.DataFrame, key: pd.Series, offset, zoffset) -> pd.DataFrame:
        d = rows["d"].to_numpy()
        beta, zbeta = (np.nan_to_num(np.asarray(key[name], float), posinf=np.inf, neginf=-np.inf) for name in ("beta", "zbeta"))
        eta = beta[d] + offset
        if covariate:
            eta = eta + beta[d + P] * rows["x"].to_numpy()
        ez = zbeta[d] + zoffset
        clipped = {name: np.fmax(np.fmin(v, limit), -limit) for name, v in (("eta", eta), ("ez", ez))}
        fixed = {name: np.full(len(rows), key[name]) for name in ("kid", "form", "zero", "logk", "zpar")}
        return rows.assign(**clipped, **fixed)

    def climbed(sums: pd.DataFrame, key: pd.Series, vectors: list[np.ndarray]) -> list[pd.DataFrame]:
        """Unit rows of every level, top first; adds what each level says of the key to ``vectors``."""
        tables = [sums]
        for i in reversed(range(L)):
            below = tables[0].assign(prec=key["prec"][i], zprec=key["zprec"][i])
            vector, above = _parts(of_levels[i]([below]), layout)
            vectors.append(vector)
            if i:
                tables.insert(0, above)
        return tables

    def descended(tables: list[pd.DataFrame], key: pd.Series) -> tuple[np.ndarray, pd.DataFrame]:
        flat = {f"s{q}": v for q, v in enumerate(key["solution"])} | {f"z{q}": v for q, v in enumerate(key["zbeta"])}
        vectors, above = [], None
        for i, table in enumerate(tables):
            wide = table.assign(prec=key["prec"][i], zprec=key["zprec"][i], **flat)
            if above is not None:
                known = above.set_index(units[i - 1])[[f"v{q}" for q in range(layout.size + 4)]].reindex(table[units[i - 1]])
                wide = wide.assign(**{f"o{name[1:]}": values.to_numpy() for name, values in known.items()})
            vector, above = _parts(of_effects[i]([wide]), layout)
            vectors.append(vector)
        return np.concatenate(vectors), above

    def run(rows: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or keys.empty:
            return none
        if not held:
            rows = rows[rows["live"] | (keys["zero"].iloc[0] == ZEROS["hurdle"])]
        loose = rows[rows["loose"]] if not keys["restricted"].iloc[0] else rows[:0]
        rows = rows[~rows["loose"]]
        if rows.empty:
            return none
        offset = zoffset = 0.0
        state = None
        for turn in range(1, rounds + 1):
            key = keys.iloc[0]
            vector, sums = _parts(of_rows([linked(rows, key, offset, zoffset)]), layout)
            vectors = [vector]
            if len(loose):
                vectors.append(_parts(of_loose([linked(loose, key, 0.0, 0.0)]), layout)[0])
            tables = climbed(sums, key, vectors) if L else []
            keys = step(keys.assign(packed=[_total(vectors)]))[columns]
            if L:
                vector, lowest = descended(tables, keys.iloc[0])
                keys = end(keys.assign(packed=[vector]))[columns]
                state = lowest.set_index(units[-1])[["v0", f"v{layout.size + 2}"]]
                found = state.reindex(rows[units[-1]]).to_numpy()
                offset, zoffset = found[:, 0], found[:, 1]
            if (turn % check_every == 0 or turn == rounds) and keys["status"].iloc[0] != "running":
                break
        ids = [] if state is None else state.index.to_numpy()
        effects = ([], []) if state is None else state.to_numpy().T
        return keys.assign(**{name: [list(v)] for name, v in zip(STATE, (ids, *effects))})

    return run
