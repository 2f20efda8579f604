"""Batch functions of the fit: each reduces an Arrow batch to partial sums that Spark then adds up.

All tables of a round have the same narrow shape: a key id, a slot, unit ids and ``WIDTH`` numbers. Slot 0 holds
the sums of one sampling unit. Slots above 0 hold pieces of the key-level system (its matrix, right side
and log determinant), to which the rows and every eliminated level contribute. A batch emits at most one
row per unit and key it contains, so whatever a hot unit or key holds is combined before it is shuffled.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from panelweave.operators.likelihood import LOGK_STEP, count_terms, proportion_terms

# Ship these functions with the job, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Layout:
    """Positions inside the packed vectors. ``periods`` levels, ``size`` design columns (levels, then
    slopes), then two columns for the zero parameter and the log dispersion; ``zero`` adds the system of the
    zero regression."""

    periods: int
    size: int
    zero: bool

    @property
    def full(self) -> int:
        return self.size + 2

    @property
    def width(self) -> int:
        """Numbers per unit: c and b of the count system, c and b of the zero system."""
        return max(1 + self.full + (1 + self.periods if self.zero else 0), 4 + self.size)

    @property
    def parts(self) -> list[tuple[str, int]]:
        f, P = self.full, self.periods
        count = [("xx", f * (f + 1) // 2), ("xz", f), ("ll", 1), ("ld", 1)]
        return count + ([("zxx", P * (P + 1) // 2), ("zxz", P), ("zld", 1), ("cross", 3 * P)] if self.zero else [])

    def slots(self, length: int) -> int:
        return -(-length // self.width)

    @property
    def system_length(self) -> int:
        return sum(n for _, n in self.parts)

    @property
    def effect_parts(self) -> list[tuple[str, int]]:
        p = self.size
        return [("units", 1), ("uu", 1), ("vv", 1), ("gg", p * (p + 1) // 2), ("zuu", 1), ("zvv", 1)]

    @property
    def effect_length(self) -> int:
        return sum(n for _, n in self.effect_parts)

    @property
    def names(self) -> list[str]:
        return [f"v{i}" for i in range(self.width)]


def split(vector: np.ndarray, parts: list[tuple[str, int]]) -> dict[str, np.ndarray]:
    """Named pieces of packed vectors (rows of ``vector``)."""
    cuts = np.cumsum([n for _, n in parts])[:-1]
    used = vector[:, : sum(n for _, n in parts)]
    return {name: piece for (name, _), piece in zip(parts, np.split(used, cuts, axis=1))}


def _key_frame(layout: Layout, kid: np.ndarray, vectors: np.ndarray, units: list[str], offset: int = 0) -> pd.DataFrame:
    """Key-level vectors as slot rows."""
    n, slots = len(kid), layout.slots(vectors.shape[1])
    padded = np.zeros((n, slots * layout.width))
    padded[:, : vectors.shape[1]] = vectors
    out = pd.DataFrame(padded.reshape(n * slots, layout.width), columns=layout.names)
    out.insert(0, "kid", np.repeat(kid, slots))
    out.insert(1, "slot", (np.tile(np.arange(1, slots + 1), n) + offset).astype("int32"))
    for i, u in enumerate(units):
        out.insert(2 + i, u, np.zeros(n * slots, dtype="int64"))
    return out


def _unit_frame(layout: Layout, kid: np.ndarray, ids: dict[str, np.ndarray], values: np.ndarray) -> pd.DataFrame:
    padded = np.zeros((len(kid), layout.width))
    padded[:, : values.shape[1]] = values
    out = pd.DataFrame(padded, columns=layout.names)
    out.insert(0, "kid", kid)
    out.insert(1, "slot", np.zeros(len(kid), dtype="int32"))
    for i, (name, value) in enumerate(ids.items()):
        out.insert(2 + i, name, value)
    return out


def _sum(code: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(code, weights=weights, minlength=n)


def make_row_sums(layout: Layout, units: list[str], proportions: bool, joint: bool = False):
    """Rows with predictors to sums per unit and per key; a row counts ``weight`` times.

    ``joint``: count part and zero regression are solved together, so the sums hold their cross information (by period: with
    levels, slopes and log dispersion).
    """
    P, p, f = layout.periods, layout.size, layout.full
    upper = {pair: i for i, pair in enumerate(zip(*np.triu_indices(f)))}

    def at(i: int, j: int) -> int:
        return upper[(min(i, j), max(i, j))]

    def row_sums(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            c = {n: pdf[n].to_numpy() for n in pdf.columns}
            if proportions:
                t = proportion_terms(c["y"], c["n"], c["lgy"], c["eta"], c["form"], c["logk"])
            else:
                t = count_terms(c["y"], c["lgy"], c["eta"], c["ez"], c["form"], c["zero"], c["logk"], c["zpar"])
            t = {name: terms * c["weight"] for name, terms in t.items()}
            d, x, eta = c["d"].astype("int64"), c["x"], c["eta"]
            wz = t["w"] * eta + t["s"]
            zwz = t["zi"] * c["ez"] + t["zs"]
            kid_code, kids = pd.factorize(c["kid"])
            n = len(kids)
            cell = kid_code * P + d

            def by_period(v):
                return _sum(cell, n * P, v).reshape(n, P)

            xx, xz = np.zeros((n, f * (f + 1) // 2)), np.zeros((n, f))
            w_sum, wz_sum = by_period(t["w"]), by_period(wz)
            extras = {p: by_period(t["hz"]), p + 1: by_period(t["hk"])}
            for i in range(P):
                xx[:, at(i, i)], xz[:, i] = w_sum[:, i], wz_sum[:, i]
                for e, sums in extras.items():
                    xx[:, at(i, e)] = sums[:, i]
            if p > P:
                wx, wxx, wxz = by_period(t["w"] * x), by_period(t["w"] * x * x), by_period(wz * x)
                slopes = {p: by_period(t["hz"] * x), p + 1: by_period(t["hk"] * x)}
                for i in range(P):
                    xx[:, at(i, P + i)], xx[:, at(P + i, P + i)], xz[:, P + i] = wx[:, i], wxx[:, i], wxz[:, i]
                    for e, sums in slopes.items():
                        xx[:, at(P + i, e)] = sums[:, i]
            xx[:, at(p, p)] = _sum(kid_code, n, t["zi"])
            xx[:, at(p, p + 1)] = _sum(kid_code, n, t["hzk"])
            xx[:, at(p + 1, p + 1)] = _sum(kid_code, n, (2 * t["ll"] - t["ll_lo"] - t["ll_hi"]) / LOGK_STEP**2)
            xz[:, p] = _sum(kid_code, n, t["zs"] + t["hz"] * eta)
            xz[:, p + 1] = _sum(kid_code, n, (t["ll_hi"] - t["ll_lo"]) / (2 * LOGK_STEP) + t["hk"] * eta)
            pieces = [xx, xz, _sum(kid_code, n, t["ll"])[:, None], np.zeros((n, 1))]
            if layout.zero:
                i, j = np.triu_indices(P)
                zw, both = by_period(t["zi"]), np.zeros((n, 3 * P))
                if joint:
                    zwz = zwz + t["hr"] * eta
                    both = np.concatenate([by_period(t["hr"]), by_period(t["hr"] * x), by_period(t["hrk"])], axis=1)
                    xz[:, :P] += by_period(t["hr"] * c["ez"])
                    if p > P:
                        xz[:, P:p] += by_period(t["hr"] * c["ez"] * x)
                    xz[:, p + 1] += _sum(kid_code, n, t["hrk"] * c["ez"])
                pieces += [np.where(i == j, zw[:, i], 0.0), by_period(zwz), np.zeros((n, 1)), both]
            yield _key_frame(layout, np.asarray(kids), np.concatenate(pieces, axis=1), units)
            if not units:
                continue
            low_code, lows = pd.factorize(c[units[-1]])
            code, pairs = pd.factorize(low_code.astype("int64") * n + kid_code)
            m = len(pairs)
            first = np.zeros(m, dtype="int64")
            first[code[::-1]] = np.arange(len(code))[::-1]
            cell = code * P + d

            def unit_period(v):
                return _sum(cell, m * P, v).reshape(m, P)

            columns = [_sum(code, m, wz)[:, None], unit_period(t["w"])]
            if p > P:
                columns.append(unit_period(t["w"] * x))
            columns += [_sum(code, m, t["hz"])[:, None], _sum(code, m, t["hk"])[:, None]]
            if layout.zero:
                columns += [_sum(code, m, zwz)[:, None], unit_period(t["zi"])]
            yield _unit_frame(layout, c["kid"][first], {u: c[u][first] for u in units}, np.concatenate(columns, axis=1))

    return row_sums


def _unit_parts(layout: Layout, pdf: pd.DataFrame):
    """c, b and a of both systems from the packed unit rows."""
    v = pdf[layout.names].to_numpy()
    f, P = layout.full, layout.periods
    c, b = v[:, 0], v[:, 1 : 1 + f]
    a = b[:, :P].sum(axis=1)
    if not layout.zero:
        return c, b, a, None, None, None
    zc, zb = v[:, 1 + f], v[:, 2 + f : 2 + f + P]
    return c, b, a, zc, zb, zb.sum(axis=1)


def _by_key(kid: np.ndarray, values: np.ndarray):
    """Sum rows of ``values`` per key."""
    code, kids = pd.factorize(kid)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(kids)))
    return np.asarray(kids), np.add.reduceat(values[order], starts, axis=0)


def make_level_sums(layout: Layout, units: list[str]):
    """Eliminate the intercepts of a level: its units' share of the level above and of the key system.

    ``units`` are the ids of the levels above (none at the top).
    """
    i, j = np.triu_indices(layout.full)
    zi, zj = np.triu_indices(layout.periods)

    def level_sums(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            kid = pdf["kid"].to_numpy()
            c, b, a, zc, zb, za = _unit_parts(layout, pdf)
            L = pdf["prec"].to_numpy()
            k, h = 1.0 / (a + L), L / (a + L)
            pieces = [-k[:, None] * b[:, i] * b[:, j], -(k * c)[:, None] * b, np.zeros((len(kid), 1)), -np.log(h)[:, None]]
            up = [(c * h)[:, None], b * h[:, None]]
            if layout.zero:
                zL = pdf["zprec"].to_numpy()
                zk, zh = 1.0 / (za + zL), zL / (za + zL)
                pieces += [-zk[:, None] * zb[:, zi] * zb[:, zj], -(zk * zc)[:, None] * zb, -np.log(zh)[:, None]]
                up += [(zc * zh)[:, None], zb * zh[:, None]]
            kids, sums = _by_key(kid, np.concatenate(pieces, axis=1))
            yield _key_frame(layout, kids, sums, units)
            if not units:
                continue
            parent = pdf[units[-1]].to_numpy()
            kid_code, names = pd.factorize(kid)
            low, _ = pd.factorize(parent)
            code, pairs = pd.factorize(low.astype("int64") * len(names) + kid_code)
            first = np.zeros(len(pairs), dtype="int64")
            first[code[::-1]] = np.arange(len(code))[::-1]
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(pairs)))
            total = np.add.reduceat(np.concatenate(up, axis=1)[order], starts, axis=0)
            yield _unit_frame(layout, kid[first], {u: pdf[u].to_numpy()[first] for u in units}, total)

    return level_sums


def make_effects(layout: Layout, units: list[str], level: int, slot_offset: int):
    """Unit effects of a level given the totals above it.

    Unit rows hold: total effect, its variance, its derivative in the design coefficients, and total and
    variance of the zero part. Key slots hold the sums that move the variance components; the products of the
    derivatives give the part that the uncertainty of the coefficients adds (restricted likelihood).
    """
    p, P = layout.size, layout.periods
    i, j = np.triu_indices(p)

    def unit_effects(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            kid = pdf["kid"].to_numpy()
            c, b, a, zc, zb, za = _unit_parts(layout, pdf)
            n = len(kid)
            above = pdf[[f"o{q}" for q in range(p + 4)]].to_numpy() if level else np.zeros((n, p + 4))
            o, vo, g, zo, zvo = above[:, 0], above[:, 1], above[:, 2 : 2 + p], above[:, 2 + p], above[:, 3 + p]
            solution = pdf[[f"s{q}" for q in range(layout.full)]].to_numpy()
            k = 1.0 / (a + pdf["prec"].to_numpy())
            u = k * (c - (b * solution).sum(axis=1) - a * o)
            ka = k * a
            v = k + ka * ka * vo
            slope = -k[:, None] * (b[:, :p] + a[:, None] * g)
            zu = zv = np.zeros(n)
            zo_new, zvo_new = zo, zvo
            if layout.zero:
                zeta = np.nan_to_num(pdf[[f"z{q}" for q in range(P)]].to_numpy())
                zk = 1.0 / (za + pdf["zprec"].to_numpy())
                zu = zk * (zc - (zb * zeta).sum(axis=1) - za * zo)
                zv = zk + (zk * za) ** 2 * zvo
                zo_new, zvo_new = zo + zu, zk + zvo * (1 - zk * za) ** 2
            own = [(o + u)[:, None], (k + vo * (1 - ka) ** 2)[:, None], g + slope, zo_new[:, None], zvo_new[:, None]]
            moments = [np.ones((n, 1)), (u * u)[:, None], v[:, None], slope[:, i] * slope[:, j], (zu * zu)[:, None], zv[:, None]]
            kids, sums = _by_key(kid, np.concatenate(moments, axis=1))
            yield _key_frame(layout, kids, sums, units, slot_offset)
            yield _unit_frame(layout, kid, {q: pdf[q].to_numpy() for q in units}, np.concatenate(own, axis=1))

    return unit_effects
