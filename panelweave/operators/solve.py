"""Small dense steps on one row per key: solve the p x p system, move the scalar parameters, recode."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from panelweave.operators.batches import Layout, split

# Ship these functions with the job, so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_MOVE = 2.0
LOGK_RANGE = (-13.0, 8.0)
ZPAR_RANGE = (-14.0, 14.0)


def unpack(triangles: np.ndarray, p: int) -> np.ndarray:
    """Upper triangles (rows of the batch) to symmetric matrices."""
    full = np.zeros((len(triangles), p, p))
    i, j = np.triu_indices(p)
    full[:, i, j] = triangles
    full[:, j, i] = triangles
    return full


def solve_scaled(xx: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solve batched systems that may lack columns: absent coefficients are NaN, collinear ones minimum norm."""
    diagonal = np.einsum("kii->ki", xx)
    present = diagonal > 1e-10
    scale = np.where(present, 1.0 / np.sqrt(np.where(present, diagonal, 1.0)), 0.0)
    scaled = xx * scale[:, :, None] * scale[:, None, :]
    inverse = np.linalg.pinv(scaled, rcond=1e-9, hermitian=True)
    cov = inverse * scale[:, :, None] * scale[:, None, :]
    beta = np.einsum("kij,kj->ki", cov, rhs)
    beta[~present] = np.nan
    cov[~(present[:, :, None] & present[:, None, :])] = np.nan
    return beta, cov


def treatment_map(periods: int, covariate: bool) -> np.ndarray:
    """Matrix from per-period coefficients (levels, then slopes) to treatment coding."""
    block = np.eye(periods)
    block[1:, 0] = -1.0
    if not covariate:
        return block
    return np.kron(np.eye(2), block)


def joint_step(xx, rhs, p, active, settled_below, at_low, at_high):
    """Solve for coefficients and scalar changes together.

    A scalar takes no part once it sits at a bound and would move beyond it, or once neither its score nor
    its information reaches ``settled_below``.

    The scalars (zero parameter, log dispersion) are eliminated last. Where their information is not
    positive, as far from the maximum, its absolute eigenvalues give an uphill move. Returns coefficients,
    their covariance and the scalar changes.
    """
    base, cov = solve_scaled(xx[:, :p, :p], rhs[:, :p])
    known = np.nan_to_num(cov)
    cross = xx[:, :p, p:] * active[:, None, :]
    gain = known @ cross
    left = (rhs[:, p:] - np.einsum("kpe,kp->ke", cross, np.nan_to_num(base))) * active
    flat = np.maximum(np.abs(left), np.abs(np.einsum("kee->ke", xx[:, p:, p:]))) < settled_below[:, None]
    active = active * ~(flat | (at_low & (left < 0)) | (at_high & (left > 0)))
    left, cross, gain = left * active, cross * active[:, None, :], gain * active[:, None, :]
    schur = xx[:, p:, p:] * active[:, :, None] * active[:, None, :] - np.swapaxes(cross, 1, 2) @ gain
    values, vectors = np.linalg.eigh(schur)
    turned = np.einsum("kij,ki->kj", vectors, left)
    inverse = 1.0 / np.maximum(np.abs(values), 1e-9)
    change = np.einsum("kij,kj->ki", vectors, turned * inverse) * active
    change = np.clip(change, -1.0, 1.0)
    beta = base - np.einsum("kpe,ke->kp", gain, change)
    # coefficients also carry the uncertainty of the scalars where that is well determined
    good = (values > 1e-6).astype(float)
    share = np.einsum("kpe,kej->kpj", gain, vectors) * np.sqrt(good / np.maximum(values, 1e-6))[:, None, :]
    return beta, cov + share @ np.swapaxes(share, 1, 2), change, left


def with_zero_part(xx, xz, zxx, zxz, cross, p: int, regression: np.ndarray):
    """The system of count coefficients, zero coefficients and scalars of keys with a zero regression.

    ``cross`` holds by period the cross information of the zero coefficient with the level, the slope and the log dispersion.
    Other keys have no zero coefficients.
    """
    n, P = zxz.shape
    size = p + P
    order = [*range(p), *range(size, size + 2)]
    both, right = np.zeros((n, size + 2, size + 2)), np.zeros((n, size + 2))
    both[np.ix_(range(n), order, order)], right[:, order] = xx, xz
    own = regression[:, None].astype(float)
    both[:, p:size, p:size], right[:, p:size] = zxx * own[:, :, None], zxz * own
    at = np.arange(P)
    columns = [at] + ([P + at] if p > P else []) + [np.full(P, size + 1)]
    parts = [cross[:, :P]] + ([cross[:, P : 2 * P]] if p > P else []) + [cross[:, 2 * P :]]
    for column, values in zip(columns, parts):
        both[:, p + at, column] = both[:, column, p + at] = values * own
    return both, right


def with_columns(function, columns: list[str]):
    """Run a function on each batch and keep the named columns."""

    def run(batches):
        for pdf in batches:
            yield (function(pdf) if len(pdf) else pdf)[columns]

    return run


def make_step(layout: Layout, prior: tuple[np.ndarray, np.ndarray] | None, levels: bool, tolerance: float):
    """One scoring step per key from its packed sums.

    ``prior`` is (precision matrix, precision times mean) in per-period coding. Without levels the step also
    ends the round.
    """
    p = layout.size

    def move(old: np.ndarray, new: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(old), new, old + np.clip(new - old, -MAX_MOVE, MAX_MOVE))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        part = split(np.stack(pdf["packed"]), layout.parts)
        pdf["start"] = [_vector(row) for row in pdf[MOVING].to_dict("records")]
        pdf["ll_old"] = pdf["ll"]
        zero, form = pdf["zero"].to_numpy(), pdf["form"].to_numpy()
        xx, xz, ll = unpack(part["xx"], layout.full), part["xz"].copy(), part["ll"][:, 0]
        if prior is not None:
            xx[:, :p, :p] += prior[0]  # it also holds periods without rows
            xz[:, :p] += prior[1]
        active = np.stack([(zero == 2) | (zero == 3), (form > 0) & ~pdf["fixed"].to_numpy()], axis=1).astype(float)
        scalars = pdf[["zpar", "logk"]].to_numpy()
        low, high = np.array([ZPAR_RANGE, LOGK_RANGE]).T
        settled = 1e-7 * (1.0 + np.abs(ll))
        regression, P = zero == 4, layout.periods
        together = layout.zero and not levels
        if together:
            both, right = with_zero_part(xx, xz, unpack(part["zxx"], P), part["zxz"], part["cross"], p, regression)
            new, cov, change, gradient = joint_step(both, right, p + P, active, settled, scalars <= low, scalars >= high)
            znew, zcov = new[:, p:], cov[:, p:, p:]
            new, cov = new[:, :p], cov[:, :p, :p]
        else:
            new, cov, change, gradient = joint_step(xx, xz, p, active, settled, scalars <= low, scalars >= high)
        old = np.stack(pdf["beta"]).astype(float)
        beta = move(old, new)
        delta = np.max(np.abs(np.nan_to_num(beta - old)), axis=1)
        present = ~np.isnan(new)
        filled = np.where(present[:, :, None] & present[:, None, :], xx[:, :p, :p], np.eye(p))
        logdet = np.where(pdf["restricted"], np.linalg.slogdet(filled)[1], 0.0)
        ld = part["ld"][:, 0]
        if layout.zero:
            if not together:
                znew, zcov = solve_scaled(unpack(part["zxx"], P), part["zxz"])
            zold = np.stack(pdf["zbeta"]).astype(float)
            if together:  # a coefficient at its limit, of which the rows say nothing more, stays there
                znew = np.where(np.isnan(znew), zold, znew)
            zbeta = np.clip(move(zold, znew), *ZPAR_RANGE)
            zdelta = np.max(np.abs(np.nan_to_num(zbeta - zold)), axis=1)
            delta = np.where(regression, np.maximum(delta, zdelta), delta)
            ld = ld + np.where(regression, part["zld"][:, 0], 0.0)
            zbeta = np.where(regression[:, None], zbeta, zold)
            pdf["zbeta"], pdf["zcov"] = list(zbeta), [m.ravel() for m in zcov]
        scalars_new = np.where(active > 0, np.clip(scalars + change, low, high), scalars)
        # movement along a direction that no longer changes the likelihood does not count
        moves = np.where(np.abs(gradient) > settled[:, None], np.abs(scalars_new - scalars), 0.0)
        pdf["delta"] = np.maximum(delta, moves.max(axis=1))
        pdf["beta"] = list(beta)
        pdf["solution"] = list(np.concatenate([np.nan_to_num(beta), change], axis=1))
        pdf["cov"] = [m.ravel() for m in cov]
        pdf["zpar"], pdf["logk"] = scalars_new[:, 0], scalars_new[:, 1]
        pdf["ll"] = ll - 0.5 * (ld + logdet + pdf["pen"].to_numpy())
        pdf["logdet"] = logdet
        pdf["iterations"] = pdf["iterations"] + 1
        pdf.loc[~np.isfinite(pdf["ll"].to_numpy()), "status"] = "failed"
        if levels:
            return pdf
        pdf.loc[(pdf["status"] == "running") & (pdf["delta"] < tolerance), "status"] = "ok"
        return pdf  # both parts have moved together, which needs no extrapolation

    return step


def make_round_end(layout: Layout, levels: int, variance_tolerance: float, tolerance: float):
    """Move the variance components from the sums over unit effects, then extrapolate.

    The new precision is the effective number of units over the summed squared effects.
    """
    length, slots = layout.effect_length, layout.slots(layout.effect_length)
    i, j = np.triu_indices(layout.size)
    double = np.where(i == j, 1.0, 2.0)

    def update(old, units, uu, vv):
        effective = np.maximum(units - old * vv, units * 1e-6)
        ratio = np.clip(effective / (uu + 1e-14) / old, 0.1, 10.0)
        return np.clip(old * ratio, *np.exp(LOG_PRECISION_RANGE))

    def round_end(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = np.stack(pdf["packed"]).reshape(len(pdf), levels, slots * layout.width)
        cov = np.nan_to_num(np.stack(pdf["cov"]).reshape(-1, layout.size, layout.size))[:, i, j] * double
        restricted, regression = pdf["restricted"].to_numpy(), pdf["zero"].to_numpy() == 4
        prec, zprec = np.stack(pdf["prec"]), np.stack(pdf["zprec"])
        new, znew, penalty = prec.copy(), zprec.copy(), np.zeros(len(pdf))
        for level in range(levels):
            m = {n: v[:, 0] if v.shape[1] == 1 else v for n, v in split(packed[:, level, :length], layout.effect_parts).items()}
            vv = m["vv"] + np.where(restricted, (m["gg"].reshape(len(pdf), -1) * cov).sum(axis=1), 0.0)
            new[:, level] = update(prec[:, level], m["units"], m["uu"], vv)
            penalty += prec[:, level] * m["uu"]
            if layout.zero:
                znew[:, level] = np.where(regression, update(zprec[:, level], m["units"], m["zuu"], m["zvv"]), zprec[:, level])
                penalty += np.where(regression, zprec[:, level] * m["zuu"], 0.0)
        pdf["prec"], pdf["zprec"], pdf["pen"] = list(new), list(znew), penalty
        # a standard deviation that moves by less than 0.001 of a link unit is settled
        both, both_old = np.concatenate([new, znew], axis=1), np.concatenate([prec, zprec], axis=1)
        still = np.abs(1 / np.sqrt(both) - 1 / np.sqrt(both_old)) < 1e-3
        moved = np.where(still, 0.0, np.abs(np.log(both / both_old))).max(axis=1)
        done = (pdf["status"] == "running") & (pdf["delta"] < max(tolerance, 1e-4)) & (moved < variance_tolerance)
        pdf.loc[done, "status"] = "ok"
        pdf["ll_old"] = pdf["ll"]
        return accelerate(pdf)

    return round_end


MOVING = ["beta", "zbeta", "logk", "zpar", "prec", "zprec"]
DEPTH = 5  # rounds remembered by the extrapolation
LOG_PRECISION_RANGE = (-9.0, float(np.log(1e4)))


def _vector(row) -> np.ndarray:
    """The parameters of a key as one vector, precisions on the log scale."""
    parts = [row["beta"], row["zbeta"], [row["logk"], row["zpar"]], np.log(row["prec"]), np.log(row["zprec"])]
    return np.concatenate([np.asarray(p, float) for p in parts])


def extrapolate(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Anderson extrapolation of a fixed-point iteration from its last (start, end) pairs, oldest first."""
    residuals = ends - starts
    if len(starts) < 2:
        return ends[-1]
    df, dg = np.diff(residuals, axis=0).T, np.diff(ends, axis=0).T
    scale = np.linalg.norm(df, axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    weights = np.linalg.lstsq(df / scale, residuals[-1], rcond=1e-8)[0] / scale
    return ends[-1] - dg @ weights


def accelerate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Replace the parameters of running two-part keys by their extrapolation.

    Their count and zero parts move in turn, which converges slowly; all other keys move jointly and need no
    help. ``start`` is the point the round started from and ``trace`` the remembered (start, end) pairs.
    """
    out = {n: list(pdf[n]) for n in (*MOVING, "trace")}
    for i, row in enumerate(pdf.to_dict("records")):
        if row["status"] != "running" or row["zero"] != 4:
            out["trace"][i] = np.zeros(0)
            continue
        start, end = np.asarray(row["start"], float), _vector(row)
        missing = np.isnan(end)
        pairs = np.asarray(row["trace"], float).reshape(-1, 2, len(end))
        pairs = np.concatenate([pairs, np.nan_to_num(np.stack([start, end]))[None]])[-DEPTH:]
        value = np.nan_to_num(end)
        if row["iterations"] >= 4:  # the first rounds start far away and would distort the extrapolation
            jump = extrapolate(pairs[:, 0], pairs[:, 1])
            value = value + np.clip(np.where(np.isfinite(jump), jump - value, 0.0), -0.5, 0.5)
        value[missing] = np.nan
        sizes = [len(row["beta"]), len(row["zbeta"]), 1, 1, len(row["prec"])]
        beta, zbeta, logk, zpar, prec, zprec = np.split(value, np.cumsum(sizes))
        out["beta"][i], out["zbeta"][i] = beta, np.clip(zbeta, *ZPAR_RANGE)
        out["logk"][i] = float(np.clip(logk[0], *LOGK_RANGE))
        out["zpar"][i] = float(np.clip(zpar[0], *ZPAR_RANGE))
        out["prec"][i] = np.exp(np.clip(prec, *LOG_PRECISION_RANGE))
        out["zprec"][i] = np.exp(np.clip(zprec, *LOG_PRECISION_RANGE))
        out["trace"][i] = pairs.ravel()
    scalar = ("logk", "zpar")
    return pdf.assign(**{n: pd.Series(v, index=pdf.index, dtype=float if n in scalar else object) for n, v in out.items()})


def lower_factor(matrix: np.ndarray) -> np.ndarray:
    """Lower-triangular factor; a matrix that is singular up to rounding gets the factor of its positive part."""
    try:
        return np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(matrix)
        root = vectors * np.sqrt(np.clip(values, 0.0, None))
        factor = np.linalg.qr(root.T, mode="r").T
        return factor * np.where(np.diag(factor) < 0, -1.0, 1.0)


def make_recode(periods: int, covariate: bool):
    """Batch function that adds treatment-coded coefficients, covariance and its Cholesky factor.

    A coefficient of a period without information is NaN and takes no part in the factor.
    """
    map_ = treatment_map(periods, covariate)
    p = len(map_)

    def recode(batches):
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(coef=pd.Series(dtype=object), coef_cov=pd.Series(dtype=object), coef_chol=pd.Series(dtype=object))
                continue
            coef, covs, chols = [], [], []
            for beta, cov, sign, shift in zip(pdf["beta"], pdf["cov"], pdf["sign"], pdf["shift"]):
                beta = np.asarray(beta, float) * sign
                beta[:periods] += shift
                cov = np.asarray(cov, float).reshape(p, p)
                bad = np.isnan(beta)
                used = map_ @ np.nan_to_num(beta)
                lost = (np.abs(map_) @ bad.astype(float)) > 0
                full = map_ @ np.nan_to_num(cov) @ map_.T
                keep = np.flatnonzero(~lost & (np.diag(full) > 0))
                chol = np.zeros((p, p))
                chol[np.ix_(keep, keep)] = lower_factor(full[np.ix_(keep, keep)])
                used[lost] = np.nan
                full[lost, :] = np.nan
                full[:, lost] = np.nan
                coef.append(used)
                covs.append(full.ravel())
                chols.append(chol.ravel())
            yield pdf.assign(coef=coef, coef_cov=covs, coef_chol=chols)

    return recode
