"""Iterative fits: many trajectories or conditions at once in Arrow batches, and global robust calibration by repeated aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.score import replicated
from tracelake.operators.select import joined, stored


def _expit(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1, e) / (1 + e)


def quarter_model(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """p: logs of k, t0, s by fit, over times by fit."""
    k, t0, s = (np.exp(p[:, j : j + 1]) for j in range(3))
    return _expit((t - t0) / s) * k * np.maximum(t, 0) ** 0.25


def blend_model(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """p: logs of k_sqrt, k_quarter, t0, s by fit, over times by fit."""
    a, b, t0, s = (np.exp(p[:, j : j + 1]) for j in range(4))
    w, pos = _expit((t - t0) / s), np.maximum(t, 0)
    return (1 - w) * a * np.sqrt(pos) + w * b * pos**0.25


@dataclass
class Fits:
    """Parameters, their deviations and correlations, costs, and whether a fit came to rest, by fit."""

    p: np.ndarray
    sd: np.ndarray
    corr: np.ndarray
    cost: np.ndarray
    converged: np.ndarray


def robust_fits(model: Callable, t: np.ndarray, y: np.ndarray, on: np.ndarray, start: np.ndarray, delta: float, steps: int = 60) -> Fits:
    """Levenberg-Marquardt under Huber weights for many fits at once.

    ``t``, ``y`` and ``on`` (which points count) are arrays by fit and point; ``start`` by fit and parameter. Each fit has its own
    damping; normal equations are solved as a stack, and fits that have come to rest leave it.
    """
    n_fits, n = start.shape
    p, damp, h, eye = start.astype(float), np.full(n_fits, 1e-2), 1e-6, np.eye(n)

    def state(q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.where(on[at], model(q, t[at]) - y[at], 0.0)
        a = np.abs(r)
        return r, np.where(a <= delta, 0.5 * r * r, delta * (a - 0.5 * delta)).sum(axis=1)

    r, cost = state(p, np.arange(n_fits))
    weights, normal, done = np.ones_like(r), np.zeros((n_fits, n, n)), np.zeros(n_fits, bool)
    for _ in range(steps):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        jac = np.stack([np.where(on[at], (model(p[at] + h * e, t[at]) - model(p[at] - h * e, t[at])) / (2 * h), 0.0) for e in eye], axis=2)
        w = np.where(np.abs(r[at]) <= delta, 1.0, delta / np.maximum(np.abs(r[at]), 1e-300))
        a, g = np.einsum("fti,ft,ftj->fij", jac, w, jac), np.einsum("fti,ft->fi", jac, w * r[at])
        weights[at], normal[at] = w, a
        scale = np.einsum("fii->fi", a)[:, :, None] * eye + 1e-12 * eye
        left = np.arange(len(at))
        for _ in range(12):
            here = at[left]
            m = a[left] + damp[here][:, None, None] * scale[left]
            try:
                step = -np.linalg.solve(m, g[left][:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                step = -(np.linalg.pinv(m) @ g[left][:, :, None])[:, :, 0]
            q = np.clip(p[here] + np.clip(step, -2, 2), -30, 30)
            r2, cost2 = state(q, here)
            better = np.isfinite(cost2) & (cost2 <= cost[here])
            good = here[better]
            done[good] = cost[good] - cost2[better] <= 1e-12 * np.maximum(cost[good], 1e-300)
            p[good], r[good], cost[good] = q[better], r2[better], cost2[better]
            damp[good] = np.maximum(damp[good] / 5, 1e-12)
            damp[here[~better]] *= 5
            left = left[~better]
            if not len(left):
                break
        #: no step brings anything more
        done[at[left]] = True
    count = on.sum(axis=1)
    cov = np.linalg.pinv(normal) * ((r * weights * r).sum(axis=1) / np.maximum(count - n, 1))[:, None, None]
    sd = np.sqrt(np.clip(np.einsum("fii->fi", cov), 0, None))
    both = sd[:, :, None] * sd[:, None, :]
    return Fits(p, sd, cov / np.where(both > 0, both, np.nan), cost, done)


QUARTER = "k double, t0 double, s double, std_log_k double, std_log_t0 double, std_log_s double, corr_k_t0 double, corr_k_s double, corr_t0_s double, cost double, n long, converged boolean"
BLEND = "k_sqrt double, k_quarter double, t0 double, s double, cost double, n long, converged boolean"


BLOCK_POINTS, MOST_CELLS = 1 << 16, 1 << 18


def _median(x: np.ndarray, on: np.ndarray) -> np.ndarray:
    return np.nanmedian(np.where(on, x, np.nan), axis=1)


def _fitted(groups: list[tuple[np.ndarray, np.ndarray]], kind: str, delta: float) -> dict[str, np.ndarray]:
    """Fits of (t, y) pairs as columns; pairs are padded to the longest, so pass ones of like length."""
    n = np.array([len(t) for t, _ in groups])
    on = np.arange(n.max())[None, :] < n[:, None]
    t, y = np.zeros(on.shape), np.zeros(on.shape)
    t[on], y[on] = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
    later = on & (t > 0)
    root = np.where(later, t, 1.0)
    k0 = np.maximum(_median(y / root**0.25, later), 1e-6)
    mid = np.log(np.maximum(np.where(on, t, 0).max(axis=1) / 10, 1e-9))
    if kind == "quarter":
        f = robust_fits(quarter_model, t, y, on, np.stack([np.log(k0), mid, mid], 1), delta)
        named = dict(zip(("k", "t0", "s"), np.exp(f.p).T)) | dict(zip(("std_log_k", "std_log_t0", "std_log_s"), f.sd.T))
        named |= {"corr_k_t0": f.corr[:, 0, 1], "corr_k_s": f.corr[:, 0, 2], "corr_t0_s": f.corr[:, 1, 2]}
    else:
        ks = np.maximum(_median(y / np.sqrt(root), later), 1e-6)
        f = robust_fits(blend_model, t, y, on, np.stack([np.log(ks), np.log(k0), mid, mid], 1), delta)
        named = dict(zip(("k_sqrt", "k_quarter", "t0", "s"), np.exp(f.p).T))
    return named | {"cost": f.cost, "n": n, "converged": f.converged}


def _fit_block(pdf: pd.DataFrame, keys: list[str], time: str, value: str, kind: str, delta: float) -> pd.DataFrame:
    """All groups of rows that lie together by key."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        c = pdf[k]
        same = (c == c.shift()) | (c.isna() & c.shift().isna())
        new[1:] |= ~same.to_numpy()[1:]
    first = np.flatnonzero(new)
    t, y = pdf[time].to_numpy(float), pdf[value].to_numpy(float)
    fine = np.isfinite(t) & np.isfinite(y) & (t >= 0)
    free = 3 if kind == "quarter" else 4
    found = []
    for i, (a, b) in enumerate(zip(first, np.append(first[1:], len(pdf)))):
        on = fine[a:b]
        ti, yi = t[a:b][on], y[a:b][on]
        if len(ti) > free and ti.max() > 0 and yi.max() > 0:
            found.append((i, ti, yi))
    found.sort(key=lambda x: len(x[1]))
    out, a = [], 0
    while a < len(found):
        b = a + 1
        while b < len(found) and (b + 1 - a) * len(found[b][1]) <= MOST_CELLS:
            b += 1
        columns = _fitted([x[1:] for x in found[a:b]], kind, delta)
        heads = pdf.iloc[first[[x[0] for x in found[a:b]]]][keys].reset_index(drop=True)
        out.append(pd.concat([heads, pd.DataFrame(columns)], axis=1))
        a = b
    return pd.concat(out) if out else pd.DataFrame([])


def fit_groups(df: DataFrame, keys: list[str], time: str, value: str, kind: str = "quarter", delta: float = 10.0) -> DataFrame:
    """One fit per group; groups with too few points give no row. A group is one trajectory or condition: bounded by its frames.

    Rows are dealt and sorted by key; a task fits blocks of many groups at once (see :func:`robust_fits`).
    """
    rows = df.select(*keys, F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    schema = f"{fields}, {QUARTER if kind == 'quarter' else BLEND}"
    names = [*keys, *[x.split()[0] for x in (QUARTER if kind == "quarter" else BLEND).split(", ")]]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def fitted(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            out = _fit_block(pdf, keys, time, value, kind, delta)
            if len(out):
                yield out[names]

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += len(pdf)
            if size < BLOCK_POINTS:
                continue
            whole = pd.concat(held, ignore_index=True)
            #: the last group may go on in the next batch
            tail = whole[keys].iloc[-1]
            same = np.ones(len(whole), bool)
            for k in keys:
                same &= (whole[k].isna() if pd.isna(tail[k]) else whole[k] == tail[k]).to_numpy()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from fitted(whole.iloc[:cut].reset_index(drop=True))
            held, size = [whole.iloc[cut:]], len(whole) - cut
        if held:
            yield from fitted(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys, time, value).mapInPandas(blocks, schema)


def _weighted(rows: DataFrame, state: DataFrame | None, keys: list[str], xs: list[str], y: str, delta: float, base) -> DataFrame:
    """``rows`` with ``_w``: the base weight times the Huber weight of the residual under the coefficients in ``state``."""
    if state is None:
        return rows.withColumn("_w", base)
    rows = joined(rows, state, keys, "inner")
    r = F.abs(F.col(y) - sum((F.col(f"b_{x}") * F.col(x) for x in xs), F.lit(0.0)))
    return rows.withColumn("_w", base * F.when(r <= delta, 1.0).otherwise(delta / r)).drop(*[f"b_{x}" for x in xs])


def _products(xs: list[str], y: str) -> dict:
    """Sums of weighted products, by the names that the solution reads."""
    return {f"{i}_{j}": F.sum(F.col("_w") * F.col(a) * F.col(b)) for i, a in enumerate(xs) for j, b in enumerate(xs) if j >= i} | {f"{i}_y": F.sum(F.col("_w") * F.col(a) * F.col(y)) for i, a in enumerate(xs)}


def _rounds(df: DataFrame, xs: list[str], y: str, delta: float, keys: list[str], rounds: int, weight: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows with the weights of the last round, its coefficients)."""
    base = F.lit(1.0) if weight is None else F.col(weight)
    rows, state = stored(df, "calibration"), None
    for _ in range(rounds):
        now = _weighted(rows, state, keys, xs, y, delta, base)
        sums = now.groupBy(*keys).agg(*[c.alias(k) for k, c in _products(xs, y).items()])
        state = stored(sums.select(*keys, *[c.alias(f"b_{x}") for x, c in zip(xs, _cramer(len(xs)))]), "coefficients")
    return now, state


def calibrate(df: DataFrame, xs: list[str], y: str, delta: float, keys: list[str] | None = None, rounds: int = 8, weight: str | None = None) -> DataFrame:
    """Huber regression of y on xs without intercept, by iterated reweighting; per key if given.

    The rows are written once; each round is one aggregation of weighted products over them (at most three regressors), and the
    coefficients come back as a small table with one row per key. Nothing is collected.
    """
    return _rounds(df, xs, y, delta, keys or [], rounds, weight)[1]


def calibration_bootstrap(df: DataFrame, xs: list[str], y: str, delta: float, cluster: str, reps: int, seed: str, rounds: int = 8) -> DataFrame:
    """(rep, b_<x>): coefficients of cluster replicates under the robust weights of the whole fit.

    Clusters are reduced once to their weighted products at the last round's weights; a replicate is a weighted sum of these.
    """
    rows, _ = _rounds(df, xs, y, delta, [], rounds, None)
    products = _products(xs, y)
    each = rows.groupBy(cluster).agg(*[c.alias(k) for k, c in products.items()])
    sums = replicated(each, cluster, reps, seed).groupBy("rep").agg(*[F.sum(F.col("w") * F.col(k)).alias(k) for k in products])
    return sums.select("rep", *[c.alias(f"b_{x}") for x, c in zip(xs, _cramer(len(xs)))])


def _cramer(p: int) -> list:
    """Solutions of the p by p normal equations as expressions, by elimination."""
    at = lambda i, j: F.col(f"{min(i, j)}_{max(i, j)}")
    m = [[at(i, j) for j in range(p)] for i in range(p)]
    v = [F.col(f"{i}_y") for i in range(p)]
    for k in range(p):
        for i in range(k + 1, p):
            f = F.try_divide(m[i][k], m[k][k])
            m[i] = [m[i][j] - f * m[k][j] for j in range(p)]
            v[i] = v[i] - f * v[k]
    out: list = [None] * p
    for k in reversed(range(p)):
        rest = v[k]
        for j in range(k + 1, p):
            rest = rest - m[k][j] * out[j]
        out[k] = F.try_divide(rest, m[k][k])
    return out
