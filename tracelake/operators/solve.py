"""Bounded robust calibration of a model over a whole table: a distributed Levenberg-Marquardt solver.

The model is a column expression of its parameters. One step is one aggregation over the rows, which are written once: the
Huber cost, the gradient J'Wr and the products J'WJ, with Jacobians by central differences, all as column expressions. The
driver gets these few sums, solves the small system under damping, and projects the step on the bounds; a parameter that
sits at a bound and whose gradient points outward is left out of the system. Parameters are solved for as logarithms unless
they say otherwise.

J'WJ is more than the curvature of a Huber cost where most residuals are large, so its steps are short and come nearer by a
constant share each. The curvature is therefore learned from the gradients along the way (BFGS, from J'WJ on, kept from one
descent to the next); a step by it that doesn't lower the cost is followed by one under damped J'WJ.

A parameter that only decides where a model switches has no useful gradient. It is found by scans: one aggregation gives the
cost at a grid of its values, the grid narrows around the best, and the other parameters are solved again, until a whole
cycle brings nothing.

Rows whose target, weight or model value is null or not a number are left out; a table without rows, or without enough of
them to tell the parameters apart, leaves these where they started and is reported as not converged.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.score import replicated
from tracelake.operators.select import stored

GRID, STEPS, CYCLES, NEAR = 24, 30, 12, 2e-4


@dataclass(frozen=True)
class Parameter:
    """A start and bounds, in the parameter's own unit; ``log``: solved for as its logarithm; ``switch``: found by scans."""

    name: str
    start: float
    low: float
    high: float
    log: bool = True
    switch: bool = False

    def code(self, value: float) -> float:
        return math.log(value) if self.log else value

    def value(self, code: float) -> float:
        return math.exp(code) if self.log else float(code)


@dataclass
class Calibration:
    """What was found, and what a bootstrap needs of it."""

    parameters: list[Parameter]
    at: np.ndarray
    cost: float
    gradient: np.ndarray
    n: int
    steps: int
    converged: bool
    rows: DataFrame = field(repr=False)
    model: Callable = field(repr=False)
    y: str = "y"
    delta: float = 1.0
    weight: str | None = None

    @property
    def values(self) -> dict[str, float]:
        return {p.name: p.value(c) for p, c in zip(self.parameters, self.at)}

    def bound(self, k: int) -> str:
        p, c = self.parameters[k], self.at[k]
        return "low" if c <= p.code(p.low) + 1e-9 else "high" if c >= p.code(p.high) - 1e-9 else ""

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each parameter."""
        rows = [(p.name, float(p.value(c)), self.bound(k), float(self.gradient[k] / max(self.n, 1)), float(self.cost), self.n, self.converged) for k, (p, c) in enumerate(zip(self.parameters, self.at))]
        return spark.createDataFrame(rows, "parameter string, value double, at_bound string, gradient double, cost double, n long, converged boolean")


def _huber(r: Column, delta: float) -> Column:
    a = F.abs(r)
    return F.when(a <= delta, 0.5 * r * r).otherwise(delta * (a - 0.5 * delta))


class _Problem:
    def __init__(self, rows: DataFrame, model: Callable, y: str, parameters: list[Parameter], delta: float, weight: str | None):
        self.rows, self.model, self.y, self.parameters, self.delta = rows, model, F.col(y).cast("double"), parameters, delta
        self.weight = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        self.low, self.high = (np.array([p.code(getattr(p, end)) if not p.log or getattr(p, end) > 0 else -math.inf for p in parameters]) for end in ("low", "high"))
        self.smooth = [k for k, p in enumerate(parameters) if not p.switch]
        self.passes = 0
        self._build()

    def predicted(self, place: Column) -> Column:
        """The model at the point that begins at ``place`` of the array ``_at``.

        The values are items of a column, at places that the optimizer doesn't know: so expressions are built once, and the code
        that is generated for a pass doesn't hold the values and is compiled once for all passes.
        """
        return self.model({q.name: F.get("_at", place + k) for k, q in enumerate(self.parameters)})

    def _point(self, at: np.ndarray) -> list[float]:
        return [float(q.value(c)) for q, c in zip(self.parameters, at)]

    def _given(self, numbers: list[float]) -> DataFrame:
        return self.rows.withColumn("_at", F.array(*[F.lit(x) for x in numbers]))

    def products(self, at: np.ndarray) -> DataFrame:
        """The rows with cost, weight, residual and derivatives; ``_fine`` where these are numbers, else without cost and weight.

        A filter in its place would be moved below the columns and compute them twice.
        """
        numbers, width = self._point(at), []
        for k in self.smooth:
            h = 1e-5 * max(1.0, abs(at[k]))
            up, down = at.copy(), at.copy()
            up[k], down[k] = min(at[k] + h, self.high[k]), max(at[k] - h, self.low[k])
            numbers += self._point(up) + self._point(down)
            width.append(float(up[k] - down[k]))
        return self._given(numbers + width).withColumns(self.columns).withColumns(self.weights)

    def _build(self) -> None:
        p, zero = len(self.parameters), F.col("_zero")
        self.columns = {"_r": self.predicted(zero) - self.y, "_v": self.weight}
        for i, k in enumerate(self.smooth):
            step = F.get("_at", zero + (p * (1 + 2 * len(self.smooth)) + i))
            self.columns[f"_j{k}"] = (self.predicted(zero + p * (1 + 2 * i)) - self.predicted(zero + p * (2 + 2 * i))) / step
        fine = F.lit(True)
        for c in self.columns:
            fine = fine & F.col(c).isNotNull() & ~F.isnan(c)
        weights = {"_c": F.col("_v") * _huber(F.col("_r"), self.delta), "_w": F.col("_v") * F.when(F.abs("_r") <= self.delta, 1.0).otherwise(self.delta / F.abs("_r"))}
        self.weights = {"_fine": fine} | {k: F.when(fine, c) for k, c in weights.items()}
        s = self.smooth
        self.names = {f"a{i}_{j}": F.sum(F.col("_w") * F.col(f"_j{i}") * F.col(f"_j{j}")) for i in s for j in s if j >= i} | {f"g{i}": F.sum(F.col("_w") * F.col("_r") * F.col(f"_j{i}")) for i in s}
        self.totals = [F.sum("_c").alias("cost"), F.count_if("_fine").alias("n"), *[c.alias(k) for k, c in self.names.items()]]
        r = self.predicted(F.col("_g") * p) - self.y
        self.cost = F.sum(F.when(r.isNotNull() & ~F.isnan(r), self.weight * _huber(r, self.delta))).alias("cost")

    def sums(self, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        """(cost, gradient, J'WJ, rows): one aggregation."""
        self.passes += 1
        got = self.products(at).agg(*self.totals).first()
        p = len(self.parameters)
        g, a = np.zeros(p), np.zeros((p, p))
        for i in self.smooth:
            g[i] = got[f"g{i}"] or 0.0
            for j in self.smooth:
                a[i, j] = got[f"a{min(i, j)}_{max(i, j)}"] or 0.0
        return (math.inf if got["cost"] is None else got["cost"]), g, a, got["n"]

    def scan(self, at: np.ndarray, k: int, codes: np.ndarray) -> np.ndarray:
        """The cost at each value of one parameter: one aggregation, which sums before it shuffles."""
        self.passes += 1
        points = np.repeat(at[None, :], len(codes), 0)
        points[:, k] = codes
        grid = self._given([x for there in points for x in self._point(there)]).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(len(codes) - 1))))
        out = np.full(len(codes), math.inf)
        for row in grid.groupBy("_g").agg(self.cost).collect():
            out[row["_g"]] = math.inf if row["cost"] is None else row["cost"]
        return out


def _learned(curve: np.ndarray, moved: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """The curvature that also explains how the gradient turned over a step (BFGS); as it was where that isn't convex."""
    along = curve @ moved
    if moved @ turned <= 1e-10 * np.linalg.norm(moved) * np.linalg.norm(turned) or moved @ along <= 0:
        return curve
    return curve + np.outer(turned, turned) / (moved @ turned) - np.outer(along, along) / (moved @ along)


def _descend(problem: _Problem, at: np.ndarray, steps: int, here: tuple | None = None, curve: np.ndarray | None = None) -> tuple[np.ndarray, tuple, bool, np.ndarray | None]:
    """Steps over the smooth parameters within their bounds, from ``at`` with its sums and what is known of the curvature."""
    here, damp, done = here or problem.sums(at), 1e-3, False
    if not problem.smooth or not here[3]:
        return at, here, bool(here[3]), curve
    for _ in range(steps):
        cost, g, a, _ = here
        free = [k for k in problem.smooth if not (at[k] <= problem.low[k] and g[k] > 0) and not (at[k] >= problem.high[k] and g[k] < 0)]
        if not free or np.abs(g[free]).max() <= 1e-9 * max(cost, 1e-12):
            return at, here, True, curve
        moved = False
        for learned in [*([True] if curve is not None else []), *[False] * 8]:
            m = (curve if learned else a)[np.ix_(free, free)]
            if not learned:
                m = m + damp * np.diag(np.maximum(np.diag(m), 1e-300))
            step = -np.linalg.lstsq(m, g[free], rcond=None)[0]
            new = at.copy()
            new[free] = np.clip(at[free] + np.clip(step, -2, 2), problem.low[free], problem.high[free])
            there = problem.sums(new)
            if there[0] < cost:
                #: what a step under J'WJ would bring from there, which a wrong curvature can't hide
                left = there[1][free] @ np.linalg.lstsq(there[2][np.ix_(free, free)], there[1][free], rcond=None)[0] / 2
                done = left <= 1e-12 * cost and (np.abs(new - at).max() <= 1e-8 or cost - there[0] <= 1e-12 * cost)
                curve = _learned(a if curve is None else curve, new - at, there[1] - g)
                at, here, damp, moved = new, there, damp if learned else max(damp / 10, 1e-12), True
                break
            if learned:
                curve = None
            elif np.abs(new - at).max() <= 1e-10:
                return at, here, True, curve
            else:
                damp = max(damp * 10, 1e-6)
        if not moved or done:
            return at, here, True, curve
    return at, here, False, curve


def calibrate(df: DataFrame, model: Callable[[dict[str, Column]], Column], y: str, parameters: list[Parameter], delta: float, weight: str | None = None, steps: int = STEPS, cycles: int = CYCLES) -> Calibration:
    """The parameters of least Huber cost within their bounds. Pass the columns that the model reads, and no more: they are written once."""
    #: over all cores, as a pass reads what was written
    rows = stored(df.repartition(df.sparkSession.sparkContext.defaultParallelism).withColumn("_zero", F.lit(0)), "calibration-rows")
    problem = _Problem(rows, model, y, parameters, delta, weight)
    at = np.clip(np.array([p.code(p.start) for p in parameters]), problem.low, problem.high)
    at, here, done, curve = _descend(problem, at, steps)
    switches = [k for k, p in enumerate(parameters) if p.switch]
    reach = {k: (problem.low[k], problem.high[k]) for k in switches}
    for _ in range(cycles if switches and here[3] else 0):
        best, widest, at_hand = here[0], 0.0, here
        for k in switches:
            low, high = reach[k]
            codes = np.sort(np.append(np.linspace(low, high, GRID), at[k]))
            costs = problem.scan(at, k, codes)
            first = int(costs.argmin())
            if codes[first] != at[k]:
                at, at_hand = at.copy(), None
                at[k] = codes[first]
            #: around the best, a quarter of what was searched
            wide = max((high - low) / 8, NEAR / 4)
            reach[k] = (max(problem.low[k], codes[first] - wide), min(problem.high[k], codes[first] + wide))
            widest = max(widest, high - low)
        at, here, done, curve = _descend(problem, at, steps, at_hand, curve)
        if widest <= NEAR and best - here[0] <= 1e-10 * max(best, 1e-300):
            break
    cost, gradient, products, n = here
    told = bool(n) and all(products[k, k] > 0 for k in problem.smooth)
    return Calibration(parameters, at, cost, gradient, n, problem.passes, bool(done and told), rows, model, y, delta, weight)


def bootstrap(found: Calibration, cluster: str, reps: int, seed: str, level: float = 0.95) -> DataFrame:
    """(parameter, value, low, high): percentile intervals of a cluster bootstrap.

    Clusters are reduced once to their J'WJ and J'Wr where the whole fit stands. A replicate is a weighted sum of these and one
    projected Gauss-Newton step from there: replicates differ from the whole fit by a step of the order of the standard errors, over
    which the sums stay as they are. Parameters at a bound, and those that only switch, stay where they are.
    """
    problem = _Problem(found.rows, found.model, found.y, found.parameters, found.delta, found.weight)
    free = [k for k in problem.smooth if not found.bound(k)]
    names = problem.names
    each = problem.products(found.at).filter("_fine").groupBy(cluster).agg(*[c.alias(k) for k, c in names.items()])
    sums = replicated(each, cluster, reps, seed).groupBy("rep").agg(*[F.sum(F.col("w") * F.col(k)).alias(k) for k in names])
    #: by elimination, as column expressions
    m = [[F.col(f"a{min(i, j)}_{max(i, j)}") for j in free] for i in free]
    v = [-F.col(f"g{i}") for i in free]
    p = len(free)
    for k in range(p):
        for i in range(k + 1, p):
            f = F.try_divide(m[i][k], m[k][k])
            m[i] = [m[i][j] - f * m[k][j] for j in range(p)]
            v[i] = v[i] - f * v[k]
    step: list = [None] * p
    for k in reversed(range(p)):
        rest = v[k]
        for j in range(k + 1, p):
            rest = rest - m[k][j] * step[j]
        step[k] = F.try_divide(rest, m[k][k])
    moved = []
    for k, q in enumerate(found.parameters):
        code = F.lit(float(found.at[k]))
        if k in free:
            code = F.least(F.greatest(code + F.coalesce(step[free.index(k)], F.lit(0.0)), F.lit(float(problem.low[k]))), F.lit(float(problem.high[k])))
        moved.append((F.exp(code) if q.log else code).alias(q.name))
    drawn = sums.select(*moved)
    ends = ((1 - level) / 2, (1 + level) / 2)
    #: one row a replicate is left
    wide = drawn.agg(*[F.percentile(q.name, F.array(*[F.lit(x) for x in ends])).alias(q.name) for q in found.parameters])
    rows = F.array(*[F.struct(F.lit(q.name).alias("parameter"), F.lit(float(found.values[q.name])).alias("value"), F.col(q.name)[0].alias("low"), F.col(q.name)[1].alias("high")) for q in found.parameters])
    return wide.select(F.inline(rows))
