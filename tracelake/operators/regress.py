"""Grouped regressions from sufficient statistics: one partial aggregation of products, then a closed form per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import ratio
from tracelake.operators.score import replicated
from tracelake.operators.select import joined, median_spread, stored


def gram(df: DataFrame, keys: list[str], xs: list[str], y: str, weight: Column | None = None) -> DataFrame:
    """n, sums and sums of products of xs and y per group (times a weight): additive, so groups can be combined or left out."""
    w = F.lit(1.0) if weight is None else weight
    names = [*xs, y]
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull()
    sums = [F.sum(w).alias("n")] + [F.sum(w * F.col(a)).alias(f"s_{a}") for a in names]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return df.filter(ok).groupBy(*keys).agg(*sums)


def additive(xs: list[str], y: str) -> list[str]:
    names = [*xs, y]
    return ["n", *[f"s_{a}" for a in names], *[f"s_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]]


def solve(g: DataFrame, keys: list[str], xs: list[str], y: str, errors: bool = True) -> DataFrame:
    """Least squares with intercept from :func:`gram` rows, for one to three regressors: b0, b_<x>, r2 and standard errors.

    The centred normal equations are solved by cofactors; singular groups give nulls.
    """
    names = [*xs, y]
    c = lambda a, b: F.col(f"c_{a}_{b}" if f"c_{a}_{b}" in known else f"c_{b}_{a}")
    known = {f"c_{a}_{b}" for i, a in enumerate(names) for b in names[i:]}
    g = g.withColumns({f"c_{a}_{b}": F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n") for i, a in enumerate(names) for b in names[i:]})
    p = len(xs)
    m = [[c(a, b) for b in xs] for a in xs]

    def minor(i: int, j: int) -> Column:
        rows, cols = [r for r in range(p) if r != i], [k for k in range(p) if k != j]
        if p == 1:
            return F.lit(1.0)
        if p == 2:
            return m[rows[0]][cols[0]]
        return m[rows[0]][cols[0]] * m[rows[1]][cols[1]] - m[rows[0]][cols[1]] * m[rows[1]][cols[0]]

    if p > 3:
        raise ValueError("one to three regressors")
    g = g.withColumns({f"_i{i}{j}": (-1 if (i + j) % 2 else 1) * minor(i, j) for i in range(p) for j in range(p)})
    det = sum((m[0][j] * F.col(f"_i0{j}") for j in range(p)), F.lit(0.0))
    g = g.withColumn("_det", det)
    g = g.withColumns({f"b_{x}": F.try_divide(sum((F.col(f"_i{i}{j}") * c(xs[j], y) for j in range(p)), F.lit(0.0)), F.col("_det")) for i, x in enumerate(xs)})
    g = g.withColumn("b0", (F.col(f"s_{y}") - sum((F.col(f"b_{x}") * F.col(f"s_{x}") for x in xs), F.lit(0.0))) / F.col("n"))
    g = g.withColumn("_res", F.greatest(F.col(f"c_{y}_{y}") - sum((F.col(f"b_{x}") * c(x, y) for x in xs), F.lit(0.0)), F.lit(0.0)))
    out = [*keys, F.col("n").cast("long").alias("n"), "b0", *[f"b_{x}" for x in xs], (1 - ratio(F.col("_res"), F.col(f"c_{y}_{y}"))).alias("r2")]
    if errors:
        var = ratio(F.col("_res"), F.greatest(F.col("n") - p - 1, F.lit(1.0)))
        out += [F.sqrt(F.greatest(var * F.try_divide(F.col(f"_i{i}{i}"), F.col("_det")), F.lit(0.0))).alias(f"se_{x}") for i, x in enumerate(xs)]
    return g.select(*out)


def ols(df: DataFrame, keys: list[str], xs: list[str], y: str, errors: bool = True) -> DataFrame:
    return solve(gram(df, keys, xs, y), keys, xs, y, errors)


def leave_one_out(df: DataFrame, keys: list[str], group: str, xs: list[str], y: str) -> DataFrame:
    """Smallest and largest coefficients over fits that each leave one group out: totals less the group's sums."""
    each = gram(df, [*keys, group], xs, y)
    cols = additive(xs, y)
    total = each.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in cols])
    rest = each.join(total, keys) if keys else each.withColumns({f"t_{c}": total.select(f"t_{c}").scalar() for c in cols})
    rest = rest.select(*keys, group, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in cols])
    fits = solve(rest, [*keys, group], xs, y, errors=False)
    return fits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fits"), *[f(f"b_{x}").alias(f"{name}_{x}") for x in xs for name, f in (("min", F.min), ("max", F.max))])


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, xs: list[str], y: str, reps: int, seed: str) -> DataFrame:
    """Percentile intervals of the coefficients: clusters are reduced to their sums once, replicates reweight them."""
    each = gram(df, [*keys, cluster], xs, y)
    cols = additive(xs, y)
    sums = replicated(each, cluster, reps, seed).groupBy(*keys, "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])
    fits = solve(sums, [*keys, "rep"], xs, y, errors=False)
    return fits.groupBy(*keys).agg(*[F.percentile(f"b_{x}", F.lit(p)).alias(f"{name}_{x}") for x in xs for name, p in (("low", 0.025), ("high", 0.975))])


def fixed_intercept_slope(x: Column, y: Column, b0: float) -> Column:
    return ratio(F.sum(x * (y - b0)), F.sum(x * x))


def quarter_root(t: str, y: str) -> tuple[Column, Column]:
    """y^4 is linear in t: (k^4, t0 k^4) as slope and intercept."""
    return F.regr_slope(F.pow(F.col(y), F.lit(4.0)), F.col(t)), F.regr_intercept(F.pow(F.col(y), F.lit(4.0)), F.col(t))


def robust_line(df: DataFrame, keys: list[str], order: str, x: str, y: str, tol: float, stride: int = 1) -> DataFrame:
    """The line through two points of a key that has the most points within ``tol`` (ties: earliest pair), refitted to them.

    Candidates pair a point with the ones ``stride`` rows on; each candidate's inliers are counted in an array of the key's
    points, so a key's work is its rows squared and nothing is exploded.
    """
    pts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, x, y))).alias("p"))

    def line(i: Column) -> Column:
        a, b = F.get("p", i), F.get("p", i + stride)
        slope = F.try_divide(b[y] - a[y], b[x] - a[x])
        return F.struct(slope.alias("b"), (a[y] - slope * a[x]).alias("a"), i.alias("i"))

    lines = F.when(F.size("p") > stride, F.transform(F.sequence(F.lit(0), F.size("p") - 1 - stride), line))
    inliers = lambda c: F.filter("p", lambda q: F.abs(q[y] - c["a"] - c["b"] * q[x]) <= tol)
    scored = F.transform(F.filter(lines, lambda c: c["b"].isNotNull()), lambda c: F.struct(F.size(inliers(c)).alias("n"), (-c["i"]).alias("i"), c["a"].alias("a"), c["b"].alias("b")))
    best = pts.select(*keys, "p", F.array_max(scored).alias("c"))
    rows = best.select(*keys, F.explode(F.filter("p", lambda q: F.abs(q[y] - F.col("c")["a"] - F.col("c")["b"] * q[x]) <= tol)).alias("q"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_inliers"), F.regr_slope(F.col("q")[y], F.col("q")[x]).alias("slope"), F.regr_intercept(F.col("q")[y], F.col("q")[x]).alias("intercept"))


def circle(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares circle per group from moments: cx, cy, r."""
    df = df.withColumn("_z", F.col(x) * F.col(x) + F.col(y) * F.col(y))
    fit = ols(df, keys, [x, y], "_z", errors=False)
    cx, cy = F.col(f"b_{x}") / 2, F.col(f"b_{y}") / 2
    return fit.select(*keys, cx.alias("cx"), cy.alias("cy"), F.sqrt(F.col("b0") + cx * cx + cy * cy).alias("r"))


def sigma_by_bin(df: DataFrame, bin_col: str, resid: str, n_bins: int, min_count: int, floor: float) -> DataFrame:
    """Robust residual sigma per bin: bins with too few rows take the overall one; never under the floor."""
    spread = median_spread(df, [bin_col], resid).select(bin_col, (1.4826 * F.col("mad")).alias("sigma"))
    rows = joined(df.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n")), spread, [bin_col])
    overall = stored(median_spread(df, [], resid), "sigma").select(1.4826 * F.col("mad")).scalar()
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias(bin_col))
    out = grid.join(rows, bin_col, "left").fillna(0, ["n"])
    return out.withColumn("sigma", F.greatest(F.when(F.col("n") >= min_count, F.col("sigma")).otherwise(overall), F.lit(floor)))
