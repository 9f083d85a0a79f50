"""Queries of regressions, models and fits, with the same answers as SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions import models
from tracelake.functions.scalars import time_bin
from tracelake.operators import fit, regress, solve
from tracelake.plans.registry import Registry, replicated_sql, rounded
from tracelake.plans.series_queries import DISTINCT_T, _by_time
from tracelake.plans.views import KEYS, V_POINTS, V_PRED, V_REG, V_SERIES, load, v_points, v_pred, v_reg, v_series

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
XS = ["x1", "x2", "x3"]


def _ols_sql(source: str, keys: str, y: str = "y", w: str = "1") -> str:
    """CTEs gm and fit_ for y on x1, x2, x3 by centred cofactors, rows counting ``w`` times."""
    pairs = [("x1", "x1"), ("x1", "x2"), ("x1", "x3"), ("x2", "x2"), ("x2", "x3"), ("x3", "x3"), ("x1", y), ("x2", y), ("x3", y), (y, y)]
    c = ", ".join(f"sum({w} * {a} * {b}) - sum({w} * {a}) * sum({w} * {b}) / sum({w}) AS c_{a}_{b}" for a, b in pairs)
    return f"""
gm AS (SELECT {keys}, sum({w}) AS n, sum({w} * x1) AS s1, sum({w} * x2) AS s2, sum({w} * x3) AS s3, sum({w} * {y}) AS sy, {c} FROM {source} GROUP BY {keys}),
cf AS (SELECT *, c_x2_x2 * c_x3_x3 - c_x2_x3 * c_x2_x3 AS i00, -(c_x1_x2 * c_x3_x3 - c_x2_x3 * c_x1_x3) AS i01, c_x1_x2 * c_x2_x3 - c_x2_x2 * c_x1_x3 AS i02,
  c_x1_x1 * c_x3_x3 - c_x1_x3 * c_x1_x3 AS i11, -(c_x1_x1 * c_x2_x3 - c_x1_x2 * c_x1_x3) AS i12, c_x1_x1 * c_x2_x2 - c_x1_x2 * c_x1_x2 AS i22 FROM gm),
dt_ AS (SELECT *, c_x1_x1 * i00 + c_x1_x2 * i01 + c_x1_x3 * i02 AS det FROM cf),
b_ AS (SELECT *, (i00 * c_x1_{y} + i01 * c_x2_{y} + i02 * c_x3_{y}) / det AS b1, (i01 * c_x1_{y} + i11 * c_x2_{y} + i12 * c_x3_{y}) / det AS b2, (i02 * c_x1_{y} + i12 * c_x2_{y} + i22 * c_x3_{y}) / det AS b3 FROM dt_),
fit_ AS (SELECT *, (sy - b1 * s1 - b2 * s2 - b3 * s3) / n AS b0, 1 - (c_{y}_{y} - b1 * c_x1_{y} - b2 * c_x2_{y} - b3 * c_x3_{y}) / c_{y}_{y} AS r2,
  (c_{y}_{y} - b1 * c_x1_{y} - b2 * c_x2_{y} - b3 * c_x3_{y}) / greatest(n - 4, 1) AS s2_ FROM b_)"""


OLS_OUT = "n::BIGINT AS n, round(b0, 5) AS b0, round(b1, 5) AS b_x1, round(b2, 5) AS b_x2, round(b3, 5) AS b_x3, round(r2, 5) AS r2, round(sqrt(greatest(s2_ * i00 / det, 0)), 5) AS se_x1, round(sqrt(greatest(s2_ * i11 / det, 0)), 5) AS se_x2, round(sqrt(greatest(s2_ * i22 / det, 0)), 5) AS se_x3"


@query("r1_loglog_ols", f"WITH {V_REG}, {_ols_sql('v_reg', 'grp')} SELECT grp, {OLS_OUT} FROM fit_")
def r1_loglog_ols(spark, sf_dir):
    return rounded(regress.ols(v_reg(spark, sf_dir), ["grp"], XS, "y"), 5)


@query("r2_binned_screen", f"WITH {V_REG}, {_ols_sql('v_reg', 'win')}, rs AS (SELECT v.win, var_pop(y) AS raw, var_pop(y - b1 * x1 - b2 * x2 - b3 * x3) AS fitted, var_pop(y - x1) AS fixed FROM v_reg v JOIN fit_ USING (win) GROUP BY 1) SELECT win, round(b1, 5) AS b_x1, round(r2, 5) AS r2, round(fitted / raw, 5) AS fitted_share, round(fixed / raw, 5) AS fixed_share FROM fit_ JOIN rs USING (win)")
def r2_binned_screen(spark, sf_dir):
    df = v_reg(spark, sf_dir)
    fits = regress.ols(df, ["win"], XS, "y", errors=False)
    rows = df.join(fits.select("win", "b_x1", "b_x2", "b_x3", "r2"), "win")
    left = F.col("y") - sum((F.col(f"b_{x}") * F.col(x) for x in XS), F.lit(0.0))
    out = rows.groupBy("win").agg(F.first("b_x1").alias("b_x1"), F.first("r2").alias("r2"), (F.var_pop(left) / F.var_pop("y")).alias("fitted_share"), (F.var_pop(F.col("y") - F.col("x1")) / F.var_pop("y")).alias("fixed_share"))
    return rounded(out, 5)


@query("r3_windowed_exponents", f"WITH {V_REG}, md AS (SELECT win, grp, median(y) AS y, median(x1) AS x1, median(x2) AS x2, median(x3) AS x3 FROM v_reg GROUP BY 1, 2), {_ols_sql('md', 'win')} SELECT win, n::BIGINT AS n, round(b1, 4) AS b_x1, round(b2, 4) AS b_x2, round(b3, 4) AS b_x3, round(r2, 4) AS r2 FROM fit_")
def r3_windowed_exponents(spark, sf_dir):
    med = v_reg(spark, sf_dir).groupBy("win", "grp").agg(*[F.median(c).alias(c) for c in ("y", *XS)])
    return rounded(regress.ols(med, ["win"], XS, "y", errors=False).drop("b0"), 4)


@query("r3_leave_one_out_range", f"WITH {V_REG}, gs AS (SELECT DISTINCT grp AS out FROM v_reg), lo AS (SELECT out, v.* FROM v_reg v JOIN gs ON gs.out <> v.grp), {_ols_sql('lo', 'out')} SELECT count(*) AS n_fits, round(min(b1), 5) AS min_x1, round(max(b1), 5) AS max_x1, round(min(b2), 4) AS min_x2, round(max(b2), 4) AS max_x2, round(min(b3), 4) AS min_x3, round(max(b3), 4) AS max_x3 FROM fit_")
def r3_leave_one_out_range(spark, sf_dir):
    out = regress.leave_one_out(v_reg(spark, sf_dir), [], "grp", XS, "y")
    return out.select("n_fits", *[F.round(f"{m}_{x}", 5 if x == "x1" else 4).alias(f"{m}_{x}") for x in XS for m in ("min", "max")])


REP_ENDS = ", ".join(f"round(quantile_cont(b{x[1]}, {p}), 4) AS {name}_{x}" for x in XS for name, p in (("low", "0.025"), ("high", "0.975")))


@query("r3_cluster_bootstrap", f"""WITH {V_REG}, gs AS (SELECT DISTINCT grp FROM v_reg), dr AS ({replicated_sql("gs", "grp", 50, "reg")}), bw AS (SELECT v.*, rep, w FROM v_reg v JOIN dr USING (grp)), {_ols_sql("bw", "win, rep", w="w")} SELECT win, {REP_ENDS} FROM fit_ GROUP BY win""")
def r3_cluster_bootstrap(spark, sf_dir):
    return rounded(regress.cluster_bootstrap(v_reg(spark, sf_dir), ["win"], "grp", XS, "y", 50, "reg"), 4)


@query("r4_parameter_scaling", f"WITH {V_REG}, u AS (SELECT 'y' AS target, y AS yy, x1, x2, x3 FROM v_reg UNION ALL SELECT 'win', win, x1, x2, x3 FROM v_reg), {_ols_sql('u', 'target', 'yy')} SELECT target, n::BIGINT AS n, round(b1, 5) AS b_x1, round(b2, 5) AS b_x2, round(b3, 5) AS b_x3, round(r2, 5) AS r2 FROM fit_")
def r4_parameter_scaling(spark, sf_dir):
    rows = v_reg(spark, sf_dir).select(*XS, "y", "win").unpivot(XS, ["y", "win"], "target", "v")
    return rounded(regress.ols(rows, ["target"], XS, "v", errors=False).drop("b0"), 5)


@query("r5_quarter_root", f"WITH {V_SERIES} SELECT cond, round(regr_slope(pow(value, 4), time) / 1e6, 4) AS slope, round(regr_intercept(pow(value, 4), time) / 1e6, 4) AS intercept FROM v_series GROUP BY cond")
def r5_quarter_root(spark, sf_dir):
    slope, at0 = regress.quarter_root("time", "value")
    return rounded(v_series(spark, sf_dir).groupBy("cond").agg((slope / 1e6).alias("slope"), (at0 / 1e6).alias("intercept")), 4)


@query("r6_fixed_intercept", f"WITH {V_SERIES} SELECT cond, traj, round(sum(time * (value - 90.0)) / sum(time * time), 6) AS slope FROM v_series GROUP BY 1, 2")
def r6_fixed_intercept(spark, sf_dir):
    return rounded(v_series(spark, sf_dir).groupBy(*KEYS).agg(regress.fixed_intercept_slope(F.col("time"), F.col("value"), 90.0).alias("slope")))


@query("r7_robust_line", f"""WITH {V_SERIES}, c AS (SELECT cond, traj, pos, time, value, lead(time) OVER w AS t1, lead(value) OVER w AS v1 FROM v_series WINDOW w AS (PARTITION BY cond, traj ORDER BY pos)),
l AS (SELECT cond, traj, pos AS i, (v1 - value) / (t1 - time) AS b, value - (v1 - value) / (t1 - time) * time AS a FROM c WHERE t1 > time), s AS (SELECT l.cond, l.traj, i, a, b, count(*) AS n FROM l JOIN v_series p ON p.cond = l.cond AND p.traj = l.traj AND abs(p.value - a - b * p.time) <= 15.0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY cond, traj ORDER BY n DESC, i) AS r FROM s)
SELECT p.cond, p.traj, count(*) AS n_inliers, round(regr_slope(value, time), 4) AS slope, round(regr_intercept(value, time), 4) AS intercept FROM v_series p JOIN k ON k.cond = p.cond AND k.traj = p.traj AND r = 1 AND abs(value - a - b * time) <= 15.0 GROUP BY 1, 2""")
def r7_robust_line(spark, sf_dir):
    return rounded(regress.robust_line(v_series(spark, sf_dir), KEYS, "pos", "time", "value", 15.0), 4)


@query("r8_circle", """WITH p AS (SELECT p_brand AS grp, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part), z AS (SELECT *, x * x + y * y AS z FROM p),
g AS (SELECT grp, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x * x) - sum(x) * sum(x) / count(*) AS xx, sum(x * y) - sum(x) * sum(y) / count(*) AS xy, sum(y * y) - sum(y) * sum(y) / count(*) AS yy, sum(x * z) - sum(x) * sum(z) / count(*) AS xz, sum(y * z) - sum(y) * sum(z) / count(*) AS yz FROM z GROUP BY 1),
b AS (SELECT *, (yy * xz - xy * yz) / (xx * yy - xy * xy) AS bx, (xx * yz - xy * xz) / (xx * yy - xy * xy) AS by_ FROM g) SELECT grp, round(bx / 2, 4) AS cx, round(by_ / 2, 4) AS cy, round(sqrt((sz - bx * sx - by_ * sy) / n + bx * bx / 4 + by_ * by_ / 4), 4) AS r FROM b""")
def r8_circle(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return rounded(regress.circle(part, ["grp"], "x", "y"), 4)


SIGMA = V_PRED + """, rb AS (SELECT *, least(greatest(floor(tax / 0.0101), 0), 9)::INT AS bin, mu - truth AS resid FROM v_pred), rm AS (SELECT *, median(resid) OVER (PARTITION BY bin) AS m, median(resid) OVER () AS mm FROM rb),
ov AS (SELECT 1.4826 * median(abs(resid - mm)) AS s FROM rm), bs AS (SELECT bin, count(*) AS n, 1.4826 * median(abs(resid - m)) AS s FROM rm GROUP BY 1),
sigma_bins AS (SELECT g.bin::INT AS bin, coalesce(n, 0) AS n, greatest(CASE WHEN coalesce(n, 0) >= 50 THEN bs.s ELSE ov.s END, 1.0) AS sigma FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN bs USING (bin) CROSS JOIN ov)"""


def _sigma(spark, sf_dir):
    df = v_pred(spark, sf_dir).withColumns({"bin": time_bin(F.col("tax"), 0.0101, 10), "resid": F.col("mu") - F.col("truth")})
    return df, regress.sigma_by_bin(df, "bin", "resid", 10, 50, 1.0)


@query("r14_sigma_by_bin", f"WITH {SIGMA} SELECT bin, n, round(sigma, 4) AS sigma FROM sigma_bins")
def r14_sigma_by_bin(spark, sf_dir):
    return rounded(_sigma(spark, sf_dir)[1].select("bin", "n", "sigma"), 4)


@query("r15_total_sigma", f"WITH {SIGMA} SELECT grp, count(*) AS n, round(avg(sqrt(v.sigma * v.sigma + b.sigma * b.sigma)), 4) AS mean_sigma FROM (SELECT *, least(greatest(floor(tax / 0.0101), 0), 9)::INT AS bin FROM v_pred) v JOIN sigma_bins b USING (bin) GROUP BY grp")
def r15_total_sigma(spark, sf_dir):
    df, sig = _sigma(spark, sf_dir)
    rows = df.join(sig.select("bin", F.col("sigma").alias("own")), "bin")
    return rounded(rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.sqrt(F.col("sigma") * F.col("sigma") + F.col("own") * F.col("own"))).alias("mean_sigma")), 4)


T = "time::DOUBLE"


@query("x1_quarter_curve", f"WITH {V_POINTS} SELECT event_id, round(1 / (1 + exp(-(time - 8.0) / 2.5)) * 60.0 * pow(time, 0.25), 6) AS y FROM v_points")
def x1_quarter_curve(spark, sf_dir):
    return v_points(spark, sf_dir).select("event_id", F.round(models.quarter_curve(F.col("time"), F.lit(60.0), F.lit(8.0), F.lit(2.5)), 6).alias("y"))


@query("x2_blend_curve", f"WITH {V_POINTS}, w AS (SELECT *, 1 / (1 + exp(-(time - 8.0) / 2.5)) AS w, greatest(time, 1e-12) AS p FROM v_points) SELECT event_id, round((1 - w) * 30.0 * sqrt(time) + w * 60.0 * pow(time, 0.25), 6) AS y, round(w * (1 - w) / 2.5 * (60.0 * pow(p, 0.25) - 30.0 * sqrt(p)) + (1 - w) * 30.0 * sqrt(p) / (2 * p) + w * 60.0 * pow(p, 0.25) / (4 * p), 4) AS slope FROM w WHERE time > 0.01")
def x2_blend_curve(spark, sf_dir):
    args = [F.col("time"), *map(F.lit, (30.0, 60.0, 8.0, 2.5))]
    return v_points(spark, sf_dir).filter("time > 0.01").select("event_id", F.round(models.blend_curve(*args), 6).alias("y"), F.round(models.blend_slope(*args), 4).alias("slope"))


@query("x3_breakup_curve", f"WITH {V_POINTS}, q AS (SELECT *, time / 10000 AS t, 0.0003 AS d, 1e8 AS dp, 20.0 + traj % 7 AS rho FROM v_points), b AS (SELECT *, 15.8 * 840.0 * d / sqrt(rho * dp) AS tb, 2.95 * pow(dp / rho, 0.25) * sqrt(d) AS base FROM q) SELECT event_id, round(1000 * CASE WHEN t > 2 * 0.001 THEN sqrt(2.0) * base * pow(0.001, 0.25) * pow(greatest(t - 0.001, 0), 0.25) WHEN t < tb THEN 0.39 * sqrt(2 * dp / 840.0) * t ELSE base * sqrt(t) END, 6) AS mm FROM b")
def x3_breakup_curve(spark, sf_dir):
    mm = models.breakup_curve(F.col("time") / 10000, F.lit(0.0003), F.lit(1e8), 20.0 + F.col("traj") % 7, 0.39, 2.95, 15.8, F.lit(0.001)) * 1000
    return v_points(spark, sf_dir).select("event_id", F.round(mm, 6).alias("mm"))


@query("x4_delay_curve", f"WITH {V_POINTS} SELECT event_id, round(0.9 * (3 + traj % 5) * sqrt(greatest(time - 0.4, 0)) / sqrt(tan(0.3 / 2)), 6) AS y FROM v_points")
def x4_delay_curve(spark, sf_dir):
    return v_points(spark, sf_dir).select("event_id", F.round(models.delay_curve(F.col("time"), 0.9, 0.4, 3 + F.col("traj") % 5, F.lit(0.3)), 6).alias("y"))


@query("j15_fit_residuals", f"WITH {V_SERIES}, f AS (SELECT cond, regr_slope(value, time) AS b, regr_intercept(value, time) AS a FROM v_series GROUP BY 1) SELECT cond, bin, count(*) AS n, round(avg(value - a - b * time), 5) AS mean_resid FROM v_series JOIN f USING (cond) GROUP BY 1, 2")
def j15_fit_residuals(spark, sf_dir):
    rows = v_series(spark, sf_dir)
    fits = rows.groupBy("cond").agg(F.regr_slope("value", "time").alias("b"), F.regr_intercept("value", "time").alias("a"))
    rows = rows.join(fits, "cond")
    return rounded(rows.groupBy("cond", "bin").agg(F.count("*").alias("n"), F.avg(F.col("value") - F.col("a") - F.col("b") * F.col("time")).alias("mean_resid")), 5)


@query("r9_trajectory_fits")
def r9_trajectory_fits(spark, sf_dir):
    return rounded(fit.fit_groups(_by_time(spark, sf_dir), KEYS, "time", "value"), 4)


@query("r10_condition_fits")
def r10_condition_fits(spark, sf_dir):
    p50 = _by_time(spark, sf_dir).withColumn("t", F.floor("time") + 0.5).groupBy("cond", "t").agg(F.median("value").alias("p50"))
    fits = fit.fit_groups(p50, ["cond"], "t", "p50")
    grid = fits.select("cond", "k", "t0", "s", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("t"))
    return rounded(grid.select("cond", "t", models.quarter_curve(F.col("t").cast("double"), F.col("k"), F.col("t0"), F.col("s")).alias("y")), 4)


@query("r11_blend_fits")
def r11_blend_fits(spark, sf_dir):
    return rounded(fit.fit_groups(_by_time(spark, sf_dir), ["cond", "traj"], "time", "value", kind="blend"), 3)


def _calibration(spark, sf_dir):
    return v_reg(spark, sf_dir).select(F.lit(1.0).alias("one"), "x1", "x2", "y", "grp")


CAL_XS = ("one", "x1", "x2")


def _huber_sql(rounds: int, delta: float) -> str:
    """CTEs ending in b<rounds - 1>: iterated reweighting of y on one, x1, x2, and cal, the rows with the weights of the last round."""
    at = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    minor = lambda i, j: "({} * {} - {} * {})".format(*(lambda r, c: (at(r[0], c[0]), at(r[1], c[1]), at(r[0], c[1]), at(r[1], c[0])))([k for k in range(3) if k != i], [k for k in range(3) if k != j]))
    sign = lambda i, j: "-" if (i + j) % 2 else ""
    det = " + ".join(f"{at(0, j)} * {sign(0, j)}{minor(0, j)}" for j in range(3))
    solved = ", ".join(f"({' + '.join(f'{sign(i, j)}{minor(i, j)} * gy{j}' for j in range(3))}) / ({det}) AS c{i}" for i in range(3))
    sums = ", ".join([f"sum(w * {a} * {b}) AS g{i}{j}" for i, a in enumerate(CAL_XS) for j, b in enumerate(CAL_XS) if j >= i] + [f"sum(w * {a} * y) AS gy{i}" for i, a in enumerate(CAL_XS)])
    out = ["h0 AS (SELECT 1.0 AS one, x1, x2, y, grp, 1.0 AS w FROM v_reg)"]
    for k in range(rounds):
        out.append(f"b{k} AS (SELECT {solved} FROM (SELECT {sums} FROM h{k}))")
        if k + 1 < rounds:
            r = "abs(y - c0 - c1 * x1 - c2 * x2)"
            out.append(f"h{k + 1} AS (SELECT one, x1, x2, y, grp, CASE WHEN {r} <= {delta} THEN 1.0 ELSE {delta} / {r} END AS w FROM h{k}, b{k})")
    reps = f"cg AS (SELECT grp, {sums} FROM h{rounds - 1} GROUP BY grp), dr AS ({replicated_sql('cg', 'grp', 100, 'cal')}), rs AS (SELECT {', '.join(f'sum(w * {c}) AS {c}' for c in [*(f'g{i}{j}' for i in range(3) for j in range(i, 3)), *(f'gy{i}' for i in range(3))])} FROM dr GROUP BY rep), rb AS (SELECT {solved} FROM rs)"
    return ",\n".join([*out, reps])


@query("r12_robust_calibration", f"WITH {V_REG}, {_huber_sql(4, 0.05)} SELECT round(c0, 5) AS b_one, round(c1, 5) AS b_x1, round(c2, 5) AS b_x2 FROM b3")
def r12_robust_calibration(spark, sf_dir):
    return rounded(fit.calibrate(_calibration(spark, sf_dir), list(CAL_XS), "y", 0.05, rounds=4), 5)


CAL_ENDS = ", ".join(f"round(quantile_cont(c{i}, {p}), 5) AS {x}_{side}" for i, x in enumerate(CAL_XS) for side, p in (("low", "0.025"), ("high", "0.975")))


@query("r13_bootstrap_calibration", f"WITH {V_REG}, {_huber_sql(4, 0.05)} SELECT {CAL_ENDS} FROM rb")
def r13_bootstrap_calibration(spark, sf_dir):
    fits = fit.calibration_bootstrap(_calibration(spark, sf_dir), list(CAL_XS), "y", 0.05, "grp", 100, "cal", rounds=4)
    return rounded(fits.agg(*[F.percentile(f"b_{x}", F.lit(p)).alias(f"{x}_{n}") for x in CAL_XS for n, p in (("low", 0.025), ("high", 0.975))]), 5)


BREAKUP = [solve.Parameter("kv", 0.39, 0.05, 10.0), solve.Parameter("kp", 2.95, 0.3, 30.0), solve.Parameter("kbt", 15.8, 1.0, 500.0, switch=True)]
DELAY = [solve.Parameter("k", 20.0, 1e-4, 1e6), solve.Parameter("delay", 0.0, -0.1, 5.0, log=False)]


def _breakup(spark, sf_dir):
    """Values as millimetres over time in ten-thousandths of a day, under the operating points of x3."""
    rows = v_points(spark, sf_dir).select((F.col("time") / 10000).alias("t"), (20.0 + F.col("traj") % 7).alias("rho"), F.col("value").alias("y"), F.col("traj").alias("cluster"))
    return rows, lambda p: 1000 * models.breakup_curve(F.col("t"), F.lit(0.0003), F.lit(1e8), F.col("rho"), p["kv"], p["kp"], p["kbt"])


def _delay(spark, sf_dir):
    rows = v_points(spark, sf_dir).select(F.col("time").alias("t"), (3 + F.col("traj") % 5).cast("double").alias("a"), F.col("value").alias("y"), F.col("traj").alias("cluster"))
    return rows, lambda p: models.delay_curve(F.col("t"), p["k"], p["delay"], F.col("a"))


@query("r12_breakup_calibration")
def r12_breakup_calibration(spark, sf_dir):
    """Bounded robust calibration of the break-up correlation."""
    rows, model = _breakup(spark, sf_dir)
    return rounded(solve.calibrate(rows, model, "y", BREAKUP, 1.0).table(spark), 4)


@query("r12_delay_calibration")
def r12_delay_calibration(spark, sf_dir):
    rows, model = _delay(spark, sf_dir)
    return rounded(solve.calibrate(rows, model, "y", DELAY, 1.0).table(spark), 4)


@query("r13_delay_bootstrap")
def r13_delay_bootstrap(spark, sf_dir):
    """Intervals of the delay correlation's parameters over trajectories."""
    rows, model = _delay(spark, sf_dir)
    found = solve.calibrate(rows, model, "y", DELAY, 1.0)
    return rounded(solve.bootstrap(found, "cluster", 200, "delay"), 4)


@query("a34_collapse_bins", f"WITH {DISTINCT_T}, n AS (SELECT cond, traj, time, value / max(value) OVER (PARTITION BY cond, traj) AS u FROM dt), b AS (SELECT cond, least(floor(time / 3), 9)::INT AS bin, count(*) AS n, avg(u) AS mean FROM n GROUP BY 1, 2) SELECT cond, bin, n, round(mean, 6) AS mean, round(mean / avg(mean) OVER (PARTITION BY bin), 6) AS ratio FROM b")
def a34_collapse_bins(spark, sf_dir):
    rows = _by_time(spark, sf_dir).withColumn("u", F.col("value") / F.max("value").over(W.partitionBy(*KEYS)))
    b = rows.withColumn("bin", F.least(F.floor(F.col("time") / 3), F.lit(9)).cast("int")).groupBy("cond", "bin").agg(F.count("*").alias("n"), F.avg("u").alias("mean"))
    return rounded(b.withColumn("ratio", F.col("mean") / F.avg("mean").over(W.partitionBy("bin"))))


@query("a35_collapse_check", f"WITH {V_REG} SELECT win, round(stddev_pop(y), 6) AS raw_std, round(stddev_pop(y - x1), 6) AS scaled_std, round(stddev_pop(y - x1) / stddev_pop(y), 6) AS ratio, round(regr_r2(y, x1), 6) AS r2, CASE WHEN stddev_pop(y - x1) / stddev_pop(y) < 0.5 THEN 'collapsed' ELSE 'spread' END AS verdict FROM v_reg GROUP BY win")
def a35_collapse_check(spark, sf_dir):
    r = F.stddev_pop(F.col("y") - F.col("x1")) / F.stddev_pop("y")
    return rounded(v_reg(spark, sf_dir).groupBy("win").agg(F.stddev_pop("y").alias("raw_std"), F.stddev_pop(F.col("y") - F.col("x1")).alias("scaled_std"), r.alias("ratio"), F.regr_r2("y", "x1").alias("r2"), F.when(r < 0.5, "collapsed").otherwise("spread").alias("verdict")))


@query("a40_sanity_regression", f"WITH {V_REG} SELECT grp, round(regr_slope(y, x1), 6) AS slope, round(regr_r2(y, x1), 6) AS r2, round(corr(y, x2), 5) AS corr FROM v_reg GROUP BY grp")
def a40_sanity_regression(spark, sf_dir):
    out = v_reg(spark, sf_dir).groupBy("grp").agg(F.regr_slope("y", "x1").alias("slope"), F.regr_r2("y", "x1").alias("r2"), F.round(F.corr("y", "x2"), 5).alias("corr"))
    return rounded(out)
