"""Queries of quality gates, audits, support checks, selection and set operations, with the same answers as SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import as_boolean, ratio
from tracelake.operators import align, quality, robust, select, support
from tracelake.plans.registry import Registry, nearest, rounded
from tracelake.plans.series_queries import CENSOR, DISTINCT_T, Z, _by_time, _censor_bins
from tracelake.plans.views import KEYS, V_FITS, V_POINTS, V_SERIES, load, v_fits, v_points, v_series

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

GATE = quality.GateRule(negative_step=-180, spike_step=180, spike_d1=2000, spike_d2=40000, plateau_step=10, plateau_jump=80, repeat_conditions=1, repeat_fraction=0.1, loose=(5, 0.5), strict=(3, 0.75))
GRID = [5.0, 10.0, 15.0, 20.0, 25.0]
#: unit of a condition: ten groups of trajectories
UNIT_SQL = "traj % 10 AS unit"

SHAPES = DISTINCT_T + f""",
sh1 AS (SELECT *, time - lag(time) OVER w AS dt_, value - lag(value) OVER w AS dy FROM dt WINDOW w AS (PARTITION BY cond, traj ORDER BY time)),
sh2 AS (SELECT *, dy / dt_ AS d1 FROM sh1),
sh3 AS (SELECT *, (d1 - lag(d1) OVER w) / ((dt_ + lag(dt_) OVER w) * 0.5) AS d2, CASE WHEN greatest(lag(dy) OVER w, lag(dy, 2) OVER w) <= {GATE.plateau_step} AND lag(dy, 2) OVER w IS NOT NULL AND dy >= {GATE.plateau_jump} THEN dy END AS jump
  FROM sh2 WINDOW w AS (PARTITION BY cond, traj ORDER BY time)),
shapes AS (SELECT cond, traj, {UNIT_SQL}, count(*) AS n_points, min(time) AS t_min, max(time) AS t_max, arg_max(value, time) AS v_last, quantile_cont(value, 0.9) AS v_p90, min(dy) AS min_step, max(dy) AS max_step, max(d1) AS max_d1, max(abs(d2)) AS max_d2,
  count(*) >= 4 AS valid, coalesce(min(dy) <= {GATE.negative_step}, FALSE) AS negative, coalesce(max(dy) >= {GATE.spike_step}, FALSE) OR coalesce(max(d1) >= {GATE.spike_d1}, FALSE) OR coalesce(max(abs(d2)) >= {GATE.spike_d2}, FALSE) AS spike,
  max(jump) IS NOT NULL AND count(dy) >= 4 AS plateau FROM sh3 GROUP BY cond, traj)"""


def _shapes(spark, sf_dir):
    return quality.trace_shape(_by_time(spark, sf_dir), KEYS, "time", "value", GATE).withColumn("unit", F.col("traj") % 10)


@query("w10_trace_shape", f"WITH {SHAPES} SELECT cond, traj, n_points, round(t_min, 6) AS t_min, round(t_max, 6) AS t_max, round(v_last, 6) AS v_last, round(v_p90, 5) AS v_p90, round(min_step, 5) AS min_step, round(max_step, 5) AS max_step, valid, negative, spike, plateau FROM shapes")
def w10_trace_shape(spark, sf_dir):
    s = _shapes(spark, sf_dir)
    return s.select(*KEYS, "n_points", *[F.round(c, 6).alias(c) for c in ("t_min", "t_max", "v_last")], *[F.round(c, 5).alias(c) for c in ("v_p90", "min_step", "max_step")], "valid", "negative", "spike", "plateau")


COMPARED = SHAPES + """,
gseg AS (SELECT *, lead(time) OVER w AS t1, lead(value) OVER w AS v1 FROM dt WINDOW w AS (PARTITION BY cond, traj ORDER BY time)), gg AS (SELECT unnest([5.0, 10.0, 15.0, 20.0, 25.0])::DOUBLE AS g),
atg AS (SELECT cond, traj, traj % 10 AS unit, g AS time, value + coalesce((v1 - value) / (t1 - time), 0) * (g - time) AS v FROM gseg JOIN gg ON g >= time AND (g < t1 OR (t1 IS NULL AND g = time))),
each_ AS (SELECT cond, unit, time, median(v) AS v FROM atg GROUP BY 1, 2, 3), m1 AS (SELECT *, median(v) OVER (PARTITION BY cond, time) AS m FROM each_), m2 AS (SELECT *, median(abs(v - m)) OVER (PARTITION BY cond, time) AS mad FROM m1),
compared AS (SELECT cond, unit, time, v, v / nullif(m, 0) AS ratio, 0.6745 * (v - m) / nullif(mad, 0) AS z FROM m2)"""
GATED = COMPARED + f""",
by_ AS (SELECT cond, unit, count(*) AS n_traces, avg(spike::INT) AS spike_fraction, avg(plateau::INT) AS plateau_fraction, avg(negative::INT) AS negative_fraction FROM shapes WHERE valid GROUP BY 1, 2),
low_ AS (SELECT cond, unit, min(ratio) AS min_low, median(ratio) AS median_low, count(*) FILTER (ratio < 0.8) AS n_low, count(ratio) AS n_compared FROM compared GROUP BY 1, 2),
gt AS (SELECT *, count(*) OVER (PARTITION BY cond) AS n_units, greatest(spike_fraction, plateau_fraction, negative_fraction) AS worst FROM by_ LEFT JOIN low_ USING (cond, unit)),
gated AS (SELECT *, coalesce(n_units >= 4 AND ((min_low <= 0.75 AND n_low >= 2) OR (min_low <= 0.70 AND n_low >= 1)), FALSE) AS systematic_low, coalesce(n_units >= 4 AND min_low <= 0.65 AND n_low >= 2, FALSE) AS severe_low,
  (n_traces >= {GATE.strict[0]} AND worst >= {GATE.strict[1]}) OR (n_traces >= {GATE.loose[0]} AND worst >= {GATE.loose[1]}) AS recurrent_shape FROM gt)"""
SUPPORT = GATED + f", sup AS (SELECT unit, count(*) AS n_conditions, count(*) FILTER (systematic_low) AS n_systematic, count(*) FILTER (systematic_low) / greatest(count(*), 1) AS low_fraction FROM gated GROUP BY 1), sup2 AS (SELECT *, n_systematic >= {GATE.repeat_conditions} AND low_fraction >= {GATE.repeat_fraction} AS repeat_low FROM sup)"
MANIFEST = SUPPORT + """, man AS (SELECT * FROM (VALUES ('click', 3), ('view', 7)) AS t(cond, unit)),
mf AS (SELECT g.*, coalesce(repeat_low, FALSE) AS repeat_low, man.cond IS NOT NULL AS manual FROM gated g LEFT JOIN sup2 USING (unit) LEFT JOIN man ON man.cond = g.cond AND man.unit = g.unit),
manifest AS (SELECT *, manual OR (systematic_low AND (repeat_low OR severe_low)) OR recurrent_shape AS drop_, concat_ws(';', CASE WHEN manual THEN 'manual' END, CASE WHEN systematic_low AND (repeat_low OR severe_low) THEN 'systematic_low' END, CASE WHEN recurrent_shape THEN 'recurrent_shape' END) AS reason FROM mf)"""


def _gated(spark, sf_dir):
    at = align.at_grid(_by_time(spark, sf_dir), KEYS, "time", "value", GRID, "v").withColumn("unit", F.col("traj") % 10)
    compared = quality.compared_with_condition(at, ["cond"], "unit", "time", "v")
    return compared, quality.gate_units(_shapes(spark, sf_dir), compared, ["cond"], "unit", GATE)


def _manifest(spark, sf_dir):
    _, gated = _gated(spark, sf_dir)
    manual = spark.createDataFrame([("click", 3), ("view", 7)], "cond string, unit long")
    return quality.gate_manifest(gated, quality.repeat_support(gated, ["unit"], GATE), manual, ["cond", "unit"], ["unit"])


@query("a12_condition_unit_gate", f"WITH {GATED} SELECT cond, unit, n_traces, round(spike_fraction, 6) AS spike_fraction, round(min_low, 6) AS min_low, round(median_low, 6) AS median_low, n_low, systematic_low, severe_low, recurrent_shape FROM gated")
def a12_condition_unit_gate(spark, sf_dir):
    return rounded(_gated(spark, sf_dir)[1].select("cond", "unit", "n_traces", "spike_fraction", "min_low", "median_low", "n_low", "systematic_low", "severe_low", "recurrent_shape"))


@query("a12_compared_at_grid", f"WITH {COMPARED} SELECT cond, unit, time, round(ratio, 6) AS ratio, round(z, 5) AS z FROM compared")
def a12_compared_at_grid(spark, sf_dir):
    return _gated(spark, sf_dir)[0].select("cond", "unit", "time", F.round("ratio", 6).alias("ratio"), F.round("z", 5).alias("z"))


@query("a13_repeat_support", f"WITH {SUPPORT} SELECT unit, n_conditions, n_systematic, round(low_fraction, 6) AS low_fraction, repeat_low FROM sup2")
def a13_repeat_support(spark, sf_dir):
    return rounded(quality.repeat_support(_gated(spark, sf_dir)[1], ["unit"], GATE))


@query("j10_gate_manifest", f"WITH {MANIFEST} SELECT cond, unit, manual, drop_ AS drop, reason FROM manifest")
def j10_gate_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir).select("cond", "unit", "manual", "drop", "reason")


@query("a14_gate_report", f"WITH {MANIFEST} SELECT cond, reason, count(*) AS n FROM manifest WHERE drop_ GROUP BY 1, 2")
def a14_gate_report(spark, sf_dir):
    return _manifest(spark, sf_dir).filter(F.col("drop")).groupBy("cond", "reason").agg(F.count("*").alias("n"))


@query("j9_drop_gated", f"WITH {MANIFEST} SELECT p.cond, count(*) AS n_before, count(*) FILTER (NOT coalesce(drop_, FALSE)) AS n_after FROM v_points p LEFT JOIN manifest m ON m.cond = p.cond AND m.unit = p.traj % 10 GROUP BY 1")
def j9_drop_gated(spark, sf_dir):
    points = v_points(spark, sf_dir).withColumn("unit", F.col("traj") % 10)
    rest = points.join(_manifest(spark, sf_dir).filter(F.col("drop")), ["cond", "unit"], "left_anti")
    before = points.groupBy("cond").agg(F.count("*").alias("n_before"))
    return before.join(rest.groupBy("cond").agg(F.count("*").alias("n_after")), "cond", "left").fillna(0, ["n_after"])


MASKS = V_FITS + """,
lg AS (SELECT *, log(1 + price) / log(exp(1)) AS lp FROM v_fits), f0 AS (SELECT *, ln(1 + price) AS l FROM v_fits), f1 AS (SELECT *, median(l) OVER (PARTITION BY grp) AS m FROM f0), f2 AS (SELECT *, median(abs(l - m)) OVER (PARTITION BY grp) AS mad FROM f1),
masks AS (SELECT *, price >= 30000 AS mask_basic, price <= 380000 AS mask_far, CASE WHEN mad < 1e-12 THEN 0.0 ELSE 0.6745 * (l - m) / (mad + 1e-12) END AS z_log FROM f2),
fits AS (SELECT *, abs(z_log) <= 2.5 AS mask_outlier, mask_basic AND mask_far AND abs(z_log) <= 2.5 AS clean FROM masks)"""


def _fits(spark, sf_dir):
    return robust.filter_masks(v_fits(spark, sf_dir), ["grp"], "price", 30000, 380000, 2.5)


@query("p18_filter_masks", f"WITH {MASKS} SELECT o_orderkey, mask_basic, mask_far, mask_outlier, clean, round(z_log, 5) AS z_log FROM fits")
def p18_filter_masks(spark, sf_dir):
    return _fits(spark, sf_dir).select("o_orderkey", "mask_basic", "mask_far", "mask_outlier", "clean", F.round("z_log", 5).alias("z_log"))


QUALITY_SQL = V_FITS + """, f0 AS (SELECT o_orderkey, grp, status <> 'P' AS success, o_orderkey % 60 AS n, price / 6e8 AS t0, (bal + 1200) / 1.1e7 AS s, price / 1e5 AS rmse, price / 7e3 AS cost, ln(60 + o_orderkey % 1100) AS log_k, ln(price / 6e8) AS log_t0, ln(greatest((bal + 1200) / 1.1e7, 1e-12)) AS log_s FROM v_fits),
f1 AS (SELECT *, 2 * cost / greatest(n, 1) AS cpp, CASE WHEN success THEN exp(log_k) * pow(0.005, 0.25) / (1 + exp(-(0.005 - exp(log_t0)) / exp(log_s))) END AS far FROM f0),
f2 AS (SELECT *, coalesce(success AND n >= 10 AND t0 > 0 AND t0 < (SELECT max(t0) FROM f0) AND s > 0 AND s < 1e-3 AND t0 < 0.8e-3, FALSE) AS mask_basic, coalesce(far BETWEEN 18.0 AND 300.0, FALSE) AS mask_penetration_far, ln(1 + rmse) AS lr, ln(1 + cpp) AS lc FROM f1),
f3 AS (SELECT *, median(t0) OVER w AS m1, median(lr) OVER w AS m2, median(lc) OVER w AS m3 FROM f2 WINDOW w AS (PARTITION BY grp)),
f4 AS (SELECT *, median(abs(t0 - m1)) OVER w AS d1, median(abs(lr - m2)) OVER w AS d2, median(abs(lc - m3)) OVER w AS d3 FROM f3 WINDOW w AS (PARTITION BY grp)),
f5 AS (SELECT *, """ + ", ".join(f"CASE WHEN d{i} < 1e-12 THEN 0.0 ELSE 0.6745 * ({v} - m{i}) / (d{i} + 1e-12) END AS {z}" for i, v, z in ((1, "t0", "z_t0"), (2, "lr", "z_rmse"), (3, "lc", "z_cost"))) + """ FROM f4),
f6 AS (SELECT *, abs(z_t0) > 3 OR abs(z_rmse) > 3 OR abs(z_cost) > 3 AS mask_outlier FROM f5)"""


@query("p18_fit_quality", f"WITH {QUALITY_SQL} SELECT o_orderkey, round(cpp, 5) AS cost_per_point, round(far, 5) AS penetration_far, round(z_t0, 5) AS z_t0, round(z_rmse, 5) AS z_rmse, round(z_cost, 5) AS z_cost, mask_basic, mask_penetration_far, mask_outlier, NOT mask_basic OR NOT mask_penetration_far OR mask_outlier AS flag_bad_fit FROM f6")
def p18_fit_quality(spark, sf_dir):
    """All nine columns of the fit masks, over fit rows made of the orders."""
    c = F.col
    s = (c("bal") + 1200) / 1.1e7
    fits = v_fits(spark, sf_dir).select("o_orderkey", "grp", (c("status") != "P").alias("success"), (c("o_orderkey") % 60).alias("n"), (c("price") / 6e8).alias("t0"), s.alias("s"), (c("price") / 1e5).alias("rmse"), (c("price") / 7e3).alias("cost"), F.ln(60 + c("o_orderkey") % 1100).alias("log_k"), F.ln(c("price") / 6e8).alias("log_t0"), F.ln(F.greatest(s, F.lit(1e-12))).alias("log_s"))
    cols = ("cost_per_point", "penetration_far", "z_t0", "z_rmse", "z_cost")
    return robust.fit_masks(fits, ["grp"]).select("o_orderkey", *[nearest(x, 5).alias(x) for x in cols], "mask_basic", "mask_penetration_far", "mask_outlier", "flag_bad_fit")


@query("a15_fit_report", f"WITH {MASKS} SELECT grp, count(*) AS n, count(*) FILTER (clean) AS n_clean, count(*) FILTER (NOT clean) AS n_flagged, round(100.0 * count(*) FILTER (status = 'F') / count(*), 6) AS success_pct, round(median(price), 6) AS median_price FROM fits GROUP BY grp")
def a15_fit_report(spark, sf_dir):
    return rounded(_fits(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.count_if("clean").alias("n_clean"), F.count_if(~F.col("clean")).alias("n_flagged"), (100.0 * F.count_if(F.col("status") == "F") / F.count("*")).alias("success_pct"), F.median("price").alias("median_price")))


@query("a16_survival_grains", f"WITH {MASKS} SELECT coalesce(grp, 'all') AS grp, coalesce(status, 'all') AS status, count(*) AS n, count(*) FILTER (clean) AS n_clean, round(count(*) FILTER (clean) / count(*), 6) AS clean_rate FROM fits GROUP BY GROUPING SETS ((grp, status), (grp), ())")
def a16_survival_grains(spark, sf_dir):
    return rounded(quality.survival(_fits(spark, sf_dir), [["grp", "status"], ["grp"], []], ["grp", "status"], ["clean"]))


CASCADE = MASKS + """,
wide AS (SELECT o.o_orderkey, CASE WHEN o.o_orderstatus <> 'P' THEN f.mask_basic END AS basic, CASE WHEN o.o_orderstatus <> 'P' THEN f.mask_far END AS far, f.mask_outlier AS outlier, coalesce(t.k IS NOT NULL, FALSE) AS trained
  FROM orders o LEFT JOIN fits f USING (o_orderkey) LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01') t ON t.k = o.o_orderkey)"""


def _cascade(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    fits = _fits(spark, sf_dir).select("o_orderkey", "mask_basic", "mask_far", "mask_outlier")
    trained = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("trained", F.lit(True))
    known = F.col("o_orderstatus") != "P"
    wide = orders.join(fits, "o_orderkey", "left").join(trained, "o_orderkey", "left").fillna(False, ["trained"])
    return wide.select("o_orderkey", F.when(known, F.col("mask_basic")).alias("basic"), F.when(known, F.col("mask_far")).alias("far"), F.col("mask_outlier").alias("outlier"), "trained")


@query("j8_attrition_cascade", f"WITH {CASCADE} SELECT * FROM wide")
def j8_attrition_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir)


@query("a17_attrition_funnel", f"""WITH {CASCADE}, n AS (SELECT count(*) AS n_raw FROM wide), g AS (SELECT 0 AS gate_order, 'raw' AS gate, count(*) AS n_known, count(*) AS n_pass FROM wide
UNION ALL SELECT 1, 'basic', count(basic), count(*) FILTER (basic) FROM wide UNION ALL SELECT 2, 'far', count(far), count(*) FILTER (far) FROM wide UNION ALL SELECT 3, 'outlier', count(outlier), count(*) FILTER (outlier) FROM wide UNION ALL SELECT 4, 'trained', count(*), count(*) FILTER (trained) FROM wide)
SELECT n_raw, gate_order, gate, n_known, n_pass, round(100 * (n_pass / n_raw), 6) AS pct_of_raw, round(100 * (n_pass / n_known), 6) AS pct_of_known FROM g CROSS JOIN n""")
def a17_attrition_funnel(spark, sf_dir):
    return rounded(quality.funnel(_cascade(spark, sf_dir), {"raw": F.lit(True), "basic": "basic", "far": "far", "outlier": "outlier", "trained": "trained"}))


@query("a19_condition_censoring_rate", f"WITH {V_POINTS}, t AS (SELECT cond, traj, max(value) >= 160 AS hit FROM v_points GROUP BY 1, 2) SELECT cond, count(*) AS n, count(*) FILTER (hit) AS n_hit, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM t GROUP BY cond")
def a19_condition_censoring_rate(spark, sf_dir):
    tops = v_points(spark, sf_dir).groupBy(*KEYS).agg((F.max("value") >= 160).alias("hit"))
    return rounded(quality.survival(tops, [["cond"]], ["cond"], ["hit"]).select("cond", "n", "n_hit", F.col("hit_rate").alias("rate")))


@query("a20_hold_gap", f"WITH {V_SERIES}, g AS (SELECT cond, traj, arg_max(value, pos) - max(value) AS gap FROM v_series GROUP BY 1, 2) SELECT coalesce(cond, 'all') AS cond, count(*) AS n, round(avg(gap), 5) AS mean_gap, round(median(gap), 5) AS median_gap, round(quantile_cont(gap, 0.1), 5) AS p10_gap FROM g GROUP BY ROLLUP (cond)")
def a20_hold_gap(spark, sf_dir):
    gaps = v_series(spark, sf_dir).groupBy(*KEYS).agg((F.max_by("value", "pos") - F.max("value")).alias("gap"))
    return rounded(gaps.rollup("cond").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.percentile("gap", F.lit(0.1)).alias("p10_gap")).fillna("all", ["cond"]), 5)


@query("a21_selection_profile", f"""WITH {MASKS}, sp AS (SELECT unnest(['all', CASE WHEN clean THEN 'clean' ELSE 'flagged' END]) AS split, unnest(['price', 'price']) AS m1, price, bal FROM fits), u AS (SELECT split, 'price' AS metric, price AS v FROM sp UNION ALL SELECT split, 'bal', bal FROM sp)
SELECT split, metric, count(v) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.9), 4) AS p90 FROM u GROUP BY 1, 2""")
def a21_selection_profile(spark, sf_dir):
    rows = _fits(spark, sf_dir).select(F.explode(F.array(F.lit("all"), F.when(F.col("clean"), "clean").otherwise("flagged"))).alias("split"), "price", "bal")
    rows = rows.unpivot("split", ["price", "bal"], "metric", "v")
    return rounded(rows.groupBy("split", "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.percentile("v", F.lit(0.1)).alias("p10"), F.percentile("v", F.lit(0.9)).alias("p90")), 4)


@query("a22_category_share", f"WITH {V_FITS} SELECT grp, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 6) AS share FROM v_fits GROUP BY 1, 2")
def a22_category_share(spark, sf_dir):
    n = v_fits(spark, sf_dir).groupBy("grp", "status").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("grp"))))


@query("a24_time_bin_profile", f"WITH {V_POINTS} SELECT bin, round(avg(value), 5) AS mean, round(median(value), 5) AS median, round(stddev_samp(value), 5) AS std, round(quantile_cont(value, 0.1), 5) AS p10, round(quantile_cont(value, 0.9), 5) AS p90 FROM v_points GROUP BY 1")
def a24_time_bin_profile(spark, sf_dir):
    return rounded(v_points(spark, sf_dir).groupBy("bin").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"), F.percentile("value", F.lit(0.1)).alias("p10"), F.percentile("value", F.lit(0.9)).alias("p90")), 5)


@query("a25_error_pivot", f"WITH {V_FITS} SELECT grp, round(median(price) FILTER (status = 'F'), 4) AS F, round(median(price) FILTER (status = 'O'), 4) AS O, round(median(price) FILTER (status = 'P'), 4) AS P FROM v_fits GROUP BY grp")
def a25_error_pivot(spark, sf_dir):
    return rounded(v_fits(spark, sf_dir).groupBy("grp").pivot("status", ["F", "O", "P"]).agg(F.median("price")), 4)


@query("a26_robust_residual", f"WITH {V_POINTS}, m AS (SELECT *, median(value) OVER (PARTITION BY bin) AS med FROM v_points) SELECT bin, count(*) AS n, round(any_value(med), 5) AS median, round(median(abs(value - med)), 5) AS mad, round(1.4826 * median(abs(value - med)), 5) AS sigma FROM m GROUP BY bin HAVING count(*) >= 20")
def a26_robust_residual(spark, sf_dir):
    points = v_points(spark, sf_dir)
    spread = select.median_spread(points, ["bin"], "value").withColumnRenamed("med", "median")
    rows = select.joined(points.groupBy("bin").agg(F.count("*").alias("n")), spread, ["bin"])
    return rounded(rows.filter("n >= 20").withColumn("sigma", 1.4826 * F.col("mad")), 5)


@query("a27_status_histogram", f"WITH {V_FITS} SELECT CASE WHEN price < 100000 THEN 'small' WHEN price < 300000 THEN 'middle' ELSE 'large' END AS class, status, count(*) AS n FROM v_fits GROUP BY 1, 2")
def a27_status_histogram(spark, sf_dir):
    size = F.when(F.col("price") < 100000, "small").when(F.col("price") < 300000, "middle").otherwise("large")
    return v_fits(spark, sf_dir).groupBy(size.alias("class"), "status").agg(F.count("*").alias("n"))


@query("a28_headline_stats", f"WITH {MASKS} SELECT nation, count(*) AS n, count(*) FILTER (NOT mask_basic) AS n_basic, count(*) FILTER (NOT mask_far) AS n_far, count(*) FILTER (NOT mask_outlier) AS n_outlier FROM fits GROUP BY nation HAVING count(*) >= 50")
def a28_headline_stats(spark, sf_dir):
    return _fits(spark, sf_dir).groupBy("nation").agg(F.count("*").alias("n"), *[F.count_if(~F.col(f"mask_{m}")).alias(f"n_{m}") for m in ("basic", "far", "outlier")]).filter("n >= 50")


CAPS = [100.0, 120.0, 140.0, 160.0, 180.0]


@query("a30_threshold_sweep", f"WITH {V_POINTS}, t AS (SELECT cond, traj, max(value) AS top FROM v_points GROUP BY 1, 2), c AS (SELECT unnest({CAPS})::DOUBLE AS cap) SELECT count(*) AS n, cap, count(*) FILTER (top >= cap) AS n_over, round(count(*) FILTER (top >= cap) / count(*), 6) AS rate FROM t CROSS JOIN c GROUP BY cap")
def a30_threshold_sweep(spark, sf_dir):
    return rounded(quality.endpoint_thresholds(v_points(spark, sf_dir), KEYS, "value", CAPS))


@query("a31_pointwise_cutoff", f"WITH {V_POINTS}, r AS (SELECT * FROM (VALUES ('value', 120.0), ('value', 150.0), ('time', 20.0)) AS t(rule, cut)) SELECT cond, rule, cut::DOUBLE AS cut, count(*) FILTER (CASE rule WHEN 'value' THEN value ELSE time END < cut) AS n_kept, round(avg(value) FILTER (CASE rule WHEN 'value' THEN value ELSE time END < cut), 5) AS mean_kept FROM v_points CROSS JOIN r GROUP BY 1, 2, 3")
def a31_pointwise_cutoff(spark, sf_dir):
    rules = [("value", 120.0), ("value", 150.0), ("time", 20.0)]
    cells = [F.struct(F.lit(c).alias("rule"), F.lit(x).alias("cut"), F.count_if(F.col(c) < x).alias("n_kept"), F.round(F.avg(F.when(F.col(c) < x, F.col("value"))), 5).alias("mean_kept")) for c, x in rules]
    return v_points(spark, sf_dir).groupBy("cond").agg(F.array(*cells).alias("c")).select("cond", F.inline("c"))


@query("a8_raw_inventory", f"WITH {V_SERIES} SELECT cond, traj, count(*) AS n, count(*) FILTER (value > 50) AS n_over, min(pos) FILTER (value > 50) AS first_over, max(pos) FILTER (value > 50) AS last_over, round(max(value), 6) AS top FROM v_series GROUP BY 1, 2")
def a8_raw_inventory(spark, sf_dir):
    over = F.col("value") > 50
    return rounded(v_series(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(over).alias("n_over"), F.min(F.when(over, F.col("pos"))).alias("first_over"), F.max(F.when(over, F.col("pos"))).alias("last_over"), F.max("value").alias("top")))


@query("a9_group_caps", f"WITH {V_POINTS}, q AS (SELECT cond, quantile_cont(value, [0.9, 0.95, 0.99, 0.995]) AS q FROM v_points GROUP BY 1) SELECT cond, round(q[1], 5) AS q90, round(q[2], 5) AS q95, round(q[3], 5) AS q99, round(q[4], 5) AS cap, round(0.02 * q[4], 5) AS tol FROM q")
def a9_group_caps(spark, sf_dir):
    q = select.quantiles(v_points(spark, sf_dir), ["cond"], {"q": "value"}, {"q": (0.9, 0.95, 0.99, 0.995)})
    return rounded(q.select("cond", *[F.col("q")[k].alias(n) for k, n in enumerate(("q90", "q95", "q99", "cap"))], (0.02 * F.col("q")[3]).alias("tol")), 5)


@query("j4_attach_caps", f"WITH {V_POINTS}, c AS (SELECT cond, quantile_cont(value, 0.95) AS cap FROM v_points GROUP BY 1) SELECT cond, count(*) AS n, count(*) FILTER (value >= cap) AS n_at_cap, round(any_value(cap), 5) AS cap FROM v_points JOIN c USING (cond) GROUP BY cond")
def j4_attach_caps(spark, sf_dir):
    points = v_points(spark, sf_dir)
    caps = select.quantiles(points, ["cond"], {"q": "value"}, {"q": (0.95,)}).select("cond", F.col("q")[0].alias("cap"))
    return rounded(points.join(caps, "cond", "left").groupBy("cond").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= F.col("cap")).alias("n_at_cap"), F.first("cap").alias("cap")), 5)


LABELS = V_SERIES + """, raw AS (SELECT cond, traj, count(*) AS n, max(value) AS top, arg_max(value, pos) AS last FROM v_series GROUP BY 1, 2), cl AS (SELECT cond, traj, count(*) AS n_clean FROM v_series WHERE value > 40 GROUP BY 1, 2),
cp AS (SELECT cond, quantile_cont(value, 0.98) AS cap FROM v_series GROUP BY 1), lab AS (SELECT raw.*, n_clean, cap, top >= cap AS censored, cap - top AS gap FROM raw JOIN cl USING (cond, traj) JOIN cp USING (cond))"""


def _labels(spark, sf_dir):
    s = v_series(spark, sf_dir)
    raw = s.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("value").alias("top"), F.max_by("value", "pos").alias("last"))
    clean = s.filter("value > 40").groupBy(*KEYS).agg(F.count("*").alias("n_clean"))
    caps = select.quantiles(s, ["cond"], {"q": "value"}, {"q": (0.98,)}).select("cond", F.col("q")[0].alias("cap"))
    return raw.join(clean, KEYS).join(caps, "cond").withColumns({"censored": F.col("top") >= F.col("cap"), "gap": F.col("cap") - F.col("top")})


@query("j5_three_way_comparison", f"WITH {LABELS} SELECT cond, traj, n, n_clean, censored, round(gap, 5) AS gap FROM lab")
def j5_three_way_comparison(spark, sf_dir):
    return _labels(spark, sf_dir).select(*KEYS, "n", "n_clean", "censored", F.round("gap", 5).alias("gap"))


@query("a11_censoring_summary", f"WITH {LABELS} SELECT cond, count(*) AS n, count(*) FILTER (censored) AS n_censored, round(median(gap), 5) AS median_gap, round(avg(n_clean / n), 6) AS mean_kept FROM lab GROUP BY cond")
def a11_censoring_summary(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy("cond").agg(F.count("*").alias("n"), F.count_if("censored").alias("n_censored"), F.round(F.median("gap"), 5).alias("median_gap"), F.round(F.avg(F.col("n_clean") / F.col("n")), 6).alias("mean_kept"))


@query("j7_attach_audit_labels", f"WITH {LABELS} SELECT CASE WHEN p.cond = 'view' THEN 'seen' ELSE p.cond END AS alias, coalesce(censored, FALSE) AS censored, p.value >= 0.9 * cap AS near_cap, count(*) AS n FROM v_series p LEFT JOIN lab USING (cond, traj) GROUP BY 1, 2, 3")
def j7_attach_audit_labels(spark, sf_dir):
    rows = v_series(spark, sf_dir).join(_labels(spark, sf_dir).select(*KEYS, "censored", "cap"), KEYS, "left")
    alias = F.when(F.col("cond") == "view", "seen").otherwise(F.col("cond"))
    return rows.groupBy(alias.alias("alias"), F.coalesce("censored", F.lit(False)).alias("censored"), (F.col("value") >= 0.9 * F.col("cap")).alias("near_cap")).agg(F.count("*").alias("n"))


@query("j1_surviving_points", f"WITH {V_POINTS}, ok AS (SELECT cond, traj FROM v_points GROUP BY 1, 2 HAVING max(value) >= 120) SELECT cond, count(*) AS n FROM v_points p WHERE EXISTS (SELECT 1 FROM ok WHERE ok.cond = p.cond AND ok.traj = p.traj) GROUP BY cond")
def j1_surviving_points(spark, sf_dir):
    points = v_points(spark, sf_dir)
    return points.join(points.groupBy(*KEYS).agg(F.max("value").alias("top")).filter("top >= 120"), KEYS, "left_semi").groupBy("cond").agg(F.count("*").alias("n"))


@query("a36_empirical_support", "SELECT 'p_retailprice' AS feature, count(p_retailprice) AS n, round(avg(p_retailprice), 5) AS mean, round(stddev_pop(p_retailprice), 5) AS std, min(p_retailprice)::DOUBLE AS min, max(p_retailprice)::DOUBLE AS max FROM part UNION ALL SELECT 'p_size', count(p_size), round(avg(p_size), 5), round(stddev_pop(p_size), 5), min(p_size)::DOUBLE, max(p_size)::DOUBLE FROM part")
def a36_empirical_support(spark, sf_dir):
    return rounded(support.column_support(load(spark, sf_dir, "part"), ["p_retailprice", "p_size"]), 5)


TRAIN = "tr AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)), st AS (SELECT avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1, min(p_retailprice) AS a1, max(p_retailprice) AS b1, avg(p_size) AS m2, stddev_pop(p_size) AS s2, min(p_size) AS a2, max(p_size) AS b2 FROM tr)"


@query("a37_support_check", f"""WITH {TRAIN}, z AS (SELECT p.*, (p_retailprice - m1) / s1 AS z1, (p_size - m2) / s2 AS z2, p_retailprice < a1 - 1e-9 OR p_retailprice > b1 + 1e-9 AS o1, p_size < a2 - 1e-9 OR p_size > b2 + 1e-9 AS o2 FROM part p CROSS JOIN st),
v1 AS (SELECT *, CASE WHEN o1 OR abs(z1) >= 1.7 THEN 'strong' WHEN abs(z1) >= 1.5 THEN 'warn' ELSE 'ok' END AS sev1 FROM z), v2 AS (SELECT *, CASE WHEN o2 OR abs(z2) >= 1.7 THEN 'strong' WHEN sev1 = 'ok' AND abs(z2) >= 1.5 THEN 'warn' ELSE sev1 END AS sev2 FROM v1),
v3 AS (SELECT *, p_brand IN (SELECT p_brand FROM tr) AS seen, EXISTS (SELECT 1 FROM tr WHERE tr.p_type = v2.p_type AND tr.p_size = v2.p_size) AS combo_seen FROM v2)
SELECT p_partkey, round(z1, 5) AS z_p_retailprice, round(z2, 5) AS z_p_size, seen AS seen_p_brand, combo_seen, CASE WHEN seen AND combo_seen THEN sev2 ELSE 'strong' END AS severity FROM v3""")
def a37_support_check(spark, sf_dir):
    """Of all parts against those that have been ordered."""
    part = load(spark, sf_dir, "part")
    ordered = part.join(load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    out = support.support_check(part, ordered, ["p_retailprice", "p_size"], ["p_brand"], ["p_type", "p_size"], z_warn=1.5, z_strong=1.7)
    return rounded(out.select("p_partkey", "z_p_retailprice", "z_p_size", "seen_p_brand", "combo_seen", "severity"), 5)


@query("a38_contingency", "SELECT p_type, count(*) FILTER (p_size <= 16) AS small, count(*) FILTER (p_size BETWEEN 17 AND 33) AS middle, count(*) FILTER (p_size > 33) AS large FROM part GROUP BY p_type")
def a38_contingency(spark, sf_dir):
    size = F.when(F.col("p_size") <= 16, "small").when(F.col("p_size") <= 33, "middle").otherwise("large")
    return load(spark, sf_dir, "part").withColumn("s", size).groupBy("p_type").pivot("s", ["small", "middle", "large"]).count().fillna(0)


@query("j11_nearest_combinations", """WITH cb AS (SELECT DISTINCT s_nationkey::DOUBLE AS a, floor(s_acctbal / 1000)::DOUBLE AS b FROM supplier), sd AS (SELECT CASE WHEN stddev_pop(a) > 1e-12 THEN stddev_pop(a) ELSE 1 END AS sa, CASE WHEN stddev_pop(b) > 1e-12 THEN stddev_pop(b) ELSE 1 END AS sb FROM cb),
d AS (SELECT c_custkey, cb.a, cb.b, sqrt(pow((c_nationkey - cb.a) / sa, 2) + pow((floor(c_acctbal / 1000) - cb.b) / sb, 2)) AS distance FROM customer CROSS JOIN cb CROSS JOIN sd),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, a, b) AS rank FROM d) SELECT c_custkey, rank::INT AS rank, a AS near_a, b AS near_b, round(distance, 6) AS distance FROM r WHERE rank <= 3""")
def j11_nearest_combinations(spark, sf_dir):
    combos = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("double").alias("a"), F.floor(F.col("s_acctbal") / 1000).cast("double").alias("b")).distinct()
    samples = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("a"), F.floor(F.col("c_acctbal") / 1000).cast("double").alias("b"))
    return rounded(support.nearest_combos(samples, combos, "c_custkey", ["a", "b"], 3))


@query("j12_tolerance_match", "SELECT s_suppkey, count(*) AS n, min(c_custkey) AS first_cust FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 1.5 GROUP BY s_suppkey")
def j12_tolerance_match(spark, sf_dir):
    s, c = load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return support.tolerance_match(s, c, "s_acctbal", "c_acctbal", 1.5).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_cust"))


@query("t1_representative_row", f"WITH {V_FITS}, d AS (SELECT *, abs(price - median(price) OVER (PARTITION BY grp, status)) AS d FROM v_fits), r AS (SELECT *, row_number() OVER (PARTITION BY grp, status ORDER BY d, o_orderkey) AS k FROM d) SELECT grp, status, o_orderkey, price FROM r WHERE k = 1")
def t1_representative_row(spark, sf_dir):
    return support.representative(v_fits(spark, sf_dir), ["grp", "status"], "price", "o_orderkey").select("grp", "status", "o_orderkey", "price")


@query("t2_robust_rows", f"WITH {Z}, s AS (SELECT *, CASE WHEN 1.4826 * mad = 0 THEN 1.0 ELSE 1.4826 * mad END AS sg FROM z) SELECT cond, count(*) FILTER (abs(value - med) / sg <= 2.0) AS n_kept, count(*) AS n FROM s GROUP BY cond")
def t2_robust_rows(spark, sf_dir):
    points = v_points(spark, sf_dir)
    df = select.joined(points, select.median_spread(points, ["cond"], "value"), ["cond"]).withColumn("sg", 1.4826 * F.col("mad"))
    z = F.abs(F.col("value") - F.col("med")) / F.when(F.col("sg") == 0, 1.0).otherwise(F.col("sg"))
    return df.groupBy("cond").agg(F.count_if(z <= 2.0).alias("n_kept"), F.count("*").alias("n"))


@query("t4_extreme_cases", f"WITH {V_FITS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY price DESC, o_orderkey) AS hi, row_number() OVER (PARTITION BY grp ORDER BY price, o_orderkey) AS lo FROM v_fits) SELECT grp, CASE WHEN hi <= 2 THEN 'largest' ELSE 'smallest' END AS case_, o_orderkey FROM r WHERE hi <= 2 OR lo <= 2")
def t4_extreme_cases(spark, sf_dir):
    hi = F.row_number().over(W.partitionBy("grp").orderBy(F.col("price").desc(), "o_orderkey"))
    lo = F.row_number().over(W.partitionBy("grp").orderBy("price", "o_orderkey"))
    rows = v_fits(spark, sf_dir).withColumns({"hi": hi, "lo": lo}).filter("hi <= 2 or lo <= 2")
    return rows.select("grp", F.when(F.col("hi") <= 2, "largest").otherwise("smallest").alias("case_"), "o_orderkey")


@query("t5_top_n", f"WITH {V_FITS} SELECT o_orderkey, price FROM v_fits ORDER BY price DESC, o_orderkey LIMIT 20")
def t5_top_n(spark, sf_dir):
    return v_fits(spark, sf_dir).select("o_orderkey", "price").orderBy(F.col("price").desc(), "o_orderkey").limit(20)


@query("t6_best_run", f"WITH {V_FITS}, e AS (SELECT grp, status, avg(price) AS m FROM v_fits GROUP BY 1, 2) SELECT grp, arg_min(status, m) AS best, round(avg(m), 4) AS mean, round(coalesce(stddev_samp(m), 0), 4) AS std FROM e GROUP BY grp")
def t6_best_run(spark, sf_dir):
    each = v_fits(spark, sf_dir).groupBy("grp", "status").agg(F.avg("price").alias("m"))
    return rounded(each.groupBy("grp").agg(F.min_by("status", "m").alias("best"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std")), 4)


@query("t7_condition_list", f"WITH {V_POINTS} SELECT cond, bin, count(*) AS n FROM v_points GROUP BY 1, 2 HAVING count(*) >= 60 ORDER BY n DESC, cond, bin LIMIT 40")
def t7_condition_list(spark, sf_dir):
    return v_points(spark, sf_dir).groupBy("cond", "bin").agg(F.count("*").alias("n")).filter("n >= 60").orderBy(F.col("n").desc(), "cond", "bin").limit(40)


@query("t12_holdout_candidates", f"WITH {V_FITS} SELECT nation, count(DISTINCT o_custkey) AS n_groups FROM v_fits GROUP BY nation HAVING count(DISTINCT o_custkey) >= 30")
def t12_holdout_candidates(spark, sf_dir):
    return v_fits(spark, sf_dir).groupBy("nation").agg(F.countDistinct("o_custkey").alias("n_groups")).filter("n_groups >= 30")


@query("t14_best_result", f"WITH {V_FITS}, e AS (SELECT grp, stddev_pop(price) AS s FROM v_fits GROUP BY 1) SELECT arg_min(grp, s) AS best, round(min(s), 4) AS metric FROM e")
def t14_best_result(spark, sf_dir):
    each = v_fits(spark, sf_dir).groupBy("grp").agg(F.stddev_pop("price").alias("s"))
    return each.agg(F.min_by("grp", "s").alias("best"), F.round(F.min("s"), 4).alias("metric"))


def _split_sql(source: str, group: str, seed: str, val: float, test: float) -> str:
    """A statement for the split of ``source`` by whole groups."""
    return f"""SELECT s.*, CASE WHEN r <= floor(n * {test}) THEN 'test' WHEN r <= floor(n * {test}) + floor(n * {val}) THEN 'val' ELSE 'train' END AS split
FROM {source} s JOIN (SELECT g, row_number() OVER (ORDER BY md5('{seed}:' || g), g) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {group} AS g FROM {source})) x ON x.g = s.{group}"""


@query("t8_seeded_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('sample:' || o_orderkey), o_orderkey LIMIT 200")
def t8_seeded_sample(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy(support.seeded_rank("sample", "o_orderkey"), "o_orderkey").limit(200)


def _split(spark, sf_dir):
    return support.split_by_group(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "split", 0.15, 0.15)


ORDERS = "o AS (SELECT o_orderkey, o_custkey FROM orders)"


@query("t9_group_split", f"WITH {ORDERS} {_split_sql('o', 'o_custkey', 'split', 0.15, 0.15)}")
def t9_group_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query("t10_leave_one_out", f"WITH {V_FITS}, rest AS (SELECT o_orderkey, o_custkey FROM v_fits WHERE grp <> 'BUILDING') SELECT o_orderkey, split FROM ({_split_sql('rest', 'o_custkey', 'loo', 0.2, 0.0)}) UNION ALL SELECT o_orderkey, 'test' FROM v_fits WHERE grp = 'BUILDING'")
def t10_leave_one_out(spark, sf_dir):
    fits = v_fits(spark, sf_dir).select("o_orderkey", "o_custkey", "grp")
    rest = support.split_by_group(fits.filter("grp <> 'BUILDING'"), "o_custkey", "loo", 0.2, 0.0)
    return rest.select("o_orderkey", "split").union(fits.filter("grp = 'BUILDING'").select("o_orderkey", F.lit("test")))


@query("t11_row_split", f"WITH o AS (SELECT o_orderkey FROM orders) {_split_sql('o', 'o_orderkey', 'rows', 0.1, 0.1)}")
def t11_row_split(spark, sf_dir):
    return support.split_by_group(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "rows", 0.1, 0.1)


@query("t13_rows_per_split", f"WITH {ORDERS}, sp AS ({_split_sql('o', 'o_custkey', 'split', 0.15, 0.15)}) SELECT o_orderkey, o_custkey, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('few:' || o_orderkey), o_orderkey) AS k FROM sp) WHERE k <= 100")
def t13_rows_per_split(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("split").orderBy(support.seeded_rank("few", "o_orderkey"), "o_orderkey"))
    return _split(spark, sf_dir).withColumn("k", rank).filter("k <= 100").drop("k")


@query("a44_split_counts", "SELECT o_orderstatus AS split, count(*) AS n FROM orders GROUP BY 1")
def a44_split_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("n"))


@query("a43_delay_distribution", f"WITH {V_SERIES}, d AS (SELECT cond, traj, min(pos) FILTER (value > 100)::DOUBLE AS d FROM v_series GROUP BY 1, 2) SELECT cond, count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, quantile_cont(d, 0.25) AS q25, quantile_cont(d, 0.75) AS q75 FROM d GROUP BY cond")
def a43_delay_distribution(spark, sf_dir):
    d = v_series(spark, sf_dir).groupBy(*KEYS).agg(F.min(F.when(F.col("value") > 100, F.col("pos"))).cast("double").alias("d"))
    return rounded(d.groupBy("cond").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.percentile("d", F.lit(0.25)).alias("q25"), F.percentile("d", F.lit(0.75)).alias("q75")))


@query("u1_union_all", "SELECT 'cust' AS kind, count(*) AS n, count(name) AS n_name, count(region) AS n_region FROM (SELECT c_custkey AS id, c_name AS name, NULL AS region FROM customer UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation)")
def u1_union_all(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))
    return a.unionByName(b, allowMissingColumns=True).agg(F.lit("cust").alias("kind"), F.count("*").alias("n"), F.count("name").alias("n_name"), F.count("region").alias("n_region"))


@query("u2_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u2_union_distinct(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(load(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("u3_distinct_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def u3_distinct_first(spark, sf_dir):
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return load(spark, sf_dir, "orders").withColumn("k", k).filter("k = 1").select("o_custkey", "o_orderkey")


@query("u4_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u4_intersect(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("u5_fixed_cohort", f"WITH {V_POINTS} SELECT cond, count(*) AS n FROM v_points WHERE (cond, traj) IN (SELECT cond, traj FROM v_points WHERE bin = 10) GROUP BY cond")
def u5_fixed_cohort(spark, sf_dir):
    points = v_points(spark, sf_dir)
    return points.join(points.filter("bin = 10").select(*KEYS).distinct(), KEYS, "left_semi").groupBy("cond").agg(F.count("*").alias("n"))


@query("u6_except", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def u6_except(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey").join(load(spark, sf_dir, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").distinct()


@query("j20_class_imputation", f"WITH {V_FITS}, b AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE bal END AS x FROM v_fits), g AS (SELECT grp, median(x) AS m FROM b GROUP BY 1) SELECT grp, count(*) AS n, round(avg(coalesce(x, m)), 5) AS mean FROM b JOIN g USING (grp) GROUP BY grp")
def j20_class_imputation(spark, sf_dir):
    fits = v_fits(spark, sf_dir).withColumn("x", F.when(F.col("o_orderkey") % 7 != 0, F.col("bal")))
    med = select.medians(fits, ["grp"], {"m": "x"})
    whole = select.stored(select.medians(fits, [], {"m": "x"}), "median").scalar()
    return rounded(select.joined(fits, med, ["grp"]).withColumn("v", F.coalesce("x", "m", whole)).groupBy("grp").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), 5)


@query("p21_fill_metadata", f"WITH {V_SERIES}, b AS (SELECT *, CASE WHEN value > 90 THEN value END AS x FROM v_series), f AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER a, first_value(x IGNORE NULLS) OVER b) AS y FROM b WINDOW a AS (PARTITION BY cond, traj ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY cond, traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT cond, count(y) AS n_known, round(avg(y), 5) AS mean FROM f GROUP BY cond")
def p21_fill_metadata(spark, sf_dir):
    w = W.partitionBy(*KEYS).orderBy("pos")
    x = F.when(F.col("value") > 90, F.col("value"))
    df = v_series(spark, sf_dir).withColumn("x", x)
    df = df.withColumn("y", F.coalesce(F.last("x", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("x", True).over(w.rowsBetween(0, W.unboundedFollowing))))
    return rounded(df.groupBy("cond").agg(F.count("y").alias("n_known"), F.avg("y").alias("mean")), 5)


@query("p7_boolean_coercion", "SELECT status, CASE WHEN lower(trim(flag)) IN ('true', '1', '1.0', 'yes', 'y', 't') THEN TRUE WHEN lower(trim(flag)) IN ('false', '0', '0.0', 'no', 'n', 'f') THEN FALSE END AS b, count(*) AS n FROM (SELECT l_linestatus AS status, CASE l_returnflag WHEN 'A' THEN ' True ' WHEN 'N' THEN 'NO' ELSE l_returnflag END AS flag FROM lineitem) GROUP BY 1, 2")
def p7_boolean_coercion(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "A", " True ").when(F.col("l_returnflag") == "N", "NO").otherwise(F.col("l_returnflag"))
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("status"), as_boolean(flag).alias("b")).agg(F.count("*").alias("n"))


@query("p15_zscore_scaler", f"WITH {V_FITS}, p AS (SELECT grp, avg(price) AS m, CASE WHEN stddev_pop(price) < 1e-8 THEN 1.0 ELSE stddev_pop(price) END AS s FROM v_fits WHERE status = 'F' GROUP BY 1) SELECT o_orderkey, round((price - m) / s, 5) AS z FROM v_fits JOIN p USING (grp)")
def p15_zscore_scaler(spark, sf_dir):
    fits = v_fits(spark, sf_dir)
    params = robust.zscore_params(fits.filter("status = 'F'"), ["grp"], "price")
    return fits.join(params, "grp").select("o_orderkey", F.round((F.col("price") - F.col("mean")) / F.col("scale"), 5).alias("z"))


@query("p17_window_filter", f"WITH {V_POINTS}, r AS (SELECT *, dense_rank() OVER (ORDER BY cond) AS k FROM (SELECT DISTINCT cond FROM v_points)) SELECT p.cond, count(*) AS n FROM v_points p JOIN r USING (cond) WHERE time BETWEEN 2 AND 20 AND k <= 3 GROUP BY p.cond")
def p17_window_filter(spark, sf_dir):
    points = v_points(spark, sf_dir)
    first = points.select("cond").distinct().orderBy("cond").limit(3)
    return points.filter(F.col("time").between(2, 20)).join(first, "cond", "left_semi").groupBy("cond").agg(F.count("*").alias("n"))


@query("j19_holdout_oracle", f"WITH {CENSOR} SELECT cond, round(sqrt(avg(pow(value - 100, 2))), 5) AS rmse, count(*) AS n FROM v_points JOIN (SELECT DISTINCT cond FROM cs WHERE reason <> 'none') USING (cond) GROUP BY cond")
def j19_holdout_oracle(spark, sf_dir):
    keep = _censor_bins(spark, sf_dir).filter("reason <> 'none'").select("cond").distinct()
    return rounded(v_points(spark, sf_dir).join(keep, "cond").groupBy("cond").agg(F.sqrt(F.avg(F.pow(F.col("value") - 100, F.lit(2.0)))).alias("rmse"), F.count("*").alias("n")), 5)


@query("a39_detector_success", "SELECT label, count(*) AS n, count(*) FILTER (ok) AS n_ok, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM (SELECT label, len(list_filter(embedding, lambda x: x > 0.3)) = 0 AS ok FROM embeddings) GROUP BY label")
def a39_detector_success(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("label", F.forall("embedding", lambda x: ~(x > F.lit(0.3).cast("double"))).alias("ok"))
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), ratio(F.count_if("ok"), F.count("*")).alias("rate")))
