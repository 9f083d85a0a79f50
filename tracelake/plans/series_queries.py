"""Queries over trajectories: bins, censoring, runs, alignment, robust statistics. Each with the same answer as SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import stable_key
from tracelake.operators import align, bins, robust, runs
from tracelake.plans.registry import Registry, rounded
from tracelake.plans.views import KEYS, N_BINS, V_FRAMES, V_POINTS, V_SERIES, v_frames, v_points, v_series

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

RULE = bins.CensorRule(n_bins=N_BINS, cap=160.0, cap_fraction=1.0, ratio=0.9)

STATS = V_POINTS + """,
stats AS (SELECT cond, bin, count(value) AS n_points, count(DISTINCT traj) AS n_traces, min(value) AS v_min, avg(value) AS v_mean, max(value) AS v_max,
  quantile_cont(value, 0.5) AS v_p50, quantile_cont(value, 0.9) AS v_p90, quantile_cont(value, 0.95) AS v_p95, quantile_cont(value, 0.99) AS v_p99 FROM v_points GROUP BY ALL)"""
SMOOTHED = STATS + f""",
grid AS (SELECT cond, unnest(range({N_BINS}))::INT AS bin FROM (SELECT DISTINCT cond FROM v_points)),
full_bins AS (SELECT g.cond, g.bin, coalesce(n_traces, 0) AS n_traces, n_points, v_p95 FROM grid g LEFT JOIN stats USING (cond, bin)),
sm AS (SELECT *, avg(n_traces) OVER (PARTITION BY cond ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM full_bins),
pk AS (SELECT *, smooth / greatest(max(smooth) OVER (PARTITION BY cond), 1.0) AS ratio,
  first_value(bin) OVER (PARTITION BY cond ORDER BY smooth DESC, bin) AS b_peak FROM sm)"""
CENSOR = SMOOTHED + f""",
trig AS (SELECT *, (ratio < 0.9 OR n_traces < 4) AS density_drop, (coalesce(v_p95 >= 160.0, FALSE) AND n_traces >= 4) AS saturated FROM pk),
run_ AS (SELECT *, CASE WHEN density_drop AND lead(density_drop) OVER (PARTITION BY cond ORDER BY bin) AND bin >= b_peak THEN bin END AS d,
  CASE WHEN saturated AND bin >= b_peak THEN bin END AS s FROM trig),
st AS (SELECT cond, coalesce(sum(n_points), 0)::BIGINT AS n_points, any_value(b_peak) AS b_peak, coalesce(min(d), {N_BINS}) AS b_density, coalesce(min(s), {N_BINS}) AS b_cap FROM run_ GROUP BY cond),
cs AS (SELECT *, least(b_density, b_cap) AS b_start, CASE WHEN least(b_density, b_cap) >= {N_BINS} THEN 'none' WHEN b_density = b_cap THEN 'density_drop+fov_saturation'
  WHEN b_density < b_cap THEN 'density_drop' ELSE 'fov_saturation' END AS reason FROM st)"""


def _censor_bins(spark, sf_dir):
    return bins.censor_bins(bins.bin_stats(v_points(spark, sf_dir), ["cond"], "traj", "value"), ["cond"], RULE)


@query("w8_censor_start", f"WITH {CENSOR} SELECT cond, n_points, b_peak, b_density, b_cap, b_start, reason FROM cs")
def w8_censor_start(spark, sf_dir):
    return bins.censor_summary(_censor_bins(spark, sf_dir), ["cond"])


@query("w8_censor_bins", f"WITH {CENSOR} SELECT r.cond, bin, n_traces, round(smooth, 6) AS smooth, round(ratio, 6) AS ratio, density_drop, saturated, bin >= b_start AS censored FROM run_ r JOIN cs USING (cond)")
def w8_censor_bins(spark, sf_dir):
    return rounded(_censor_bins(spark, sf_dir).select("cond", "bin", "n_traces", "smooth", "ratio", "density_drop", "saturated", "censored"))


@query("j3_attach_bins", f"WITH {CENSOR} SELECT cond, bin >= b_start AS censored, count(*) AS n, round(avg(value), 6) AS mean_value FROM v_points JOIN cs USING (cond) GROUP BY 1, 2")
def j3_attach_bins(spark, sf_dir):
    out = bins.attach_bins(v_points(spark, sf_dir), _censor_bins(spark, sf_dir), ["cond"], ["censored"])
    return out.groupBy("cond", "censored").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("j6_truncate_series", f"WITH {CENSOR}, cut AS (SELECT cond, CASE WHEN b_start < {N_BINS} THEN b_start::DOUBLE END AS t FROM cs) SELECT cond, traj, count(*) FILTER (t IS NULL OR time < t - 1e-9) AS kept, count(*) FILTER (time >= t - 1e-9) AS removed FROM v_points JOIN cut USING (cond) GROUP BY 1, 2")
def j6_truncate_series(spark, sf_dir):
    cut = bins.censor_summary(_censor_bins(spark, sf_dir), ["cond"]).select("cond", F.when(F.col("b_start") < N_BINS, F.col("b_start").cast("double")).alias("t"))
    gone = F.coalesce(F.col("time") >= F.col("t") - 1e-9, F.lit(False))
    return v_points(spark, sf_dir).join(cut, "cond").groupBy(*KEYS).agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"))


@query("a6_bin_stats", f"WITH {STATS} SELECT cond, bin, n_points, n_traces, round(v_min, 6) AS v_min, round(v_mean, 6) AS v_mean, round(v_max, 6) AS v_max, round(v_p50, 6) AS v_p50, round(v_p90, 6) AS v_p90, round(v_p95, 6) AS v_p95, round(v_p99, 6) AS v_p99 FROM stats")
def a6_bin_stats(spark, sf_dir):
    return rounded(bins.bin_stats(v_points(spark, sf_dir), ["cond"], "traj", "value"))


@query("j18_dense_grid", f"WITH {STATS} SELECT cond, b.bin::INT AS bin, coalesce(n_points, 0) AS n_points FROM (SELECT DISTINCT cond FROM v_points) CROSS JOIN (SELECT unnest(range(40)) AS bin) b LEFT JOIN stats USING (cond, bin)")
def j18_dense_grid(spark, sf_dir):
    stats = bins.bin_stats(v_points(spark, sf_dir), ["cond"], "traj", "value").select("cond", "bin", "n_points")
    return bins.dense(stats, ["cond"], "bin", 40, ["n_points"])


@query("w6_rolling_mean", f"WITH {V_SERIES} SELECT cond, traj, pos, round(avg(value) OVER (PARTITION BY cond, traj ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS rolled FROM v_series")
def w6_rolling_mean(spark, sf_dir):
    w = W.partitionBy(*KEYS).orderBy("pos")
    return v_series(spark, sf_dir).select(*KEYS, "pos", F.round(bins.rolling_mean("value", w, 5), 6).alias("rolled"))


@query("w7_first_run", f"""WITH {V_SERIES}, f AS (SELECT *, value > 100 AS h FROM v_series),
r AS (SELECT *, CASE WHEN h AND lead(h) OVER w THEN pos END AS p FROM f WINDOW w AS (PARTITION BY cond, traj ORDER BY pos)) SELECT cond, traj, min(p) AS first_pos FROM r GROUP BY 1, 2""")
def w7_first_run(spark, sf_dir):
    w = W.partitionBy(*KEYS).orderBy("pos")
    rows = v_series(spark, sf_dir).withColumn("_p", bins.first_run(F.col("value") > 100, "pos", w, 2))
    return rows.groupBy(*KEYS).agg(F.min("_p").alias("first_pos"))


REGIMES = SMOOTHED + f""",
lo AS (SELECT *, (ratio < 0.9 AND bin >= b_peak) AS low FROM pk),
u AS (SELECT *, CASE WHEN low AND lead(low) OVER (PARTITION BY cond ORDER BY bin) THEN bin END AS u FROM lo),
u2 AS (SELECT *, coalesce(min(u) OVER (PARTITION BY cond), {N_BINS}) AS b_uncertain FROM u),
gone AS (SELECT *, ((ratio < 0.8 OR n_traces < 4) AND bin >= b_uncertain) AS g FROM u2),
t AS (SELECT *, CASE WHEN g AND lead(g) OVER (PARTITION BY cond ORDER BY bin) THEN bin END AS t FROM gone),
t2 AS (SELECT *, coalesce(min(t) OVER (PARTITION BY cond), {N_BINS}) AS b_teacher FROM t)"""


@query("w9_coverage_regimes", f"WITH {REGIMES} SELECT cond, bin, n_traces, round(ratio, 6) AS ratio, b_peak, b_uncertain, b_teacher, CASE WHEN bin < b_uncertain THEN 'raw_reliable' WHEN bin < b_teacher THEN 'raw_uncertain' ELSE 'teacher_only' END AS regime FROM t2")
def w9_coverage_regimes(spark, sf_dir):
    stats = bins.bin_stats(v_points(spark, sf_dir), ["cond"], "traj", "value").select("cond", "bin", "n_traces")
    return rounded(bins.coverage_regimes(stats, ["cond"], N_BINS, 0.9, 0.8, 4, 2).select("cond", "bin", "n_traces", "ratio", "b_peak", "b_uncertain", "b_teacher", "regime"))


@query("a7_p50_curve", f"WITH {V_POINTS} SELECT cond, bin, round(median(value), 6) AS p50, round(avg(time), 6) AS time_mean, count(value) AS n_points, count(DISTINCT traj) AS n_traces FROM v_points GROUP BY 1, 2 HAVING count(DISTINCT traj) >= 50")
def a7_p50_curve(spark, sf_dir):
    return rounded(bins.p50_curve(v_points(spark, sf_dir), ["cond"], "traj", "time", "value", 50))


@query("a18_coverage_table", f"WITH {SMOOTHED} SELECT cond, bin, n_traces, round(smooth, 6) AS smooth, round(ratio, 6) AS ratio FROM pk")
def a18_coverage_table(spark, sf_dir):
    return rounded(bins.coverage_table(v_points(spark, sf_dir), ["cond"], "traj", N_BINS).select("cond", "bin", "n_traces", "smooth", "ratio"))


@query("p24_time_bins", f"WITH {V_POINTS} SELECT bin, count(*) AS n, round(min(time), 6) AS t_min, round(max(time), 6) AS t_max FROM v_points GROUP BY 1")
def p24_time_bins(spark, sf_dir):
    return v_points(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min("time"), 6).alias("t_min"), F.round(F.max("time"), 6).alias("t_max"))


LATCH = V_SERIES + """,
ev AS (SELECT *, CASE WHEN value >= 120 THEN 1 WHEN value < 80 THEN 0 END AS e FROM v_series),
latch AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY cond, traj ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS latched FROM ev)"""
RUNS = LATCH + """,
ch AS (SELECT *, CASE WHEN latched <> lag(latched) OVER w THEN 1 ELSE 0 END AS c FROM latch WINDOW w AS (PARTITION BY cond, traj ORDER BY pos)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY cond, traj ORDER BY pos) AS r FROM ch),
ln AS (SELECT *, count(*) OVER (PARTITION BY cond, traj, r) AS len FROM rn)"""


def _latched(spark, sf_dir):
    return runs.hysteresis(v_series(spark, sf_dir), KEYS, "pos", "value", 80, 120)


@query("w17_hysteresis", f"WITH {LATCH} SELECT cond, traj, pos, latched FROM latch")
def w17_hysteresis(spark, sf_dir):
    return _latched(spark, sf_dir).select(*KEYS, "pos", "latched")


@query("w18_fill_short_false", f"WITH {RUNS} SELECT cond, traj, pos, latched OR len <= 2 AS filled FROM ln")
def w18_fill_short_false(spark, sf_dir):
    return runs.fill_short_false(_latched(spark, sf_dir), KEYS, "pos", "latched", 2, "filled").select(*KEYS, "pos", "filled")


@query("w19_remove_short_true", f"WITH {RUNS} SELECT cond, traj, pos, latched AND len >= 3 AS kept FROM ln")
def w19_remove_short_true(spark, sf_dir):
    return runs.remove_short_true(_latched(spark, sf_dir), KEYS, "pos", "latched", 3, "kept").select(*KEYS, "pos", "kept")


@query("w20_longest_true", f"""WITH {RUNS}, isle AS (SELECT cond, traj, r, min(pos) AS a, max(pos) AS b, count(*) AS n FROM ln WHERE latched GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY cond, traj ORDER BY n DESC, a) AS k FROM isle)
SELECT s.cond, s.traj, a AS start, b AS end, n AS length FROM (SELECT DISTINCT cond, traj FROM v_series) s LEFT JOIN best ON s.cond = best.cond AND s.traj = best.traj AND k = 1""")
def w20_longest_true(spark, sf_dir):
    return runs.longest_true(_latched(spark, sf_dir), KEYS, "pos", "latched")


@query("w21_high_interval", f"""WITH {V_SERIES}, b AS (SELECT *, quantile_cont(value, 0.3) OVER (PARTITION BY cond, traj) AS base FROM v_series),
s AS (SELECT *, greatest(1.4826 * median(CASE WHEN value <= base THEN abs(value - base) END) OVER (PARTITION BY cond, traj), 1e-12) AS sigma FROM b),
ev AS (SELECT *, CASE WHEN value >= base + 3.0 * sigma THEN 1 WHEN value < base + 1.0 * sigma THEN 0 END AS e FROM s),
la AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY cond, traj ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS f FROM ev),
r1 AS (SELECT *, sum(c) OVER (PARTITION BY cond, traj ORDER BY pos) AS r FROM (SELECT *, CASE WHEN f <> lag(f) OVER (PARTITION BY cond, traj ORDER BY pos) THEN 1 ELSE 0 END AS c FROM la)),
f1 AS (SELECT cond, traj, pos, f OR count(*) OVER (PARTITION BY cond, traj, r) <= 1 AS f FROM r1),
r2 AS (SELECT *, sum(c) OVER (PARTITION BY cond, traj ORDER BY pos) AS r FROM (SELECT *, CASE WHEN f <> lag(f) OVER (PARTITION BY cond, traj ORDER BY pos) THEN 1 ELSE 0 END AS c FROM f1)),
isle AS (SELECT cond, traj, min(pos) AS a, max(pos) AS b, count(*) AS n FROM r2 WHERE f GROUP BY cond, traj, r HAVING count(*) >= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY cond, traj ORDER BY n DESC, a) AS k FROM isle)
SELECT s.cond, s.traj, best.a AS start, best.b AS end, n AS length FROM (SELECT DISTINCT cond, traj FROM v_series) s LEFT JOIN best ON s.cond = best.cond AND s.traj = best.traj AND k = 1""")
def w21_high_interval(spark, sf_dir):
    return runs.high_interval(v_series(spark, sf_dir), KEYS, "pos", "value", 0.3, 1.0, 3.0, 1, 2)


@query("w22_circular_runs", f"""WITH {V_FRAMES}, f AS (SELECT vec_id, pos, v > 0 AS h, count(*) OVER (PARTITION BY vec_id) AS n, coalesce(min(CASE WHEN v > 0 THEN NULL ELSE pos END) OVER (PARTITION BY vec_id), 0) AS off FROM v_frames),
o AS (SELECT *, ((pos - off) % n + n) % n AS at_ FROM f),
r AS (SELECT *, sum(c) OVER (PARTITION BY vec_id ORDER BY at_) AS r FROM (SELECT *, CASE WHEN h <> lag(h) OVER (PARTITION BY vec_id ORDER BY at_) THEN 1 ELSE 0 END AS c FROM o))
SELECT vec_id, arg_min(pos, at_) AS start, count(*) AS length FROM r WHERE h GROUP BY vec_id, r.r""")
def w22_circular_runs(spark, sf_dir):
    return runs.circular_runs(v_frames(spark, sf_dir).withColumn("h", F.col("v") > 0), ["vec_id"], "pos", "h")


@query("w15_running_max", f"WITH {V_FRAMES} SELECT vec_id, pos, round(max(v) OVER (PARTITION BY vec_id ORDER BY pos), 6) AS mono FROM v_frames")
def w15_running_max(spark, sf_dir):
    return v_frames(spark, sf_dir).select("vec_id", "pos", F.round(runs.running_max("v", ["vec_id"], "pos"), 6).alias("mono"))


@query("w16_cut_at_decrease", f"""WITH {V_SERIES}, l AS (SELECT *, lead(value) OVER (PARTITION BY cond, traj ORDER BY pos) AS nx FROM v_series),
c0 AS (SELECT *, min(CASE WHEN nx < value THEN pos END) OVER (PARTITION BY cond, traj) AS first FROM l),
c AS (SELECT *, CASE WHEN first IS NOT NULL THEN greatest(first - 1, 0) END AS cut FROM c0),
k AS (SELECT *, coalesce(pos < cut, TRUE) AS ok FROM c), n AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY cond, traj) AS len FROM k)
SELECT cond, traj, count(*) FILTER (ok AND len >= 2) AS n_kept, round(max(CASE WHEN ok AND len >= 2 THEN value END), 6) AS top FROM n GROUP BY 1, 2""")
def w16_cut_at_decrease(spark, sf_dir):
    out = runs.cut_at_decrease(v_series(spark, sf_dir), KEYS, "pos", "value", 2, "kept")
    return out.groupBy(*KEYS).agg(F.count("kept").alias("n_kept"), F.round(F.max("kept"), 6).alias("top"))


Z = V_POINTS + """,
m AS (SELECT *, median(value) OVER (PARTITION BY cond) AS med FROM v_points),
d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY cond) AS mad FROM m),
z AS (SELECT *, CASE WHEN mad < 1e-12 THEN 0.0 ELSE 0.6745 * (value - med) / (mad + 1e-12) END AS z FROM d)"""


@query("a4_robust_z", f"WITH {Z} SELECT event_id, round(z, 6) AS z FROM z")
def a4_robust_z(spark, sf_dir):
    return robust.robust_z(v_points(spark, sf_dir), ["cond"], "value").select("event_id", F.round("z", 6).alias("z"))


@query("p22_outliers", f"""WITH {Z}, q AS (SELECT *, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3 FROM z WINDOW w AS (PARTITION BY cond))
SELECT cond, count(*) FILTER (abs(value - mu) <= 2.5 * sd) AS n_z, count(*) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_iqr, count(*) FILTER (abs(z) <= 3.0) AS n_mad FROM q GROUP BY 1""")
def p22_outliers(spark, sf_dir):
    df = robust.zscore_inlier(v_points(spark, sf_dir).select("cond", "value"), ["cond"], "value", 2.5, "z_ok")
    df = robust.mad_inlier(robust.iqr_inlier(df, ["cond"], "value", 1.5, "iqr_ok"), ["cond"], "value", 3.0, "mad_ok")
    return df.groupBy("cond").agg(F.count_if("z_ok").alias("n_z"), F.count_if("iqr_ok").alias("n_iqr"), F.count_if("mad_ok").alias("n_mad"))


@query("p23_scaling", f"""WITH {V_POINTS}, q AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, quantile_cont(value, 0.05) OVER w AS q1, quantile_cont(value, 0.95) OVER w AS q2 FROM v_points WINDOW w AS (PARTITION BY cond))
SELECT event_id, round((value - lo) / (hi - lo), 6) AS unit, round(least(greatest((value - q1) / (q2 - q1), 0), 1), 6) AS clipped FROM q""")
def p23_scaling(spark, sf_dir):
    df = robust.min_max(v_points(spark, sf_dir), ["cond"], "value", "unit")
    return robust.percentile_scale(df, ["cond"], "value", 0.05, 0.95, "clipped").select("event_id", F.round("unit", 6).alias("unit"), F.round("clipped", 6).alias("clipped"))


@query("a5_trace_summary", f"WITH {V_SERIES} SELECT cond, traj, count(*) AS n, round(min(time), 6) AS t_min, round(max(time), 6) AS t_max, round(max(value), 6) AS v_max, round(arg_max(value, pos), 6) AS v_last, round(arg_max(time, value), 6) AS t_of_max FROM v_series GROUP BY 1, 2")
def a5_trace_summary(spark, sf_dir):
    return v_series(spark, sf_dir).groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.round(F.min("time"), 6).alias("t_min"), F.round(F.max("time"), 6).alias("t_max"), F.round(F.max("value"), 6).alias("v_max"),
        F.round(F.max_by("value", "pos"), 6).alias("v_last"), F.round(F.max_by("time", F.struct("value", -F.col("pos"))), 6).alias("t_of_max"),
    )


@query("w1_area_onset", f"""WITH {V_SERIES}, a AS (SELECT *, greatest(value - 100, 0) AS area FROM v_series), b AS (SELECT *, lag(area) OVER (PARTITION BY cond, traj ORDER BY pos) AS before FROM a),
f AS (SELECT cond, traj, min(pos) AS pos, arg_min(before, pos) FILTER (TRUE) AS x FROM b WHERE area > 0 GROUP BY 1, 2),
g AS (SELECT f.cond, f.traj, CASE WHEN b.before = 0 THEN f.pos - 1 END AS delay FROM f JOIN b ON f.cond = b.cond AND f.traj = b.traj AND f.pos = b.pos)
SELECT s.cond, s.traj, delay FROM (SELECT DISTINCT cond, traj FROM v_series) s LEFT JOIN g ON s.cond = g.cond AND s.traj = g.traj""")
def w1_area_onset(spark, sf_dir):
    df = v_series(spark, sf_dir).withColumn("area", F.greatest(F.col("value") - 100, F.lit(0.0)))
    return align.area_onset(df, KEYS, "pos", "area")


CLEAN = V_SERIES + """,
w0 AS (SELECT *, greatest(value - 60, 0) AS v0 FROM v_series),
w1 AS (SELECT *, (pos < 3 AND coalesce(lead(v0) OVER (PARTITION BY cond, traj ORDER BY pos), 0) = 0) AS idle FROM w0),
w2 AS (SELECT *, sum(idle::INT) OVER (PARTITION BY cond, traj) AS delay FROM w1),
w3 AS (SELECT *, CASE WHEN NOT idle AND pos >= delay THEN greatest(v0, 0) * 2.0 END AS v FROM w2),
w4 AS (SELECT *, lead(v) OVER (PARTITION BY cond, traj ORDER BY pos) - v AS step FROM w3),
w5 AS (SELECT *, min(CASE WHEN step < -120 THEN pos END) OVER (PARTITION BY cond, traj) AS cut1 FROM w4),
w6 AS (SELECT *, min(CASE WHEN step > 150 AND coalesce(pos < cut1, TRUE) THEN pos END) OVER (PARTITION BY cond, traj) AS cut2 FROM w5),
cleaned AS (SELECT *, CASE WHEN coalesce(pos <= cut1, TRUE) AND coalesce(pos <= cut2, TRUE) THEN v END AS clean FROM w6)"""


def _cleaned(spark, sf_dir):
    df = v_series(spark, sf_dir).withColumn("v0", F.greatest(F.col("value") - 60, F.lit(0.0)))
    return align.clean_series(df, KEYS, "pos", "v0", low=-120, high=150, scan=3, scale=2.0)


@query("w2_clean_series", f"WITH {CLEAN} SELECT cond, traj, pos, delay::BIGINT AS delay, round(clean, 6) AS clean FROM cleaned")
def w2_clean_series(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(*KEYS, "pos", "delay", F.round("clean", 6).alias("clean"))


@query("w29_stage_replay", f"""WITH {CLEAN} SELECT cond, count(*) AS n, count(*) FILTER (v IS NULL) AS n_onset, count(*) FILTER (v IS NOT NULL AND NOT coalesce(pos <= cut1, TRUE)) AS n_cut1,
count(*) FILTER (v IS NOT NULL AND coalesce(pos <= cut1, TRUE) AND NOT coalesce(pos <= cut2, TRUE)) AS n_cut2 FROM cleaned GROUP BY 1""")
def w29_stage_replay(spark, sf_dir):
    raw = v_series(spark, sf_dir).withColumn("v0", F.greatest(F.col("value") - 60, F.lit(0.0)))
    step1 = align.clean_series(raw, KEYS, "pos", "v0", low=-1e18, high=1e18, scan=3, scale=2.0, out="s1").drop("delay")
    step2 = align.clean_series(step1, KEYS, "pos", "v0", low=-120, high=1e18, scan=3, scale=2.0, out="s2").drop("delay")
    step3 = align.clean_series(step2, KEYS, "pos", "v0", low=-120, high=150, scan=3, scale=2.0, out="s3")
    return step3.groupBy("cond").agg(F.count("*").alias("n"), F.count_if(F.col("s1").isNull()).alias("n_onset"), F.count_if(F.col("s1").isNotNull() & F.col("s2").isNull()).alias("n_cut1"), F.count_if(F.col("s2").isNotNull() & F.col("s3").isNull()).alias("n_cut2"))


@query("w3_subframe_onset", f"""WITH {CLEAN}, p AS (SELECT *, row_number() OVER (PARTITION BY cond, traj ORDER BY pos) AS k FROM cleaned WHERE clean > 0),
l AS (SELECT cond, traj, regr_slope(clean, time) AS b, regr_intercept(clean, time) AS a, count(*) AS n FROM p WHERE k <= 2 GROUP BY 1, 2), e AS (SELECT cond, traj, max(time) AS last FROM cleaned GROUP BY 1, 2)
SELECT e.cond, e.traj, round(CASE WHEN n >= 2 AND b > 1e-7 AND -a / b >= 0 AND -a / b <= last THEN -a / b END, 6) AS onset FROM e LEFT JOIN l USING (cond, traj)""")
def w3_subframe_onset(spark, sf_dir):
    return rounded(align.subframe_onset(_cleaned(spark, sf_dir), KEYS, "pos", "time", "clean"))


DELAYS = CLEAN + """, dl AS (SELECT cond, traj, any_value(CASE WHEN delay > 0 THEN delay::DOUBLE END) AS delay FROM cleaned GROUP BY 1, 2),
md AS (SELECT *, median(delay) OVER (PARTITION BY traj) AS m FROM dl), cl AS (SELECT *, coalesce(least(greatest(delay, m - 0.5), m + 0.5), m) AS used FROM md)"""


def _delays(spark, sf_dir):
    d = _cleaned(spark, sf_dir).groupBy(*KEYS).agg(F.max(F.when(F.col("delay") > 0, F.col("delay").cast("double"))).alias("delay"))
    return align.clip_to_median(d, ["traj"], "delay", 0.5, "used")


@query("w4_clip_delay", f"WITH {DELAYS} SELECT cond, traj, delay, round(used, 6) AS used FROM cl")
def w4_clip_delay(spark, sf_dir):
    return rounded(_delays(spark, sf_dir))


@query("w5_shift_series", f"WITH {DELAYS} SELECT s.cond, s.traj, pos - round_even(coalesce(used, 0), 0)::INT AS frame, round(value, 6) AS value FROM v_series s JOIN cl USING (cond, traj) WHERE pos - round_even(coalesce(used, 0), 0)::INT >= 0")
def w5_shift_series(spark, sf_dir):
    d = _delays(spark, sf_dir).select(*KEYS, F.coalesce("used", F.lit(0.0)).alias("used"))
    out = v_series(spark, sf_dir).join(d, KEYS).withColumn("frame", align.shifted("pos", "used"))
    return out.filter("frame >= 0").select(*KEYS, "frame", F.round("value", 6).alias("value"))


GAPS = V_SERIES + ", gp AS (SELECT *, CASE WHEN value > 60 AND value < 140 THEN value END AS g FROM v_series)"


def _gaps(spark, sf_dir):
    return v_series(spark, sf_dir).withColumn("g", F.when((F.col("value") > 60) & (F.col("value") < 140), F.col("value")))


@query("w27_fill_gaps", f"""WITH {GAPS}, k AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS px, last_value(g IGNORE NULLS) OVER a AS py, first_value(CASE WHEN g IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS qx, first_value(g IGNORE NULLS) OVER b AS qy FROM gp
WINDOW a AS (PARTITION BY cond, traj ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY cond, traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT cond, traj, pos, round(CASE WHEN g IS NOT NULL THEN g WHEN px IS NOT NULL AND qx IS NOT NULL THEN py + (qy - py) * (pos - px)::DOUBLE / (qx - px)::DOUBLE ELSE coalesce(py, qy) END, 6) AS filled FROM k""")
def w27_fill_gaps(spark, sf_dir):
    return align.filled_between(_gaps(spark, sf_dir), KEYS, "pos", "g", "filled").select(*KEYS, "pos", F.round("filled", 6).alias("filled"))


DISTINCT_T = V_SERIES + ", dt AS (SELECT cond, traj, time, max(value) AS value FROM v_series GROUP BY 1, 2, 3)"


def _by_time(spark, sf_dir):
    return v_points(spark, sf_dir).groupBy(*KEYS, "time").agg(F.max("value").alias("value"))


@query("j13_interpolating_asof", f"""WITH {DISTINCT_T}, c AS (SELECT traj, time, value FROM dt WHERE cond = (SELECT min(cond) FROM dt)), p AS (SELECT traj, time FROM dt WHERE cond = (SELECT max(cond) FROM dt)),
lo AS (SELECT p.traj, p.time, c.time AS t0, c.value AS v0 FROM p ASOF LEFT JOIN c ON p.traj = c.traj AND p.time >= c.time),
hi AS (SELECT lo.*, c.time AS t1, c.value AS v1 FROM lo ASOF LEFT JOIN c ON lo.traj = c.traj AND lo.time <= c.time)
SELECT traj, time, round(CASE WHEN t0 = time THEN v0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * (time - t0) / (t1 - t0) END, 6) AS other FROM hi""")
def j13_interpolating_asof(spark, sf_dir):
    rows = _by_time(spark, sf_dir)
    ends = rows.agg(F.min("cond").alias("lo"), F.max("cond").alias("hi"))
    base = rows.join(F.broadcast(ends), F.col("cond") == F.col("hi")).select("traj", "time")
    other = rows.join(F.broadcast(ends), F.col("cond") == F.col("lo")).select("traj", "time", "value")
    out = align.interpolate_at(base, other, ["traj"], "time", "value", "other")
    return out.select("traj", "time", F.round("other", 6).alias("other"))


@query("j14_grid_sampling", f"""WITH {DISTINCT_T}, s AS (SELECT *, lead(time) OVER w AS t1, lead(value) OVER w AS v1 FROM dt WINDOW w AS (PARTITION BY cond, traj ORDER BY time)), g AS (SELECT unnest([5.0, 10.0, 15.0, 20.0, 25.0])::DOUBLE AS g)
SELECT cond, traj, g AS time, round(value + coalesce((v1 - value) / (t1 - time), 0) * (g - time), 6) AS at_time FROM s JOIN g ON g >= time AND (g < t1 OR (t1 IS NULL AND g = time))""")
def j14_grid_sampling(spark, sf_dir):
    return rounded(align.at_grid(_by_time(spark, sf_dir), KEYS, "time", "value", [5, 10, 15, 20, 25], "at_time"))


@query("w25_event_window", f"""WITH {V_SERIES}, g AS (SELECT *, (lead(value) OVER w - lag(value) OVER w) / 2 AS gr FROM v_series WINDOW w AS (PARTITION BY cond, traj ORDER BY pos)),
e AS (SELECT *, greatest(coalesce(min(CASE WHEN gr > 30 THEN pos END) OVER (PARTITION BY cond, traj) - 2, 0), 0) AS st FROM g)
SELECT cond, traj, (pos - st)::INT AS rel, round(value, 6) AS value FROM e WHERE pos - st BETWEEN 0 AND 5""")
def w25_event_window(spark, sf_dir):
    return align.event_window(v_series(spark, sf_dir), KEYS, "pos", "value", 30, 2, 6).select(*KEYS, "rel", F.round("value", 6).alias("value"))


@query("w26_sample_rate", f"WITH {V_POINTS}, d AS (SELECT cond, traj, time - lag(time) OVER (PARTITION BY cond, traj ORDER BY time) AS dt FROM v_points) SELECT cond, traj, round(1 / median(dt), 6) AS rate FROM d WHERE dt > 0 GROUP BY 1, 2")
def w26_sample_rate(spark, sf_dir):
    return rounded(align.sample_rate(v_points(spark, sf_dir), KEYS, "time"))


@query("w28_rate_and_integral", f"""WITH {DISTINCT_T}, o AS (SELECT *, row_number() OVER (PARTITION BY cond, traj ORDER BY time) - 1 AS k FROM dt),
d AS (SELECT *, time - lag(time) OVER w AS a, lead(time) OVER w - time AS b, value - lag(value) OVER w AS d0, lead(value) OVER w - value AS d1, lag(value) OVER w AS pv FROM o WINDOW w AS (PARTITION BY cond, traj ORDER BY k))
SELECT cond, traj, k::INT AS k, round(CASE WHEN a IS NULL THEN d1 / b WHEN b IS NULL THEN d0 / a ELSE (a * a * d1 + b * b * d0) / (a * b * (a + b)) END, 4) AS rate,
round(sum(coalesce(a * (value + pv) / 2, 0)) OVER (PARTITION BY cond, traj ORDER BY k), 6) AS integral FROM d""")
def w28_rate_and_integral(spark, sf_dir):
    rows = _by_time(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy(*KEYS).orderBy("time")) - 1)
    rows = rows.withColumn("rate", F.round(align.gradient(KEYS, "k", "time", "value"), 4))
    return align.cumulative_trapezoid(rows, KEYS, "k", "time", "value", "integral").select(*KEYS, "k", "rate", F.round("integral", 6).alias("integral"))


@query("w12_hampel", f"""WITH {V_SERIES}, p AS (SELECT a.cond, a.traj, a.pos, a.value, b.value AS v2 FROM v_series a JOIN v_series b ON a.cond = b.cond AND a.traj = b.traj AND abs(a.time - b.time) <= 2.0),
m AS (SELECT *, median(v2) OVER (PARTITION BY cond, traj, pos) AS med, count(*) OVER (PARTITION BY cond, traj, pos) AS n FROM p),
g AS (SELECT cond, traj, pos, any_value(value) AS v, any_value(med) AS med, any_value(n) AS n, median(abs(v2 - med)) * 1.4826 AS mad FROM m GROUP BY 1, 2, 3)
SELECT cond, traj, pos, (n >= 3 AND count(v) OVER (PARTITION BY cond, traj) >= 5 AND mad > 0 AND abs(v - med) > 3.0 * mad) AS spike FROM g""")
def w12_hampel(spark, sf_dir):
    return align.hampel(v_series(spark, sf_dir), KEYS, "pos", "time", "value", 2.0, 3.0)


@query("w33_resample", f"""WITH {V_POINTS}, h AS (SELECT cond, traj, round_even(time / 2.0, 0)::INT AS node, avg(value) AS value FROM v_points WHERE round_even(time / 2.0, 0) BETWEEN 0 AND 14 GROUP BY 1, 2, 3)
SELECT k.cond, k.traj, g.node::INT AS node, round(h.value, 6) AS value, h.value IS NOT NULL AS valid FROM (SELECT DISTINCT cond, traj FROM v_points) k CROSS JOIN (SELECT unnest(range(15)) AS node) g LEFT JOIN h ON h.cond = k.cond AND h.traj = k.traj AND h.node = g.node""")
def w33_resample(spark, sf_dir):
    return rounded(align.resample_nearest(v_points(spark, sf_dir), KEYS, "time", "value", 2.0, 15))


@query("w11_endpoint_slope", f"WITH {V_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY cond, traj ORDER BY pos DESC) AS k FROM v_series) SELECT cond, traj, count(*) AS n, round(regr_slope(value, time), 4) AS slope, round(arg_max(value, pos), 6) AS last_value FROM r WHERE k <= 5 GROUP BY 1, 2")
def w11_endpoint_slope(spark, sf_dir):
    back = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.col("pos").desc()))
    tail = v_series(spark, sf_dir).withColumn("_k", back).filter("_k <= 5")
    return tail.groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.regr_slope("value", "time"), 4).alias("slope"), F.round(F.max_by("value", "pos"), 6).alias("last_value"))


@query("w14_first_cap_hit", f"WITH {V_SERIES} SELECT cond, traj, min(pos) AS pos, round(arg_min(value, pos), 6) AS value FROM v_series WHERE value >= 160.0 - 5.0 GROUP BY 1, 2")
def w14_first_cap_hit(spark, sf_dir):
    return v_series(spark, sf_dir).filter(F.col("value") >= 160.0 - 5.0).groupBy(*KEYS).agg(F.min("pos").alias("pos"), F.round(F.min_by("value", "pos"), 6).alias("value"))


@query("w34_onset_weights", f"""WITH {V_POINTS}, o AS (SELECT cond, traj, min(bin) AS b FROM v_points WHERE value > 100 GROUP BY 1, 2), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY b) AS w FROM o)
SELECT cond, traj, b AS onset_bin, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w""")
def w34_onset_weights(spark, sf_dir):
    onset = v_points(spark, sf_dir).filter("value > 100").groupBy(*KEYS).agg(F.min("bin").alias("onset_bin"))
    sizes = onset.groupBy("onset_bin").agg((1 / F.count("*")).alias("w"), F.count("*").alias("n"))
    mean = sizes.agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("m"))
    return onset.join(sizes, "onset_bin").select(*KEYS, "onset_bin", F.round(F.col("w") / mean.scalar(), 6).alias("weight"))


@query("w36_bin_weights", f"""WITH {V_POINTS}, c AS (SELECT b.bin::INT AS bin, count(p.bin) AS n FROM (SELECT unnest(range(40)) AS bin) b LEFT JOIN v_points p ON p.bin = b.bin GROUP BY 1)
SELECT bin, round(CASE WHEN n = 0 THEN 1.0 ELSE least(greatest((SELECT avg(n) FROM c WHERE n > 0) / n, 0.5), 2.0) END, 6) AS weight FROM c""")
def w36_bin_weights(spark, sf_dir):
    held = v_points(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"))
    mean = held.agg(F.avg("n")).scalar()
    grid = spark.range(40).select(F.col("id").cast("int").alias("bin")).join(held, "bin", "left")
    return grid.select("bin", F.round(F.when(F.col("n").isNull(), 1.0).otherwise(F.least(F.greatest(mean / F.col("n"), F.lit(0.5)), F.lit(2.0))), 6).alias("weight"))


@query("p8_stable_key", f"WITH {V_POINTS} SELECT event_id, cond || '|' || printf('%.6f', traj::DOUBLE) || '|' || printf('%.6f', value) AS key FROM v_points")
def p8_stable_key(spark, sf_dir):
    return v_points(spark, sf_dir).select("event_id", stable_key((F.col("cond"), False), (F.col("traj"), True), (F.col("value"), True)).alias("key"))
