"""Queries that score and calibrate the prediction view, with the same answers as SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracelake.functions.scalars import normal_cdf_sql
from tracelake.operators import score
from tracelake.plans.registry import Registry, replicated_sql, rounded, stepped, stepped_sql
from tracelake.plans.views import V_PRED, v_pred

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

SCORED = V_PRED + f""",
s1 AS (SELECT *, greatest(sigma, 1e-9) AS sig, mu - truth AS resid FROM v_pred),
s2 AS (SELECT *, abs(resid) AS abs_err, -resid / sig AS z FROM s1),
s3 AS (SELECT *, {normal_cdf_sql("z")} AS cdf FROM s2),
scored AS (SELECT *, least(greatest(cdf, 1e-9), {1 - 1e-9!r}) AS pit, sig * (z * (2 * cdf - 1) + 2 * (exp(-z * z / 2) * {1 / math.sqrt(2 * math.pi)!r}) - {1 / math.sqrt(math.pi)!r}) AS crps,
  0.5 * ({math.log(2 * math.pi)!r} + 2 * ln(sig) + z * z) AS nll FROM s3)"""


def _pred(spark, sf_dir):
    return score.scored(v_pred(spark, sf_dir))


def _q(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


def _share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"


def _r(items: dict[str, str]) -> str:
    return ", ".join(f"round({x}, 6) AS {k}" for k, x in items.items())


REL = "abs_err / greatest(abs(truth), 5.0)"
POINT = {
    "rmse": "sqrt(avg(resid * resid))", "mae": "avg(abs_err)", "bias": "avg(resid)", "median_abs_err": _q("abs_err", 0.5), "p90_abs_err": _q("abs_err", 0.9), "p95_abs_err": _q("abs_err", 0.95), "max_abs_err": "max(abs_err)",
    **{f"coverage_{k}sigma": _share(f"abs_err <= {k} * sig") for k in (1, 2, 3)}, "mean_sigma": "avg(sigma)", "p25_sigma": _q("sigma", 0.25), "median_sigma": _q("sigma", 0.5), "p75_sigma": _q("sigma", 0.75),
    "mean_rel_err": f"avg({REL})", "median_rel_err": _q(REL, 0.5), "truth_min": "min(truth)", "truth_max": "max(truth)", "truth_range": "max(truth) - min(truth)", "nrmse_range": "sqrt(avg(resid * resid)) / (max(truth) - min(truth))",
    **{f"coverage_central_{n}": _share(f"abs(z) <= {score.QUANTILES[p]!r}") for n, p in ((50, 0.75), (80, 0.9), (90, 0.95), (95, 0.975))},
}
ADDITIVE = {k: POINT[k] for k in ("rmse", "mae", "bias", "coverage_1sigma", "coverage_2sigma")}


def _interval(level: float) -> str:
    half = f"(sig * {score.QUANTILES[round(0.5 + level / 2, 3)]!r})"
    return f"avg(((mu + {half}) - (mu - {half})) + {2 / (1 - level)!r} * (greatest((mu - {half}) - truth, 0.0) + greatest(truth - (mu + {half}), 0.0)))"


def _pinball(q: float) -> str:
    d = f"(truth - (mu + sig * {score.QUANTILES[q]!r}))"
    return f"avg(greatest({q} * {d}, {q - 1} * {d}))"


SHARP = {
    "nll": "avg(nll)", "crps_mean": "avg(crps)", "crps_std": "stddev_pop(crps)", "crps_median": _q("crps", 0.5), "crps_p90": _q("crps", 0.9), "sharpness": "avg(sigma)", "mean_abs_z": "avg(abs(z))", "z_mean": "avg(z)", "z_var": "var_pop(z)",
    "spiegelhalter_z": "sum(z * z - 1) / sqrt(2.0 * count(z))", "interval_score_50": _interval(0.5), "interval_score_90": _interval(0.9), "pinball_q10": _pinball(0.1), "pinball_q50": _pinball(0.5), "pinball_q90": _pinball(0.9),
}
LEVELS_SQL = "lv AS (SELECT unnest([" + ", ".join(map(repr, score.LEVELS)) + "])::DOUBLE AS level)"


@query("m1_point_metrics", f"WITH {SCORED} SELECT grp, count(*) AS n_points, {_r(POINT)} FROM scored GROUP BY grp")
def m1_point_metrics(spark, sf_dir):
    return rounded(score.point_metrics(_pred(spark, sf_dir), ["grp"]))


@query("m2_column_scores", f"WITH {SCORED} SELECT cluster, point, {stepped_sql("z")} AS z, {stepped_sql("pit")} AS pit, {stepped_sql("crps", 4)} AS crps, {stepped_sql("nll")} AS nll FROM scored")
def m2_column_scores(spark, sf_dir):
    return _pred(spark, sf_dir).select("cluster", "point", stepped("z").alias("z"), stepped("pit").alias("pit"), stepped("crps", 4).alias("crps"), stepped("nll").alias("nll"))


@query("m3_probabilistic_summary", f"WITH {SCORED} SELECT grp, {_r(SHARP)} FROM scored GROUP BY grp")
def m3_probabilistic_summary(spark, sf_dir):
    return rounded(score.sharp_metrics(_pred(spark, sf_dir), ["grp"]))


@query("m4_reliability_table", f"WITH {SCORED}, {LEVELS_SQL} SELECT grp, round(level, 6) AS level, round({_share('pit <= level')}, 6) AS share, round(abs({_share('pit <= level')} - level), 6) AS error FROM scored CROSS JOIN lv GROUP BY grp, level")
def m4_reliability_table(spark, sf_dir):
    return rounded(score.reliability(_pred(spark, sf_dir), ["grp"]))


@query("m4_calibration_error", f"WITH {SCORED}, {LEVELS_SQL}, e AS (SELECT grp, level, abs({_share('pit <= level')} - level) AS error FROM scored CROSS JOIN lv GROUP BY grp, level) SELECT grp, round(avg(error), 6) AS ece FROM e GROUP BY grp")
def m4_calibration_error(spark, sf_dir):
    return score.reliability(_pred(spark, sf_dir), ["grp"]).groupBy("grp").agg(F.round(F.avg("error"), 6).alias("ece"))


HIST = "hb AS (SELECT grp, least(floor(pit * 20), 19)::INT AS bin, count(*) AS n, sum(weight) AS w FROM scored GROUP BY 1, 2), hg AS (SELECT grp, b.bin::INT AS bin FROM (SELECT DISTINCT grp FROM scored) CROSS JOIN (SELECT unnest(range(20)) AS bin) b)"


@query("m5_pit_histogram", f"WITH {SCORED}, {HIST} SELECT grp, bin, coalesce(n, 0) AS count, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY grp), 6) AS share FROM hg LEFT JOIN hb USING (grp, bin)")
def m5_pit_histogram(spark, sf_dir):
    return rounded(score.pit_histogram(_pred(spark, sf_dir), ["grp"]))


@query("m5_weighted_tvd", f"WITH {SCORED}, {HIST}, f AS (SELECT grp, coalesce(w, 0) / sum(coalesce(w, 0)) OVER (PARTITION BY grp) AS s FROM hg LEFT JOIN hb USING (grp, bin)) SELECT grp, round(0.5 * sum(abs(s - 0.05)), 6) AS tvd FROM f GROUP BY grp")
def m5_weighted_tvd(spark, sf_dir):
    return score.pit_histogram(_pred(spark, sf_dir), ["grp"], weight="weight").groupBy("grp").agg(F.round(0.5 * F.sum(F.abs(F.col("share") - 0.05)), 6).alias("tvd"))


KS = tuple(0.25 + 0.125 * k for k in range(23))


@query("m6_coverage_curve", f"WITH {SCORED}, ks AS (SELECT unnest([{', '.join(map(repr, KS))}])::DOUBLE AS k) SELECT grp, k, round({_share('abs(z) <= k')}, 6) AS coverage, round(2 * any_value({normal_cdf_sql('k')}) - 1, 6) AS nominal FROM scored CROSS JOIN ks GROUP BY grp, k")
def m6_coverage_curve(spark, sf_dir):
    return rounded(score.coverage_curve(_pred(spark, sf_dir), ["grp"], KS))


@query("m7_interval_scores", f"WITH {SCORED} SELECT status, {_r({k: SHARP[k] for k in ('interval_score_50', 'interval_score_90', 'pinball_q10', 'pinball_q90', 'spiegelhalter_z')})} FROM scored GROUP BY status")
def m7_interval_scores(spark, sf_dir):
    cols = ("interval_score_50", "interval_score_90", "pinball_q10", "pinball_q90", "spiegelhalter_z")
    return rounded(_pred(spark, sf_dir).groupBy("status").agg(*score.sharp_measures()).select("status", *cols))


@query("m8_sigma_deciles", f"""WITH {SCORED}, e AS (SELECT list_distinct(quantile_cont(sigma, [{", ".join(str(k / 10) for k in range(11))}])) AS e FROM scored),
b AS (SELECT *, greatest(len(list_filter((SELECT e FROM e), lambda x: x < sigma)), 1)::INT AS bin FROM scored)
SELECT bin, count(*) AS n, round(avg(sigma), 6) AS mean_sigma, round(avg(abs_err), 6) AS mae, round(sqrt(avg(resid * resid)), 6) AS rmse, round({_share('abs(z) <= 1')}, 6) AS coverage_1sigma, round({_share('abs(z) <= 2')}, 6) AS coverage_2sigma, {stepped_sql("quantile_cont(abs(z), 0.9)", 4)} AS p90_abs_z FROM b GROUP BY bin""")
def m8_sigma_deciles(spark, sf_dir):
    return rounded(score.sigma_deciles(_pred(spark, sf_dir)).withColumn("p90_abs_z", stepped("p90_abs_z", 4)))


@query("m9_ks_statistic", f"WITH {SCORED}, r AS (SELECT grp, pit, row_number() OVER (PARTITION BY grp ORDER BY pit) AS r, count(*) OVER (PARTITION BY grp) AS n FROM scored) SELECT grp, round(max(greatest(r / n - pit, pit - (r - 1) / n)), 6) AS ks, any_value(n) AS n FROM r GROUP BY grp")
def m9_ks_statistic(spark, sf_dir):
    return rounded(score.ks_statistic(_pred(spark, sf_dir), ["grp"]))


@query("m10_grouped_metrics", f"WITH {SCORED} SELECT coalesce(grp, 'all') AS grp, coalesce(status, 'all') AS status, coalesce(tax, -1) AS tax, count(*) AS n_points, {_r(ADDITIVE)} FROM scored GROUP BY GROUPING SETS ((), (grp), (status), (tax), (grp, status), (grp, tax))")
def m10_grouped_metrics(spark, sf_dir):
    df = _pred(spark, sf_dir)
    sets = [[], [F.col("grp")], [F.col("status")], [F.col("tax")], [F.col("grp"), F.col("status")], [F.col("grp"), F.col("tax")]]
    out = df.groupingSets(sets, "grp", "status", "tax").agg(*score.additive_measures())
    return rounded(out.fillna("all", ["grp", "status"]).fillna(-1, ["tax"]))


@query("m11_overall_summary", f"WITH {SCORED} SELECT count(*) AS n_points, count(DISTINCT grp) AS n_groups, count(DISTINCT cluster) AS n_clusters, round(sqrt(avg(resid * resid)), 6) AS rmse, round(avg(crps), 6) AS crps FROM scored")
def m11_overall_summary(spark, sf_dir):
    return rounded(_pred(spark, sf_dir).agg(F.count("*").alias("n_points"), F.countDistinct("grp").alias("n_groups"), F.countDistinct("cluster").alias("n_clusters"), F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("rmse"), F.avg("crps").alias("crps")))


def _ci_sql(source: str, cluster: str, reps: int, seed: str, out=("rmse", "mae", "bias")) -> str:
    """CTEs and select of percentile intervals; ``source`` has grp, resid and abs_err."""
    ends = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_{side}" for c in out for side, p in (("low", "0.025"), ("high", "0.975")))
    return f"""cs AS (SELECT grp, {cluster} AS c, count(resid) AS n, sum(resid) AS s, sum(abs_err) AS a, sum(resid * resid) AS q FROM {source} GROUP BY 1, 2),
dr AS ({replicated_sql("cs", "c", reps, seed)}), ea AS (SELECT grp, rep, sqrt(sum(w * q) / sum(w * n)) AS rmse, sum(w * a) / sum(w * n) AS mae, sum(w * s) / sum(w * n) AS bias FROM dr GROUP BY 1, 2)
SELECT grp, {ends} FROM ea GROUP BY grp"""


@query("m12_bootstrap_ci", f"WITH {SCORED}, {_ci_sql('scored', "cluster || ':' || point", 20, 'points')}")
def m12_bootstrap_ci(spark, sf_dir):
    #: without one of the two no key, as in SQL
    df = _pred(spark, sf_dir).withColumn("row", F.concat("cluster", F.lit(":"), "point"))
    return rounded(score.bootstrap_ci(df, ["grp"], "row", 20, "points"))


@query("m13_cluster_bootstrap_ci", f"WITH {SCORED}, {_ci_sql('scored', 'cluster', 50, 'clusters')}")
def m13_cluster_bootstrap_ci(spark, sf_dir):
    return rounded(score.bootstrap_ci(_pred(spark, sf_dir), ["grp"], "cluster", 50, "clusters"))


@query("m14_nested_metrics", f"WITH {SCORED}, c AS (SELECT grp, cluster, sqrt(avg(resid * resid)) AS rmse, avg(abs_err) AS mae, count(*) AS n FROM scored GROUP BY 1, 2) SELECT grp, count(*) AS n_clusters, sum(n)::BIGINT AS n_points, round(avg(rmse), 6) AS mean_rmse, round(median(rmse), 6) AS median_rmse, round(avg(mae), 6) AS mean_mae FROM c GROUP BY grp")
def m14_nested_metrics(spark, sf_dir):
    each = _pred(spark, sf_dir).groupBy("grp", "cluster").agg(F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("rmse"), F.avg("abs_err").alias("mae"), F.count("*").alias("n"))
    return rounded(each.groupBy("grp").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_points"), F.avg("rmse").alias("mean_rmse"), F.median("rmse").alias("median_rmse"), F.avg("mae").alias("mean_mae")))


@query("m15_split_evaluation", f"WITH {SCORED} SELECT CASE WHEN tax < 0.03 THEN 'test' WHEN tax < 0.05 THEN 'val' ELSE 'train' END AS split, count(*) AS n_points, {_r(ADDITIVE)} FROM scored GROUP BY 1")
def m15_split_evaluation(spark, sf_dir):
    split = F.when(F.col("tax") < 0.03, "test").when(F.col("tax") < 0.05, "val").otherwise("train")
    return rounded(_pred(spark, sf_dir).groupBy(split.alias("split")).agg(*score.additive_measures()))


@query("m16_macro_average", f"WITH {SCORED}, c AS (SELECT grp, status, sqrt(avg(resid * resid)) AS rmse, avg(resid) AS bias FROM scored GROUP BY 1, 2) SELECT grp, count(*) AS n_conditions, round(avg(rmse), 6) AS macro_rmse, round(avg(bias), 6) AS macro_bias FROM c GROUP BY grp")
def m16_macro_average(spark, sf_dir):
    each = _pred(spark, sf_dir).groupBy("grp", "status").agg(*score.additive_measures())
    return rounded(each.groupBy("grp").agg(F.count("*").alias("n_conditions"), F.avg("rmse").alias("macro_rmse"), F.avg("bias").alias("macro_bias")))


@query("m17_weight_summary", f"WITH {V_PRED} SELECT grp, round(avg(weight), 6) AS mean_weight, round(median(weight), 6) AS median_weight, min(weight) AS min_weight, max(weight) AS max_weight FROM v_pred GROUP BY grp")
def m17_weight_summary(spark, sf_dir):
    return rounded(v_pred(spark, sf_dir).groupBy("grp").agg(F.avg("weight").alias("mean_weight"), F.median("weight").alias("median_weight"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight")))


SLICES = "sl AS (SELECT *, unnest(list_filter(['all', CASE WHEN tax < 0.05 THEN 'observed' ELSE 'extrapolated' END, CASE WHEN status = 'O' THEN 'uncensored' ELSE 'censored' END], lambda x: x IS NOT NULL)) AS slice FROM scored)"


def _slices(spark, sf_dir):
    names = F.array(F.lit("all"), F.when(F.col("tax") < 0.05, "observed").otherwise("extrapolated"), F.when(F.col("status") == "O", "uncensored").otherwise("censored"))
    return _pred(spark, sf_dir).withColumn("slice", F.explode(names))


@query("p19_named_slices", f"WITH {SCORED}, {SLICES} SELECT slice, count(*) AS n_points, {_r(ADDITIVE)} FROM sl GROUP BY slice")
def p19_named_slices(spark, sf_dir):
    return rounded(_slices(spark, sf_dir).groupBy("slice").agg(*score.additive_measures()))


@query("m18_wide_slice_table", f"WITH {SCORED}, {SLICES} SELECT grp, {', '.join(f'round(sqrt(avg(resid * resid) FILTER (slice = {n!r})), 6) AS rmse_{n}' for n in ('all', 'observed', 'extrapolated'))} FROM sl GROUP BY grp")
def m18_wide_slice_table(spark, sf_dir):
    out = _slices(spark, sf_dir).groupBy("grp").pivot("slice", ["all", "observed", "extrapolated"]).agg(F.sqrt(F.avg(F.col("resid") * F.col("resid"))))
    return rounded(out.withColumnsRenamed({c: f"rmse_{c}" for c in ("all", "observed", "extrapolated")}))


@query("m19_fold_mean_std", f"WITH {SCORED}, c AS (SELECT grp, tax, sqrt(avg(resid * resid)) AS rmse FROM scored GROUP BY 1, 2) SELECT grp, round(avg(rmse), 6) AS mean_rmse, round(stddev_samp(rmse), 6) AS std_rmse, count(*) AS n_folds FROM c GROUP BY grp")
def m19_fold_mean_std(spark, sf_dir):
    each = _pred(spark, sf_dir).groupBy("grp", "tax").agg(*score.additive_measures())
    return rounded(each.groupBy("grp").agg(F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.count("*").alias("n_folds")))


@query("m20_seed_bootstrap", f"WITH {SCORED}, sd AS (SELECT grp, round(tax * 100)::INT AS seed, sqrt(avg(resid * resid)) AS resid, 0.0 AS abs_err FROM scored GROUP BY 1, 2), {_ci_sql('sd', 'seed', 200, 'seeds', ('bias',))}")
def m20_seed_bootstrap(spark, sf_dir):
    each = _pred(spark, sf_dir).groupBy("grp", F.round(F.col("tax") * 100).cast("int").alias("seed")).agg(F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("resid"))
    return rounded(score.bootstrap_ci(each.withColumn("abs_err", F.abs("resid")), ["grp"], "seed", 200, "seeds").select("grp", "bias_low", "bias_high"))


@query("m21_known_number_guard", f"WITH {SCORED}, c AS (SELECT grp, sqrt(avg(resid * resid)) AS rmse FROM scored GROUP BY 1), x AS (SELECT * FROM (VALUES ('A', 27000.0, 2000.0), ('N', 1.0, 0.5), ('Z', 1.0, 0.5)) AS t(grp, want, tol)) SELECT x.grp, CASE WHEN rmse IS NULL THEN 'SKIP' WHEN abs(rmse - want) <= tol THEN 'PASS' ELSE 'FAIL' END AS verdict FROM x LEFT JOIN c USING (grp)")
def m21_known_number_guard(spark, sf_dir):
    got = _pred(spark, sf_dir).groupBy("grp").agg(*score.additive_measures())
    want = spark.createDataFrame([("A", 27000.0, 2000.0), ("N", 1.0, 0.5), ("Z", 1.0, 0.5)], "grp string, want double, tol double")
    verdict = F.when(F.col("rmse").isNull(), "SKIP").when(F.abs(F.col("rmse") - F.col("want")) <= F.col("tol"), "PASS").otherwise("FAIL")
    return want.join(got, "grp", "left").select("grp", verdict.alias("verdict"))


@query("m22_sweep_pivot", f"WITH {SCORED}, c AS (SELECT grp, status, tax, sqrt(avg(resid * resid)) AS rmse FROM scored GROUP BY ALL) SELECT grp, round(avg(rmse) FILTER (status = 'F'), 6) AS run_f, round(avg(rmse) FILTER (status = 'O'), 6) AS run_o, round(stddev_samp(rmse), 6) AS std, count(*) AS n FROM c GROUP BY grp")
def m22_sweep_pivot(spark, sf_dir):
    each = _pred(spark, sf_dir).groupBy("grp", "status", "tax").agg(*score.additive_measures())
    pivot = each.groupBy("grp").pivot("status", ["F", "O"]).agg(F.avg("rmse"))
    spread = each.groupBy("grp").agg(F.stddev_samp("rmse").alias("std"), F.count("*").alias("n"))
    return rounded(pivot.join(spread, "grp").withColumnsRenamed({"F": "run_f", "O": "run_o"}))


@query("m23_weighted_summary", f"WITH {SCORED} SELECT grp, round(sum(crps * weight) / sum(weight), 6) AS crps, round(sum(nll * weight) / sum(weight), 6) AS nll, round(sum(CASE WHEN abs(z) <= 1 THEN weight ELSE 0 END) / sum(weight), 6) AS coverage FROM scored GROUP BY grp")
def m23_weighted_summary(spark, sf_dir):
    inside = F.when(F.abs("z") <= 1, 1.0).otherwise(0.0)
    return rounded(_pred(spark, sf_dir).groupBy("grp").agg(score.weighted_mean("crps", "weight").alias("crps"), score.weighted_mean("nll", "weight").alias("nll"), score.weighted_mean(inside, "weight").alias("coverage")))


@query("m23_weighted_reliability", f"WITH {SCORED}, {LEVELS_SQL} SELECT round(level, 6) AS level, round(sum(CASE WHEN pit <= level THEN weight ELSE 0 END) / sum(weight), 6) AS share, round(abs(sum(CASE WHEN pit <= level THEN weight ELSE 0 END) / sum(weight) - level), 6) AS error FROM scored CROSS JOIN lv GROUP BY level")
def m23_weighted_reliability(spark, sf_dir):
    return rounded(score.reliability(_pred(spark, sf_dir), weight="weight"))


@query("m24_calibration_with_mean", f"WITH {SCORED}, c AS (SELECT grp, avg(crps) AS crps, avg(nll) AS nll FROM scored GROUP BY grp) SELECT grp, round(crps, 6) AS crps, round(nll, 6) AS nll FROM c UNION ALL SELECT 'mean', round(avg(crps), 6), round(avg(nll), 6) FROM c")
def m24_calibration_with_mean(spark, sf_dir):
    each = _pred(spark, sf_dir).groupBy("grp").agg(F.avg("crps").alias("crps"), F.avg("nll").alias("nll"))
    return rounded(each.unionByName(each.agg(F.avg("crps").alias("crps"), F.avg("nll").alias("nll")).withColumn("grp", F.lit("mean"))))


BINNED = V_PRED + ", pb AS (SELECT *, least(floor(truth / 10000), 9)::INT AS bin, mu - truth AS resid FROM v_pred)"


@query("a32_residual_band", f"WITH {BINNED} SELECT bin, count(*) AS n, round(quantile_cont(resid, 0.1), 6) AS p10, round(median(resid), 6) AS p50, round(quantile_cont(resid, 0.9), 6) AS p90 FROM pb GROUP BY bin HAVING count(*) >= 10")
def a32_residual_band(spark, sf_dir):
    df = _pred(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("truth") / 10000), F.lit(9)).cast("int"))
    return rounded(df.groupBy("bin").agg(F.count("*").alias("n"), *[F.percentile("resid", F.lit(p)).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))]).filter("n >= 10"))


@query("a33_sliced_error_table", f"WITH {SCORED}, {SLICES} SELECT grp, slice, count(*) AS n_points, round(sqrt(avg(resid * resid)), 6) AS rmse, round(sqrt(avg(resid * resid)) - avg(sigma), 6) AS rmse_less_sigma FROM sl GROUP BY 1, 2")
def a33_sliced_error_table(spark, sf_dir):
    rmse = F.sqrt(F.avg(F.col("resid") * F.col("resid")))
    return rounded(_slices(spark, sf_dir).groupBy("grp", "slice").agg(F.count("*").alias("n_points"), rmse.alias("rmse"), (rmse - F.avg("sigma")).alias("rmse_less_sigma")))


@query("j16_paired_comparison", f"WITH {SCORED}, a AS (SELECT part, sqrt(avg(resid * resid)) AS r FROM scored WHERE status = 'F' GROUP BY 1), b AS (SELECT part, sqrt(avg(resid * resid)) AS r FROM scored WHERE status = 'O' GROUP BY 1) SELECT count(*) AS n_pairs, round(avg(b.r - a.r), 6) AS mean_delta, count(*) FILTER (b.r < a.r) AS n_better FROM a JOIN b USING (part)")
def j16_paired_comparison(spark, sf_dir):
    each = _pred(spark, sf_dir).groupBy("part").agg(*[F.sqrt(F.avg(F.when(F.col("status") == s, F.col("resid") * F.col("resid")))).alias(s) for s in ("F", "O")])
    each = each.dropna(subset=["F", "O"])
    return rounded(each.agg(F.count("*").alias("n_pairs"), F.avg(F.col("O") - F.col("F")).alias("mean_delta"), F.count_if(F.col("O") < F.col("F")).alias("n_better")))


@query("j17_metric_deltas", f"WITH {SCORED}, c AS (SELECT grp, sqrt(avg(resid * resid) FILTER (status = 'F' AND tax < 0.04)) AS a, sqrt(avg(resid * resid) FILTER (status = 'F' AND tax >= 0.04)) AS b, sqrt(avg(resid * resid) FILTER (status = 'O' AND tax < 0.04)) AS c, sqrt(avg(resid * resid) FILTER (status = 'O' AND tax >= 0.04)) AS d FROM scored GROUP BY grp) SELECT grp, round(c - a, 6) AS data_effect, round(b - a, 6) AS model_effect, round(d - b - c + a, 6) AS interaction FROM c")
def j17_metric_deltas(spark, sf_dir):
    cell = lambda s, low: F.sqrt(F.avg(F.when((F.col("status") == s) & ((F.col("tax") < 0.04) == low), F.col("resid") * F.col("resid"))))
    c = _pred(spark, sf_dir).groupBy("grp").agg(cell("F", True).alias("a"), cell("F", False).alias("b"), cell("O", True).alias("c"), cell("O", False).alias("d"))
    return rounded(c.select("grp", (F.col("c") - F.col("a")).alias("data_effect"), (F.col("b") - F.col("a")).alias("model_effect"), (F.col("d") - F.col("b") - F.col("c") + F.col("a")).alias("interaction")))
