"""Queries of reshaping, features, sources and pixel reductions, with the same answers as SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions import models
from tracelake.functions.scalars import clean_number, first_known
from tracelake.operators import align, pixels, reshape, runs, support
from tracelake.plans.registry import Registry, rounded
from tracelake.plans.series_queries import CLEAN, _cleaned
from tracelake.sources.design import expand_design
from tracelake.plans.views import KEYS, V_FITS, V_FRAMES, V_PIXELS, V_POINTS, V_SERIES, load, v_fits, v_frames, v_pixels, v_points, v_series, v_wide

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


N_FRAMES = 64


@query("a1_long_to_wide", f"WITH {V_FRAMES} SELECT vec_id, {', '.join(f'round(max(v) FILTER (pos = {k}), 6) AS v_{k:03d}' for k in range(N_FRAMES))} FROM v_frames GROUP BY vec_id")
def a1_long_to_wide(spark, sf_dir):
    return rounded(reshape.to_columns(v_frames(spark, sf_dir), ["vec_id"], "pos", "v", N_FRAMES, "v"))


@query("a2_wide_to_long", f"WITH {V_FRAMES} SELECT vec_id, pos, round(v, 6) AS v FROM v_frames")
def a2_wide_to_long(spark, sf_dir):
    wide = v_wide(spark, sf_dir).select("vec_id", *[F.col("series")[k].alias(f"v_{k:03d}") for k in range(N_FRAMES)])
    return rounded(reshape.from_columns(wide, ["vec_id"], "v", "v"))


@query("a2_condition_id", f"WITH {V_FITS}, k AS (SELECT grp, status, dense_rank() OVER (ORDER BY grp, status) - 1 AS id FROM (SELECT DISTINCT grp, status FROM v_fits)) SELECT id::INT AS id, count(*) AS n FROM v_fits JOIN k USING (grp, status) GROUP BY 1")
def a2_condition_id(spark, sf_dir):
    return reshape.dense_id(v_fits(spark, sf_dir), ["grp", "status"], "id").groupBy("id").agg(F.count("*").alias("n"))


@query("a3_flatten_series", f"WITH {V_SERIES} SELECT cond, traj, pos, round(time, 6) AS time, round(value, 6) AS value FROM v_series")
def a3_flatten_series(spark, sf_dir):
    wide = reshape.to_sequences(v_series(spark, sf_dir), KEYS, "pos", ["time", "value"])
    flat = wide.select(*KEYS, F.posexplode("series").alias("p", "s")).select(*KEYS, F.col("s")["pos"].alias("pos"), F.col("s")["time"].alias("time"), F.col("s")["value"].alias("value"))
    return rounded(flat)


@query("a10_series_endpoints", f"WITH {V_FRAMES} SELECT vec_id, round(arg_min(v, pos), 6) AS first_v, round(arg_max(v, pos), 6) AS last_v, round(max(v), 6) AS top, min(pos) FILTER (v = m) AS top_pos FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM v_frames) GROUP BY vec_id")
def a10_series_endpoints(spark, sf_dir):
    top = F.max(F.struct("v", (-F.col("pos")).alias("p")))
    return rounded(v_frames(spark, sf_dir).groupBy("vec_id").agg(F.min_by("v", "pos").alias("first_v"), F.max_by("v", "pos").alias("last_v"), F.max("v").alias("top"), (-top["p"]).alias("top_pos")))


@query("a23_stage_effect", f"WITH {CLEAN}, u AS (SELECT 'shift' AS stage, abs(coalesce(v, 0) - 2 * v0) AS d FROM cleaned UNION ALL SELECT 'cut', abs(coalesce(clean, 0) - coalesce(v, 0)) FROM cleaned) SELECT stage, round(avg(d), 5) AS mean, round(median(d), 5) AS median, round(avg((d > 0)::INT), 6) AS affected FROM u GROUP BY stage")
def a23_stage_effect(spark, sf_dir):
    raw = v_series(spark, sf_dir).withColumn("v0", F.greatest(F.col("value") - 60, F.lit(0.0)))
    s1 = align.clean_series(raw, KEYS, "pos", "v0", low=-1e18, high=1e18, scan=3, scale=2.0, out="v").drop("delay")
    s2 = align.clean_series(s1, KEYS, "pos", "v0", low=-120, high=150, scan=3, scale=2.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = s2.select(F.abs(zero(F.col("v")) - 2 * F.col("v0")).alias("shift"), F.abs(zero(F.col("clean")) - zero(F.col("v"))).alias("cut")).unpivot([], ["shift", "cut"], "stage", "d")
    return rounded(rows.groupBy("stage").agg(F.round(F.avg("d"), 5).alias("mean"), F.round(F.median("d"), 5).alias("median"), F.avg((F.col("d") > 0).cast("int")).alias("affected")))


@query("a29_branch_ratio", f"WITH {V_POINTS} SELECT event_id, round((60.0 * pow(time, 0.25)) / (30.0 * sqrt(time)), 6) AS ratio FROM v_points WHERE time > 1 AND abs(time - 8.0) <= 1")
def a29_branch_ratio(spark, sf_dir):
    t = F.col("time")
    return v_points(spark, sf_dir).filter((t > 1) & (F.abs(t - 8.0) <= 1)).select("event_id", F.round(60.0 * F.pow(t, F.lit(0.25)) / (30.0 * F.sqrt(t)), 6).alias("ratio"))


@query("a41_sensitivity_deltas", "WITH m AS (SELECT l_returnflag AS run, l_partkey AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT a.run, count(*) AS n, round(median(a.v - b.v), 4) AS median, round(quantile_cont(a.v - b.v, 0.95), 4) AS p95, round(max(abs(a.v - b.v)), 4) AS worst FROM m a JOIN m b ON a.k = b.k AND b.run = 'N' AND a.run <> 'N' GROUP BY 1")
def a41_sensitivity_deltas(spark, sf_dir):
    m = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("k")).agg(F.avg("l_extendedprice").alias("v"))
    base = m.filter("run = 'N'").select("k", F.col("v").alias("base"))
    d = m.filter("run <> 'N'").join(base, "k").withColumn("d", F.col("v") - F.col("base"))
    return rounded(d.groupBy("run").agg(F.count("*").alias("n"), F.median("d").alias("median"), F.percentile("d", F.lit(0.95)).alias("p95"), F.max(F.abs("d")).alias("worst")), 4)


@query("a42_condition_bins", f"WITH {V_POINTS} SELECT cond, least(floor(time / 5), 5)::INT AS bin, count(*) AS n, round(avg(value), 5) AS mean, round(sqrt(avg(pow(value - 100, 2))), 5) AS rmse FROM v_points GROUP BY 1, 2")
def a42_condition_bins(spark, sf_dir):
    b = F.least(F.floor(F.col("time") / 5), F.lit(5)).cast("int").alias("bin")
    return rounded(v_points(spark, sf_dir).groupBy("cond", b).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sqrt(F.avg(F.pow(F.col("value") - 100, F.lit(2.0)))).alias("rmse")), 5)


@query("j2_merge_sources", "WITH a AS (SELECT l_partkey AS k, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), c AS (SELECT l_partkey AS k, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, round(a.q, 6) AS a_q, round(b.q, 6) AS n_q, round(c.q, 6) AS r_q FROM a JOIN b USING (k) JOIN c USING (k)")
def j2_merge_sources(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    one = lambda f: li.filter(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_quantity").alias("q"))
    return rounded(reshape.merge_sources({"a": one("A"), "n": one("N"), "r": one("R")}, ["k"]))


SIDE = "try_cast(json_extract_string(props, '$.k') AS DOUBLE)"


@query("s1_sidecar_metadata", f"SELECT event_id, {SIDE} AS k, coalesce({SIDE}, 0) AS k_known FROM events")
def s1_sidecar_metadata(spark, sf_dir):
    side = clean_number(F.get_json_object("props", "$.k"))
    return load(spark, sf_dir, "events").select("event_id", side.alias("k"), first_known(side, F.lit(0.0)).alias("k_known"))


@query("s16_schema_parity", f"SELECT event_type, count(*) AS n, count(*) FILTER (array_to_string(json_keys(props), ',') = 'k') AS n_keys, count({SIDE}) AS n_numbers FROM events GROUP BY 1")
def s16_schema_parity(spark, sf_dir):
    keys = F.array_join(F.json_object_keys("props"), ",")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(keys == "k").alias("n_keys"), F.count(clean_number(F.get_json_object("props", "$.k"))).alias("n_numbers"))


@query("j21_attach_sidecar", f"WITH s AS (SELECT user_id, max({SIDE}) AS k FROM events WHERE event_type = 'click' GROUP BY 1) SELECT e.event_type, count(*) AS n, round(avg(coalesce(k, -1)), 6) AS mean_k FROM events e LEFT JOIN s USING (user_id) GROUP BY 1")
def j21_attach_sidecar(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    side = e.filter("event_type = 'click'").groupBy("user_id").agg(F.max(clean_number(F.get_json_object("props", "$.k"))).alias("k"))
    return rounded(e.join(side, "user_id", "left").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.coalesce("k", F.lit(-1.0))).alias("mean_k")))


@query("s2_tagged_union", "SELECT 'customer' AS experiment, count(*) AS n, count(segment) AS n_segment, count(acct) AS n_acct FROM (SELECT c_mktsegment AS segment, c_acctbal AS acct FROM customer) UNION ALL SELECT 'supplier', count(*), 0, count(s_acctbal) FROM supplier")
def s2_tagged_union(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acct"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acct"))
    out = reshape.union_all([c, s], "experiment", ["customer", "supplier"])
    return out.groupBy("experiment").agg(F.count("*").alias("n"), F.count("segment").alias("n_segment"), F.count("acct").alias("n_acct"))


@query("s5_cartesian_design", "SELECT (row_number() OVER (ORDER BY s, p, q) - 1)::INT AS id, a AS segment, b AS priority, c AS status FROM (SELECT DISTINCT c_mktsegment AS a, dense_rank() OVER (ORDER BY c_mktsegment) AS s FROM customer) CROSS JOIN (SELECT DISTINCT o_orderpriority AS b, dense_rank() OVER (ORDER BY o_orderpriority) AS p FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus AS c, dense_rank() OVER (ORDER BY o_orderstatus) AS q FROM orders)")
def s5_cartesian_design(spark, sf_dir):
    levels = lambda t, c: load(spark, sf_dir, t).agg(F.array_sort(F.collect_set(c)).alias("v"))
    one = levels("customer", "c_mktsegment").select(F.col("v").alias("segment"), levels("orders", "o_orderpriority").scalar().alias("priority"), levels("orders", "o_orderstatus").scalar().alias("status"))
    return expand_design(one, ["segment", "priority", "status"])


@query("s6_condition_by_id", "SELECT a AS segment, n FROM (SELECT c_mktsegment AS a, count(*) AS n, (row_number() OVER (ORDER BY c_mktsegment) - 1) AS id FROM customer GROUP BY 1) WHERE id = 2")
def s6_condition_by_id(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"))
    return reshape.dense_id(c, ["segment"], "id").filter("id = 2").groupBy("segment").agg(F.count("*").alias("n"))


@query("s7_point_accounting", "SELECT count(*) AS n_rows, count(*) FILTER (value > 0) AS n_kept, count(DISTINCT event_type) AS n_conditions, count(DISTINCT user_id) AS n_traces FROM events")
def s7_point_accounting(spark, sf_dir):
    return load(spark, sf_dir, "events").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value") > 0).alias("n_kept"), F.countDistinct("event_type").alias("n_conditions"), F.countDistinct("user_id").alias("n_traces"))


@query("s11_tidy_results", "SELECT e.event_type, p.name, e.n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e CROSS JOIN (SELECT r_name AS name FROM region) p")
def s11_tidy_results(spark, sf_dir):
    names = load(spark, sf_dir, "region").agg(F.array_sort(F.collect_set("r_name"))).scalar()
    n = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", F.explode(names).alias("name"), "n")


@query("s12_boundary_points", f"WITH {V_PIXELS} SELECT frame, count(*) AS n, string_agg(x::VARCHAR, ',' ORDER BY x) AS xs FROM v_pixels WHERE v > 1.15 GROUP BY frame")
def s12_boundary_points(spark, sf_dir):
    xs = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.cast("string")), ",")
    return v_pixels(spark, sf_dir).filter("v > 1.15").groupBy("frame").agg(F.count("*").alias("n"), xs.alias("xs"))


@query("s13_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def s13_resume(spark, sf_dir):
    done = load(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("s15_design_ranges", "SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1")
def s15_design_ranges(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.countDistinct("p_type").alias("n_types"))


@query("p1_first_known", f"WITH {V_SERIES}, b AS (SELECT *, CASE WHEN value > 110 THEN value END AS x FROM v_series) SELECT cond, traj, round(arg_min(x, pos) FILTER (x IS NOT NULL), 6) AS first_x FROM b GROUP BY 1, 2")
def p1_first_known(spark, sf_dir):
    df = v_series(spark, sf_dir).withColumn("x", F.when(F.col("value") > 110, F.col("value")))
    return rounded(df.groupBy(*KEYS).agg(F.min_by("x", F.when(F.col("x").isNotNull(), F.col("pos"))).alias("first_x")))


@query("p2_fallback_chain", f"SELECT event_id, coalesce(nullif({SIDE}, 0), CASE WHEN value > 100 THEN value END, 1.0) AS v FROM events")
def p2_fallback_chain(spark, sf_dir):
    side = clean_number(F.get_json_object("props", "$.k"))
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif(side, F.lit(0.0)), F.when(F.col("value") > 100, F.col("value")), F.lit(1.0)).alias("v"))


@query("p3_backfill_report", "WITH b AS (SELECT c.*, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS bal, n_regionkey FROM customer c JOIN nation ON c_nationkey = n_nationkey) SELECT n_regionkey AS region, count(*) AS n, count(*) FILTER (bal IS NULL) AS n_filled, round(sum(coalesce(bal, n_regionkey)), 4) AS total FROM b GROUP BY 1")
def p3_backfill_report(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    b = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").withColumn("bal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    return rounded(b.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.count_if(F.col("bal").isNull()).alias("n_filled"), F.sum(F.coalesce("bal", F.col("n_regionkey"))).alias("total")), 4)


@query("p5_scaled_series", f"WITH {V_SERIES} SELECT event_id, round(coalesce(CASE WHEN value > 100 THEN value END, value * 0.8 / cos(radians((180 - 150) / 2.0))), 6) AS mm FROM v_series")
def p5_scaled_series(spark, sf_dir):
    px = F.col("value") * 0.8 / math.cos(math.radians((180 - 150) / 2))
    return v_series(spark, sf_dir).select("event_id", F.round(F.coalesce(F.when(F.col("value") > 100, F.col("value")), px), 6).alias("mm"))


@query("p4_backfill_columns", f"WITH {V_POINTS} SELECT event_id, round(value * 0.25, 6) AS value_mm, round(time * 0.25, 6) AS time_mm FROM v_points")
def p4_backfill_columns(spark, sf_dir):
    df = v_points(spark, sf_dir)
    return rounded(df.withColumns({f"{c}_mm": F.col(c) * 0.25 for c in df.columns if c in ("value", "time")}).select("event_id", "value_mm", "time_mm"))


@query("p6_numeric_coercion", "SELECT c_mktsegment AS grp, count(*) AS n, count(TRY_CAST(right(c_name, 3) AS DOUBLE)) AS n_ok, count(TRY_CAST(c_name AS DOUBLE)) AS n_bad FROM customer GROUP BY 1")
def p6_numeric_coercion(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("n"), F.count(clean_number(F.substring("c_name", -3, 3))).alias("n_ok"), F.count(clean_number(F.col("c_name"))).alias("n_bad"))


@query("p9_ids_from_names", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS id, regexp_extract(c_name, '^([A-Za-z]+)', 1) AS family FROM customer")
def p9_ids_from_names(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long").alias("id"), F.regexp_extract("c_name", "^([A-Za-z]+)", 1).alias("family"))


@query("p10_trajectory_keys", f"WITH {V_POINTS} SELECT DISTINCT cond || '|' || traj::VARCHAR AS key, cond, traj::BIGINT AS traj FROM v_points")
def p10_trajectory_keys(spark, sf_dir):
    key = v_points(spark, sf_dir).select(F.concat_ws("|", "cond", "traj").alias("key")).distinct()
    return key.select("key", F.regexp_extract("key", r"^(.*)\|", 1).alias("cond"), F.regexp_extract("key", r"\|(\d+)$", 1).cast("long").alias("traj"))


@query("p11_block_rule", "SELECT o_orderkey, CASE WHEN floor((o_orderkey - 1) / 5) % 4 = 0 THEN 300 WHEN floor((o_orderkey - 1) / 5) % 4 = 1 THEN 600 ELSE 300 + 100 * (floor((o_orderkey - 1) / 5) % 4) END::BIGINT AS us FROM orders")
def p11_block_rule(spark, sf_dir):
    b = F.floor((F.col("o_orderkey") - 1) / 5) % 4
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(b == 0, 300).when(b == 1, 600).otherwise(300 + 100 * b).cast("long").alias("us"))


REG = "reg AS (SELECT * FROM (VALUES (10.0, 1.0), (20.0, 2.0), (30.0, 3.5)) AS t(dens, pres))"


@query("p12_canonical_state", f"WITH {REG}, s AS (SELECT p_partkey, p_size::DOUBLE AS raw FROM part), d AS (SELECT s.*, (SELECT pres FROM reg WHERE dens = raw) AS by_dens, (SELECT max(dens) FROM reg WHERE abs(pres - raw) <= 1e-6) AS by_pres FROM s) SELECT p_partkey, coalesce(by_dens, CASE WHEN by_pres IS NOT NULL THEN raw END, raw * 0.11) AS pressure, CASE WHEN by_dens IS NOT NULL THEN 'density' WHEN by_pres IS NOT NULL THEN 'pressure' ELSE 'linear' END AS source FROM d")
def p12_canonical_state(spark, sf_dir):
    reg = F.array(*[F.struct(F.lit(a).alias("dens"), F.lit(b).alias("pres")) for a, b in ((10.0, 1.0), (20.0, 2.0), (30.0, 3.5))])
    s = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("raw"))
    dens = F.get(F.filter(reg, lambda r: r["dens"] == F.col("raw")), F.lit(0))["pres"]
    pres = F.exists(reg, lambda r: F.abs(r["pres"] - F.col("raw")) <= 1e-6)
    return s.select("p_partkey", F.coalesce(dens, F.when(pres, F.col("raw")), F.col("raw") * 0.11).alias("pressure"), F.when(dens.isNotNull(), "density").when(pres, "pressure").otherwise("linear").alias("source"))


FEATURES = "ft AS (SELECT p_partkey, p_retailprice - 300 AS dp, 10.0 + p_size AS rho, 0.1 + (p_partkey % 5) / 10.0 AS d FROM part)"


def _features(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_retailprice") - 300).alias("dp"), (10.0 + F.col("p_size")).alias("rho"), (0.1 + (F.col("p_partkey") % 5) / 10.0).alias("d"))


@query("p13_canonical_features", f"WITH {FEATURES} SELECT p_partkey, CASE WHEN dp > 0 THEN round(ln(dp), 6) END AS log_dp, round(ln(rho), 6) AS log_rho, round(ln(d), 6) AS log_d, dp <= 0 AS rejected FROM ft")
def p13_canonical_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("p_partkey", F.when(F.col("dp") > 0, F.ln("dp")).alias("log_dp"), F.ln("rho").alias("log_rho"), F.ln("d").alias("log_d"), (F.col("dp") <= 0).alias("rejected")))


@query("p14_similarity_scale", f"WITH {FEATURES} SELECT p_partkey, round(pow(dp, 0.5) * pow(rho, -0.25) * sqrt(d), 6) AS a, round(ln(pow(dp, 0.5) * pow(rho, -0.25) * sqrt(d)), 6) AS log_a FROM ft WHERE dp > 0")
def p14_similarity_scale(spark, sf_dir):
    a = models.similarity_scale(F.col("dp"), F.col("rho"), F.col("d"), 0.5)
    return rounded(_features(spark, sf_dir).filter("dp > 0").select("p_partkey", a.alias("a"), F.ln(a).alias("log_a")))


@query("p25_scale_check", f"WITH {FEATURES}, e AS (SELECT pow(dp, 0.5) * pow(rho, -0.25) * sqrt(d) AS a, exp(0.5 * ln(dp) - 0.25 * ln(rho) + 0.5 * ln(d)) AS b FROM ft WHERE dp > 0) SELECT count(*) AS n, max(abs(a - b) / greatest(abs(b), 1e-12)) <= 1e-9 AS ok FROM e")
def p25_scale_check(spark, sf_dir):
    a = models.similarity_scale(F.col("dp"), F.col("rho"), F.col("d"), 0.5)
    b = F.exp(0.5 * F.ln("dp") - 0.25 * F.ln("rho") + 0.5 * F.ln("d"))
    return _features(spark, sf_dir).filter("dp > 0").agg(F.count("*").alias("n"), (F.max(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12))) <= 1e-9).alias("ok"))


@query("p16_feature_variant", f"WITH {FEATURES} SELECT p_partkey, round(ln(rho), 6) AS log_rho, round(d, 6) AS d FROM ft")
def p16_feature_variant(spark, sf_dir):
    variants = {"small": [F.ln("rho").alias("log_rho"), F.col("d")]}
    return rounded(_features(spark, sf_dir).select("p_partkey", *variants["small"]))


@query("p20_prefixed_columns", "SELECT n_nationkey, n_name AS nation_name, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def p20_prefixed_columns(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("key"), F.col("n_name").alias("name"))
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return reshape.merge_sources({"nation": n.withColumnRenamed("n_nationkey", "id"), "region": r}, ["key"]).select(F.col("nation_id").alias("n_nationkey"), "nation_name", "region_name")


@query("p26_evaluation_table", f"WITH {V_POINTS} SELECT event_id, round(time / 10000, 9) AS time_s, round(value, 6) AS truth, 20.0 + traj % 7 AS rho FROM v_points WHERE value IS NOT NULL AND time >= 0")
def p26_evaluation_table(spark, sf_dir):
    df = v_points(spark, sf_dir).filter("value is not null and time >= 0")
    return df.select("event_id", F.round(F.col("time") / 10000, 9).alias("time_s"), F.round("value", 6).alias("truth"), (20.0 + F.col("traj") % 7).alias("rho"))


@query("w13_local_slope_ratio", f"WITH {V_SERIES}, g AS (SELECT *, (lead(value) OVER w - lag(value) OVER w) / (lead(time) OVER w - lag(time) OVER w) AS g FROM v_series WINDOW w AS (PARTITION BY cond, traj ORDER BY pos)), s AS (SELECT *, sum(coalesce(g, 0)) OVER (PARTITION BY cond, traj ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS sm, regr_slope(value, time) OVER (PARTITION BY cond) AS ex FROM g) SELECT cond, traj, pos, round(sm / ex, 3) AS ratio FROM s")
def w13_local_slope_ratio(spark, sf_dir):
    w, whole = W.partitionBy(*KEYS).orderBy("pos"), W.partitionBy("cond")
    g = F.try_divide(F.lead("value").over(w) - F.lag("value").over(w), F.lead("time").over(w) - F.lag("time").over(w))
    df = v_series(spark, sf_dir).withColumn("g", F.coalesce(g, F.lit(0.0)))
    return df.select(*KEYS, "pos", F.round(F.sum("g").over(w.rowsBetween(-1, 1)) / 3 / F.regr_slope("value", "time").over(whole), 3).alias("ratio"))


@query("w23_snap_to_maximum", f"WITH {V_FRAMES}, m AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, first_value(v) OVER p AS f, last_value(v) OVER p AS l FROM v_frames WINDOW w AS (PARTITION BY vec_id ORDER BY pos), p AS (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), mx AS (SELECT vec_id, pos, v FROM m WHERE v > coalesce(a, l) AND v >= coalesce(b, f)), c AS (SELECT mx.*, t.t, least((pos - t.t + 64) % 64, (t.t - pos + 64) % 64) AS dist FROM mx CROSS JOIN (SELECT unnest([0, 16, 32, 48]) AS t) t), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY v DESC, dist, pos) AS k FROM c WHERE dist <= 4) SELECT vec_id, t, pos AS snapped FROM r WHERE k = 1")
def w23_snap_to_maximum(spark, sf_dir):
    w = W.partitionBy("vec_id").orderBy("pos")
    ends = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = v_frames(spark, sf_dir).withColumns({"a": F.coalesce(F.lag("v").over(w), F.last("v").over(ends)), "b": F.coalesce(F.lead("v").over(w), F.first("v").over(ends))})
    peaks = df.filter("v > a and v >= b").withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0, 16, 32, 48)])))
    peaks = peaks.withColumn("dist", F.least(F.pmod(F.col("pos") - F.col("t"), F.lit(64)), F.pmod(F.col("t") - F.col("pos"), F.lit(64)))).filter("dist <= 4")
    best = F.max(F.struct("v", (-F.col("dist")).alias("d"), (-F.col("pos")).alias("p")))
    return peaks.groupBy("vec_id", "t").agg((-best["p"]).alias("snapped"))


@query("w24_profile_cleanup", f"WITH {V_FRAMES}, m AS (SELECT *, max(v) OVER (PARTITION BY vec_id ORDER BY pos) AS mono FROM v_frames) SELECT vec_id, pos, CASE WHEN pos = 0 THEN 0.0 WHEN mono <= 0 OR pos >= 62 THEN NULL ELSE round(mono, 6) END AS clean FROM m")
def w24_profile_cleanup(spark, sf_dir):
    df = v_frames(spark, sf_dir).withColumn("mono", runs.running_max("v", ["vec_id"], "pos"))
    return df.select("vec_id", "pos", F.when(F.col("pos") == 0, 0.0).when((F.col("mono") > 0) & (F.col("pos") < 62), F.round("mono", 6)).alias("clean"))


@query("w30_series_equality", f"WITH {CLEAN}, s AS (SELECT cond, traj, pos, 2 * v0 AS stored FROM cleaned) SELECT cond, count(*) AS n, count(*) FILTER (clean IS NOT NULL AND stored IS NOT NULL AND abs(clean - stored) > 1e-9) AS n_differ, count(*) FILTER (clean IS NULL) AS n_missing, round(max(abs(clean - stored)), 6) AS worst FROM cleaned JOIN s USING (cond, traj, pos) GROUP BY cond")
def w30_series_equality(spark, sf_dir):
    c = _cleaned(spark, sf_dir)
    stored = c.select(*KEYS, "pos", (2 * F.col("v0")).alias("stored"))
    both = c.select(*KEYS, "pos", "clean").join(stored, [*KEYS, "pos"], "full")
    d = F.abs(F.col("clean") - F.col("stored"))
    return rounded(both.groupBy("cond").agg(F.count("*").alias("n"), F.count_if(d > 1e-9).alias("n_differ"), F.count_if(F.col("clean").isNull()).alias("n_missing"), F.max(d).alias("worst")))


@query("w31_audit_assembly", f"WITH {CLEAN} SELECT cond, traj, count(*) AS n, count(clean) AS n_kept, round(max(clean), 6) AS top, round(avg(clean - 2 * v0), 6) AS mean_resid FROM cleaned GROUP BY 1, 2")
def w31_audit_assembly(spark, sf_dir):
    return rounded(_cleaned(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.count("clean").alias("n_kept"), F.max("clean").alias("top"), F.avg(F.col("clean") - 2 * F.col("v0")).alias("mean_resid")))


@query("w32_positions", f"WITH {V_SERIES} SELECT event_id, pos FROM v_series")
def w32_positions(spark, sf_dir):
    return v_series(spark, sf_dir).select("event_id", "pos")


@query("w35_regime_weights", f"WITH {V_POINTS}, w AS (SELECT * FROM (VALUES (0, 1.0), (1, 0.5)) AS t(half, w)) SELECT cond, round(sum(coalesce(w.w, 0.1)), 6) AS total FROM v_points LEFT JOIN w ON w.half = floor(bin / 10) GROUP BY cond")
def w35_regime_weights(spark, sf_dir):
    w = spark.createDataFrame([(0, 1.0), (1, 0.5)], "half long, w double")
    return rounded(v_points(spark, sf_dir).withColumn("half", F.floor(F.col("bin") / 10)).join(F.broadcast(w), "half", "left").groupBy("cond").agg(F.sum(F.coalesce("w", F.lit(0.1))).alias("total")))


@query("t3_selected_rows", f"WITH {V_FITS}, d AS (SELECT *, abs(price - median(price) OVER (PARTITION BY grp)) AS d FROM v_fits), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY d, o_orderkey) AS k FROM d) SELECT dense_rank() OVER (ORDER BY grp) - 1 AS id, grp, o_orderkey, k = 1 AS representative FROM r WHERE k <= 5")
def t3_selected_rows(spark, sf_dir):
    d = support.nearest_to_median(v_fits(spark, sf_dir), ["grp"], "price")
    r = d.withColumn("k", F.row_number().over(W.partitionBy("grp").orderBy("_d", "o_orderkey"))).filter("k <= 5")
    return reshape.dense_id(r, ["grp"], "id").select("id", "grp", "o_orderkey", (F.col("k") == 1).alias("representative"))


# pixel reductions: frame = vector, position on a line, or on an 8 by 8 square


def _square(spark, sf_dir):
    return v_pixels(spark, sf_dir).select("frame", (F.col("x") % 8).alias("x"), F.floor(F.col("x") / 8).alias("y"), "v")


SQ = V_PIXELS + ", sq AS (SELECT frame, x % 8 AS x, x // 8 AS y, v FROM v_pixels)"


@query("v1_angular_density", f"WITH {SQ}, a AS (SELECT *, degrees(atan2(y - 3.5, x - 3.5)) AS d FROM sq), b AS (SELECT frame, least(floor((CASE WHEN d < 0 THEN d + 360 ELSE d END) / 30.0), 11)::INT AS bin, v FROM a) SELECT frame, bin, round(sum(v), 5) AS total, round(avg(v), 5) AS mean, count(*) AS n FROM b GROUP BY 1, 2")
def v1_angular_density(spark, sf_dir):
    return rounded(pixels.angular_density(_square(spark, sf_dir), ["frame"], "x", "y", "v", 3.5, 3.5, 12), 5)


@query("v2_harmonic_phase", f"WITH {V_PIXELS} SELECT frame, round(-atan2(-sum(v * sin(x::DOUBLE * {2 * math.pi * 4 / 64!r}::DOUBLE)), sum(v * cos(x::DOUBLE * {2 * math.pi * 4 / 64!r}::DOUBLE))), 5) AS phase FROM v_pixels GROUP BY frame")
def v2_harmonic_phase(spark, sf_dir):
    return rounded(pixels.harmonic_phase(v_pixels(spark, sf_dir), ["frame"], "x", "v", 64, 4), 5)


@query("v3_sector_occupancy", f"WITH {V_PIXELS} SELECT frame, (((x - 4) % 64 + 64) % 64) // 16 AS sector, count(*) FILTER (v > 1.0) * 5.625 AS degrees FROM v_pixels GROUP BY 1, 2")
def v3_sector_occupancy(spark, sf_dir):
    sector = F.floor(F.pmod(F.col("x") - 4, F.lit(64)) / 16)
    return v_pixels(spark, sf_dir).groupBy("frame", sector.alias("sector")).agg((F.count_if(F.col("v") > 1.0) * 5.625).alias("degrees"))


@query("v4_time_distance_map", f"WITH {V_PIXELS} SELECT frame // 50 AS block, x, round(sum(v), 5) AS energy, round(sum(v) / sum(sum(v)) OVER (PARTITION BY frame // 50), 6) AS share FROM v_pixels GROUP BY 1, 2")
def v4_time_distance_map(spark, sf_dir):
    e = v_pixels(spark, sf_dir).groupBy(F.floor(F.col("frame") / 50).alias("block"), "x").agg(F.sum("v").alias("energy"))
    return e.select("block", "x", F.round("energy", 5).alias("energy"), F.round(F.col("energy") / F.sum("energy").over(W.partitionBy("block")), 6).alias("share"))


@query("v5_peak_and_delay", f"WITH {V_PIXELS}, e AS (SELECT x, sum(v) AS e FROM v_pixels GROUP BY 1), d AS (SELECT *, e - lag(e) OVER (ORDER BY x) AS de FROM e) SELECT arg_max(x, e) AS peak, min(x) FILTER (de > 5) AS delay FROM d")
def v5_peak_and_delay(spark, sf_dir):
    e = v_pixels(spark, sf_dir).groupBy("x").agg(F.sum("v").alias("e"))
    d = e.withColumn("de", F.col("e") - F.lag("e").over(W.orderBy("x")))
    return d.agg(F.max_by("x", "e").alias("peak"), F.min(F.when(F.col("de") > 5, F.col("x"))).alias("delay"))


@query("v6_front", f"WITH {V_PIXELS}, b AS (SELECT *, greatest(v - quantile_cont(v, 0.1) OVER (PARTITION BY frame), 0) AS b FROM v_pixels), r AS (SELECT *, sum(b) OVER (PARTITION BY frame ORDER BY x) AS run, sum(b) OVER (PARTITION BY frame) AS tot FROM b) SELECT frame, min(x) FILTER (tot > 0 AND run >= 0.9 * tot) AS front FROM r GROUP BY frame")
def v6_front(spark, sf_dir):
    return pixels.front(v_pixels(spark, sf_dir), "frame", "x", "v", 0.9)


@query("v7_background", f"WITH {V_PIXELS}, m AS (SELECT x, median(v) AS m FROM v_pixels WHERE frame < 100 GROUP BY 1) SELECT frame, round(sum(greatest(v - m, 0)), 5) AS net FROM v_pixels JOIN m USING (x) GROUP BY frame")
def v7_background(spark, sf_dir):
    return rounded(pixels.less_background(v_pixels(spark, sf_dir), "frame", "x", "v", 100).groupBy("frame").agg(F.sum("net").alias("net")), 5)


@query("v8_temporal_range", f"WITH {V_PIXELS} SELECT x, round(max(v) - min(v), 6) AS span FROM v_pixels GROUP BY x")
def v8_temporal_range(spark, sf_dir):
    return rounded(v_pixels(spark, sf_dir).groupBy("x").agg((F.max("v") - F.min("v")).alias("span")))


HIST = V_PIXELS + ", h AS (SELECT x, least(greatest(floor((v - 0.5) / (1.0 / 32)), 0), 31)::INT AS bin, count(*) AS n FROM v_pixels GROUP BY 1, 2)"


def _hist(spark, sf_dir):
    return pixels.histogram(v_pixels(spark, sf_dir), ["x"], "v", 0.5, 1.5, 32)


@query("v9_percentile_level", f"WITH {HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY x ORDER BY bin) AS run, sum(n) OVER (PARTITION BY x) AS tot FROM h) SELECT x, min(bin) AS level FROM r WHERE run >= 0.9 * tot GROUP BY x")
def v9_percentile_level(spark, sf_dir):
    return pixels.percentile_level(_hist(spark, sf_dir), ["x"], 0.9)


@query("v9_triangle_level", f"WITH {HIST}, p AS (SELECT *, first_value(bin) OVER (PARTITION BY x ORDER BY n DESC, bin) AS px, max(n) OVER (PARTITION BY x) AS py, max(bin) OVER (PARTITION BY x) AS ex, first_value(n) OVER (PARTITION BY x ORDER BY bin DESC) AS ey FROM h), g AS (SELECT *, py + (ey - py) * coalesce((bin - px)::DOUBLE / nullif(ex - px, 0), 0) - n AS gap FROM p WHERE bin >= px), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY gap DESC, bin) AS k FROM g) SELECT x, bin AS level FROM k WHERE k = 1")
def v9_triangle_level(spark, sf_dir):
    return pixels.triangle_level(_hist(spark, sf_dir), ["x"])


@query("v10_ring_region", f"WITH {SQ} SELECT frame, count(*) AS n, round(avg(v), 6) AS mean FROM sq WHERE (x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) BETWEEN 2.0 AND 10.0 AND abs(y - 3.5) <= 2 * abs(x - 3.5) GROUP BY frame")
def v10_ring_region(spark, sf_dir):
    dx, dy = F.col("x") - 3.5, F.col("y") - 3.5
    inside = (dx * dx + dy * dy).between(2.0, 10.0) & (F.abs(dy) <= 2 * F.abs(dx))
    return rounded(_square(spark, sf_dir).filter(inside).groupBy("frame").agg(F.count("*").alias("n"), F.avg("v").alias("mean")))


@query("v11_binary_measures", f"WITH {SQ}, c AS (SELECT frame, x, count(*) AS w FROM sq WHERE v > 1.05 GROUP BY 1, 2), o AS (SELECT frame, sum(w)::BIGINT AS area, max(x) FILTER (w >= 2) AS reach, sum(w * w) * {math.pi / 4!r} AS volume FROM c GROUP BY 1) SELECT f.frame, coalesce(area, 0) AS area, reach, round(coalesce(volume, 0), 6) AS volume FROM (SELECT DISTINCT frame FROM sq) f LEFT JOIN o USING (frame)")
def v11_binary_measures(spark, sf_dir):
    return rounded(pixels.binary_measures(_square(spark, sf_dir), "frame", "x", F.col("v") > 1.05, 2))


@query("v12_boundary_measures", f"WITH {SQ}, e AS (SELECT frame, x, max(y) AS top FROM sq WHERE v > 1.05 GROUP BY 1, 2) SELECT frame, round(max(sqrt(x * x + top * top)), 6) AS reach, round(avg(atan2(top, x + 1)), 6) AS mean_angle, round(sum((x + 1) * top) / sum((x + 1) * (x + 1)), 6) AS slope FROM e WHERE x BETWEEN 1 AND 6 GROUP BY frame")
def v12_boundary_measures(spark, sf_dir):
    edge = _square(spark, sf_dir).filter("v > 1.05").groupBy("frame", "x").agg(F.max("y").alias("top")).filter("x between 1 and 6")
    x, top = F.col("x").cast("double"), F.col("top").cast("double")
    return rounded(edge.groupBy("frame").agg(F.max(F.sqrt(x * x + top * top)).alias("reach"), F.avg(F.atan2(top, x + 1)).alias("mean_angle"), (F.sum((x + 1) * top) / F.sum((x + 1) * (x + 1))).alias("slope")))


@query("v13_open_close", f"WITH {V_PIXELS}, t AS (SELECT frame // 100 AS block, frame % 100 AS pos, sum(v) AS s FROM v_pixels WHERE x < 8 GROUP BY 1, 2), l AS (SELECT *, coalesce(last_value(CASE WHEN s >= 8.2 THEN 1 WHEN s < 7.9 THEN 0 END IGNORE NULLS) OVER (PARTITION BY block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS f FROM t), r AS (SELECT *, sum(c) OVER (PARTITION BY block ORDER BY pos) AS r FROM (SELECT *, CASE WHEN f <> lag(f) OVER (PARTITION BY block ORDER BY pos) THEN 1 ELSE 0 END AS c FROM l)), i AS (SELECT block, min(pos) AS a, max(pos) AS b, count(*) AS n FROM r WHERE f GROUP BY block, r.r), k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, a) AS k FROM i) SELECT d.block, a AS start, b AS end, n AS length FROM (SELECT DISTINCT block FROM t) d LEFT JOIN k ON k.block = d.block AND k.k = 1")
def v13_open_close(spark, sf_dir):
    t = v_pixels(spark, sf_dir).filter("x < 8").groupBy(F.floor(F.col("frame") / 100).alias("block"), (F.col("frame") % 100).alias("pos")).agg(F.sum("v").alias("s"))
    return runs.longest_true(runs.hysteresis(t, ["block"], "pos", "s", 7.9, 8.2), ["block"], "pos", "latched")


@query("v14_region_stats", f"WITH {SQ} SELECT frame % 20 AS label, count(*) AS volume, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM sq WHERE v > 1.1 GROUP BY 1")
def v14_region_stats(spark, sf_dir):
    return rounded(pixels.region_stats(_square(spark, sf_dir).filter("v > 1.1").withColumn("label", F.col("frame") % 20), "label", "x", "y"))


@query("v15_brightness_clusters", f"""WITH {V_PIXELS}, e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 256 AS w FROM v_pixels), c AS (SELECT v, least(floor((v - lo) / w), 255)::INT AS cell FROM v_pixels, e),
h AS (SELECT i AS cell, count(v) AS n, coalesce(sum(v), 0) AS s, coalesce(sum(v * v), 0) AS q FROM (SELECT unnest(range(256))::INT AS i) LEFT JOIN c ON cell = i GROUP BY i),
p AS (SELECT cell, sum(n) OVER o AS n, sum(s) OVER o AS s, sum(q) OVER o AS q FROM h WINDOW o AS (ORDER BY cell)),
k AS (SELECT i.cell AS i, j.cell AS j, i.q - i.s * i.s / i.n + (j.q - i.q - CASE WHEN j.n > i.n THEN (j.s - i.s) * (j.s - i.s) / (j.n - i.n) ELSE 0 END) + (t.q - j.q - CASE WHEN t.n > j.n THEN (t.s - j.s) * (t.s - j.s) / (t.n - j.n) ELSE 0 END) AS cost
  FROM p i JOIN p j ON i.cell < j.cell JOIN p t ON t.cell = 255 WHERE j.cell < 255),
b AS (SELECT i, j FROM k ORDER BY cost, j, i LIMIT 1)
SELECT (cell > i)::INT + (cell > j)::INT AS label, round(avg(v), 6) AS centre, count(*) AS n FROM c, b GROUP BY 1""")
def v15_brightness_clusters(spark, sf_dir):
    out = pixels.brightness_clusters(v_pixels(spark, sf_dir), "v", 3)
    return out.groupBy("label").agg(F.round(F.avg("v"), 6).alias("centre"), F.count("*").alias("n"))
