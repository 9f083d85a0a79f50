"""Queries of sources, sinks and streams over the given tables, with the same answers as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.sources import design, recordings, trees
from tracelake.streaming import arrivals
from tracelake.plans.registry import Registry, rounded
from tracelake.plans.views import KEYS, V_POINTS, V_SERIES, load, v_points, v_series

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("s8_points_round_trip", f"WITH {V_POINTS} SELECT event_id, cond, traj, round(time, 6) AS time, round(value, 6) AS value FROM v_points")
def s8_points_round_trip(spark, sf_dir):
    path = recordings.scratch(spark, "points")
    recordings.write_points(rounded(v_points(spark, sf_dir).select("event_id", *KEYS, "time", "value")), path)
    return spark.read.parquet(path)


@query("s9_partitioned_tables", f"WITH {V_POINTS} SELECT t AS name, cond, count(*) AS n FROM (SELECT 'all' AS t, cond, value FROM v_points UNION ALL SELECT 'clean', cond, value FROM v_points WHERE value < 160 UNION ALL SELECT 'flagged', cond, value FROM v_points WHERE value >= 160) GROUP BY 1, 2")
def s9_partitioned_tables(spark, sf_dir):
    root, points = recordings.scratch(spark, "tables"), v_points(spark, sf_dir).select("event_id", "cond", "value")
    recordings.write_tables({"all": points, "clean": points.filter("value < 160"), "flagged": points.filter("value >= 160")}, root, ["cond"])
    parts = [spark.read.parquet(f"{root}/{t}").groupBy("cond").agg(F.count("*").alias("n")).withColumn("name", F.lit(t)) for t in ("all", "clean", "flagged")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s3_split_tables", f"WITH {V_POINTS} SELECT cond, count(*) AS n FROM v_points WHERE value < 160 AND cond IN ('click', 'view') GROUP BY cond")
def s3_split_tables(spark, sf_dir):
    root = recordings.scratch(spark, "splits")
    points = v_points(spark, sf_dir).select("event_id", "cond", F.when(F.col("value") < 160, "clean").otherwise("truncated").alias("split"))
    recordings.write_points(points, root, ["split", "cond"])
    return spark.read.parquet(root).filter("split = 'clean' and cond in ('click', 'view')").groupBy("cond").agg(F.count("*").alias("n"))


@query("s10_append_master", "SELECT c_mktsegment AS grp, 2 * count(*) AS n FROM customer GROUP BY 1")
def s10_append_master(spark, sf_dir):
    path, rows = recordings.scratch(spark, "master"), load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("grp"))
    recordings.append_master(rows, path)
    return recordings.append_master(rows, path).groupBy("grp").agg(F.count("*").alias("n"))


BLOCK = 20


def _recording_tree(spark, sf_dir) -> str:
    """All trajectories as wide CSV files, one file per condition and block of 20 trajectories.

    A folder is named by the hexadecimal condition, which any text can be, and the block.
    """
    root = recordings.scratch(spark, "recordings")
    block = F.floor(F.col("traj") / BLOCK).cast("long")
    s = v_series(spark, sf_dir).select(F.concat_ws("-", F.coalesce(F.hex("cond"), F.lit("null")), block).alias("key"), F.col("pos").alias("frame_idx"), "traj", F.pmod("traj", F.lit(BLOCK)).alias("plume"), "value")
    wide = s.groupBy("key", "frame_idx").pivot("plume", list(range(BLOCK))).agg(F.first("value")).withColumnsRenamed({str(k): f"pen_plume_{k}" for k in range(BLOCK)})
    wide.repartition("key").write.partitionBy("key").option("header", True).csv(f"{root}/lab/cdf")
    return root


def _named(df):
    """``df`` with the condition as folder, and the block, both from the folder's name."""
    name = F.split(F.regexp_replace("folder", "^key=", ""), "-", 2)
    return df.withColumns({"folder": F.when(name[0] != "null", F.unhex(name[0]).cast("string")), "block": name[1].cast("long")})


def _long(spark, sf_dir):
    """(folder, plume_idx, n, total) of all trajectories, by their ids."""
    long = _named(recordings.to_long(recordings.read_wide(spark, _recording_tree(spark, sf_dir))))
    traj = (F.col("block") * BLOCK + F.col("plume_idx")).cast("int").alias("plume_idx")
    return rounded(long.groupBy("folder", traj).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 5)


def _files(spark, sf_dir):
    """(folder, block) of each file of the tree."""
    return _named(recordings.inventory(spark, _recording_tree(spark, sf_dir), "*.csv", 1).filter("n_bytes > 0"))


@query("s1_recordings_to_long", f"WITH {V_SERIES} SELECT cond AS folder, traj::INT AS plume_idx, count(*) AS n, round(sum(value), 5) AS total FROM v_series GROUP BY 1, 2")
def s1_recordings_to_long(spark, sf_dir):
    return _long(spark, sf_dir)


@query("s14_inventory", f"SELECT event_type AS folder, count(DISTINCT user_id // {BLOCK}) AS n_files FROM events GROUP BY 1")
def s14_inventory(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("folder").agg(F.sum("n_files").alias("n_files"))


def _sidecar_tree(spark, sf_dir) -> tuple:
    """(root, names and bytes written): lab-<condition>/cdf/T<n>/rec<traj>.csv with sidecars beside them, some missing, broken or odd."""
    root = recordings.scratch(spark, "tree")
    s = v_series(spark, sf_dir).filter("cond is not null and traj is not null").select(F.hex("cond").alias("cond"), "traj", "pos", "value")
    #: the camera's rate is on the rows from the third frame on, twice the one in the sidecar
    line = F.concat_ws(",", "pos", F.coalesce(F.col("value").cast("string"), F.lit("")), F.when(F.col("pos") >= 2, (F.col("traj") * 2.0 + F.col("pos") / 8).cast("string")).otherwise(""))
    stem = F.concat(F.lit("lab-"), "cond", F.lit("/cdf/T"), F.pmod("traj", F.lit(5)), F.lit("/rec"), "traj")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    csv = s.groupBy("cond", "traj").agg(lines.alias("lines")).select(F.concat(stem, F.lit(".csv")).alias("name"), F.concat(F.lit("frame_idx,pen_plume_0,fps\n"), "lines", F.lit("\n")).alias("content"))
    t = F.col("traj")
    n = F.pmod(t, F.lit(3)).cast("int")
    widths = F.transform(F.sequence(F.lit(0), n), lambda i: i * 2.5 + 10)
    total = F.aggregate(widths, F.lit(0.0), lambda a, x: a + x) + F.when(t % 17 == 0, 5.0).otherwise(0.25)
    fields = F.struct(
        F.when(t % 19 != 0, F.lit(1.0)).alias("plumes"), F.when(t % 6 != 1, t.cast("double")).alias("fps"), (F.pmod(t, F.lit(4)) * 100.0).alias("injection_pressure_bar"), (F.pmod(t, F.lit(3)) * 5.0).alias("chamber_pressure_bar"),
        (300.0 + F.pmod(t, F.lit(9)) * 50).alias("injection_duration_us"), (n + 1 + F.when(t % 13 == 0, 1).otherwise(0)).alias("occupied_angle_segment_count"), widths.alias("occupied_angle_segment_widths_deg"), total.alias("occupied_angle_total_deg"),
    )
    meta = s.select("cond", "traj").distinct().filter("traj % 7 <> 0").select(F.concat(stem, F.lit(".meta.json")).alias("name"), F.when(t % 11 == 0, '{"fps": ').otherwise(F.to_json(fields)).alias("content"))
    written = trees.write_files(csv.unionByName(meta), root)
    return root, written


def _dataset(c: str = "dataset"):
    return F.unhex(F.substring(c, 5, 1000)).cast("string").alias("cond")


@query("s1_sidecar_join", f"WITH {V_SERIES} SELECT cond, traj, count(*) AS n, round(sum(value), 5) AS total, CASE WHEN traj % 7 <> 0 AND traj % 11 <> 0 AND traj % 6 <> 1 THEN traj::DOUBLE WHEN count(*) > 2 THEN traj * 2.0 + 0.25 END AS fps FROM v_series GROUP BY 1, 2")
def s1_sidecar_join(spark, sf_dir):
    """The rate of each recording: the sidecar's, or the first that its rows have."""
    root, _ = _sidecar_tree(spark, sf_dir)
    files = trees.file_table(spark, root)
    rows = trees.read_rows(spark, root, files).withColumn("frame", F.try_element_at("cells", F.lit("frame_idx")).cast("long"))
    rows = trees.with_sidecars(rows, trees.read_sidecars(spark, root, files), ["fps"], "frame")
    value = F.try_element_at("cells", F.lit("pen_plume_0")).cast("double")
    out = rows.groupBy("dataset", F.regexp_extract("recording", r"rec(-?\d+)$", 1).cast("long").alias("traj")).agg(F.count("*").alias("n"), F.round(F.sum(value), 5).alias("total"), F.min("fps").alias("fps"), F.max("fps").alias("fps_"))
    return out.filter("fps is null or fps = fps_").select(_dataset(), "traj", "n", "total", "fps")


@query("s14_dataset_inventory", """WITH r AS (SELECT DISTINCT event_type AS cond, user_id AS traj FROM events), m AS (SELECT *, traj % 7 <> 0 AS meta, traj % 7 <> 0 AND traj % 11 <> 0 AS known FROM r)
SELECT cond, count(DISTINCT traj % 5) AS n_folders, count(*) AS n_csv, count(*) FILTER (meta) AS n_meta, TRUE AS bytes_agree, count(DISTINCT traj % 4) FILTER (known AND traj % 4 <> 0) AS n_pressures, count(DISTINCT traj % 3) FILTER (known AND traj % 3 <> 0) AS n_densities,
  min(300.0 + traj % 9 * 50) FILTER (known) AS duration_min_us, max(300.0 + traj % 9 * 50) FILTER (known) AS duration_max_us FROM m GROUP BY cond""")
def s14_dataset_inventory(spark, sf_dir):
    root, written = _sidecar_tree(spark, sf_dir)
    found = trees.inventory(spark, root)
    sizes = written.groupBy(F.split("name", "/")[0].alias("d")).agg(F.sum("n_bytes").alias("b"))
    both = found.join(sizes, F.col("dataset") == F.col("d"))
    return both.select(_dataset(), "n_folders", "n_csv", "n_meta", (F.col("n_bytes") == F.col("b")).alias("bytes_agree"), F.size("injection_pressure_bar").cast("long").alias("n_pressures"), F.size("chamber_pressure_bar").cast("long").alias("n_densities"), "duration_min_us", "duration_max_us")


@query("s16_tree_parity", """WITH r AS (SELECT DISTINCT event_type AS cond, user_id AS traj FROM events WHERE user_id % 7 <> 0), x AS (SELECT cond, traj, traj % 11 = 0 AS broken FROM r)
SELECT cond, breach, count(*) AS n FROM (SELECT cond, unnest(list_filter([CASE WHEN broken THEN 'broken' END, CASE WHEN NOT broken AND ((traj % 19 = 0) OR (traj % 6 = 1)) THEN 'keys' END, CASE WHEN NOT broken AND traj % 13 = 0 THEN 'count' END, CASE WHEN NOT broken AND traj % 17 = 0 THEN 'total' END], lambda v: v IS NOT NULL)) AS breach FROM x) GROUP BY 1, 2""")
def s16_tree_parity(spark, sf_dir):
    root, _ = _sidecar_tree(spark, sf_dir)
    return trees.parity(trees.read_sidecars(spark, root)).groupBy(_dataset(), "breach").agg(F.count("*").alias("n"))


@query("s2_tree_union", f"WITH {V_SERIES}, e AS (SELECT *, ascii(cond) % 2 = 0 AS wide FROM v_series) SELECT cond, wide, count(DISTINCT traj) AS n_rows, count(*) AS n_values, round(sum(value), 5) AS total FROM e GROUP BY 1, 2")
def s2_tree_union(spark, sf_dir):
    """Conditions of even initials have wide files beside long ones, whose values must not be read; the others have long files only."""
    root = recordings.scratch(spark, "union")
    s = v_series(spark, sf_dir).select(F.hex("cond").alias("c"), F.pmod(F.ascii("cond"), F.lit(2)).alias("odd"), "traj", "pos", F.col("value").cast("string").alias("v"))
    by = s.groupBy("c", "odd", "traj").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
    name = lambda folder: F.concat(F.lit("exp-"), "c", F.lit(f"/cdf/{folder}/traj"), "traj", F.lit(".csv")).alias("name")
    each = lambda f: F.transform("p", f)
    wide = by.filter("odd = 0").select(name("wide"), F.concat(F.lit("traj,"), F.array_join(each(lambda x: F.concat(F.lit("value_"), x["pos"])), ","), F.lit("\n"), "traj", F.lit(","), F.array_join(each(lambda x: x["v"]), ","), F.lit("\n")).alias("content"))
    value = lambda x: F.when(F.col("odd") == 1, x["v"]).otherwise("1e9")
    long = by.select(name("long"), F.concat(F.lit("pos,traj,value\n"), F.array_join(each(lambda x: F.concat_ws(",", x["pos"], "traj", value(x))), "\n")).alias("content"))
    trees.write_files(wide.unionByName(long), root)
    rows = trees.read_source(spark, root, "cdf", "wide", "long", ["traj"], "pos", "value")
    values = rows.select(F.unhex(F.substring("experiment_name", 5, 1000)).cast("string").alias("cond"), "traj", F.explode("cells").alias("k", "v"))
    wide_ = (F.pmod(F.ascii("cond"), F.lit(2)) == 0).alias("wide")
    return values.groupBy("cond", wide_).agg(F.countDistinct("traj").alias("n_rows"), F.count("*").alias("n_values"), F.round(F.sum(F.col("v").cast("double")), 5).alias("total"))


@query("s4_design_registry", "SELECT p_brand AS name, d AS density, round(d * 0.11, 6) AS pressure FROM (SELECT DISTINCT p_brand, p_size AS d FROM part)")
def s4_design_registry(spark, sf_dir):
    levels = F.array_sort(F.collect_set("p_size"))
    designs = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(levels.alias("densities"))
    designs = designs.withColumn("pressures", F.transform("densities", lambda d: F.round(d * 0.11, 6)))
    return design.registry(designs, "name", "densities", "pressures")


@query("s5_grouped_design", """WITH p AS (SELECT DISTINCT p_brand AS name, p_size % 4 AS a, p_size % 3 AS b, p_size % 5 AS c FROM part), pa AS (SELECT DISTINCT name, a FROM p), pb AS (SELECT DISTINCT name, b FROM p),
x AS (SELECT name, g, a, b, CASE g WHEN 1 THEN 600.0 ELSE 900.0 END AS pressure FROM pa JOIN pb USING (name), (SELECT unnest([1, 3]) AS g))
SELECT name, (row_number() OVER (PARTITION BY name ORDER BY g, a, b))::BIGINT AS id, a::INT AS density, b::INT AS duration, pressure FROM x
UNION ALL SELECT name, 100::BIGINT + min(c), NULL, NULL, 300.0 FROM p GROUP BY name""")
def s5_grouped_design(spark, sf_dir):
    """Designs by brand: a condition of its own id, two cartesian groups around it, and a group of neither kind."""
    p = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_set(F.col("p_size") % 4)).alias("a"), F.array_sort(F.collect_set(F.col("p_size") % 3)).alias("b"), F.min(F.col("p_size") % 5).alias("c"))
    group = lambda i, kind, pressure: F.struct(i.cast("int").alias("id"), F.lit(kind).alias("expansion"), F.col("a").alias("density"), F.col("b").alias("duration"), F.lit(pressure).alias("pressure"))
    none = F.lit(None)
    designs = p.select("name", F.array(group(100 + F.col("c"), None, 300.0), group(none, "cartesian", 600.0), group(none, "other", 1.0), group(none, "cartesian", 900.0)).alias("groups"))
    return design.grouped_conditions(designs, "name", "groups", ["density", "duration"], ["pressure"])


@query("s13_pending_stream", f"WITH {V_POINTS} SELECT cond, count(*) AS n FROM v_points WHERE value > 50 GROUP BY cond")
def s13_pending_stream(spark, sf_dir):
    """Arriving files go through a batch operator once each, as a stream that stops when all are read."""
    base = recordings.scratch(spark, "stream")
    recordings.write_points(v_points(spark, sf_dir).select("event_id", "cond", "value"), f"{base}/in", ["cond"])
    stream = arrivals.arriving(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, 2)
    arrivals.each_batch(stream, lambda b: b.filter("value > 50"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("cond").agg(F.count("*").alias("n"))


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 5) AS total FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    base = recordings.scratch(spark, "windows")
    events = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    #: in order of time, so that a file's rows are no later than the next one's
    events.repartitionByRange("ts").write.parquet(f"{base}/in")
    stream = arrivals.arriving(spark, f"{base}/in", events.schema)
    arrivals.appended(arrivals.windowed_counts(stream, "ts", ["event_type"], "value", "1 day", "1 hour"), f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 5).alias("total"))
