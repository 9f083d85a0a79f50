"""Views over the given tables that stand for the tables of a measurement archive, and the same views as SQL.

Trajectory: ``traj`` within ``cond``; ``time`` in days since the first event, ``bin`` of one day, 30 bins; ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import time_bin

N_BINS = 30
DAY_US = 86_400_000_000
KEYS = ["cond", "traj"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").alias("traj"), F.col("event_type").alias("cond"), "value")
    start = events.agg(F.min("us").alias("us")).scalar()
    time = (F.col("us") - start).cast("double") / DAY_US
    return events.withColumn("time", time).withColumn("bin", time_bin(F.col("time"), 1.0, N_BINS))


def v_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy(*KEYS).orderBy("us", "event_id")
    return v_points(spark, sf_dir).withColumn("pos", F.row_number().over(order) - 1)


def v_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("series"))


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of v_wide: (vec_id, pos, v)."""
    return v_wide(spark, sf_dir).select("vec_id", "label", F.posexplode("series").alias("pos", "v"))


def v_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_frames(spark, sf_dir).select(F.col("vec_id").alias("frame"), F.col("pos").alias("x"), (F.col("v") + 1).alias("v"))


def v_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("point"), F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("truth"), (50000 + 100 * (F.col("l_quantity") - 25)).alias("mu"), (20000 + 200000 * F.col("l_discount")).alias("sigma"),
        F.col("l_quantity").alias("weight"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part"),
    )


def v_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    both = li.join(part, li["l_partkey"] == part["p_partkey"])
    return both.select(
        F.ln("l_extendedprice").alias("y"), F.ln("l_quantity").alias("x1"), F.ln("p_retailprice").alias("x2"), F.ln(F.col("p_size").cast("double")).alias("x3"),
        F.col("l_tax").alias("win"), F.col("p_brand").alias("grp"), F.col("l_orderkey").alias("cluster"),
    )


def v_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    both = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return both.select("o_orderkey", "o_custkey", F.col("c_mktsegment").alias("grp"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))


V_POINTS = f"""v_points AS (SELECT event_id, epoch_us(ts) AS us, user_id AS traj, event_type AS cond, value,
  (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE / {DAY_US} AS time,
  least(greatest(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE / {DAY_US} / 1.0), 0), {N_BINS - 1})::INT AS bin FROM events)"""
V_SERIES = V_POINTS + """,
v_series AS (SELECT *, (row_number() OVER (PARTITION BY cond, traj ORDER BY us, event_id) - 1)::INT AS pos FROM v_points)"""
V_FRAMES = """v_frames AS (SELECT vec_id, label, (unnest(range(1, len(embedding) + 1)) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
V_PIXELS = V_FRAMES + """,
v_pixels AS (SELECT vec_id AS frame, pos AS x, v + 1 AS v FROM v_frames)"""
V_PRED = """v_pred AS (SELECT l_orderkey AS cluster, l_linenumber AS point, l_returnflag AS grp, l_linestatus AS status, l_extendedprice AS truth,
  50000 + 100 * (l_quantity - 25) AS mu, 20000 + 200000 * l_discount AS sigma, l_quantity AS weight, l_tax AS tax, l_partkey AS part FROM lineitem)"""
V_REG = """v_reg AS (SELECT ln(l_extendedprice) AS y, ln(l_quantity) AS x1, ln(p_retailprice) AS x2, ln(p_size::DOUBLE) AS x3, l_tax AS win, p_brand AS grp, l_orderkey AS cluster
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
V_FITS = """v_fits AS (SELECT o_orderkey, o_custkey, c_mktsegment AS grp, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority, c_nationkey AS nation, c_acctbal AS bal
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
