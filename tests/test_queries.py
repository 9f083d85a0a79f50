"""Every registered query against its SQL on the smallest tables; queries without SQL give stable rows."""

import importlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import DATA, same_rows

PLANS = [importlib.import_module(f"tracelake.plans.{x}") for x in __spark_entry__.PLANS]
QUERIES = {k: f for p in PLANS for k, f in p.QUERIES.items()}
ORACLE = {k: s for p in PLANS for k, s in p.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_reruns_agree(spark, name):
    rows = [sorted(map(str, QUERIES[name](spark, DATA).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_reshaping_has_all_frames(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("sum(size(embedding))").first()[0]
    assert len(QUERIES["a1_long_to_wide"](spark, DATA).columns) == 65
    assert QUERIES["a2_wide_to_long"](spark, DATA).count() == n


def test_recording_tree_has_all_trajectories(spark, tmp_path):
    """Trajectories beyond the first block, and event types of any name, are in the tree."""
    rows = [(k, f"2024-01-{1 + k % 28:02d} 00:00:00", kind, k % 45, 1.5) for k in range(450) for kind in ("click", "a b/ü=-1", None)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, user_id long, value double")
    events.selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "event_type", "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["folder"], r["plume_idx"]): (r["n"], r["total"]) for r in QUERIES["s1_recordings_to_long"](spark, str(tmp_path)).collect()}
    assert got == {(kind, t): (10, 15.0) for kind in ("click", "a b/ü=-1", None) for t in range(45)}
    assert {tuple(r) for r in QUERIES["s14_inventory"](spark, str(tmp_path)).collect()} == {(kind, 3) for kind in ("click", "a b/ü=-1", None)}


def test_points_without_a_number_are_drawn_together(spark, tmp_path):
    """A bootstrap of rows, some of whose keys are missing: the same draws as SQL."""
    import duckdb

    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("l_linenumber", F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber")))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    same_rows(QUERIES["m12_bootstrap_ci"](spark, str(tmp_path)), con, ORACLE["m12_bootstrap_ci"])
