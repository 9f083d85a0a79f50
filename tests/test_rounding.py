"""Ties of SQL's round: quotients of cents that lie on, or a bit off, half a last digit."""

import duckdb

import __spark_entry__
from tests.conftest import same_rows
from tracelake.plans.registry import nearest


def test_nearest_is_sql_round(spark):
    found = spark.range(40000).selectExpr("(id - 20000) * 0.00037 + 0.000005 * (id % 3) as x", "id")
    odd = spark.createDataFrame([(x, -k) for k, x in enumerate((None, float("nan"), float("inf"), float("-inf"), 1e300, -1e308, 4.5e15 + 0.5, 0.49999999999999994e-5, -0.0), 1)], "x double, id long")
    rows = found.union(odd)
    data = rows.toPandas().astype({"x": "float64"})  # noqa: F841
    want = {k: v for k, v in duckdb.sql("select id, round(x, 5) from data").fetchall()}
    got = {r["id"]: r["y"] for r in rows.select("id", nearest("x", 5).alias("y")).collect()}
    same = lambda a, b: a == b or (a is None or a != a) and (b is None or b != b)
    assert not [(k, got[k], want[k]) for k in want if not same(got[k], want[k])]


def test_fit_quality_ties(spark, tmp_path):
    """Prices whose cost a point lies at half of the fifth digit."""
    cents = "700 * (1 + id % 2999) + 35 * (id % 20)"
    spark.range(6000).selectExpr("60 * id + 10 + id % 50 as o_orderkey", "id % 40 as o_custkey", "if(id % 7 = 0, 'P', 'F') as o_orderstatus", f"cast(({cents}) as double) / 100 as o_totalprice", "'1' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id as c_custkey", "concat('g', id % 3) as c_mktsegment", "id as c_nationkey", "10.5D * id as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for table in ("orders", "customer"):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    same_rows(__spark_entry__.queries()["p18_fit_quality"](spark, str(tmp_path)), con, __spark_entry__.oracle_sql()["p18_fit_quality"])
