"""Run-length and hysteresis logic over ordered rows, by windows: no loop over rows and no Python.

Each function takes a frame with key columns, an order column whose values are consecutive positions within a key, and a
boolean or numeric column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_runs(df: DataFrame, keys: list[str], order: str, flag: str, run: str = "run") -> DataFrame:
    """Number the runs of equal ``flag`` per key (gaps and islands) and add their length as ``<run>_len``."""
    w = W.partitionBy(*keys).orderBy(order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    out = df.withColumn("_change", change).withColumn(run, F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_change")
    return out.withColumn(f"{run}_len", F.count(F.lit(1)).over(W.partitionBy(*keys, run)))


def hysteresis(df: DataFrame, keys: list[str], order: str, value: str, low: float | Column, high: float | Column, out: str = "latched") -> DataFrame:
    """True from a value of ``high`` or more until one under ``low``; false before the first of either."""
    v, lo, hi = F.col(value), low if isinstance(low, Column) else F.lit(low), high if isinstance(high, Column) else F.lit(high)
    event = F.when(v >= hi, True).when(v < lo, False)
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))


def fill_short_false(df: DataFrame, keys: list[str], order: str, flag: str, longest: int, out: str) -> DataFrame:
    """False runs of up to ``longest`` rows become true, at the ends too."""
    runs = with_runs(df, keys, order, flag, "_r")
    return runs.withColumn(out, F.col(flag) | (F.col("_r_len") <= longest)).drop("_r", "_r_len")


def remove_short_true(df: DataFrame, keys: list[str], order: str, flag: str, shortest: int, out: str) -> DataFrame:
    """True runs of fewer than ``shortest`` rows become false."""
    runs = with_runs(df, keys, order, flag, "_r")
    return runs.withColumn(out, F.col(flag) & (F.col("_r_len") >= shortest)).drop("_r", "_r_len")


def longest_true(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """(keys, start, end, length) of the longest true run, the earliest of equals; keys without one have nulls."""
    runs = with_runs(df, keys, order, flag, "_r")
    isles = runs.groupBy(*keys, "_r", flag).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"))
    best = F.max(F.when(F.col(flag), F.struct("length", (-F.col("start")).alias("s"), "start", "end")))
    return isles.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.start", "b.end", "b.length")


def high_interval(df: DataFrame, keys: list[str], order: str, value: str, base_q: float, low_sigmas: float, high_sigmas: float, fill: int, shortest: int) -> DataFrame:
    """The longest interval in which a series is high: a quantile is its base and a MAD of the part at or under it the noise."""
    whole = W.partitionBy(*keys)
    df = df.withColumn("_base", F.percentile(value, F.lit(base_q)).over(whole))
    df = df.withColumn("_dev", F.when(F.col(value) <= F.col("_base"), F.abs(F.col(value) - F.col("_base"))))
    df = df.withColumn("_sigma", F.greatest(1.4826 * F.median("_dev").over(whole), F.lit(1e-12)))
    df = hysteresis(df, keys, order, value, F.col("_base") + low_sigmas * F.col("_sigma"), F.col("_base") + high_sigmas * F.col("_sigma"), "_on")
    df = fill_short_false(df, keys, order, "_on", fill, "_filled")
    df = remove_short_true(df, keys, order, "_filled", shortest, "_kept")
    return longest_true(df, keys, order, "_kept")


def circular_runs(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """(keys, start, length) of the true runs on a ring of positions 0 to n - 1: a run may join the end to the start."""
    whole = W.partitionBy(*keys)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(whole), "_off": F.coalesce(F.min(F.when(~F.col(flag), F.col(order))).over(whole), F.lit(0))})
    df = df.withColumn("_at", F.pmod(F.col(order) - F.col("_off"), F.col("_n")))
    runs = with_runs(df, keys, "_at", flag, "_r").filter(flag)
    return runs.groupBy(*keys, "_r").agg(F.min(F.struct("_at", order))[order].alias("start"), F.count(F.lit(1)).alias("length")).drop("_r")


def running_max(value: str, keys: list[str], order: str) -> Column:
    return F.max(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def cut_at_decrease(df: DataFrame, keys: list[str], order: str, value: str, shortest: int, out: str) -> DataFrame:
    """Null from one row before the first decrease on (from the first row if that is where it decreases), then drop short rests."""
    w, whole = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    df = df.withColumn("_down", F.when(F.lead(value).over(w) < F.col(value), F.col(order)))
    first = F.min("_down").over(whole)
    df = df.withColumn("_cut", F.when(first.isNotNull(), F.greatest(first - 1, F.lit(0))))
    df = df.withColumn("_ok", F.col(value).isNotNull() & F.coalesce(F.col(order) < F.col("_cut"), F.lit(True)))
    df = remove_short_true(df, keys, order, "_ok", shortest, "_long")
    return df.withColumn(out, F.when(F.col("_long"), F.col(value))).drop("_down", "_cut", "_ok", "_long")
