"""Time bins per condition: statistics, dense grids, right-censoring and coverage regimes.

All group by condition (or condition and bin) first; what follows works on that small table: one row per condition and bin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bin_stats(points: DataFrame, keys: list[str], traj: str, value: str, bin_col: str = "bin", quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Per key and bin: counts of points and trajectories, min, mean, max, exact quantiles."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in quantiles]))
    out = points.groupBy(*keys, bin_col).agg(F.count(value).alias("n_points"), F.countDistinct(traj).alias("n_traces"), F.min(value).alias("v_min"), F.avg(value).alias("v_mean"), F.max(value).alias("v_max"), q.alias("_q"))
    return out.withColumns({f"v_p{round(x * 100)}": F.col("_q")[k] for k, x in enumerate(quantiles)}).drop("_q")


def dense(df: DataFrame, keys: list[str], bin_col: str, n_bins: int, zero: list[str]) -> DataFrame:
    """One row for every bin of every key; the ``zero`` columns are 0 where a bin was missing."""
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias(bin_col))
    return grid.join(df, [*keys, bin_col], "left").fillna(0, zero)


def rolling_mean(c: str | Column, window: W, width: int) -> Column:
    """Mean over ``width`` rows around each, fewer at the ends."""
    half = width // 2
    return F.avg(c).over(window.rowsBetween(-half, width - 1 - half))


def first_run(flag: Column, at: str, window: W, n: int) -> Column:
    """The first position from which ``flag`` holds for ``n`` rows in a row, as a value of ``at`` on the row where a run starts.

    To be followed by ``min`` per key.
    """
    ahead = window.rowsBetween(0, n - 1)
    held = (F.sum(flag.cast("int")).over(ahead) == n) & (F.count(F.lit(1)).over(ahead) == n)
    return F.when(held, F.col(at))


@dataclass(frozen=True)
class CensorRule:
    n_bins: int
    cap: float
    cap_fraction: float = 0.95
    cap_min_count: int = 4
    cap_bins: int = 1
    ratio: float = 0.7
    min_count: int = 4
    drop_bins: int = 2
    smooth: int = 3


def _smoothed(stats: DataFrame, keys: list[str], n_bins: int, smooth: int, count: str) -> DataFrame:
    order, whole = W.partitionBy(*keys).orderBy("bin"), W.partitionBy(*keys)
    out = dense(stats, keys, "bin", n_bins, [count]).withColumn("smooth", rolling_mean(count, order, smooth))
    #: earliest bin of the largest smoothed count
    out = out.withColumn("b_peak", -F.max(F.struct("smooth", (-F.col("bin")).alias("b"))).over(whole)["b"])
    return out.withColumn("ratio", F.col("smooth") / F.greatest(F.max("smooth").over(whole), F.lit(1.0)))


def censor_bins(stats: DataFrame, keys: list[str], rule: CensorRule) -> DataFrame:
    """Dense bins with both triggers, the starts of each and the start of censoring (n_bins where none)."""
    order, whole = W.partitionBy(*keys).orderBy("bin"), W.partitionBy(*keys)
    bins = _smoothed(stats, keys, rule.n_bins, rule.smooth, "n_traces")
    after = F.col("bin") >= F.col("b_peak")
    bins = bins.withColumns({
        "density_drop": (F.col("ratio") < rule.ratio) | (F.col("n_traces") < rule.min_count),
        "saturated": F.coalesce(F.col("v_p95") >= rule.cap_fraction * rule.cap, F.lit(False)) & (F.col("n_traces") >= rule.cap_min_count),
    })
    bins = bins.withColumns({
        "_d": first_run(F.col("density_drop") & after, "bin", order, rule.drop_bins),
        "_s": first_run(F.col("saturated") & after, "bin", order, rule.cap_bins),
    })
    none = F.lit(rule.n_bins)
    bins = bins.withColumns({"b_density": F.coalesce(F.min("_d").over(whole), none), "b_cap": F.coalesce(F.min("_s").over(whole), none)}).drop("_d", "_s")
    start = F.least("b_density", "b_cap")
    reason = F.when(start >= none, "none").when(F.col("b_density") == F.col("b_cap"), "density_drop+fov_saturation").when(F.col("b_density") < F.col("b_cap"), "density_drop").otherwise("fov_saturation")
    return bins.withColumns({"b_start": start, "reason": reason, "censored": F.col("bin") >= start})


def censor_summary(bins: DataFrame, keys: list[str]) -> DataFrame:
    cols = ["b_peak", "b_density", "b_cap", "b_start", "reason"]
    return bins.groupBy(*keys).agg(F.sum("n_points").alias("n_points"), *[F.first(c).alias(c) for c in cols])


def attach_bins(points: DataFrame, bins: DataFrame, keys: list[str], cols: list[str], bin_col: str = "bin") -> DataFrame:
    """Points with the decisions of their bin; the bins table has one row per key and bin and keeps its own join strategy."""
    return points.join(bins.select(*keys, bin_col, *cols), [*keys, bin_col], "left")


def coverage_regimes(stats: DataFrame, keys: list[str], n_bins: int, uncertain: float, teacher: float, min_count: int, run: int, count: str = "n_traces") -> DataFrame:
    """Reliable, uncertain and teacher-only bins: each next regime is searched from the start of the one before."""
    order, whole = W.partitionBy(*keys).orderBy("bin"), W.partitionBy(*keys)
    bins = _smoothed(stats, keys, n_bins, 3, count)
    low = (F.col("ratio") < uncertain) & (F.col("bin") >= F.col("b_peak"))
    bins = bins.withColumn("_u", first_run(low, "bin", order, run))
    bins = bins.withColumn("b_uncertain", F.coalesce(F.min("_u").over(whole), F.lit(n_bins)))
    gone = ((F.col("ratio") < teacher) | (F.col(count) < min_count)) & (F.col("bin") >= F.col("b_uncertain"))
    bins = bins.withColumn("_t", first_run(gone, "bin", order, run))
    bins = bins.withColumn("b_teacher", F.coalesce(F.min("_t").over(whole), F.lit(n_bins)))
    regime = F.when(F.col("bin") < F.col("b_uncertain"), "raw_reliable").when(F.col("bin") < F.col("b_teacher"), "raw_uncertain").otherwise("teacher_only")
    return bins.withColumn("regime", regime).drop("_u", "_t")


def p50_curve(points: DataFrame, keys: list[str], traj: str, time: str, value: str, min_traces: int) -> DataFrame:
    """Median value and mean time per key and bin, where enough trajectories support it."""
    out = points.groupBy(*keys, "bin").agg(F.median(value).alias("p50"), F.avg(time).alias("time_mean"), F.count(value).alias("n_points"), F.countDistinct(traj).alias("n_traces"))
    return out.filter(F.col("n_traces") >= min_traces)


def coverage_table(points: DataFrame, keys: list[str], traj: str, n_bins: int, smooth: int = 3) -> DataFrame:
    """Trajectories per bin, smoothed, and their share of the peak."""
    stats = points.groupBy(*keys, "bin").agg(F.countDistinct(traj).alias("n_traces"))
    return _smoothed(stats, keys, n_bins, smooth, "n_traces")
