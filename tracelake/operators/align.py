"""Onset detection, cleaning, alignment and interpolation of ordered series.

Frames have key columns, an integer ``order`` with consecutive positions, and values; missing is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ordered(keys: list[str], order: str) -> W:
    return W.partitionBy(*keys).orderBy(order)


def area_onset(df: DataFrame, keys: list[str], order: str, area: str) -> DataFrame:
    """(keys, delay): the row before the first positive area, if the area there is exactly 0; else null."""
    before = F.lag(area).over(_ordered(keys, order))
    rows = df.withColumn("_before", before).filter(F.col(area) > 0)
    first = rows.groupBy(*keys).agg(F.min(F.struct(order, "_before")).alias("f"))
    found = first.select(*keys, F.when(F.col("f")["_before"] == 0, F.col("f")[order] - 1).alias("delay"))
    return df.select(*keys).distinct().join(found, keys, "left")


def clean_series(df: DataFrame, keys: list[str], order: str, value: str, *, low: float, high: float, scan: int, scale: float = 1.0, out: str = "clean") -> DataFrame:
    """Zero-scan delay, nulls before onset, scaling and two cuts.

    Of the first ``scan`` rows, those whose next value is 0 or missing count as delay and become missing. From the onset on,
    rows after the first step under ``low`` are cut (the row before the step stays), then those after the first over ``high``.
    Adds ``out`` and ``delay``.
    """
    w, whole = _ordered(keys, order), W.partitionBy(*keys)
    nxt = F.lead(value).over(w)
    idle = (F.col(order) < scan) & (nxt.isNull() | (nxt == 0))
    df = df.withColumn("_idle", idle)
    df = df.withColumn("delay", F.sum(F.col("_idle").cast("int")).over(whole))
    live = ~F.col("_idle") & (F.col(order) >= F.col("delay")) & F.col(value).isNotNull()  # greatest() would read null as 0
    df = df.withColumn("_v", F.when(live, F.greatest(F.col(value), F.lit(0.0)) * scale))
    step = F.lead("_v").over(w) - F.col("_v")
    df = df.withColumn("_step", step)
    df = df.withColumn("_cut1", F.min(F.when(F.col("_step") < low, F.col(order))).over(whole))
    keep1 = F.coalesce(F.col(order) <= F.col("_cut1"), F.lit(True))
    df = df.withColumn("_v", F.when(keep1, F.col("_v")))
    df = df.withColumn("_cut2", F.min(F.when((F.col("_step") > high) & F.coalesce(F.col(order) < F.col("_cut1"), F.lit(True)), F.col(order))).over(whole))
    keep2 = F.coalesce(F.col(order) <= F.col("_cut2"), F.lit(True))
    return df.withColumn(out, F.when(keep2, F.col("_v"))).drop("_idle", "_v", "_step", "_cut1", "_cut2")


def subframe_onset(df: DataFrame, keys: list[str], order: str, time: str, value: str, n: int = 2) -> DataFrame:
    """(keys, onset): where a line through the first ``n`` positive values meets 0, if it rises and meets it within [0, last time]."""
    w = W.partitionBy(*keys).orderBy(order)
    last = df.groupBy(*keys).agg(F.max(time).alias("_last"))
    first = df.filter(F.col(value) > 0).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    line = first.groupBy(*keys).agg(F.regr_slope(value, time).alias("_b"), F.regr_intercept(value, time).alias("_a"), F.count(F.lit(1)).alias("_k"))
    at = F.try_divide(-F.col("_a"), F.col("_b"))
    ok = (F.col("_k") >= 2) & (F.col("_b") > 1e-7) & (at >= 0) & (at <= F.col("_last"))
    return last.join(line, keys, "left").select(*keys, F.when(ok, at).alias("onset"))


def clip_to_median(df: DataFrame, group: list[str], value: str, half: float, out: str) -> DataFrame:
    """Values moved into the group's median +/- ``half``; missing ones get the median."""
    med = F.median(value).over(W.partitionBy(*group))
    return df.withColumn("_m", med).withColumn(out, F.coalesce(F.least(F.greatest(F.col(value), F.col("_m") - half), F.col("_m") + half), F.col("_m"))).drop("_m")


def shifted(order: str, delay: str) -> Column:
    """Positions after a shift by the delay rounded half to even."""
    return (F.col(order) - F.rint(F.col(delay).cast("double"))).cast("int")


def filled_between(df: DataFrame, keys: list[str], order: str, value: str, out: str, hold_edges: bool = True) -> DataFrame:
    """Gaps filled by straight lines over ``order``; edges hold the nearest value, or stay null."""
    w = _ordered(keys, order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(value).alias("y")))
    df = df.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn("_q", F.first(known, ignorenulls=True).over(ahead))
    x = F.col(order).cast("double")
    line = F.col("_p")["y"] + (F.col("_q")["y"] - F.col("_p")["y"]) * F.try_divide(x - F.col("_p")["x"], F.col("_q")["x"] - F.col("_p")["x"])
    inside = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), line)
    edge = F.coalesce(F.col("_p")["y"], F.col("_q")["y"]) if hold_edges else F.lit(None)
    return df.withColumn(out, F.coalesce(inside, edge)).drop("_p", "_q")


def interpolate_at(base: DataFrame, samples: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """Linear interpolation of ``samples`` at the times of ``base``; null outside their range. An as-of join in one sort."""
    both = base.select(*keys, time, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_base")).union(samples.select(*keys, time, F.col(value).cast("double"), F.lit(False)))
    w = W.partitionBy(*keys).orderBy(time)
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col(time).alias("x"), F.col("_v").alias("y")))
    both = both.withColumn("_p", F.last(known, ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("_q", F.first(known, ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing)))
    p, q = F.col("_p"), F.col("_q")
    line = F.when(p["x"] == F.col(time), p["y"]).when(p.isNotNull() & q.isNotNull(), p["y"] + (q["y"] - p["y"]) * F.try_divide(F.col(time) - p["x"], q["x"] - p["x"]))
    return both.filter("_base").select(*keys, time, line.alias(out))


def at_grid(samples: DataFrame, keys: list[str], time: str, value: str, grid: list[float], out: str) -> DataFrame:
    """Each key's series at fixed grid times: (keys, time, out). Brackets by ``lead``, then the grid points that fall between."""
    w = W.partitionBy(*keys).orderBy(time)
    seg = samples.select(*keys, F.col(time).alias("_t0"), F.col(value).alias("_v0"), F.lead(time).over(w).alias("_t1"), F.lead(value).over(w).alias("_v1"))
    points = F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: (g >= F.col("_t0")) & ((g < F.col("_t1")) | (F.col("_t1").isNull() & (g == F.col("_t0")))))
    seg = seg.withColumn(time, F.explode(points))
    slope = F.coalesce(F.try_divide(F.col("_v1") - F.col("_v0"), F.col("_t1") - F.col("_t0")), F.lit(0.0))
    return seg.select(*keys, time, (F.col("_v0") + slope * (F.col(time) - F.col("_t0"))).alias(out))


def event_window(df: DataFrame, keys: list[str], order: str, value: str, threshold: float, before: int, length: int) -> DataFrame:
    """``length`` rows from ``before`` rows ahead of the first gradient over the threshold, with a rebased position ``rel``.

    The gradient is central. A key without an event gives its first ``length`` rows.
    """
    w, whole = _ordered(keys, order), W.partitionBy(*keys)
    gradient = (F.lead(value).over(w) - F.lag(value).over(w)) / 2
    df = df.withColumn("_g", gradient)
    df = df.withColumn("_e", F.min(F.when(F.col("_g") > threshold, F.col(order))).over(whole))
    start = F.greatest(F.coalesce(F.col("_e") - before, F.lit(0)), F.lit(0))
    return df.withColumn("rel", F.col(order) - start).filter((F.col("rel") >= 0) & (F.col("rel") < length)).drop("_g", "_e")


def sample_rate(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys, rate): one over the median of the positive time steps."""
    step = F.col(time) - F.lag(time).over(W.partitionBy(*keys).orderBy(time))
    return df.select(*keys, step.alias("_dt")).filter("_dt > 0").groupBy(*keys).agg((1 / F.median("_dt")).alias("rate"))


def gradient(keys: list[str], order: str, time: str, value: str) -> Column:
    """Second-order gradient over uneven steps; one-sided at the ends."""
    w = _ordered(keys, order)
    a, b = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    d0, d1 = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    inner = F.try_divide(a * a * d1 + b * b * d0, a * b * (a + b))
    return F.when(a.isNull(), F.try_divide(d1, b)).when(b.isNull(), F.try_divide(d0, a)).otherwise(inner)


def cumulative_trapezoid(df: DataFrame, keys: list[str], order: str, time: str, value: str, out: str) -> DataFrame:
    w = _ordered(keys, order)
    area = (F.col(time) - F.lag(time).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return df.withColumn("_area", F.coalesce(area, F.lit(0.0))).withColumn(out, F.sum("_area").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_area")


def hampel(df: DataFrame, keys: list[str], order: str, time: str, value: str, half: float, sigmas: float) -> DataFrame:
    """(keys, order, spike): off the median of its time neighbourhood by more than ``sigmas`` scaled MADs, given three or more values.

    A frame with a time range can't take a median, so the neighbourhood is an equi-join on blocks of ``half`` width (three
    per row) with the exact distance checked on each pair: linear in rows times neighbours.
    """
    rows = df.select(*keys, order, F.col(time).alias("_t"), F.col(value).alias("_v"), F.floor(F.col(time) / half).alias("_b"))
    near = rows.select(*keys, F.col("_t").alias("_t2"), F.col("_v").alias("_v2"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    pairs = rows.join(near, [*keys, "_b"]).filter(F.abs(F.col("_t") - F.col("_t2")) <= half)
    med = pairs.groupBy(*keys, order).agg(F.first("_v").alias("_v"), F.percentile("_v2", F.lit(0.5)).alias("_m"), F.collect_list("_v2").alias("_near"))
    dev = F.array_sort(F.transform("_near", lambda x: F.abs(x - F.col("_m"))))
    n = F.size("_near")
    mad = (F.get(dev, F.floor((n - 1) / 2).cast("int")) + F.get(dev, F.floor(n / 2).cast("int"))) / 2
    med = med.withColumn("_mad", mad * 1.4826)
    valid = F.count("_v").over(W.partitionBy(*keys))
    return med.select(*keys, order, ((n >= 3) & (valid >= 5) & (F.col("_mad") > 0) & (F.abs(F.col("_v") - F.col("_m")) > sigmas * F.col("_mad"))).alias("spike"))


def resample_nearest(df: DataFrame, keys: list[str], time: str, value: str, step: float, n: int) -> DataFrame:
    """Mean of the values nearest to each of ``n`` nodes ``step`` apart, and whether a node has any: (keys, node, value, valid)."""
    node = F.rint(F.col(time) / step).cast("int")
    held = df.withColumn("node", node).filter(F.col("node").between(0, n - 1)).groupBy(*keys, "node").agg(F.avg(value).alias("value"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("node"))
    return grid.join(held, [*keys, "node"], "left").withColumn("valid", F.col("value").isNotNull())
