"""Reductions over pixel tables: one row per frame and position (x, or x and y) with a value v.

Each is a grouping by frame, position or angle; frames are never assembled into arrays.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import ratio


def angle_of(x: Column, y: Column, x0: float, y0: float) -> Column:
    """Degrees from 0 up to 360 around a centre."""
    return F.pmod(F.degrees(F.atan2(y - y0, x - x0)), F.lit(360.0))


def angular_density(px: DataFrame, keys: list[str], x: str, y: str, v: str, x0: float, y0: float, n: int) -> DataFrame:
    b = F.least(F.floor(angle_of(F.col(x), F.col(y), x0, y0) / (360.0 / n)), F.lit(n - 1)).cast("int")
    return px.groupBy(*keys, b.alias("bin")).agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.count(v).alias("n"))


def harmonic_phase(df: DataFrame, keys: list[str], pos: str, v: str, n: int, order: int) -> DataFrame:
    """Phase of one harmonic over n positions: one bin of a Fourier transform."""
    arg = F.col(pos) * (2 * math.pi * order / n)
    return df.groupBy(*keys).agg((-F.atan2(-F.sum(F.col(v) * F.sin(arg)), F.sum(F.col(v) * F.cos(arg)))).alias("phase"))


def front(px: DataFrame, frame: str, x: str, v: str, q: float, base_q: float = 0.1) -> DataFrame:
    """First x where the running sum over background reaches a share of the total, per frame."""
    whole = W.partitionBy(frame)
    px = px.withColumn("_b", F.greatest(F.col(v) - F.percentile(v, F.lit(base_q)).over(whole), F.lit(0.0)))
    px = px.withColumns({"_run": F.sum("_b").over(whole.orderBy(x).rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_b").over(whole)})
    return px.groupBy(frame).agg(F.min(F.when((F.col("_all") > 0) & (F.col("_run") >= q * F.col("_all")), F.col(x))).alias("front"))


def less_background(px: DataFrame, frame: str, x: str, v: str, first: int) -> DataFrame:
    """Values less the median of the position's first frames, not under 0."""
    base = px.filter(F.col(frame) < first).groupBy(x).agg(F.median(v).alias("_m"))
    return px.join(base, x, "left").withColumn("net", F.greatest(F.col(v) - F.coalesce("_m", F.lit(0.0)), F.lit(0.0))).drop("_m")


def histogram(df: DataFrame, keys: list[str], v: str, low: float, high: float, n: int) -> DataFrame:
    b = F.least(F.greatest(F.floor((F.col(v) - low) / ((high - low) / n)), F.lit(0)), F.lit(n - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count(v).alias("n"))


def percentile_level(hist: DataFrame, keys: list[str], share: float) -> DataFrame:
    """First bin at which the cumulative count reaches a share."""
    w = W.partitionBy(*keys)
    h = hist.withColumns({"_run": F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("n").over(w)})
    return h.filter(F.col("_run") >= share * F.col("_all")).groupBy(*keys).agg(F.min("bin").alias("level"))


def triangle_level(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Bin past the peak that is farthest under the line from the peak to the last bin (earliest of equals)."""
    w = W.partitionBy(*keys)
    h = hist.withColumns({"_peak": F.max(F.struct("n", (-F.col("bin")).alias("b"))).over(w), "_end": F.max(F.struct("bin", "n")).over(w)})
    px, py, ex, ey = -F.col("_peak")["b"], F.col("_peak")["n"], F.col("_end")["bin"], F.col("_end")["n"]
    gap = py + (ey - py) * F.coalesce(ratio(F.col("bin") - px, ex - px), F.lit(0.0)) - F.col("n")
    h = h.withColumn("_gap", gap).filter(F.col("bin") >= px)
    return h.groupBy(*keys).agg((-F.max(F.struct("_gap", (-F.col("bin")).alias("b")))["b"]).alias("level"))


def binary_measures(px: DataFrame, frame: str, x: str, on: Column, least: int) -> DataFrame:
    """Per frame: lit positions, the furthest column with ``least`` lit positions or more, and a volume of revolution."""
    cols = px.filter(on).groupBy(frame, x).agg(F.count(F.lit(1)).alias("_w"))
    out = cols.groupBy(frame).agg(F.sum("_w").alias("area"), F.max(F.when(F.col("_w") >= least, F.col(x))).alias("reach"), (F.sum(F.col("_w") * F.col("_w")) * (math.pi / 4)).alias("volume"))
    return px.select(frame).distinct().join(out, frame, "left").fillna(0, ["area", "volume"])


def region_stats(px: DataFrame, label: str, x: str, y: str) -> DataFrame:
    return px.groupBy(label).agg(F.count(F.lit(1)).alias("volume"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), *[f(c).alias(f"{c}_{n}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))])


def best_cuts(n: np.ndarray, total: np.ndarray, squares: np.ndarray, k: int) -> list[int]:
    """The last cells of the first k - 1 of k runs of cells with the least sum of squares about their means.

    Exact, by dynamic programming; of equal cuts the one whose last run begins first, and so on back.
    """
    n, total, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, total, squares))
    cells = len(n) - 1

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        count, s = n[b] - n[a], total[b] - total[a]
        return squares[b] - squares[a] - np.divide(s * s, count, out=np.zeros_like(s), where=count > 0)

    best, back = np.array([0.0, *[cost(np.array([0]), b)[0] for b in range(1, cells + 1)]]), []
    for _ in range(1, k):
        now, at = np.full(cells + 1, np.inf), np.zeros(cells + 1, int)
        for b in range(1, cells + 1):
            ways = best[1:b] + cost(np.arange(1, b), b)
            if len(ways):
                at[b] = 1 + int(ways.argmin())
                now[b] = ways[at[b] - 1]
        best = now
        back.append(at)
    cuts, b = [], cells
    for at in reversed(back):
        b = at[b]
        cuts.append(b - 1)
    return cuts[::-1]


def brightness_clusters(px: DataFrame, v: str, k: int, cells: int = 256) -> DataFrame:
    """``px`` with ``label``: the brightness cluster of each value, from 0 for the darkest.

    One-dimensional k-means is a cut of the ordered values into k runs. Values are counted by equal cells of their range, with
    the sums that a run's cost needs, and the best cuts between cells are found exactly; only these ``cells`` rows come to the
    driver. With fewer filled cells than clusters, labels stop short; a table without values keeps null labels.
    """
    low, high = px.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    width = (high - low) / cells if low is not None and high > low else 1.0
    at = F.when(F.col(v).isNotNull(), F.least(F.floor((F.col(v) - F.lit(low)) / width), F.lit(cells - 1))).cast("int")
    found = px.groupBy(at.alias("cell")).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(F.col(v) * F.col(v)).alias("q")).filter("cell is not null").collect()
    sums = np.zeros((3, cells))
    for r in found:
        sums[:, r["cell"]] = r["n"], r["s"], r["q"]
    cuts = best_cuts(*sums, k) if found else []
    label = F.when(at.isNotNull(), sum(((at > c).cast("int") for c in cuts), F.lit(0)))
    return px.withColumn("label", label)
