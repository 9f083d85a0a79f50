"""Empirical support: what a training table covers, and checks of new rows against it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.select import joined, medians, stored


def column_support(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, max) of each column, in one pass."""
    stats = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in cols]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def support_check(samples: DataFrame, train: DataFrame, cont: list[str], discrete: list[str], combo: list[str], *, z_warn: float = 2.0, z_strong: float = 3.0, tol: float = 1e-9) -> DataFrame:
    """Samples with z scores, unseen and combination flags, and the severity.

    Columns are checked in order: a value outside the range or far off is strong; a warning counts only while nothing before
    it was found. An unseen discrete value or combination is strong.
    """
    stats = train.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(f"_{c}") for c in cont])
    out = samples.withColumns({f"_{c}": stats.select(f"_{c}").scalar() for c in cont})
    severity: Column = F.lit("ok")
    for c in cont:
        s = F.col(f"_{c}")
        out = out.withColumn(f"z_{c}", F.when(s["std"] > 1e-12, (F.col(c) - s["mean"]) / s["std"]))
        strong = F.coalesce((F.col(c) < s["min"] - tol) | (F.col(c) > s["max"] + tol), F.lit(False)) | F.coalesce(F.abs(f"z_{c}") >= z_strong, F.lit(False))
        severity = F.when(strong, "strong").when((severity == "ok") & F.coalesce(F.abs(f"z_{c}") >= z_warn, F.lit(False)), "warn").otherwise(severity)
    out = out.withColumn("severity", severity).drop(*[f"_{c}" for c in cont])
    for c in discrete:
        seen = train.select(F.col(c).alias("_k")).distinct()
        out = out.join(seen, out[c] == seen["_k"], "left").withColumn(f"seen_{c}", F.col("_k").isNotNull()).drop("_k")
        out = out.withColumn("severity", F.when(F.col(f"seen_{c}"), F.col("severity")).otherwise("strong"))
    known = train.select(*[F.col(c).alias(f"_{c}") for c in combo]).distinct().withColumn("_hit", F.lit(True))
    same = [F.col(c) == F.col(f"_{c}") for c in combo]
    out = out.join(known, same, "left").withColumn("combo_seen", F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_{c}" for c in combo])
    return out.withColumn("severity", F.when(F.col("combo_seen"), F.col("severity")).otherwise("strong"))


def nearest_combos(samples: DataFrame, combos: DataFrame, key: str, cols: list[str], k: int) -> DataFrame:
    """The k nearest known combinations by deviation-scaled distance: (key, rank, combination, distance); ties by the combination.

    The combinations lie in a tree of boxes whose sides halve from level to level. Each sample goes down it and keeps, at every
    level, the boxes that may hold one of its k nearest: those no further than the distance within which k combinations are
    certain to lie (from the boxes' greatest distances and counts). Only what is in the last boxes is measured. No sample meets
    combinations that can't be among its nearest, no side is collected or broadcast by a hint, and the result is that of all
    pairs. Samples and combinations with a null coordinate have no distance and are left out; of fewer than k all are given.
    """
    number = {c: F.col(c).cast("double") for c in cols}
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    points = stored(combos.select(*[x.alias(c) for c, x in number.items()]).filter(known).distinct(), "combos")
    one = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in cols for name, f in (("sd", F.stddev_pop), ("low", F.min), ("high", F.max))]).first()
    scale = {c: one[f"sd_{c}"] if (one[f"sd_{c}"] or 0) > 1e-12 else 1.0 for c in cols}
    low = {c: one[f"low_{c}"] or 0.0 for c in cols}
    span = max(((one[f"high_{c}"] or 0.0) - low[c]) / scale[c] for c in cols) * (1 + 1e-6) or 1.0
    #: about one combination to a box at the last level, were they even
    levels = min(30, math.ceil(math.log2(max(one["n"], 2)) / len(cols)) + 2)
    boxes = {c: f"_b_{c}" for c in cols}
    place = lambda c: (F.col(c) - F.lit(low[c])) / F.lit(scale[c])
    points = points.select(*cols, *[F.floor(place(c) / (span / 2**levels)).cast("long").alias(b) for c, b in boxes.items()])
    last = stored(points.groupBy(*boxes.values()).agg(F.count("*").alias("_n")), "combo-boxes")
    asked = stored(samples.select(F.monotonically_increasing_id().alias("_id"), key, *[x.alias(c) for c, x in number.items()]).filter(known), "combo-samples")
    search = asked.select("_id", *cols, *[F.lit(0).cast("long").alias(b) for b in boxes.values()])
    for level in range(1, levels + 1):
        up = levels - level
        inner = last.groupBy(*[F.shiftright(b, up).alias(f"{b}_") for b in boxes.values()]).agg(F.sum("_n").alias("_n"))
        inner = inner.withColumns({b: F.shiftright(f"{b}_", 1) for b in boxes.values()})
        search = search.join(inner, list(boxes.values())).select("_id", *cols, *[F.col(f"{b}_").alias(b) for b in boxes.values()], "_n")
        side, near, far = span / 2**level, F.lit(0.0), F.lit(0.0)
        for c, b in boxes.items():
            start, end, x = F.col(b) * side, (F.col(b) + 1) * side, place(c)
            near = near + F.pow(F.greatest(start - x, x - end, F.lit(0.0)), F.lit(2.0))
            far = far + F.pow(F.greatest(x - start, end - x), F.lit(2.0))
        own = W.partitionBy("_id")
        search = search.withColumns({"_near": near, "_far": far}).withColumn("_sure", F.sum("_n").over(own.orderBy("_far")))
        search = search.withColumn("_bound", F.min(F.when(F.col("_sure") >= k, F.col("_far"))).over(own))
        #: a little slack, as places are rounded
        search = search.filter(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") * (1 + 1e-9) + 1e-12))
        search = stored(search.select("_id", *cols, *boxes.values()), "combo-search")
    met = search.withColumnsRenamed({c: f"_x_{c}" for c in cols}).join(points, list(boxes.values()))
    distance = F.sqrt(sum((F.pow((F.col(f"_x_{c}") - F.col(c)) / F.lit(scale[c]), F.lit(2.0)) for c in cols), F.lit(0.0)))
    met = met.select("_id", distance.alias("distance"), *cols)
    best = met.withColumn("rank", F.row_number().over(W.partitionBy("_id").orderBy("distance", *cols))).filter(F.col("rank") <= k)
    return asked.select("_id", key).join(best, "_id").select(key, "rank", *[F.col(c).alias(f"near_{c}") for c in cols], "distance")


def tolerance_match(left: DataFrame, right: DataFrame, a: str, b: str, tol: float) -> DataFrame:
    """Pairs with |a - b| <= tol: an equi-join on cells of the tolerance's width (three per right row), then the exact check."""
    cell = lambda c: F.floor(F.col(c) / (2 * tol))
    l_ = left.withColumn("_cell", cell(a))
    r_ = right.withColumn("_cell", F.explode(F.array(cell(b) - 1, cell(b), cell(b) + 1)))
    return l_.join(r_, "_cell").filter(F.abs(F.col(a) - F.col(b)) <= tol).drop("_cell")


def representative(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row of each group that is closest to the group's median; the smallest ``tie`` among equals. Groups without values have none."""
    near = nearest_to_median(df, keys, value)
    rest = [c for c in df.columns if c not in keys]
    return near.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_d", tie)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def nearest_to_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``_d``, the distance of each value from its group's median."""
    mid = stored(medians(df, keys, {"_m": value}), "medians")
    return joined(df.filter(F.col(value).isNotNull()), mid, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m"))).drop("_m")


def seeded_rank(seed: str, *cols: str) -> Column:
    """A hash to order by: the same on every run and in every engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]))


def split_by_group(df: DataFrame, group: str, seed: str, val: float, test: float) -> DataFrame:
    """Whole groups go to test, val or train: groups ranked by a seeded hash, cut at floors of the shares.

    The rank is taken within cells of the hash (its first three digits) with the counts of the cells before, so no task sorts
    all groups. A null group is one group.
    """
    groups = df.select(group).distinct().withColumn("_h", seeded_rank(seed, group))
    groups = groups.withColumn("_cell", F.substring("_h", 1, 3))
    sizes = groups.groupBy("_cell").agg(F.count(F.lit(1)).alias("_k"))
    sizes = sizes.withColumns({"_before": F.sum("_k").over(W.orderBy("_cell")) - F.col("_k"), "_all": F.sum("_k").over(W.partitionBy())}).drop("_k")
    ranked = groups.join(sizes, "_cell").withColumn("_r", F.row_number().over(W.partitionBy("_cell").orderBy("_h", group)) + F.col("_before"))
    n_test, n_val = F.floor(F.col("_all") * test), F.floor(F.col("_all") * val)
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return joined(df, ranked.select(group, split.alias("split")), [group], "inner").select(group, *[c for c in df.columns if c != group], "split")
