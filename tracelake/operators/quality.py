"""Quality gates over trajectories, and audits of what gates remove."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import ratio


@dataclass(frozen=True)
class GateRule:
    min_points: int = 4
    negative_step: float = -2.0
    spike_step: float = 14.0
    spike_d1: float = 450.0
    spike_d2: float = 10000.0
    plateau_step: float = 1.3
    plateau_jump: float = 8.0
    low_time: float = 0.80
    low: float = 0.75
    very_low: float = 0.70
    severe: float = 0.65
    min_low_times: int = 2
    min_compared: int = 4
    repeat_conditions: int = 3
    repeat_fraction: float = 0.25
    loose: tuple[int, float] = (5, 0.20)
    strict: tuple[int, float] = (3, 0.40)


def trace_shape(points: DataFrame, keys: list[str], time: str, value: str, rule: GateRule) -> DataFrame:
    """Per trajectory: points, time range, last value, steps, derivatives and shape flags. Equal times keep one row."""
    w = W.partitionBy(*keys).orderBy(time)
    one = points.groupBy(*keys, time).agg(F.max(value).alias("_v"))
    one = one.withColumns({"_dt": F.col(time) - F.lag(time).over(w), "_dy": F.col("_v") - F.lag("_v").over(w)})
    one = one.withColumn("_d1", F.try_divide("_dy", "_dt"))
    mid = (F.col("_dt") + F.lag("_dt").over(w)) * 0.5
    flat = F.max("_dy").over(w.rowsBetween(-2, -1)) <= rule.plateau_step
    enough = F.lag("_dy", 2).over(w).isNotNull()
    one = one.withColumns({"_d2": F.try_divide(F.col("_d1") - F.lag("_d1").over(w), mid), "_jump": F.when(flat & enough & (F.col("_dy") >= rule.plateau_jump), F.col("_dy"))})
    out = one.groupBy(*keys).agg(
        F.count("_v").alias("n_points"), F.min(time).alias("t_min"), F.max(time).alias("t_max"), F.max_by("_v", time).alias("v_last"), F.percentile("_v", F.lit(0.9)).alias("v_p90"),
        F.min("_dy").alias("min_step"), F.max("_dy").alias("max_step"), F.max("_d1").alias("max_d1"), F.max(F.abs("_d2")).alias("max_d2"), F.max("_jump").alias("_jump"), F.count("_dy").alias("_steps"),
    )
    out = out.withColumns({
        "valid": F.col("n_points") >= rule.min_points,
        "negative": F.coalesce(F.col("min_step") <= rule.negative_step, F.lit(False)),
        "spike": F.coalesce(F.col("max_step") >= rule.spike_step, F.lit(False)) | F.coalesce(F.col("max_d1") >= rule.spike_d1, F.lit(False)) | F.coalesce(F.col("max_d2") >= rule.spike_d2, F.lit(False)),
        "plateau": F.col("_jump").isNotNull() & (F.col("_steps") >= 4),
    })
    return out.drop("_jump", "_steps")


def compared_with_condition(at_grid: DataFrame, cond: list[str], unit: str, time: str, value: str) -> DataFrame:
    """Ratio and robust z of each unit's median at each grid time against the median of the condition's units."""
    each = at_grid.groupBy(*cond, unit, time).agg(F.median(value).alias("v"))
    group = W.partitionBy(*cond, time)
    each = each.withColumn("_m", F.median("v").over(group))
    each = each.withColumn("_mad", F.median(F.abs(F.col("v") - F.col("_m"))).over(group))
    known = lambda c: F.when(F.col(c) != 0, F.col(c))
    return each.select(*cond, unit, time, "v", (F.col("v") / known("_m")).alias("ratio"), (0.6745 * (F.col("v") - F.col("_m")) / known("_mad")).alias("z"))


def gate_units(shapes: DataFrame, compared: DataFrame, cond: list[str], unit: str, rule: GateRule) -> DataFrame:
    """Per condition and unit: fractions of flagged traces, low ratios and the low and shape flags."""
    frac = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0)).alias(f"{c}_fraction")
    by = shapes.filter("valid").groupBy(*cond, unit).agg(F.count(F.lit(1)).alias("n_traces"), frac("spike"), frac("plateau"), frac("negative"))
    low = compared.groupBy(*cond, unit).agg(F.min("ratio").alias("min_low"), F.median("ratio").alias("median_low"), F.count_if(F.col("ratio") < rule.low_time).alias("n_low"), F.count("ratio").alias("n_compared"))
    out = by.join(low, [*cond, unit], "left").fillna(0, ["n_low", "n_compared"])
    out = out.withColumn("n_units", F.count(F.lit(1)).over(W.partitionBy(*cond)))
    enough, lo = F.col("n_units") >= rule.min_compared, F.col("min_low")
    systematic = enough & (((lo <= rule.low) & (F.col("n_low") >= rule.min_low_times)) | ((lo <= rule.very_low) & (F.col("n_low") >= 1)))
    severe = enough & (lo <= rule.severe) & (F.col("n_low") >= rule.min_low_times)
    worst = F.greatest("spike_fraction", "plateau_fraction", "negative_fraction")
    shape = ((F.col("n_traces") >= rule.strict[0]) & (worst >= rule.strict[1])) | ((F.col("n_traces") >= rule.loose[0]) & (worst >= rule.loose[1]))
    return out.withColumns({"systematic_low": F.coalesce(systematic, F.lit(False)), "severe_low": F.coalesce(severe, F.lit(False)), "recurrent_shape": shape})


def repeat_support(gated: DataFrame, group: list[str], rule: GateRule) -> DataFrame:
    """How many of a unit's conditions are low, and whether that repeats often enough."""
    out = gated.groupBy(*group).agg(F.count(F.lit(1)).alias("n_conditions"), F.count_if("systematic_low").alias("n_systematic"))
    share = F.col("n_systematic") / F.greatest(F.col("n_conditions"), F.lit(1))
    return out.withColumns({"low_fraction": share, "repeat_low": (F.col("n_systematic") >= rule.repeat_conditions) & (share >= rule.repeat_fraction)})


def gate_manifest(gated: DataFrame, support: DataFrame, manual: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Decisions with reasons: low and (repeated or severe), recurrent shape, or named by hand."""
    out = gated.join(support.select(*group, "repeat_low"), group, "left").join(manual.select(*keys, F.lit(True).alias("manual")), keys, "left")
    out = out.fillna(False, ["repeat_low", "manual"])
    low = F.col("systematic_low") & (F.col("repeat_low") | F.col("severe_low"))
    reasons = F.concat_ws(";", F.when(F.col("manual"), "manual"), F.when(low, "systematic_low"), F.when(F.col("recurrent_shape"), "recurrent_shape"))
    return out.withColumns({"drop": F.col("manual") | low | F.col("recurrent_shape"), "reason": reasons})


def funnel(wide: DataFrame, gates: dict[str, str | Column]) -> DataFrame:
    """Per gate, in order: known and passed rows and their shares. A null gate is unknown and not passed."""
    parts = []
    for k, (name, g) in enumerate(gates.items()):
        c = F.col(g) if isinstance(g, str) else g
        parts += [F.struct(F.lit(k).alias("gate_order"), F.lit(name).alias("gate"), F.count(c).alias("n_known"), F.count_if(F.coalesce(c, F.lit(False))).alias("n_pass"))]
    rows = wide.agg(F.count(F.lit(1)).alias("n_raw"), F.array(*parts).alias("g")).select("n_raw", F.inline("g"))
    return rows.withColumns({"pct_of_raw": 100 * ratio(F.col("n_pass"), F.col("n_raw")), "pct_of_known": 100 * ratio(F.col("n_pass"), F.col("n_known"))})


def survival(df: DataFrame, grains: list[list[str]], columns: list[str], flags: list[str]) -> DataFrame:
    """Counts and shares of the flags at several grains in one pass (grouping sets); absent grains read as 'all'."""
    out = df.groupingSets([[F.col(c) for c in g] for g in grains], *columns).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])
    return out.fillna("all", columns).withColumns({f"{f}_rate": ratio(F.col(f"n_{f}"), F.col("n")) for f in flags})


def endpoint_thresholds(points: DataFrame, keys: list[str], value: str, caps: list[float]) -> DataFrame:
    """Share of trajectories whose top reaches each cap: a conditional count per cap in one pass."""
    top = points.groupBy(*keys).agg(F.max(value).alias("_top"))
    wide = top.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.lit(float(c)).alias("cap"), F.count_if(F.col("_top") >= c).alias("n_over")) for c in caps]).alias("c"))
    return wide.select("n", F.inline("c")).withColumn("rate", ratio(F.col("n_over"), F.col("n")))
