"""Exact order statistics of groups of any size, by refinement on the bits of a double.

A double becomes a signed long of the same order: its exponent and fraction as they are stored. A pass counts rows by group and
leading bits (20, then 42, then all 64), with map-side sums; running totals over these cells tell which cell holds a wanted rank,
and only rows of such cells go into the next pass. Three passes reach the value whatever its distribution; no group's values
are gathered, sorted or put into a window, and what a group shuffles is at most its number of cells.

Nulls are left out; NaN counts as the largest value; a group without values has no row. Quantiles lie between neighbours in
proportion (the usual continuous definition).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.sources.recordings import scratch

FRACTION = 1 << 52
PASSES = (44, 22, 0)


def order_code(x: Column) -> Column:
    """A long that is ordered as the double is: the sign times its stored exponent and fraction."""
    a, two = F.abs(x), F.lit(2.0)
    e = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023))
    #: the logarithm may be off by one next to a power of two
    e = e - F.when(F.pow(two, e) > a, 1).otherwise(0) + F.when(F.pow(two, e + 1) <= a, 1).otherwise(0)
    normal = (e + 1023) * F.lit(FRACTION) + ((a / F.pow(two, e) - 1) * float(FRACTION)).cast("long")
    tiny = (a * 2.0**537 * 2.0**537).cast("long")
    size = F.when(F.isnan(x), F.lit(2047 * FRACTION + 1)).when(a == float("inf"), F.lit(2047 * FRACTION)).when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.when(x.isNotNull(), F.when(F.isnan(x) | (x >= 0), size).otherwise(-size))


def from_code(c: Column) -> Column:
    a = F.abs(c)
    e, part = F.shiftright(a, 52), a.bitwiseAND(F.lit(FRACTION - 1))
    size = F.when((e == 2047) & (part > 0), F.lit(float("nan"))).when(e == 2047, F.lit(float("inf"))).when(e == 0, part * F.lit(5e-324)).otherwise((1 + part / float(FRACTION)) * F.pow(F.lit(2.0), e - 1023))
    return F.when(c < 0, -size).otherwise(size)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written and read back, so that its size is known when it is joined."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of a table of one row per key; null keys match each other."""
    if not keys:
        return df.join(small, F.lit(True), how)
    named = small.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(named[f"_k_{k}"])
    return df.join(named, same, how).drop(*[f"_k_{k}" for k in keys])


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    at = (n - 1) * F.lit(float(p))
    return F.floor(at), F.ceil(at)


def _within(cells: DataFrame, cell: Sequence[str], wanted: Column) -> DataFrame:
    """The cells that hold a wanted (rank, rest), with these, each less the rows of the cells before it."""
    held = F.filter(wanted, lambda r: (r["rest"] >= F.col("_before")) & (r["rest"] < F.col("_before") + F.col("_n")))
    held = F.transform(held, lambda r: F.struct(r["rank"].alias("rank"), (r["rest"] - F.col("_before")).alias("rest")))
    return cells.withColumn("_r", held).filter(F.size("_r") > 0).select(*cell, "_r", "_total")


def quantiles(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str], ps: Mapping[str, Sequence[float]]) -> DataFrame:
    """(keys, an array of quantiles for each of ``values``): those that ``ps`` names for it."""
    names = list(values)
    col = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
    codes = F.array(*[F.struct(F.lit(i).alias("_v"), order_code(col(values[k])).alias("_c")) for i, k in enumerate(names)])
    rows = df.select(*keys, F.inline(codes)).filter("_c is not null")

    by, shift = [*keys, "_v"], PASSES[0]
    cells = rows.groupBy(*by, F.shiftright("_c", shift).alias("_p")).agg(F.count("*").alias("_n"))
    cells = cells.withColumns({"_total": F.sum("_n").over(W.partitionBy(*by)), "_before": F.sum("_n").over(W.partitionBy(*by).orderBy("_p")) - F.col("_n")})
    asked = F.lit(None)
    for i, k in enumerate(names):
        at = [r for p in ps[k] for r in _ranks(F.col("_total"), p)]
        asked = F.when(F.col("_v") == i, F.array_distinct(F.array(*at))).otherwise(asked)
    cells = _within(cells, [*by, "_p"], F.transform(asked, lambda r: F.struct(r.alias("rank"), r.alias("rest"))))
    for after in PASSES[1:]:
        cells = stored(cells, "ranks")
        some = cells.select(*by, "_p")
        here = joined(rows.withColumn("_p", F.shiftright("_c", shift)), some, [*by, "_p"], "left_semi")
        step = shift - after
        counts = here.groupBy(*by, F.shiftright("_c", after).alias("_q")).agg(F.count("*").alias("_n")).withColumn("_p", F.shiftright("_q", step))
        whole = W.partitionBy(*by, "_p").orderBy("_q")
        counts = counts.withColumn("_before", F.sum("_n").over(whole) - F.col("_n"))
        counts = joined(counts, cells.withColumnsRenamed({"_r": "_w"}), [*by, "_p"], "inner")
        cells = _within(counts, [*by, "_q"], F.col("_w")).withColumnRenamed("_q", "_p")
        shift = after
    found = cells.select(*by, "_total", F.explode("_r.rank").alias("rank"), from_code(F.col("_p")).alias("x"))
    each = found.groupBy(*by).agg(F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_x"))

    def between(p: float) -> Column:
        low, high = _ranks(F.col("_total"), p)
        at, a, b = (F.col("_total") - 1) * F.lit(float(p)), F.element_at("_x", low), F.element_at("_x", high)
        return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)

    found = lambda i, k: F.max(F.when(F.col("_v") == i, F.array(*[between(p) for p in ps[k]]))).alias(k)
    return each.groupBy(*keys).agg(*[found(i, k) for i, k in enumerate(names)])


def medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str]) -> DataFrame:
    """(keys, the median of each of ``values``)."""
    out = quantiles(df, keys, values, {k: [0.5] for k in values})
    return out.select(*keys, *[F.get(k, F.lit(0)).alias(k) for k in values])


def median_spreads(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, med_<value>, mad_<value>): the median of each value, and the median distance from it."""
    mid = stored(medians(df, keys, {f"med_{v}": v for v in values}), "medians")
    far = joined(df.select(*keys, *values), mid, keys).select(*keys, *[F.abs(F.col(v) - F.col(f"med_{v}")).alias(v) for v in values])
    return joined(mid, stored(medians(far, keys, {f"mad_{v}": v for v in values}), "spreads"), keys)


def median_spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, med, mad) of one value."""
    return median_spreads(df, keys, [value]).withColumnsRenamed({f"med_{value}": "med", f"mad_{value}": "mad"})
