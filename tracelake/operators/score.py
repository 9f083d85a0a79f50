"""Scoring and calibration of probabilistic predictions (truth, mu, sigma), as aggregations over column expressions.

Every measure is an aggregate, so one grouped pass gives all of them at any grain; level grids are small arrays that are
exploded after a pre-aggregation where the counts allow it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.draws import poisson_counts
from tracelake.functions.scalars import normal_cdf, normal_pdf, ratio
from tracelake.operators.select import joined, quantiles, stored

FLOOR = 1e-9
LEVELS = tuple(round(0.025 + 0.95 * k / 18, 12) for k in range(19))
#: Quantiles of the standard normal distribution.
QUANTILES = {0.5: 0.0, 0.75: 0.6744897501960817, 0.9: 1.2815515655446004, 0.95: 1.6448536269514722, 0.975: 1.959963984540054, 0.1: -1.2815515655446004}


def scored(df: DataFrame, truth: str = "truth", mu: str = "mu", sigma: str = "sigma") -> DataFrame:
    """Add resid, abs_err, sig, z, pit, crps and nll."""
    sig = F.greatest(F.col(sigma), F.lit(FLOOR))
    df = df.withColumns({"sig": sig, "resid": F.col(mu) - F.col(truth)})
    df = df.withColumns({"abs_err": F.abs("resid"), "z": -F.col("resid") / F.col("sig")})
    cdf = normal_cdf(F.col("z"))
    df = df.withColumn("cdf", cdf)
    return df.withColumns({
        "pit": F.least(F.greatest(F.col("cdf"), F.lit(1e-9)), F.lit(1 - 1e-9)),
        "crps": F.col("sig") * (F.col("z") * (2 * F.col("cdf") - 1) + 2 * normal_pdf(F.col("z")) - 1 / math.sqrt(math.pi)),
        "nll": 0.5 * (math.log(2 * math.pi) + 2 * F.ln("sig") + F.col("z") * F.col("z")),
    }).drop("cdf")


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def point_metrics(df: DataFrame, keys: list[str], floor: float = 5.0, truth: str = "truth", sigma: str = "sigma") -> DataFrame:
    """Point measures of a scored frame by group; the quantiles are exact and selected by counting passes."""
    df = df.withColumn("rel_err", F.col("abs_err") / F.greatest(F.abs(F.col(truth)), F.lit(floor)))
    rmse, span = F.sqrt(F.avg(F.col("resid") * F.col("resid"))), F.max(truth) - F.min(truth)
    sums = df.groupBy(*keys).agg(
        F.count("resid").alias("n_points"), rmse.alias("rmse"), F.avg("abs_err").alias("mae"), F.avg("resid").alias("bias"), F.max("abs_err").alias("max_abs_err"),
        *[share(F.col("abs_err") <= k * F.col("sig")).alias(f"coverage_{k}sigma") for k in (1, 2, 3)],
        F.avg(sigma).alias("mean_sigma"), F.avg("rel_err").alias("mean_rel_err"), F.min(truth).alias("truth_min"), F.max(truth).alias("truth_max"), span.alias("truth_range"), ratio(rmse, span).alias("nrmse_range"),
        *[share(F.abs("z") <= QUANTILES[round(0.5 + level / 2, 3)]).alias(f"coverage_central_{round(level * 100)}") for level in (0.5, 0.8, 0.9, 0.95)],
    )
    names = {"a": ("median_abs_err", "p90_abs_err", "p95_abs_err"), "s": ("p25_sigma", "median_sigma", "p75_sigma"), "r": ("median_rel_err",)}
    q = quantiles(df, keys, {"a": "abs_err", "s": sigma, "r": "rel_err"}, {"a": (0.5, 0.9, 0.95), "s": (0.25, 0.5, 0.75), "r": (0.5,)})
    return joined(sums, q.select(*keys, *[F.col(k)[i].alias(n) for k, many in names.items() for i, n in enumerate(many)]), keys)


def additive_measures() -> list[Column]:
    """The measures that are sums and counts: safe in grouping sets over any grain."""
    return [F.count("resid").alias("n_points"), F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("rmse"), F.avg("abs_err").alias("mae"), F.avg("resid").alias("bias"), share(F.col("abs_err") <= F.col("sig")).alias("coverage_1sigma"), share(F.col("abs_err") <= 2 * F.col("sig")).alias("coverage_2sigma")]


def interval_score(level: float, truth: str = "truth", mu: str = "mu") -> Column:
    alpha = 1 - level
    half = F.col("sig") * QUANTILES[round(0.5 + level / 2, 3)]
    low, high, y = F.col(mu) - half, F.col(mu) + half, F.col(truth)
    return F.avg(high - low + (2 / alpha) * (F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))))


def pinball(q: float, truth: str = "truth", mu: str = "mu") -> Column:
    d = F.col(truth) - (F.col(mu) + F.col("sig") * QUANTILES[q])
    return F.avg(F.greatest(q * d, (q - 1) * d))


def sharp_measures(sigma: str = "sigma") -> list[Column]:
    """The probabilistic measures that are sums."""
    return [
        F.avg("nll").alias("nll"), F.avg("crps").alias("crps_mean"), F.stddev_pop("crps").alias("crps_std"),
        F.avg(sigma).alias("sharpness"), F.avg(F.abs("z")).alias("mean_abs_z"), F.avg("z").alias("z_mean"), F.var_pop("z").alias("z_var"),
        (F.sum(F.col("z") * F.col("z") - 1) / F.sqrt(2.0 * F.count("z"))).alias("spiegelhalter_z"),
        *[interval_score(x).alias(f"interval_score_{round(x * 100)}") for x in (0.5, 0.9)], *[pinball(x).alias(f"pinball_q{round(x * 100)}") for x in (0.1, 0.5, 0.9)],
    ]


def sharp_metrics(df: DataFrame, keys: list[str], sigma: str = "sigma") -> DataFrame:
    """Probabilistic measures by group, with exact quantiles of the crps."""
    q = quantiles(df, keys, {"c": "crps"}, {"c": (0.5, 0.9)})
    return joined(df.groupBy(*keys).agg(*sharp_measures(sigma)), q.select(*keys, F.col("c")[0].alias("crps_median"), F.col("c")[1].alias("crps_p90")), keys)


def reliability(df: DataFrame, keys: list[str] = [], levels: tuple[float, ...] = LEVELS, weight: str | None = None) -> DataFrame:  # noqa: B006
    """Per level: the (weighted) share of PIT values at or under it. One pass: a conditional sum for each level."""
    w = F.lit(1.0) if weight is None else F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    sums = [F.sum(F.when(F.col("pit") <= x, w).otherwise(0.0)) for x in levels]
    wide = df.groupBy(*keys).agg(F.array(*sums).alias("_s"), F.sum(w).alias("_w"))
    rows = wide.select(*keys, "_w", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("level"), F.col("_s").alias("s"))).alias("r"))
    share_ = ratio(F.col("r")["s"], F.col("_w"))
    return rows.select(*keys, F.col("r")["level"].alias("level"), share_.alias("share"), F.abs(share_ - F.col("r")["level"]).alias("error"))


def pit_histogram(df: DataFrame, keys: list[str] = [], n: int = 20, weight: str | None = None) -> DataFrame:  # noqa: B006
    """Counts and shares per equal bin, empty bins included."""
    w = F.lit(1.0) if weight is None else F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    b = F.least(F.floor(F.col("pit") * n), F.lit(n - 1)).cast("int")
    held = df.withColumns({"bin": b, "_w": w}).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"), F.sum("_w").alias("_w"))
    grid = (df.select(*keys).distinct() if keys else df.sparkSession.range(1)).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    out = grid.join(held, [*keys, "bin"], "left").fillna(0, ["count", "_w"])
    return out.withColumn("share", ratio(F.col("_w"), F.sum("_w").over(W.partitionBy(*keys)))).drop("_w")


def coverage_curve(df: DataFrame, keys: list[str], ks: tuple[float, ...]) -> DataFrame:
    """Share of |z| <= k and what a normal distribution has there."""
    wide = df.groupBy(*keys).agg(F.array(*[share(F.abs("z") <= k) for k in ks]).alias("_c"))
    rows = wide.select(*keys, F.explode(F.arrays_zip(F.array(*[F.lit(float(k)) for k in ks]).alias("k"), F.col("_c").alias("c"))).alias("r"))
    return rows.select(*keys, F.col("r")["k"].alias("k"), F.col("r")["c"].alias("coverage"), (2 * normal_cdf(F.col("r")["k"]) - 1).alias("nominal"))


def sigma_deciles(df: DataFrame, sigma: str = "sigma", n: int = 10) -> DataFrame:
    """Calibration by quantile bin of sigma: right-closed bins between distinct quantile edges, the first closed on the left too."""
    edges = stored(quantiles(df, [], {"e": sigma}, {"e": [k / n for k in range(n + 1)]}), "edges")
    df = df.withColumn("_e", edges.select(F.array_distinct("e")).scalar())
    df = df.withColumn("bin", F.greatest(F.size(F.filter("_e", lambda e: e < F.col(sigma))), F.lit(1)))
    out = df.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(sigma).alias("mean_sigma"), F.avg("abs_err").alias("mae"), F.sqrt(F.avg(F.col("resid") * F.col("resid"))).alias("rmse"),
        share(F.abs("z") <= 1).alias("coverage_1sigma"), share(F.abs("z") <= 2).alias("coverage_2sigma"),
    )
    q = quantiles(df, ["bin"], {"q": F.abs("z")}, {"q": (0.9,)})
    return joined(out, q.select("bin", F.col("q")[0].alias("p90_abs_z")), ["bin"])


def ks_statistic(df: DataFrame, keys: list[str], cells: int = 4096) -> DataFrame:
    """Kolmogorov-Smirnov distance of the PIT from uniform: (keys, ks, n).

    PIT values are dealt to equal cells; a cell's ranks start at the count of the cells before it, so the sort within a cell
    is a window of its own and no task holds all rows.
    """
    df = df.withColumn("_cell", F.least(F.floor(F.col("pit") * cells), F.lit(cells - 1)))
    sizes = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_k"))
    order = W.partitionBy(*keys).orderBy("_cell")
    sizes = sizes.withColumns({"_before": F.sum("_k").over(order) - F.col("_k"), "_n": F.sum("_k").over(W.partitionBy(*keys))})
    rows = df.join(sizes.drop("_k"), [*keys, "_cell"])
    rank = F.row_number().over(W.partitionBy(*keys, "_cell").orderBy("pit")) + F.col("_before")
    rows = rows.withColumn("_r", rank)
    return rows.groupBy(*keys).agg(F.max(F.greatest(F.col("_r") / F.col("_n") - F.col("pit"), F.col("pit") - (F.col("_r") - 1) / F.col("_n"))).alias("ks"), F.first("_n").alias("n"))


def weighted_mean(value: str | Column, weight: str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    ok = (F.col(weight) > 0) & v.isNotNull()
    return ratio(F.sum(F.when(ok, v * F.col(weight))), F.sum(F.when(ok, F.col(weight))))


def poisson_count(u: Column) -> Column:
    """A Poisson(1) count by inverting a uniform number."""
    out, p, total = F.lit(0), math.exp(-1), math.exp(-1)
    for k in range(1, 12):
        out = out + F.when(u >= total, 1).otherwise(0)
        p /= k
        total += p
    return out


def replicated(df: DataFrame, key: str | Column, reps: int, seed: str) -> DataFrame:
    """Each row of ``df`` once for each replicate that takes it, with ``rep`` from 1 and its Poisson count ``w``.

    Counts come from MD5 digests of (seed, block, key), a digest serving the four replicates of a block: the same on every run
    and in every engine. Apply it to rows that are reduced to one per cluster.
    """
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))
    blocks = df.select("*", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // 4))).alias("_b"))
    blocks = blocks.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_b").cast("string"), F.lit(":"), k)))
    u = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("double") / float(1 << 32)
    four = F.array(*[F.struct((F.col("_b") * 4 + (i + 1)).alias("rep"), poisson_count(u(i)).alias("w")) for i in range(4)])
    return blocks.select(*df.columns, F.inline(four)).filter(f"w > 0 and rep <= {reps}")


def _replicate(batches: Iterator[pa.RecordBatch], p: int, reps: int, seed: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of the last ``p`` columns of batches by the columns before these, the last of which is the key to draw by."""
    for batch in batches:
        *groups, key = batch.columns[:-p]
        #: a key that a batch has more than once is drawn once
        key = key.dictionary_encode()
        w = poisson_counts(key.dictionary, reps, seed)[:, key.indices.to_numpy()]
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[-p:]], 1)
        known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[-p:]], 1)
        #: zero times these is no number, so they are added up where they are taken only
        odd = (known & ~np.isfinite(x)).any(1)
        even = np.where(known & ~odd[:, None], x, 0.0)
        group = np.zeros(batch.num_rows, np.int64)
        for c in groups:
            c = c.dictionary_encode("encode")
            group = np.unique(group * len(c.dictionary) + c.indices.to_numpy(), return_inverse=True)[1]
        if not batch.num_rows:
            continue
        order = np.argsort(group, kind="stable")
        firsts, sums, counts, taken = [], [], [], []
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            firsts.append(rows[0])
            own = w[:, rows].astype(float)
            sums.append(own @ even[rows])
            for k in rows[odd[rows]]:
                sums[-1] += np.where((w[:, k, None] > 0) & known[k], w[:, k, None] * np.where(known[k], x[k], 0.0), 0.0)
            counts.append(own @ known[rows])
            taken.append(own.any(1))
        keep = np.concatenate(taken)
        sums, counts = np.concatenate(sums)[keep], np.concatenate(counts)[keep]
        at = pa.array(np.repeat(firsts, reps)[keep])
        rep = pa.array(np.tile(np.arange(1, reps + 1, dtype=np.int32), len(firsts))[keep])
        yield pa.RecordBatch.from_arrays([*[c.take(at) for c in groups], rep, *[pa.array(sums[:, k], mask=counts[:, k] == 0) for k in range(p)]], names=names)


def replicated_sums(df: DataFrame, keys: list[str], key: str | Column, reps: int, seed: str, cols: list[str]) -> DataFrame:
    """(keys, rep, weighted sums of ``cols``): the sums by replicate over the rows of :func:`replicated`, which aren't made.

    A task draws the counts of a batch's keys as arrays and sends one row for each group and replicate of a batch. Rows need not
    be reduced to one per cluster, as a weighted sum of a cluster's sum is that of its rows.
    """
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))
    rows = df.select(*keys, k.alias("_key"), *[F.col(c).cast("double").alias(c) for c in cols])
    out = df.select(*keys, F.lit(1).alias("rep"), *[F.col(c).cast("double").alias(c) for c in cols])
    parts = rows.mapInArrow(partial(_replicate, p=len(cols), reps=reps, seed=seed, names=out.columns), out.schema)
    return parts.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in cols])


def bootstrap_ci(df: DataFrame, keys: list[str], cluster: str, reps: int, seed: str, level: float = 0.95) -> DataFrame:
    """Percentile intervals of rmse, mae and bias by a cluster bootstrap.

    A replicate reweights the rows by the counts of their clusters; only its sums are shuffled.
    """
    rows = df.select(*keys, F.col(cluster).alias("_cluster"), F.col("resid").isNotNull().cast("double").alias("n"), F.col("resid").alias("s"), F.col("abs_err").alias("a"), (F.col("resid") * F.col("resid")).alias("q"))
    each = replicated_sums(rows, keys, "_cluster", reps, seed, list("nsaq"))
    each = each.select(*keys, F.sqrt(F.col("q") / F.col("n")).alias("rmse"), (F.col("a") / F.col("n")).alias("mae"), (F.col("s") / F.col("n")).alias("bias"))
    low, high = (1 - level) / 2, (1 + level) / 2
    #: one row a replicate is left
    return each.groupBy(*keys).agg(*[F.percentile(c, F.lit(p)).alias(f"{c}_{side}") for c in ("rmse", "mae", "bias") for side, p in (("low", low), ("high", high))])
