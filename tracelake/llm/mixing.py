"""Mixing sources to target weights.

Token counts are summed by source; each source's target gives a repetition rate, and a document is taken floor(rate)
times plus once more if a hash of (seed, id, text) falls under the rate's fraction. Only (key, source, size) is shuffled, with
map-side sums, so a source that holds most rows costs no more than another; the rates are joined back, by broadcast where
Spark finds that table small.

A null text has size 0; a null source is a source of its own and comes last; rows that agree in id and text are taken alike,
and rows with a null or shared id are told apart by their text.
Sources whose documents have no words get the target 0. Extra columns pass through unchanged, whatever their names (in ``mix`` but
for the copy column, which takes the place of one of its name); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import SPACED_WORD, free_name, stored

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for each source: shares by weight of all sizes, each at most ``most`` times its size.

    Filling by weight with upper bounds has a closed form: in order of bound / weight, a source is at its bound if the
    level that the rest would get, were all before it at theirs, is not below its own. Window frames over one row per
    source compute it without a loop.
    """
    by = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    by = by.withColumn("weight", weight.cast("long"))
    bound = F.col("source_size") * most
    order = W.orderBy((bound / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumns({
        "left_size": F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(bound).over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    #: not at the bound: weight * left_size / left_weight < bound
    free = F.col("weight") * F.col("left_size") < bound * F.col("left_weight")
    level = F.first(F.when(free, F.struct("left_size", "left_weight")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    by = by.withColumns({"free": free, "level": level})
    target = F.when(F.col("free"), (F.col("weight") * F.col("level")["left_size"]).cast("double") / F.col("level")["left_weight"].cast("double"))
    return by.select("source", "source_size", F.coalesce(target, bound.cast("double")).alias("target"))


def hash_uniform(seed: str, key: Column) -> Column:
    """A number from 0 up to 1 by the first 52 bits of an MD5: the same on every run and in every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, out_col: str = "_mix", **options) -> DataFrame:
    """``docs`` with ``out_col``, in place of a column of that name: a struct of size, source_size, target and copies."""
    docs = docs.drop(out_col)
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACED_WORD)).cast("long")
    targets = source_targets(docs.select(F.col(source_col).alias("source"), size.alias("size")), **options)
    #: stored, so that its size is known before the join is planned: by broadcast, documents stay where they are
    targets = stored(targets, "mix-targets").select(F.struct("source", "source_size", "target").alias(out_col))
    out = docs.join(targets, docs[source_col].eqNullSafe(targets[out_col]["source"]), "left")
    whole, goal = F.col(out_col)["source_size"], F.col(out_col)["target"]
    rate = F.when(whole > 0, goal / whole).otherwise(0.0)
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    extra = (hash_uniform(seed, key) < rate - F.floor(rate)).cast("long")
    return out.withColumn(out_col, F.struct(size.alias("size"), whole.alias("source_size"), goal.alias("target"), (F.floor(rate) + extra).alias("copies")))


def mix(docs: DataFrame, copy_col: str = "copy", **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, numbered from 1 in ``copy_col``."""
    own = free_name(docs, "_mix")
    out = mix_rates(docs, out_col=own, **options).filter(F.col(own)["copies"] > 0)
    copies = F.sequence(F.lit(1).cast("long"), F.col(own)["copies"])
    return out.select(*[c for c in docs.columns if c != copy_col], F.explode(copies).alias(copy_col))
