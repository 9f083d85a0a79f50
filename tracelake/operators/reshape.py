"""Between wide, long and sequence forms, and unions of tables from many sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_sequences(points: DataFrame, keys: list[str], order: str, cols: list[str], first: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per key: an array of structs in order, its length, and the first known value of other columns."""
    seq = F.array_sort(F.collect_list(F.struct(order, *cols)))
    return points.groupBy(*keys).agg(seq.alias("series"), F.count(F.lit(1)).alias("seq_len"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first])


def to_columns(points: DataFrame, keys: list[str], pos: str, value: str, n: int, prefix: str) -> DataFrame:
    """A fixed number of columns ``<prefix>_000`` ...: for export only."""
    out = points.groupBy(*keys).pivot(pos, list(range(n))).agg(F.first(value))
    return out.withColumnsRenamed({str(k): f"{prefix}_{k:03d}" for k in range(n)})


def from_columns(wide: DataFrame, keys: list[str], prefix: str, value: str) -> DataFrame:
    """Long rows (keys, pos, value) from ``<prefix>_NNN`` columns; nulls are left out."""
    cols = [c for c in wide.columns if c.startswith(f"{prefix}_") and c.rpartition("_")[2].isdigit()]
    long = wide.unpivot(keys, cols, "_name", value).filter(F.col(value).isNotNull())
    return long.select(*keys, F.regexp_extract("_name", r"_(\d+)$", 1).cast("int").alias("pos"), value)


def dense_id(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """Number the distinct combinations in order. The ranks are taken on the distinct rows only."""
    ids = df.select(*cols).distinct().withColumn(out, F.dense_rank().over(W.orderBy(*[F.col(c).asc_nulls_last() for c in cols])) - 1)
    ids = ids.withColumnsRenamed({c: f"_id_{c}" for c in cols})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_id_{c}")) for c in cols])
    return df.join(ids, same).drop(*[f"_id_{c}" for c in cols])


def union_all(tables: list[DataFrame], tag: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Tables with differing columns in one, tagged with their source."""
    if tag:
        tables = [t.withColumn(tag, F.lit(n)) for t, n in zip(tables, names or [])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_sources(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Inner join of sources on shared keys, other columns prefixed by the source's name."""
    named = [t.withColumnsRenamed({c: f"{n}_{c}" for c in t.columns if c not in keys}) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, keys), named)
