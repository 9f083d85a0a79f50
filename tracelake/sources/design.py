"""Test designs: nested arrays of levels expanded into numbered conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expand_design(design: DataFrame, factors: list[str], id_col: str = "id") -> DataFrame:
    """Every combination of the arrays in ``factors``, numbered from 0 in the order of their positions, the last fastest."""
    out = design
    for f in factors:
        out = out.select("*", F.posexplode(f).alias(f"_p_{f}", f"_v_{f}")).drop(f)
    sizes = design.select(*[F.size(f).alias(f"_size_{f}") for f in factors])
    number = F.lit(0)
    for f in factors:
        number = number * sizes.select(f"_size_{f}").scalar() + F.col(f"_p_{f}")
    return out.select(number.cast("int").alias(id_col), *[F.col(f"_v_{f}").alias(f) for f in factors])


def registry(designs: DataFrame, name: str, densities: str, pressures: str) -> DataFrame:
    """(name, density, pressure) pairs from two parallel arrays per design; designs without both give none."""
    pairs = F.explode(F.arrays_zip(F.col(densities).alias("density"), F.col(pressures).alias("pressure")))
    return designs.select(name, pairs.alias("x")).select(name, "x.density", "x.pressure").dropna().distinct()


def grouped_conditions(designs: DataFrame, name: str, groups: str, levels: list[str], scalars: list[str]) -> DataFrame:
    """(name, id, level values, scalars) of designs that are arrays of groups.

    A group with an ``id`` is one condition of that id, with the group's scalars; ``levels`` are then null. A group whose
    ``expansion`` is cartesian is every combination of its ``levels`` (arrays), numbered on from 1 within the design over all such
    groups, in the order of groups and positions. Other groups give nothing; an empty array gives no combination.
    """
    g = designs.select(name, F.posexplode(groups).alias("_g", "_s"))
    one = g.filter("_s.id is not null").select(name, F.col("_s.id").cast("long").alias("id"), *[F.lit(None).cast(designs.schema[groups].dataType.elementType[f].dataType.elementType).alias(f) for f in levels], *[F.col(f"_s.{c}").alias(c) for c in scalars])
    many, order = g.filter("_s.id is null and _s.expansion = 'cartesian'"), ["_g"]
    for f in levels:
        many = many.select("*", F.posexplode(f"_s.{f}").alias(f"_p_{f}", f"_v_{f}"))
        order.append(f"_p_{f}")
    #: a design is a short list
    number = F.row_number().over(W.partitionBy(name).orderBy(*order)).cast("long")
    many = many.select(name, number.alias("id"), *[F.col(f"_v_{f}").alias(f) for f in levels], *[F.col(f"_s.{c}").alias(c) for c in scalars])
    return one.unionByName(many)
