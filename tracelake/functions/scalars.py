"""Column expressions for cleaning and keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(c: Column) -> Column:
    """Double, with NaN, infinities and text that is no number as null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def as_boolean(c: Column, default: bool | None = None) -> Column:
    """Tolerant truth values from text; anything else is the default."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "1.0", "yes", "y", "t"), True).when(t.isin("false", "0", "0.0", "no", "n", "f"), False).otherwise(F.lit(default).cast("boolean"))


def stable_key(*cols: tuple[Column, bool]) -> Column:
    """Columns joined by a pipe, numbers (flagged True) with six decimals, nulls as <NA>."""
    return F.concat_ws("|", *[F.coalesce(F.when(c.isNotNull(), F.format_string("%.6f", c.cast("double"))) if number else c.cast("string"), F.lit("<NA>")) for c, number in cols])


def time_bin(time: Column, width: float, n_bins: int, start: float = 0.0) -> Column:
    """Floor of (time - start) / width, clipped to the first and last bin."""
    return F.least(F.greatest(F.floor((time - start) / width), F.lit(0)), F.lit(n_bins - 1)).cast("int")


def first_known(*cols: Column) -> Column:
    """First value that is neither null nor NaN, for a chain of fallbacks."""
    return F.coalesce(*[F.nanvl(c, F.lit(None).cast("double")) for c in cols])


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


#: Coefficients of a published polynomial approximation of the normal distribution function, error under 7.5e-8.
CDF_P, CDF_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) * (1 / math.sqrt(2 * math.pi))


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal, by built-in functions."""
    t = 1 / (1 + F.abs(z) * CDF_P)
    poly = F.lit(0.0)
    for b in reversed(CDF_B):
        poly = t * (F.lit(b) + poly)
    tail = normal_pdf(z) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    """The same for other engines."""
    t, poly = f"(1 / (1 + abs({z}) * {CDF_P}))", "0.0"
    for b in reversed(CDF_B):
        poly = f"({t} * ({b} + {poly}))"
    tail = f"(exp(-({z}) * ({z}) / 2) * {1 / math.sqrt(2 * math.pi)!r} * {poly})"
    return f"(CASE WHEN ({z}) >= 0 THEN 1 - {tail} ELSE {tail} END)"
