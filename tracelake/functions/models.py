"""Penetration models as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expit(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def quarter_curve(t: Column, k: Column, t0: Column, s: Column) -> Column:
    """expit((t - t0) / s) k t^(1/4)."""
    return expit((t - t0) / s) * k * F.pow(F.greatest(t, F.lit(0.0)), F.lit(0.25))


def blend_curve(t: Column, k_sqrt: Column, k_quarter: Column, t0: Column, s: Column) -> Column:
    """From a square-root to a quarter-root branch by a sigmoid around t0."""
    w, pos = expit((t - t0) / s), F.greatest(t, F.lit(0.0))
    return (1 - w) * k_sqrt * F.sqrt(pos) + w * k_quarter * F.pow(pos, F.lit(0.25))


def blend_slope(t: Column, k_sqrt: Column, k_quarter: Column, t0: Column, s: Column) -> Column:
    """Time derivative of the blend, for t > 0."""
    w, pos = expit((t - t0) / s), F.greatest(t, F.lit(1e-12))
    a, b = k_sqrt * F.sqrt(pos), k_quarter * F.pow(pos, F.lit(0.25))
    return w * (1 - w) / s * (b - a) + (1 - w) * a / (2 * pos) + w * b / (4 * pos)


#: Fixed value: density of the liquid, kg/m3.
LIQUID = 840.0


def breakup_time(d: Column, dp: Column, rho: Column, kbt: float | Column) -> Column:
    return kbt * LIQUID * d / F.sqrt(rho * dp)


def breakup_curve(t: Column, d: Column, dp: Column, rho: Column, kv: float | Column, kp: float | Column, kbt: float | Column, t_inj: Column | None = None) -> Column:
    """Linear before break-up, square-root after; past twice the injection time, if given, a quarter-root stage."""
    pos = F.greatest(t, F.lit(0.0))
    early = kv * F.sqrt(2 * dp / LIQUID) * pos
    base = kp * F.pow(dp / rho, F.lit(0.25)) * F.sqrt(d)
    out = F.when(t < breakup_time(d, dp, rho, kbt), early).otherwise(base * F.sqrt(pos))
    if t_inj is None:
        return out
    ti = F.greatest(t_inj, F.lit(1e-9))
    late = 2**0.5 * base * F.pow(ti, F.lit(0.25)) * F.pow(F.greatest(t - ti, F.lit(0.0)), F.lit(0.25))
    return F.when(t > 2 * ti, late).otherwise(out)


def delay_curve(t: Column, k: float | Column, delay: float | Column, a: Column, angle: Column | None = None) -> Column:
    """k A sqrt(t - delay), times tan(angle / 2)^(-1/2) if an angle is given."""
    out = k * a * F.sqrt(F.greatest(t - delay, F.lit(0.0)))
    return out if angle is None else out / F.sqrt(F.tan(angle / 2))


def similarity_scale(dp: Column, rho: Column, d: Column, exponent: float) -> Column:
    """dP^e rho^(-1/4) d^(1/2)."""
    return F.pow(dp, F.lit(exponent)) * F.pow(rho, F.lit(-0.25)) * F.sqrt(d)
