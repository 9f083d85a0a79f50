"""What the query modules share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Queries with the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def nearest(c, digits: int = 6):
    """DuckDB's round of doubles: x * 10^n to the nearest whole number, halves away from zero, by 10^n; so the same ties.

    Spark's round reads the shortest decimal form instead, which takes 2.471665 up though the double times 1e5 is under the half.
    """
    c = F.col(c) if isinstance(c, str) else c
    scaled, scale = c * float(10**digits), float(10**digits)
    size = F.abs(scaled)
    whole = F.floor(size).cast("double")
    up = F.when(size - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(size < float(1 << 52), F.signum(scaled) * (whole + up) / scale).when(size < float("inf"), scaled / scale).otherwise(c)


def stepped(c, digits: int = 6):
    """Rounding by floor(x * 10^n + 1/2): the same operations, so the same ties, in every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def stepped_sql(c: str, digits: int = 6) -> str:
    return f"(floor(({c}) * {float(10**digits)} + 0.5) / {float(10**digits)})"


def replicated_sql(source: str, key: str, reps: int, seed: str) -> str:
    """A statement that gives the rows of :func:`tracelake.operators.score.replicated`."""
    steps, p, total = [], math.exp(-1), math.exp(-1)
    for k in range(1, 12):
        steps.append(f"(u >= {total!r})::INT")
        p /= k
        total += p
    u = f"('0x' || substr(md5('{seed}:' || b_ || ':' || coalesce(({key})::VARCHAR, 'null')), 8 * p_ + 1, 8))::BIGINT::DOUBLE / {float(1 << 32)!r}"
    drawn = f"SELECT *, 4 * b_ + p_ + 1 AS rep, {u} AS u FROM {source}, (SELECT unnest(range({(reps - 1) // 4 + 1})) AS b_), (SELECT unnest(range(4)) AS p_)"
    return f"SELECT * FROM (SELECT *, {' + '.join(steps)} AS w FROM ({drawn}) WHERE rep <= {reps}) WHERE w > 0"
