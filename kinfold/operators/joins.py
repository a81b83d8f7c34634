"""Skew-aware building blocks shared by the operators.

* Per-key facts are computed with ``groupBy`` (map-side partial
  aggregation, so a key holding a third of all rows costs one small
  partial per task) and joined back, instead of windows partitioned by the
  key (a window would pull every row of a hot key into one task).
* Rows whose join key is NULL never match, but a plain shuffle would still
  hash all of them to one reducer. ``join_back`` gives such rows a spread
  salt so they scatter over all partitions.
* Hot non-NULL keys on the row side are split at runtime by AQE's skew-join
  rule (left outer joins split the left side); registries with a fixed,
  known bound are broadcast explicitly, data-grown ones are left to AQE's
  measured broadcast threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD_BUCKETS = 512
_SPREAD = "__spread"


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def join_back(df: DataFrame, registry: DataFrame, keys: list[str] | str,
              how: str = "left", spread_on: list[str] | str | None = None,
              bounded: bool = False) -> DataFrame:
    """Join a per-key registry back onto rows.

    ``spread_on`` names row columns (an id) used to scatter NULL-key rows;
    ``bounded=True`` marks a registry with a fixed size bound (broadcast).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    reg = F.broadcast(registry) if bounded else registry
    if spread_on is None or how not in ("left", "left_outer"):
        return df.join(reg, on=keys, how=how)
    spread_on = [spread_on] if isinstance(spread_on, str) else list(spread_on)
    salted = df.withColumn(
        _SPREAD,
        F.when(_any_null(keys), F.pmod(F.xxhash64(*spread_on), F.lit(SPREAD_BUCKETS)))
         .otherwise(F.lit(0)).cast("int"))
    # Always 0, but no literal: Spark would put that into the condition and deal the rows by the other keys alone.
    reg = reg.withColumn(_SPREAD, F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int"))
    return salted.join(reg, on=keys + [_SPREAD], how="left").drop(_SPREAD)


def join_null_safe(df: DataFrame, registry: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; ``keys`` come once,
    from ``df``. Still a hash-dealt join: ``<=>`` is an equality to Spark."""
    reg = registry.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in registry.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return df.join(reg, cond, how).drop(*[f"__r_{k}" for k in keys])


def add_key_count(df: DataFrame, keys: list[str] | str, out: str, spread_on=None) -> DataFrame:
    """``count(*) over (partition by keys)`` as aggregate + join back; rows
    with a NULL key get NULL."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    reg = df.where(~_any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return join_back(df, reg, keys, spread_on=spread_on)


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (a proven size of one row) to every row."""
    return df.crossJoin(F.broadcast(scalar))
