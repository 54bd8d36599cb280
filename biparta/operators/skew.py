"""Joins that spread hot keys over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above this many rows, and above HOT_SHARE of all rows; by the
# second bound there are at most 1 / HOT_SHARE hot keys, so their list may be broadcast.
HOT_ROWS = 1_000_000
HOT_SHARE = 1e-4
SALTS = 64


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys whose row count makes them hot; at most ``1 / HOT_SHARE`` rows."""
    total = counts.agg(F.sum(count_col).alias("n")).scalar()
    limit = F.greatest(F.lit(float(hot_rows)), total * F.lit(HOT_SHARE))
    return counts.filter(F.col(count_col) > limit).select(*keys)


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    hot: DataFrame,
    spread_on: list[Column],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join where rows of ``hot`` keys on the big side go to ``salts`` tasks.

    ``small`` holds one row per key; the rows of hot keys are repeated once per salt.
    Results equal those of the plain join.
    """
    flagged = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))
    left = big.join(flagged, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    slots = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(flagged, keys, "left").withColumn("__salt", F.explode(slots)).drop("__hot")
    return left.drop("__hot").join(right, keys + ["__salt"], how).drop("__salt")
