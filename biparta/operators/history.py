"""Point-in-time lookups: what was known about a key before a given time.

Events and queries are unioned and windowed, so no inequality join is needed. A key
may hold any share of the rows: rows are first reduced to one per (key, time), then
split into time buckets whose totals are carried in from the earlier buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biparta.operators.ordering import range_bucket, split_points
from biparta.session import materialize

# Time buckets per lookup: enough that the hottest key has about so many rows in each, and no fewer than the least.
MIN_BUCKETS, BUCKET_ROWS = 32, 1_000_000


def as_of(
    queries: DataFrame,
    events: DataFrame,
    keys: list[str],
    time: str = "ts",
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    inclusive: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Totals of the events before each distinct (keys, time) of ``queries``.

    ``inclusive`` counts events at the query time itself. Sums default to 0 and
    maxima to null where there is no history. ``maxes`` may be structs that start
    with the time, which gives "the latest value of".
    """
    sums, maxes = sums or {}, maxes or {}
    group = [*keys, time]
    daily = events.groupBy(*group).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxes.items()])
    daily = materialize(daily, "daily")
    if buckets is None:
        hottest = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        buckets = max(MIN_BUCKETS, -(-hottest // BUCKET_ROWS))
    types = {f.name: f.dataType for f in daily.schema.fields}
    asked = queries.select(*group).distinct()
    event_turn, query_turn = (0, 1) if inclusive else (1, 0)
    blanks = [F.lit(None).cast(types[n]).alias(n) for n in [*sums, *maxes]]
    rows = daily.withColumn("__turn", F.lit(event_turn)).unionByName(asked.select(*group, *blanks, F.lit(query_turn).alias("__turn")))
    rows = rows.withColumn("__b", range_bucket(F.col(time).cast("double"), split_points(daily, time, buckets)))

    totals = rows.groupBy(*keys, "__b").agg(*[F.sum(n).alias(f"__c_{n}") for n in sums], *[F.max(n).alias(f"__c_{n}") for n in maxes])
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "__b",
        *[F.sum(f"__c_{n}").over(earlier).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__c_{n}").over(earlier).alias(f"__c_{n}") for n in maxes],
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(time, "__turn").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        *group,
        "__b",
        "__turn",
        *[F.sum(n).over(inside).alias(n) for n in sums],
        *[F.max(n).over(inside).alias(n) for n in maxes],
    ).filter(F.col("__turn") == query_turn)
    out = local.join(carry, [*keys, "__b"])
    zero = F.lit(0)
    return out.select(
        *group,
        *[(F.coalesce(F.col(f"__c_{n}"), zero) + F.coalesce(F.col(n), zero)).cast(types[n]).alias(n) for n in sums],
        *[F.greatest(F.col(f"__c_{n}"), F.col(n)).alias(n) if not _is_struct(types[n]) else _later(f"__c_{n}", n).alias(n) for n in maxes],
    )


def _is_struct(t) -> bool:
    return t.typeName() == "struct"


def _later(a: str, b: str) -> Column:
    """The greater of two structs; null only when both are null."""
    return F.when(F.col(a).isNull() | (F.col(b) >= F.col(a)), F.col(b)).otherwise(F.col(a))


def first_times(events: DataFrame, pair: list[str], time: str = "ts") -> DataFrame:
    """First interaction time of each pair."""
    return events.groupBy(*pair).agg(F.min(time).alias(time))


def gaps(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Per (key, time): repeats, and the gap to the key's previous distinct time.

    The first gap of a key is measured from 0, and each repeat adds a gap of 0.
    """
    counted = events.groupBy(key, time).agg(F.count(F.lit(1)).alias("repeats"))
    before = as_of(counted, counted, [key], time, maxes={"previous": F.col(time)})
    return counted.join(before, [key, time]).withColumn("gap", F.col(time) - F.coalesce("previous", F.lit(0.0)))


def gap_statistics(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Mean and population deviation of all gaps of one side (one row)."""
    return statistics_of_gaps(gaps(events, key, time))


def statistics_of_gaps(g: DataFrame) -> DataFrame:
    """As ``gap_statistics``, from a table of gaps that is at hand."""
    mean = F.sum("gap") / F.sum("repeats")
    square = F.sum(F.col("gap") * F.col("gap")) / F.sum("repeats")
    return g.agg(mean.alias("mean_gap"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_gap"), F.sum("repeats").alias("events"))
