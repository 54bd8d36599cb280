"""Comparison of model runs from metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unpivot_metrics(runs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    return runs.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(key, metrics, "metric", "value").filter(F.col("value").isNotNull())


def best_per_metric(long: DataFrame, key: str, lower_is_better: list[str]) -> DataFrame:
    """Best run of each metric: smallest for the named metrics, else largest; ties by name."""
    low = F.col("metric").isin(lower_is_better)
    merit = F.when(low, -F.col("value")).otherwise(F.col("value"))
    best = long.groupBy("metric").agg(F.min(F.struct((-merit).alias("m"), F.col(key), F.col("value"))).alias("b"))
    return best.select("metric", F.col(f"b.{key}").alias("best"), F.col("b.value").alias("value"))


def win_counts(best: DataFrame) -> DataFrame:
    return best.groupBy("best").agg(F.count(F.lit(1)).alias("wins"))


def comparison(long: DataFrame, key: str, models: list[str], gap: tuple[str, str, str] | None = None) -> DataFrame:
    """Metric by model table; ``gap`` = (new metric, a, b) adds the row a - b."""
    if gap:
        name, a, b = gap
        one = lambda m: long.filter(F.col("metric") == m).select(key, F.col("value").alias(m))
        extra = one(a).join(one(b), key).select(key, F.lit(name).alias("metric"), (F.col(a) - F.col(b)).alias("value"))
        long = long.unionByName(extra)
    return long.groupBy("metric").pivot(key, models).agg(F.first("value"))


def early_stop(series: DataFrame, run: str, epoch: str, value: str, patience: int = 3, higher_better: bool = True, tolerance: float = 1e-10) -> DataFrame:
    """Per run: place and value of the best epoch, and the place where ``patience`` epochs had brought no gain.

    A gain exceeds the best of all earlier epochs by more than the tolerance times its
    size; above a best of zero any larger value is a gain. Places count from 0.
    """
    in_order = Window.partitionBy(run).orderBy(epoch)
    merit = F.col("v") if higher_better else -F.col("v")
    earlier = F.max("merit").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    s = series.select(run, epoch, F.col(value).cast("double").alias("v")).withColumn("merit", merit).withColumn("place", (F.row_number().over(in_order) - 1).cast("bigint"))
    s = s.withColumn("gain", earlier.isNull() | (F.col("merit") - earlier > tolerance * F.abs(earlier)))
    last_gain = F.last(F.when(F.col("gain"), F.struct("place", "v")), ignorenulls=True).over(in_order)
    s = s.withColumn("best", last_gain).withColumn("over", F.when(F.col("place") - F.col("best.place") >= patience, F.col("place")))
    ends = s.groupBy(run).agg(F.coalesce(F.min_by("best", "over"), F.max_by("best", "place")).alias("b"), F.min("over").alias("stop_epoch"))
    return ends.select(run, F.col("b.place").alias("best_epoch"), F.col("b.v").alias("best_value"), "stop_epoch")
