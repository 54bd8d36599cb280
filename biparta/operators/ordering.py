"""Global order without a single-task window: ranks, running sums, exact quantiles.

The input is range-partitioned on the full sort key and written once; row places
inside each range come from the write order, and only one row per range (partial
sums) is windowed. A hot value spreads over ranges because the sort key ends in an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biparta.session import materialize

_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def _placed(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Write ``df`` in range order with its partition number and place inside it."""
    slot = F.col("__slot")
    # no fixed number of ranges: AQE joins small neighbouring ones, which keeps the order
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.withColumn("__slot", F.monotonically_increasing_id()), label).select(
        "*", F.shiftright(slot, _ROW_BITS).alias("__gr_part"), slot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("__gr_place")
    )


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", start: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Ordinal rank over the whole table, or inside each of a few ``by`` groups.

    ``order`` must end in a unique column. For many groups use ``row_number`` over
    a partitioned window instead.
    """
    keys = [F.col(b).asc() for b in by] + list(order)
    placed = _placed(df, keys, "rank").drop("__slot")
    parts = placed.groupBy("__gr_part", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__gr_place").alias("__gr_head"))
    # one row per range (and group): bounded by the number of shuffle partitions
    before = Window.partitionBy(*by).orderBy("__gr_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__gr_before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    side = F.broadcast(offsets) if not by else offsets
    rank = F.col("__gr_before") + F.col("__gr_place") - F.col("__gr_head") + F.lit(start)
    return placed.join(side, ["__gr_part", *by]).withColumn(name, rank.cast("bigint")).drop("__gr_part", "__gr_place", "__gr_before", "__gr_head")


def running_sum(df: DataFrame, order: list[Column], values: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` in global order."""
    keys = [F.col(b).asc() for b in by] + list(order)
    placed = _placed(df, keys, "running").drop("__slot")
    inside = Window.partitionBy("__gr_part", *by).orderBy("__gr_place").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(v).over(inside).alias(f"__in_{n}") for n, v in values.items()])
    parts = placed.groupBy("__gr_part", *by).agg(*[F.sum(v).alias(f"__sum_{n}") for n, v in values.items()])
    before = Window.partitionBy(*by).orderBy("__gr_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__gr_part", *by, *[F.sum(f"__sum_{n}").over(before).alias(f"__off_{n}") for n in values])
    side = F.broadcast(offsets) if not by else offsets
    out = local.join(side, ["__gr_part", *by])
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"__off_{n}"), F.lit(0)) + F.col(f"__in_{n}"))
    extra = [f"__{kind}_{n}" for n in values for kind in ("in", "off")]
    return out.drop("__gr_part", "__gr_place", *extra)


def global_dense_rank(df: DataFrame, col: str, name: str, descending: bool = True) -> DataFrame:
    """Dense rank over the whole table: ranks the distinct values, joins them back."""
    order = F.col(col).desc() if descending else F.col(col).asc()
    ranks = global_rank(df.select(col).filter(F.col(col).isNotNull()).distinct(), [order], name)
    return df.join(ranks, col, "left")


def exact_quantiles(df: DataFrame, col: str, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Linear-interpolated quantiles ``q0, q1, ..`` (one row, or one per ``by`` group).

    Works on the value histogram, so repeated values cost one row; the histogram
    itself is summed in ranges, never in one aggregation buffer.
    """
    hist = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_sum(hist, [F.col("__v").asc()], {"__cum": "__n"}, by)
    totals = cum.groupBy(*by).agg(F.max("__cum").alias("__total"))
    if by:
        cum = cum.join(totals, list(by))
    else:
        cum = cum.withColumn("__total", totals.scalar())
    aggs: list[Column] = []
    for i, q in enumerate(qs):
        at = F.lit(q) * (F.col("__total") - 1)
        for end, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.min(F.when(F.col("__cum") > pos, F.col("__v"))).alias(f"__{end}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"__f{i}"))
    bounds = cum.groupBy(*by).agg(*aggs)
    outs = [(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(f"q{i}") for i in range(len(qs))]
    return bounds.select(*by, *outs)


def value_at_position(df: DataFrame, col: str, position: Column) -> Column:
    """Scalar: the value at a 0-based position of the sorted column."""
    hist = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_sum(hist, [F.col("__v").asc()], {"__cum": "__n"})
    cum = cum.withColumn("__total", cum.agg(F.max("__cum").alias("t")).scalar())
    return cum.filter(F.col("__cum") > position).agg(F.min("__v").alias("v")).scalar()


def range_bucket(col: Column, splits: list[float]) -> Column:
    """Number of splits at or below the value, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col < F.lit(splits[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splits)) if splits else F.lit(0)


def split_points(df: DataFrame, col: str, parts: int) -> list[float]:
    """At most ``parts - 1`` values that cut the column into similar shares."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), shares, F.lit(10 * parts)).alias("s")).first()
    return sorted(set(row["s"] or []))
