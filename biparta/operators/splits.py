"""Time-ordered splits of an interaction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.functions.hashing import draw_int
from biparta.operators.graph import COMPANY, INVESTOR, nodes_of
from biparta.operators.ordering import exact_quantiles, global_rank, value_at_position


def split_label(time: Column, train_end: Column, val_end: Column) -> Column:
    return F.when(time <= train_end, "train").when(time <= val_end, "val").otherwise("test")


def quantile_split(events: DataFrame, qs: tuple[float, float] = (0.70, 0.85), time: str = "ts") -> DataFrame:
    """Add ``split`` by time quantiles; a row at the boundary goes left."""
    cuts = exact_quantiles(events, time, list(qs)).select(F.struct("q0", "q1").alias("q")).scalar()
    return events.withColumn("split", split_label(F.col(time), cuts["q0"], cuts["q1"]))


def classification_split(events: DataFrame, use_validation: bool = True, qs: tuple[float, float] = (0.70, 0.85), time: str = "ts") -> DataFrame:
    """Node-classification split: without validation, train takes everything before the test
    time and validation is the test part."""
    labelled = quantile_split(events, qs, time)
    if use_validation:
        return labelled
    return labelled.withColumn("split", F.when(F.col("split") == "val", "train").otherwise(F.col("split")))


def position_split(edges: DataFrame, train: float = 0.85, val: float = 0.0, time: str = "first_ts") -> DataFrame:
    """Split by the time found at row positions of the sorted edges; edges without time are dropped."""
    dated = edges.filter(F.col(time).isNotNull())
    n = dated.agg(F.count(F.lit(1)).alias("n")).scalar()

    def cut(ratio: float, last_if_full: bool) -> Column:
        at = F.floor(n * F.lit(ratio))
        position = F.greatest(at - 1, F.lit(0))
        if last_if_full:
            position = F.when(at < n, position).otherwise(n - 1)
        return value_at_position(dated, time, position)

    return dated.withColumn("split", split_label(F.col(time), cut(train, False), cut(train + val, True)))


def history_future(test: DataFrame, fraction: float = 0.5, time: str = "ts", order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Cut the test rows at a row fraction of their time order; ``split_ts`` is the first future time."""
    n = test.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = global_rank(test, [F.col(time).asc(), *[F.col(o).asc() for o in order]], "__place", start=0)
    at = F.floor(n * F.lit(fraction))
    first = placed.filter(F.col("__place") >= at).agg(F.min(time).alias("t")).scalar()
    return placed.select("*", F.when(F.col("__place") < at, "history").otherwise("future").alias("part"), first.alias("split_ts")).drop("__place")


def future_links(parts: DataFrame) -> DataFrame:
    """Distinct pairs of the future part."""
    return parts.filter(F.col("part") == "future").select(COMPANY, INVESTOR).distinct()


def inductive_nodes(events: DataFrame, share: float = 0.1, seed: int = 2020, qs: tuple[float, float] = (0.70, 0.85), time: str = "ts") -> DataFrame:
    """Nodes held out of training: ``share`` of the count of all nodes, drawn among those
    active after the train time. ``half`` cuts the draw in two for separate val and test sets."""
    labelled = quantile_split(events, qs, time)
    count = nodes_of(events).agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("n")).scalar()
    late = nodes_of(labelled.filter(F.col("split") != "train"))
    drawn = late.withColumn("__draw", draw_int(seed, "side", "id"))
    placed = global_rank(drawn, [F.col("__draw").asc(), F.col("side").asc(), F.col("id").asc()], "__place", start=0)
    kept = placed.filter(F.col("__place") < count)
    size = F.least(count, late.agg(F.count(F.lit(1)).alias("n")).scalar())
    return kept.select("side", "id", F.when(F.col("__place") < F.floor(size / 2), "val").otherwise("test").alias("half"))


def inductive_split(
    events: DataFrame,
    share: float = 0.1,
    seed: int = 2020,
    qs: tuple[float, float] = (0.70, 0.85),
    time: str = "ts",
    separate: bool = False,
) -> DataFrame:
    """Add ``split`` and ``has_new_node``; train rows that touch a held-out node get split ``dropped``.

    A node is new when training never sees it; with ``separate`` the validation and
    test rows look at their own half of the held-out nodes only.
    """
    labelled = quantile_split(events, qs, time)
    held = inductive_nodes(events, share, seed, qs, time)
    flags = labelled
    for side in (COMPANY, INVESTOR):
        ids = held.filter(F.col("side") == side).select(F.col("id").alias(side), F.col("half").alias(f"__h_{side}"))
        flags = flags.join(ids, side, "left")
    touches = F.col(f"__h_{COMPANY}").isNotNull() | F.col(f"__h_{INVESTOR}").isNotNull()
    flags = flags.withColumn("split", F.when((F.col("split") == "train") & touches, "dropped").otherwise(F.col("split")))
    if separate:
        hit = lambda half: (F.col(f"__h_{COMPANY}") == half) | (F.col(f"__h_{INVESTOR}") == half)
        new = F.coalesce(F.when(F.col("split") == "val", hit("val")).when(F.col("split") == "test", hit("test")), F.lit(False))
        return flags.withColumn("has_new_node", new).drop(f"__h_{COMPANY}", f"__h_{INVESTOR}")
    seen = nodes_of(flags.filter(F.col("split") == "train"))
    for side in (COMPANY, INVESTOR):
        ids = seen.filter(F.col("side") == side).select(F.col("id").alias(side), F.lit(True).alias(f"__s_{side}"))
        flags = flags.join(ids, side, "left")
    new = F.col(f"__s_{COMPANY}").isNull() | F.col(f"__s_{INVESTOR}").isNull()
    return flags.withColumn("has_new_node", new & F.col("split").isin("val", "test")).drop(
        f"__h_{COMPANY}", f"__h_{INVESTOR}", f"__s_{COMPANY}", f"__s_{INVESTOR}"
    )


def leak_free_history(labelled: DataFrame, parts: DataFrame) -> DataFrame:
    """Training, validation and history rows: everything known before the future part."""
    known = labelled.filter(F.col("split").isin("train", "val"))
    history = parts.filter(F.col("part") == "history")
    cols = [c for c in known.columns if c in history.columns]
    return known.select(*cols).unionByName(history.select(*cols))


def after_horizon(events: DataFrame, train: DataFrame, time: str = "ts") -> DataFrame:
    """Events later than the last training event."""
    end = train.agg(F.max(time).alias("t")).scalar()
    return events.filter(F.col(time) > end)


def new_nodes(events: DataFrame, train: DataFrame) -> DataFrame:
    return nodes_of(events).join(nodes_of(train), ["side", "id"], "left_anti")


def split_metadata(labelled: DataFrame, time: str = "ts") -> DataFrame:
    """Counts per split: rows, companies, investors, first and last time."""
    return labelled.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(COMPANY).alias("companies"),
        F.count_distinct(INVESTOR).alias("investors"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
    )


def nodes_per_split(labelled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node attributes restricted to the nodes of each split."""
    ends = F.explode(
        F.array(F.struct(F.lit(COMPANY).alias("side"), F.col(COMPANY).alias("id")), F.struct(F.lit(INVESTOR).alias("side"), F.col(INVESTOR).alias("id")))
    )
    present = labelled.select("split", ends.alias("e")).select("split", "e.*").distinct()
    return present.join(nodes, ["side", "id"])
