"""Graph quality figures and the findings drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.operators.components import components, connectivity
from biparta.operators.graph import COMPANY, INVESTOR, degrees
from biparta.operators.ordering import exact_quantiles, running_sum
from biparta.operators.projection import assortativity
from biparta.session import materialize


def moments(x: Column) -> list[Column]:
    """Mean, population deviation, bounds, and population skewness and excess kurtosis."""
    return [
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"),
    ]


def gini(values: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Gini coefficient per group, from the value histogram: repeated values cost one row."""
    hist = values.groupBy(*by, F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_sum(hist, [F.col("__v").asc()], {"__cum": "__n"}, by)
    # ranks of equal values run from cum - n + 1 to cum: their sum is n * (2 cum - n + 1) / 2
    rank_sum = F.col("__n").cast("double") * (2 * F.col("__cum") - F.col("__n") + 1) / 2
    n, total = F.sum("__n"), F.sum(F.col("__n") * F.col("__v"))
    weighted = 2 * F.sum(rank_sum * F.col("__v")) - (n + 1) * total
    return cum.groupBy(*by).agg(F.when(total > 0, weighted / (n * total)).otherwise(F.lit(0.0)).alias("gini"))


def degree_statistics(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per side: moments, median, Gini and isolates of the degrees."""
    deg = materialize(degrees(edges, nodes), "degrees")
    base = deg.groupBy("side").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("degree") == 0).alias("isolated"), *moments(F.col("degree"))
    )
    medians = exact_quantiles(deg, "degree", [0.5], by=("side",)).withColumnRenamed("q0", "median")
    return base.join(medians, "side").join(gini(deg, "degree", ("side",)), "side")


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edge count, possible edges, density, sparsity, edges per side, one-mode density."""
    n = nodes.agg(F.struct(F.count_if(F.col("side") == COMPANY).alias("c"), F.count_if(F.col("side") == INVESTOR).alias("v")).alias("n")).scalar()
    m = F.col("edges")
    both = n["c"] + n["v"]
    # counts multiplied as doubles; the integer column is null where it does not fit
    possible = n["c"].cast("double") * n["v"]
    return edges.agg(F.count(F.lit(1)).alias("edges")).select(
        n["c"].alias("n_companies"),
        n["v"].alias("n_investors"),
        m,
        F.try_multiply(n["c"], n["v"]).alias("possible_edges"),
        F.coalesce(F.try_divide(m, possible), F.lit(0.0)).alias("density"),
        ((1 - F.coalesce(F.try_divide(m, possible), F.lit(0.0))) * 100).alias("sparsity_pct"),
        F.coalesce(F.try_divide(m, n["v"]), F.lit(0.0)).alias("edges_per_investor"),
        F.coalesce(F.try_divide(m, n["c"]), F.lit(0.0)).alias("edges_per_company"),
        F.coalesce(F.try_divide(2 * m, both.cast("double") * (both - 1)), F.lit(0.0)).alias("unipartite_density"),
    )


def imbalance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: side and degree ratios, positive rate, negatives per positive, size imbalance."""
    d = density(edges, nodes)
    c, v, m = F.col("n_companies"), F.col("n_investors"), F.col("edges")
    rate = F.coalesce(F.try_divide(m, c.cast("double") * v), F.lit(0.0))
    return d.select(
        F.try_divide(v, c).alias("ratio_investors_companies"),
        F.try_divide(m / v, m / c).alias("ratio_avg_degree"),
        rate.alias("avg_positive_rate"),
        F.try_divide(1 - rate, rate).alias("negative_positive_ratio"),
        F.coalesce(F.try_divide(F.abs(v - c), v + c), F.lit(0.0)).alias("size_imbalance"),
    )


def temporal_coverage(events: DataFrame, time: str = "ts") -> DataFrame:
    """One row: events, first and last time, span in days, events per day (0 for an empty span)."""
    span = (F.max(time) - F.min(time)) / 86400.0
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
        F.coalesce(span, F.lit(0.0)).alias("span_days"),
        F.coalesce(F.try_divide(F.count(F.lit(1)), span), F.lit(0.0)).alias("events_per_day"),
    )


def auto_bins(stats: dict) -> tuple[int, float, float]:
    """Histogram bins by the finer of the Sturges and Freedman-Diaconis widths.

    For whole-number data bins are at least 1 wide. ``stats`` holds n, low, high, q1, q3.
    """
    from math import ceil, log2

    low, high = float(stats["low"]), float(stats["high"])
    spread = high - low
    if spread == 0:
        return 1, low - 0.5, high + 0.5
    sturges = spread / (log2(stats["n"]) + 1.0)
    fd = 2.0 * (stats["q3"] - stats["q1"]) * stats["n"] ** (-1.0 / 3.0)
    width = max(min(fd, sturges) if fd > 0 else sturges, 1.0)
    return max(1, ceil(spread / width)), low, high


def power_law(edges: DataFrame, side: str, nodes: DataFrame | None = None) -> DataFrame:
    """One row: slope and fit of log bin count over log bin centre of the degree histogram.

    Fewer than 10 nodes or fewer than 3 filled bins: no fit.
    """
    deg = materialize(degrees(edges, nodes).filter(F.col("side") == side).select("degree"), "degrees")
    q = exact_quantiles(deg, "degree", [0.25, 0.75]).first()
    row = deg.agg(F.count(F.lit(1)).alias("n"), F.min("degree").alias("low"), F.max("degree").alias("high")).first()
    bins, low, high = auto_bins({"n": row["n"], "low": row["low"], "high": row["high"], "q1": q["q0"], "q3": q["q1"]})
    width = (high - low) / bins
    index = F.least(F.floor((F.col("degree") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    hist = deg.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("y")).withColumn("x", F.lit(low) + (F.col("bin") + 0.5) * F.lit(width))
    pts = hist.filter(F.col("x") > 0).select("x", F.log("x").alias("lx"), F.log(F.col("y").cast("double")).alias("ly"))
    fit = pts.agg(
        F.count(F.lit(1)).alias("points"),
        (-F.regr_slope("ly", "lx")).alias("alpha"),
        F.regr_r2("ly", "lx").alias("r_squared"),
        F.min("x").alias("xmin"),
        F.max("x").alias("xmax"),
    )
    ok = (F.col("points") >= 3) & F.lit(row["n"] >= 10)
    zero = F.lit(0.0)
    r2 = F.coalesce("r_squared", zero)
    return fit.select(
        F.lit(side).alias("side"),
        F.lit(bins).cast("bigint").alias("bins"),
        (ok & (r2 > 0.8)).alias("is_power_law"),
        F.when(ok, F.col("alpha")).otherwise(zero).alias("alpha"),
        F.when(ok, r2).otherwise(zero).alias("r_squared"),
        F.when(ok, F.col("xmin")).otherwise(zero).alias("xmin"),
        F.when(ok, F.col("xmax")).otherwise(zero).alias("xmax"),
    )


# Fixed values: (metric, direction, severe bound, its penalty, mild bounds with penalties).
HEALTH_RULES = [
    ("density", "below", [(0.0001, 40), (0.001, 20), (0.01, 10)]),
    ("max_gini", "above", [(0.8, 30), (0.6, 15)]),
    ("avg_positive_rate", "below", [(0.01, 25), (0.05, 10)]),
    ("isolated_pct", "above", [(20.0, 20), (10.0, 10)]),
    ("largest_pct_if_split", "below", [(50.0, 15)]),
]
# Fixed values: (metric, direction, [(bound, level, finding)]), strictest first.
FINDING_RULES = [
    ("density", "below", [(0.0001, "problem", "hyper sparse"), (0.001, "warning", "very sparse")]),
    ("max_gini", "above", [(0.8, "problem", "extreme inequality"), (0.6, "warning", "strong inequality")]),
    ("avg_positive_rate", "below", [(0.01, "problem", "extreme imbalance"), (0.05, "warning", "strong imbalance")]),
    ("isolated_pct", "above", [(20.0, "problem", "cold start"), (10.0, "warning", "many isolated nodes")]),
    ("largest_pct_if_split", "below", [(80.0, "warning", "fragmented graph")]),
    ("abs_assortativity_investors", "above", [(0.4, "warning", "strong investor assortativity")]),
]


def _first_hit(metric: str, direction: str, steps: list, value) -> Column | None:
    out = None
    for bound, *what in steps:
        hit = F.col(metric) < bound if direction == "below" else F.col(metric) > bound
        out = F.when(hit, value(what)) if out is None else out.when(hit, value(what))
    return out


def health_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The one-row table the rules run on."""
    alike = assortativity(edges, INVESTOR).select(F.abs("assortativity")).scalar()
    deg = degree_statistics(edges, nodes)
    top = deg.agg(
        F.struct(F.max("gini").alias("gini"), (F.sum("isolated") / F.sum("total") * 100).alias("iso")).alias("s")
    ).scalar()
    conn = connectivity(components(edges, nodes)).select(
        F.when(~F.col("is_connected"), F.col("largest_percentage")).alias("largest_pct_if_split"), "n_components", "largest_percentage"
    )
    # both sides have exactly one row
    return density(edges, nodes).select("density", F.col("density").alias("avg_positive_rate")).select(
        "*", top["gini"].alias("max_gini"), top["iso"].alias("isolated_pct"), alike.alias("abs_assortativity_investors"), F.lit(1).alias("__one")
    ).join(conn.withColumn("__one", F.lit(1)), "__one").drop("__one")


def health_score(metrics: DataFrame) -> DataFrame:
    """100 minus the penalties of the first rule step each metric hits, at least 0."""
    score = F.lit(100)
    for metric, direction, steps in HEALTH_RULES:
        score = score - F.coalesce(_first_hit(metric, direction, steps, lambda w: F.lit(w[0])), F.lit(0))
    return metrics.select("*", F.greatest(score, F.lit(0)).cast("bigint").alias("health_score"))


def health_findings(metrics: DataFrame) -> DataFrame:
    """``(level, finding)`` rows for the thresholds a graph crosses."""
    found = []
    for metric, direction, steps in FINDING_RULES:
        hit = _first_hit(metric, direction, steps, lambda w: F.struct(F.lit(w[0]).alias("level"), F.lit(w[1]).alias("finding")))
        found.append(hit)
    rows = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return metrics.select(rows.alias("f")).select("f.level", "f.finding")


def readiness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: isolates, zero rows and columns, and whether ranking may run."""
    deg = degrees(edges, nodes)
    zero = F.col("degree") == 0
    return deg.agg(
        F.count_if(zero).alias("isolated"),
        F.count_if(zero & (F.col("side") == COMPANY)).alias("zero_companies"),
        F.count_if(zero & (F.col("side") == INVESTOR)).alias("zero_investors"),
        (F.count_if(zero) == 0).alias("is_ready"),
    )


def pre_rank_report(edges: DataFrame, nodes: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: side sizes, isolates, and weight figures of the edges."""
    n = degrees(edges, nodes).agg(
        F.struct(
            F.count_if(F.col("side") == COMPANY).alias("c"), F.count_if(F.col("side") == INVESTOR).alias("v"), F.count_if(F.col("degree") == 0).alias("iso")
        ).alias("n")
    ).scalar()
    return weight_statistics(edges, weight).select(n["c"].alias("n_companies"), n["v"].alias("n_investors"), n["iso"].alias("isolated"), "*")


def weight_statistics(edges: DataFrame, weight: str = "weight") -> DataFrame:
    return edges.agg(
        F.count(F.lit(1)).alias("edges"),
        F.min(weight).alias("min_weight"),
        F.max(weight).alias("max_weight"),
        F.avg(weight).alias("mean_weight"),
        F.count_if(F.col(weight) > 0).alias("positive_weights"),
    )


def side_consistency(nodes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """How many dictionary entries of each side stand on each side of the graph."""
    d = dictionary.select(F.col("side").alias("dictionary_side"), "id").distinct()
    g = nodes.select(F.col("side").alias("graph_side"), "id").distinct()
    return d.join(g, "id").groupBy("dictionary_side", "graph_side").agg(F.count(F.lit(1)).alias("n"))


def leakage_report(pairs: DataFrame) -> DataFrame:
    """Amount and round figures of positives and negatives: a wide gap means the label leaks."""
    stats = pairs.groupBy("label").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("total_raised").alias("mean_raised"),
        F.min("total_raised").alias("min_raised"),
        F.max("total_raised").alias("max_raised"),
        F.count_if(F.col("total_raised") > 0).alias("nonzero_raised"),
        F.avg("n_rounds").alias("mean_rounds"),
        F.count_if(F.col("n_rounds") > 0).alias("nonzero_rounds"),
    )
    medians = exact_quantiles(pairs, "total_raised", [0.5], by=("label",)).withColumnRenamed("q0", "median_raised")
    return stats.join(medians, "label")


def timestamp_checks(events: DataFrame, source: str, destination: str, time: str = "ts", order: str = "idx") -> DataFrame:
    """One row: is the log sorted, repeated timestamps, zero timestamps.

    Sorted means: no row is earlier than one before it. Ranges of the row order are
    compared by their bounds, so no global window is needed.
    """
    from biparta.operators.ordering import range_bucket, split_points

    n = max(2, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = split_points(events, order, n)
    from pyspark.sql import Window

    rows = events.select(time, order, range_bucket(F.col(order).cast("double"), cuts).alias("__b"))
    inside = Window.partitionBy("__b").orderBy(order)
    backward = rows.withColumn("__back", F.col(time) < F.lag(time).over(inside)).groupBy("__b").agg(
        F.count_if("__back").alias("back"), F.min_by(time, order).alias("head"), F.max_by(time, order).alias("tail")
    )
    # one row per range
    across = Window.partitionBy(F.lit(0)).orderBy("__b")
    back = backward.withColumn("jump", (F.col("head") < F.lag("tail").over(across)).cast("int")).agg((F.sum("back") + F.coalesce(F.sum("jump"), F.lit(0))).alias("n")).scalar()
    per_ts = events.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    return per_ts.agg(
        F.sum("n").alias("events"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_ts_events"),
        F.coalesce(F.sum(F.when(F.col(time) == 0, F.col("n"))), F.lit(0)).alias("zero_ts_events"),
    ).select("*", back.alias("backward_steps"), (back == 0).alias("is_sorted"))


def node_activity(events: DataFrame, node: str, time: str = "ts", order: str = "idx") -> DataFrame:
    """Per node: events, first and last time, and whether its events go back in time in row order."""
    from biparta.operators.history import as_of

    seen = as_of(events, events, [node], order, maxes={"latest": F.col(time)})
    flagged = events.join(seen, [node, order])
    return flagged.groupBy(node).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
        F.coalesce(F.max(F.col(time) < F.col("latest")), F.lit(False)).alias("goes_back"),
    )


def batch_repeats(events: DataFrame, node: str, batch_size: int, order: str = "idx") -> DataFrame:
    """Per batch of consecutive rows: nodes that occur more than once."""
    per = events.groupBy(F.floor(F.col(order) / batch_size).alias("batch"), node).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("batch").agg(F.count(F.lit(1)).alias("distinct_nodes"), F.count_if(F.col("n") > 1).alias("repeated_nodes"))
