"""Metrics over scored tables: ``score`` with ``label`` 1/0, grouped by optional columns.

Ties are handled on the distinct score values, so equal scores cost one row.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biparta.functions.numeric import correlation_label, significance_stars
from biparta.operators.graph import COMPANY, INVESTOR
from biparta.operators.ordering import running_sum

# Cut-offs of the reports.
PRECISION_KS = [10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000]
OVERLAP_KS = [10, 20, 50, 100]


def ranking_quality(scored: DataFrame, by: tuple[str, ...] = (), score: str = "score", label: str = "label") -> DataFrame:
    """AUROC (ties count half) and average precision (one step per distinct score)."""
    pos = F.sum(F.when(F.col(label) > 0, 1).otherwise(0))
    steps = scored.groupBy(*by, F.col(score).alias("__s")).agg(pos.alias("__p"), F.count(F.lit(1)).alias("__n"))
    cum = running_sum(steps, [F.col("__s").desc()], {"__cp": "__p", "__cn": "__n"}, by)
    total = cum.groupBy(*by).agg(F.sum("__p").alias("positives"), F.sum("__n").alias("rows"))
    # negatives scored below a step, plus half of those inside it
    if by:
        cum = cum.join(total, list(by))
    else:
        t = total.select(F.struct("positives", "rows").alias("t")).scalar()
        cum = cum.withColumn("positives", t["positives"]).withColumn("rows", t["rows"])
    negatives = F.col("rows") - F.col("positives")
    inside = F.col("__n") - F.col("__p")
    below = negatives - (F.col("__cn") - F.col("__cp"))
    wins = F.sum(F.col("__p").cast("double") * (below + inside / 2))
    precision = F.sum(F.col("__p").cast("double") * F.col("__cp") / F.col("__cn"))
    return cum.groupBy(*by).agg(
        F.try_divide(wins, F.max("positives").cast("double") * F.max(negatives)).alias("auroc"),
        F.try_divide(precision, F.max("positives")).alias("average_precision"),
        F.max("positives").cast("bigint").alias("positives"),
        F.max("rows").cast("bigint").alias("rows"),
    )


def average_ranks(df: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Ascending rank with ties averaged, from the value histogram."""
    hist = df.groupBy(*by, F.col(value)).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_sum(hist, [F.col(value).asc()], {"__c": "__n"}, by)
    ranks = cum.select(*by, value, (F.col("__c") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def normal_p_value(t: Column) -> Column:
    """Two-sided tail of the normal law, by a rational fit of erfc (absolute error below 1.5e-7)."""
    z = F.abs(t) / F.lit(sqrt(2.0))
    k = 1.0 / (1.0 + 0.3275911 * z)
    # Coefficients of the Abramowitz-Stegun 7.1.26 approximation.
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + F.lit(c)) * k
    return poly * F.exp(-z * z)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation, sample size, p-value (normal approximation of the t statistic), labels."""
    ranked = average_ranks(average_ranks(df.select(a, b).dropna(), a, "__ra"), b, "__rb")
    row = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("__ra", "__rb").alias("spearman"))
    t = F.col("spearman") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)) / F.greatest(1 - F.col("spearman") * F.col("spearman"), F.lit(1e-300)))
    out = row.withColumn("p_value", F.when(F.col("n") > 2, normal_p_value(t)))
    return out.select("n", "spearman", "p_value", significance_stars(F.col("p_value")).alias("significance"), correlation_label(F.col("spearman")).alias("interpretation"))


def positive_ranks(scored: DataFrame, group: list[str], score: str = "score", label: str = "label", best: str | None = None) -> DataFrame:
    """Rank of the best positive in its candidate group: 1 plus the negatives scored above it.

    ``best``: column in which every row holds its group's best positive score, if it is known beforehand;
    then candidates are counted where they are made and only counts are shuffled.
    """
    if best is not None:
        return scored.groupBy(*group).agg((F.count_if((F.col(label) <= 0) & (F.col(score) > F.col(best))) + 1).alias("rank"))
    best = scored.filter(F.col(label) > 0).groupBy(*group).agg(F.max(score).alias("__best"))
    above = (F.col(label) <= 0) & (F.col(score) > F.col("__best"))
    return scored.join(best, group).groupBy(*group).agg((F.count_if(above) + 1).alias("rank"))


def mrr_recall(ranks: DataFrame, ks: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean reciprocal rank, and share of groups whose positive is within the first k."""
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(1.0 / F.col("rank")).alias("mrr"),
        *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}") for k in ks],
    )


def multi_positive_metrics(scored: DataFrame, group: list[str], ks: list[int], tie: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Mean over groups of 1 / rank of the first positive, and of the share of positives in the first k.

    Ties are ordered by ``tie``. The first max(k) rows of a group are found by a row limit
    per group, which Spark applies before the shuffle; ranks beyond it are counted.
    """
    order = [F.col(score).desc(), *[F.col(t).asc() for t in tie]]
    top = max(ks)
    head = scored.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__r") <= top)
    hits = head.groupBy(*group).agg(*[F.count_if((F.col(label) > 0) & (F.col("__r") <= k)).alias(f"__h{k}") for k in ks])
    key = F.struct((-F.col(score)).alias("s"), *[F.col(t) for t in tie])
    first = scored.filter(F.col(label) > 0).groupBy(*group).agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__p"))
    rank = scored.join(first, group).groupBy(*group).agg(F.count_if(key <= F.col("__first")).alias("__rank"), F.first("__p").alias("__p"))
    per = rank.join(hits, group)
    return per.agg(
        F.count(F.lit(1)).alias("queries"), F.avg(1.0 / F.col("__rank")).alias("mrr"), *[F.avg(F.col(f"__h{k}") / F.col("__p")).alias(f"recall_{k}") for k in ks]
    )


def mark_true(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Scored pairs with ``is_true``: the pair is among the true links."""
    hits = truth.select(COMPANY, INVESTOR).distinct().withColumn("__t", F.lit(True))
    return scores.join(hits, [COMPANY, INVESTOR], "left").withColumn("is_true", F.coalesce("__t", F.lit(False))).drop("__t")


def _top(scores: DataFrame, k: int, p: str) -> DataFrame:
    """The k best pairs with their place; a top-k report, so its size is k."""
    best = scores.orderBy(F.col(p).desc(), F.col(COMPANY).asc(), F.col(INVESTOR).asc()).limit(k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(p).desc(), F.col(COMPANY).asc(), F.col(INVESTOR).asc())))


def precision_at(scores: DataFrame, truth: DataFrame, threshold: float, ks: list[int] = PRECISION_KS, p: str = "p") -> DataFrame:
    """Precision@K with and without the probability threshold; K above the table size is left out.

    The denominator is K in both.
    """
    top = mark_true(_top(scores, max(ks), p), truth)
    per = top.select("place", "is_true", p, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter(F.col("place") <= F.col("k"))
    sums = per.groupBy("k").agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col(p) >= threshold).alias("above_threshold"),
        F.count_if((F.col(p) >= threshold) & F.col("is_true")).alias("hits_threshold"),
        F.count_if("is_true").alias("hits"),
    )
    return sums.filter(F.col("__n") == F.col("k")).select(
        F.col("k").cast("bigint").alias("k"),
        "above_threshold",
        (F.col("hits_threshold") / F.col("k")).alias("precision_threshold"),
        (F.col("hits") / F.col("k")).alias("precision"),
    )


def top_pairs(scores: DataFrame, k: int, p: str = "p") -> DataFrame:
    return _top(scores, k, p)


def top_overlap(ranks: DataFrame, a: str, b: str, key: str, ks: list[int] = OVERLAP_KS) -> DataFrame:
    """Common ids of the two top-K lists, for every K up to the table size."""
    n = ranks.agg(F.count(F.lit(1)).alias("n")).scalar()

    def best(col: str) -> DataFrame:
        rows = ranks.orderBy(F.col(col).desc(), F.col(key).asc()).limit(max(ks)).select(key, col)
        return rows.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(col).desc(), F.col(key).asc())).alias(f"__{col}"))

    both = best(a).join(best(b), key)
    worst = F.greatest(F.col(f"__{a}"), F.col(f"__{b}"))
    counts = both.agg(*[F.count_if(worst <= k).alias(str(k)) for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(str(k)).alias("overlap")) for k in ks])).alias("r")
    return counts.select(rows).select("r.*").filter(F.col("k") <= n).withColumn("overlap_pct", F.col("overlap") / F.col("k") * 100)


def error_table(scores: DataFrame, truth: DataFrame, k: int, threshold: float, p: str = "p") -> DataFrame:
    """Per company: true links, predictions among the first k above the threshold, hits, misses."""
    top = mark_true(_top(scores, k, p).filter(F.col(p) >= threshold), truth)
    predicted = top.groupBy(COMPANY).agg(
        F.count(F.lit(1)).alias("predicted_links"), F.count_if("is_true").alias("true_positives"), F.count_if(~F.col("is_true")).alias("false_positives")
    )
    true = truth.select(COMPANY, INVESTOR).distinct().groupBy(COMPANY).agg(F.count(F.lit(1)).alias("true_links"))
    out = true.join(predicted, COMPANY, "full_outer").fillna(0, ["true_links", "predicted_links", "true_positives", "false_positives"])
    return out.withColumn("has_true_links", F.col("true_links") > 0)


def true_link_histogram(errors: DataFrame) -> DataFrame:
    return errors.groupBy("true_links").agg(F.count(F.lit(1)).alias("companies"))


def error_trend(errors: DataFrame) -> DataFrame:
    """Line of false positives over true links, among predicted companies with true links (one row)."""
    rows = errors.filter((F.col("predicted_links") > 0) & F.col("has_true_links"))
    y, x = "false_positives", "true_links"
    return rows.agg(
        F.count(F.lit(1)).alias("companies"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared")
    )


def false_positive_leaders(errors: DataFrame, k: int = 5) -> DataFrame:
    rows = errors.filter((F.col("predicted_links") > 0) & ~F.col("has_true_links"))
    return rows.orderBy(F.col("false_positives").desc(), F.col(COMPANY).asc()).limit(k).select(COMPANY, "false_positives")
