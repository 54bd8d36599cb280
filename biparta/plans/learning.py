"""Queries of features, scoring, metrics, losses and change reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from biparta import fixtures
from biparta.functions.hashing import draw_uniform
from biparta.functions.numeric import sigmoid
from biparta.operators import delta, features, graph, losses, metrics, negatives, ordering, ranking, reports, scoring
from biparta.plans import inputs
from biparta.plans.graphs import _before_after
from biparta.plans.ranks import iterations_sql, tagged
from biparta.plans.registry import CATS, EDGES, INTER, INV, NEGS, ORGS, POOL, SCORED, SCORES, query, sql_draw, sql_uniform, with_
from biparta.session import materialize

t = fixtures.table
# prediction time of the registered queries: the 0.85 quantile of the order dates
AT = 965088000.0

# ---- features --------------------------------------------------------------


def _feature_sql(pairs: str) -> list[str]:
    """Views that end in ``feats``: the 13 features of every pair of ``pairs`` at AT, history strictly before."""
    return [
        f"hist AS MATERIALIZED (SELECT * FROM inv WHERE ts < {AT})",
        f"cs AS (SELECT company, sum(raised) AS tot, count(*) AS n, count(DISTINCT investor) AS p, floor(({AT} - max(ts)) / 86400) AS idle FROM hist GROUP BY 1)",
        f"vs AS (SELECT investor, sum(raised) AS tot, count(*) AS n, count(DISTINCT company) AS p, floor(({AT} - max(ts)) / 86400) AS idle FROM hist GROUP BY 1)",
        "hp AS MATERIALIZED (SELECT DISTINCT company, investor FROM hist)",
        "vcat AS MATERIALIZED (SELECT DISTINCT investor, category FROM hp JOIN cats USING (company))",
        "vn AS (SELECT investor, count(*) AS k FROM vcat GROUP BY 1)",
        "cn AS (SELECT company, count(*) AS o FROM cats GROUP BY 1)",
        f"ov AS MATERIALIZED (SELECT s.company, s.investor, count(*) AS both FROM {pairs} s JOIN cats USING (company) JOIN vcat ON vcat.investor = s.investor AND vcat.category = cats.category GROUP BY 1, 2)",
        "coin AS MATERIALIZED (SELECT DISTINCT a.investor AS v, b.investor AS w FROM hp a JOIN hp b ON a.company = b.company AND a.investor <> b.investor)",
        f"cc AS MATERIALIZED (SELECT s.company, s.investor, count(*) AS n FROM {pairs} s JOIN hp ON hp.company = s.company JOIN coin ON coin.v = s.investor AND coin.w = hp.investor GROUP BY 1, 2)",
        f"""feats AS (SELECT s.company, s.investor, s.label, ln(1 + coalesce(cs.tot, 0)) AS log_company_total, ln(2 + coalesce(cs.n, 0)) AS log_company_events, coalesce(cs.p, 0)::DOUBLE AS company_partners,
          ln(1 + coalesce(cs.tot / cs.n, 0)) AS log_company_mean, ln(2 + coalesce(cs.idle, 1825)) AS log_company_idle,
          ln(1 + coalesce(vs.tot, 0)) AS log_investor_total, ln(2 + coalesce(vs.n, 0)) AS log_investor_events, coalesce(vs.p, 0)::DOUBLE AS investor_partners,
          ln(1 + coalesce(vs.tot / vs.n, 0)) AS log_investor_mean, ln(2 + coalesce(vs.idle, 730)) AS log_investor_idle,
          coalesce(ov.both::DOUBLE / (vn.k + cn.o - ov.both), 0.0) AS category_overlap, coalesce(cc.n, 0)::DOUBLE AS common_coinvestors, ln(2 + coalesce(vs.p, 0)) AS log_experience
          FROM {pairs} s LEFT JOIN cs USING (company) LEFT JOIN vs USING (investor) LEFT JOIN vn USING (investor) LEFT JOIN cn USING (company)
          LEFT JOIN ov ON ov.company = s.company AND ov.investor = s.investor LEFT JOIN cc ON cc.company = s.company AND cc.investor = s.investor)""",
    ]


_LATE = f"late AS MATERIALIZED (SELECT company, investor, 1.0::DOUBLE AS label FROM inter WHERE ts >= {AT} UNION ALL SELECT company, negative, 0.0::DOUBLE FROM negs WHERE ts >= {AT})"
_LATE_UNIQUE = "pairs AS MATERIALIZED (SELECT company, investor, max(label) AS label FROM late GROUP BY 1, 2)"
_FEATURES = [INV, EDGES, INTER, POOL, NEGS, ORGS, CATS, _LATE, _LATE_UNIQUE, *_feature_sql("pairs")]


def _late_pairs(spark, d):
    """Pairs first met at or after AT, and as many random pairs, labelled."""
    return _pairs_when(spark, d, F.col("ts") >= AT)


def _pairs_when(spark, d, when):
    inter = inputs.interactions(spark, d)
    late = inter.filter(when)
    neg = inputs.negatives(inter).filter(when).select("company", F.col("negative").alias("investor"))
    both = features.labelled_pairs(late.select("company", "investor"), neg)
    return both.groupBy("company", "investor").agg(F.max("label").alias("label"))


def _features(spark, d):
    # the merged rounds are read by every feature group: join them once
    events = materialize(fixtures.investments(spark, d), "events")
    return features.pair_features(_late_pairs(spark, d), events, inputs.categories(spark, d), AT)


def _train_features(spark, d):
    """The same rows one period earlier: pairs first met from the 0.7 quantile of the dates to AT, history before it."""
    events = materialize(fixtures.investments(spark, d), "events")
    since = ordering.exact_quantiles(events, "ts", [0.7]).first()["q0"]
    pairs = _pairs_when(spark, d, (F.col("ts") >= since) & (F.col("ts") < AT))
    return features.pair_features(pairs, events, inputs.categories(spark, d), since)


_FEATURE_LIST = ", ".join(f"round({f}, 6) AS {f}" for f in features.FEATURES)


@query("m1_pair_features", with_(*_FEATURES) + "SELECT company, investor, round(category_overlap, 6) AS category_overlap, common_coinvestors::BIGINT AS common_coinvestors FROM feats")
def m1(spark, d):
    pairs = _late_pairs(spark, d).withColumn("ts", F.lit(AT))
    got = features.pair_overlaps(pairs, fixtures.investments(spark, d), inputs.categories(spark, d), AT)
    return got.select("company", "investor", F.round("category_overlap", 6).alias("category_overlap"), "common_coinvestors")


@query("m2_feature_vector", with_(*_FEATURES) + f"SELECT company, investor, label, {_FEATURE_LIST} FROM feats")
def m2(spark, d):
    return _features(spark, d).select("company", "investor", "label", *[F.round(f, 6).alias(f) for f in features.FEATURES])


@query(
    "m4_degree_features",
    with_(INV, EDGES, INTER, POOL, NEGS, _LATE, _LATE_UNIQUE, f"hp AS (SELECT company, investor FROM inter WHERE ts <= {AT})")
    + "SELECT p.company, p.investor, label, coalesce(a.n, 0) AS company_degree, coalesce(b.n, 0) AS investor_degree FROM pairs p LEFT JOIN (SELECT company, count(*) AS n FROM hp GROUP BY 1) a USING (company) LEFT JOIN (SELECT investor, count(*) AS n FROM hp GROUP BY 1) b USING (investor)",
)
def m4(spark, d):
    pairs = _late_pairs(spark, d).withColumn("ts", F.lit(AT))
    return features.degree_features(pairs, inputs.interactions(spark, d)).select("company", "investor", "label", "company_degree", "investor_degree")


@query("m5_labelled_dataset", with_(INV, EDGES, INTER, POOL, NEGS, _LATE) + f"SELECT company, investor, label, {sql_draw(0, 'company', 'investor', 'label::INT')} AS shuffle_key FROM late")
def m5(spark, d):
    inter = inputs.interactions(spark, d)
    neg = inputs.negatives(inter).filter(F.col("ts") >= AT).select("company", F.col("negative").alias("investor"))
    return features.labelled_pairs(inter.filter(F.col("ts") >= AT).select("company", "investor"), neg)


# ---- scoring ---------------------------------------------------------------


@query("m6_forest_importances")
def m6(spark, d):
    """Importances of a random forest fitted on the train rows."""
    rows = materialize(_train_features(spark, d), "features")
    return scoring.importances(scoring.fit_forest(rows, features.FEATURES), features.FEATURES, spark)


@query("m7_forest_scores")
def m7(spark, d):
    """Later pairs scored by a forest that was fitted on the train rows."""
    model = scoring.fit_forest(materialize(_train_features(spark, d), "features"), features.FEATURES)
    return scoring.score_pairs(_features(spark, d), model, features.FEATURES).select("company", "investor", "label", "p")


@query(
    "m7_formula_scores",
    with_(*_FEATURES) + "SELECT company, investor, round(1 / (1 + exp(-(0.1 * log_company_events + 0.2 * log_investor_events + category_overlap - 0.05 * common_coinvestors))), 6) AS p FROM feats",
)
def m7b(spark, d):
    def formula(*c):
        x = dict(zip(features.FEATURES, c, strict=True))
        return sigmoid(0.1 * x["log_company_events"] + 0.2 * x["log_investor_events"] + x["category_overlap"] - 0.05 * x["common_coinvestors"])

    return scoring.score_pairs(_features(spark, d), formula, features.FEATURES).select("company", "investor", F.round("p", 6).alias("p"))


# ---- metrics ---------------------------------------------------------------


def _quality_sql(source: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""st AS (SELECT {b}p, count(*) FILTER (label > 0) AS np, count(*) AS n FROM {source} GROUP BY ALL),
    cu AS (SELECT *, sum(np) OVER ({part} ORDER BY p DESC) AS cp, sum(n) OVER ({part} ORDER BY p DESC) AS cn, sum(np) OVER ({part}) AS tp, sum(n) OVER ({part}) AS tn FROM st),
    q AS (SELECT {b}round(sum(np * ((tn - tp) - (cn - cp) + (n - np) / 2.0::DOUBLE)) / (max(tp) * max(tn - tp)), 6) AS auroc,
      round(sum(np * cp / cn::DOUBLE) / max(tp), 6) AS average_precision, max(tp)::BIGINT AS positives, max(tn)::BIGINT AS rows FROM cu GROUP BY ALL)"""


def _rounded_quality(df, *by):
    return df.select(*by, F.round("auroc", 6).alias("auroc"), F.round("average_precision", 6).alias("average_precision"), "positives", "rows")


@query("m8_auroc_and_precision", SCORED + ", " + _quality_sql("scores") + " SELECT * FROM q")
def m8(spark, d):
    return _rounded_quality(metrics.ranking_quality(inputs.scores(spark, d), score="p"))


@query("m8_quality_per_batch", SCORED + ", b AS (SELECT investor % 10 AS batch, p, label FROM scores), " + _quality_sql("b", "batch") + " SELECT * FROM q")
def m8b(spark, d):
    x = inputs.scores(spark, d).withColumn("batch", F.col("investor") % 10)
    return _rounded_quality(metrics.ranking_quality(x, by=("batch",), score="p"), "batch")


@query(
    "m9_spearman",
    with_(INV, EDGES, "x AS (SELECT company, count(*) AS a, round(sum(total_raised), 2) AS b FROM edges GROUP BY 1)",
    "r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)")
    + """SELECT n, round(s, 6) AS spearman, CASE WHEN s > 0.9 THEN 'Very strong positive correlation (rankings are very similar)' WHEN s > 0.7 THEN 'Strong positive correlation (rankings are similar)'
      WHEN s > 0.5 THEN 'Moderate positive correlation (some similarity in rankings)' WHEN s > 0.3 THEN 'Weak positive correlation (rankings differ significantly)'
      WHEN s > -0.3 THEN 'No correlation (rankings are independent)' ELSE 'Negative correlation (rankings are inverted)' END AS interpretation FROM (SELECT count(*) AS n, corr(ra, rb) AS s FROM r)""",
)
def m9(spark, d):
    x = inputs.edges(spark, d).groupBy("company").agg(F.count(F.lit(1)).alias("a"), F.round(F.sum("total_raised"), 2).alias("b"))
    return metrics.spearman(x, "a", "b").select("n", F.round("spearman", 6).alias("spearman"), "interpretation")


_GROUPS = with_(
    INV, EDGES, INTER, POOL,
    f"draws AS MATERIALIZED (SELECT i.idx, i.company, {sql_draw(13, 'i.idx', 's.slot')} % c.n AS place FROM inter i, (SELECT unnest(range(0, 100)) AS slot) s, (SELECT count(*) AS n FROM pool) c)",
    f"""grp AS MATERIALIZED (SELECT idx, 1.0::DOUBLE AS label, round({sql_uniform(14, 'company', 'investor')}, 6) AS score FROM inter
      UNION ALL SELECT d.idx, 0.0, round({sql_uniform(14, 'd.company', 'p.negative')}, 6) FROM draws d JOIN pool p ON p.place = d.place)""",
    "best AS (SELECT idx, max(score) AS best FROM grp WHERE label > 0 GROUP BY 1)",
    "rk AS MATERIALIZED (SELECT g.idx, count(*) FILTER (label <= 0 AND score > best) + 1 AS rank FROM grp g JOIN best b ON b.idx = g.idx GROUP BY 1)",
)


def _groups(spark, d):
    """Each interaction with 100 draws; every row holds the interaction's own score as ``best``."""
    x = inputs.interactions(spark, d).select("idx", "company", "investor")
    pool = negatives.destinations(x, "investor")
    asked = x.withColumn("best", F.round(draw_uniform(14, "company", "investor"), 6))
    neg = negatives.random_negatives(asked.select("idx", "company", "best"), pool, "investor", 100, 13)
    drawn = neg.withColumn("raw", draw_uniform(14, "company", "negative"))
    # further from the best than half a unit of the last place, the rounded score lies on the same side
    score = F.when(F.abs(F.col("raw") - F.col("best")) > 1e-6, F.col("raw")).otherwise(F.round("raw", 6))
    return asked.select("idx", F.lit(1.0).alias("label"), F.col("best").alias("score"), "best").unionByName(drawn.select("idx", F.lit(0.0).alias("label"), score.alias("score"), "best"))


@query("w12_positive_rank", _GROUPS + "SELECT idx, rank FROM rk")
def w12(spark, d):
    return metrics.positive_ranks(_groups(spark, d), ["idx"], best="best")


@query("m10_mrr_and_recall", _GROUPS + "SELECT count(*) AS queries, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS recall_1, round(avg((rank <= 10)::INT), 6) AS recall_10 FROM rk")
def m10(spark, d):
    got = metrics.mrr_recall(metrics.positive_ranks(_groups(spark, d), ["idx"], best="best"), [1, 10])
    return got.select("queries", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_1", "recall_10")])


@query(
    "m11_multi_positive_metrics",
    SCORED + """, o AS (SELECT *, row_number() OVER (PARTITION BY investor ORDER BY p DESC, company) AS r FROM scores),
    g AS (SELECT investor, min(r) FILTER (label > 0) AS first, count(*) FILTER (label > 0) AS np, count(*) FILTER (label > 0 AND r <= 10) AS h10, count(*) FILTER (label > 0 AND r <= 50) AS h50 FROM o GROUP BY 1)
    SELECT count(*) AS queries, round(avg(1.0::DOUBLE / first), 6) AS mrr, round(avg(h10::DOUBLE / np), 6) AS recall_10, round(avg(h50::DOUBLE / np), 6) AS recall_50 FROM g WHERE np > 0""",
)
def m11(spark, d):
    got = metrics.multi_positive_metrics(inputs.scores(spark, d), ["investor"], [10, 50], ["company"], score="p")
    return got.select("queries", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_10", "recall_50")])


_TRUE = f"tr AS (SELECT DISTINCT company, investor FROM inter WHERE ts > {AT})"
_TOPK = """o AS MATERIALIZED (SELECT s.*, t.company IS NOT NULL AS hit, row_number() OVER (ORDER BY p DESC, s.company, s.investor) AS place FROM scores s LEFT JOIN tr t ON t.company = s.company AND t.investor = s.investor)"""


def _truth(spark, d):
    return inputs.interactions(spark, d).filter(F.col("ts") > AT)


@query(
    "m12_precision_at_k",
    SCORED + f", {_TRUE}, {_TOPK}" + """ SELECT k, count(*) FILTER (p >= 0.97) AS above_threshold, round(count(*) FILTER (p >= 0.97 AND hit) / k::DOUBLE, 6) AS precision_threshold, round(count(*) FILTER (hit) / k::DOUBLE, 6) AS precision
    FROM o JOIN (SELECT unnest([10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000])::BIGINT AS k) ON place <= k GROUP BY k HAVING count(*) = k""",
)
def m12(spark, d):
    got = metrics.precision_at(inputs.scores(spark, d), _truth(spark, d), 0.97)
    return got.select("k", "above_threshold", F.round("precision_threshold", 6).alias("precision_threshold"), F.round("precision", 6).alias("precision"))


_ERRORS = f"""pr AS (SELECT company, count(*) AS predicted_links, count(*) FILTER (hit) AS true_positives, count(*) FILTER (NOT hit) AS false_positives FROM o WHERE place <= 5000 AND p >= 0.45 GROUP BY 1),
  tl AS (SELECT company, count(*) AS true_links FROM tr GROUP BY 1),
  errors AS (SELECT company, coalesce(true_links, 0) AS true_links, coalesce(predicted_links, 0) AS predicted_links, coalesce(true_positives, 0) AS true_positives, coalesce(false_positives, 0) AS false_positives,
    coalesce(true_links, 0) > 0 AS has_true_links FROM pr FULL JOIN tl USING (company))"""
_ERR = SCORED + f", {_TRUE}, {_TOPK}, {_ERRORS} "


def _errors(spark, d):
    return metrics.error_table(inputs.scores(spark, d), _truth(spark, d), 5000, 0.45)


@query("a12_error_table", _ERR + "SELECT * FROM errors")
def a12(spark, d):
    return _errors(spark, d)


@query("a13_true_link_histogram", _ERR + "SELECT true_links, count(*) AS companies FROM errors GROUP BY 1")
def a13(spark, d):
    return metrics.true_link_histogram(_errors(spark, d))


@query("m14_error_trend", _ERR + "SELECT count(*) AS companies, round(regr_slope(false_positives, true_links), 6) AS slope, round(regr_intercept(false_positives, true_links), 6) AS intercept, round(regr_r2(false_positives, true_links), 6) AS r_squared FROM errors WHERE predicted_links > 0 AND has_true_links")
def m14(spark, d):
    got = metrics.error_trend(_errors(spark, d))
    return got.select("companies", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r_squared")])


@query("m15_false_positive_leaders", _ERR + "SELECT company, false_positives FROM errors WHERE predicted_links > 0 AND NOT has_true_links ORDER BY false_positives DESC, company LIMIT 5")
def m15(spark, d):
    return metrics.false_positive_leaders(_errors(spark, d))


_PRED = [INV, EDGES, INTER, POOL, NEGS, SCORES, "pred AS (SELECT * FROM scores WHERE p >= 0.45)", f"fut AS (SELECT * FROM inter WHERE ts > {AT})"]
_TWO_RANKS = [*tagged(iterations_sql("pred", "1", "0.3", "-5", 3), "a"), *tagged(iterations_sql("fut", "1", "0.3", "-5", 3), "b"),
              "met2 AS MATERIALIZED (SELECT x.id, x.score AS sp, y.score AS st FROM a_result x JOIN b_result y ON x.side = 'company' AND y.side = 'company' AND x.id = y.id)"]


def _two_ranks(spark, d, iterations=3):
    pred = graph.scored_graph(inputs.scores(spark, d), 0.45)
    fut = _truth(spark, d).select("company", "investor")
    a = materialize(ranking.scores_of(pred, iterations).filter("side = 'company'"), "pred").select("id", F.round("score", 9).alias("score"))
    b = materialize(ranking.scores_of(fut, iterations).filter("side = 'company'"), "true").select("id", F.round("score", 9).alias("score"))
    return a, b


@query(
    "m17_rank_validation",
    with_(*_PRED, *_TWO_RANKS, "rr AS (SELECT rank() OVER (ORDER BY round(sp, 9)) + (count(*) OVER (PARTITION BY round(sp, 9)) - 1) / 2.0 AS ra, rank() OVER (ORDER BY round(st, 9)) + (count(*) OVER (PARTITION BY round(st, 9)) - 1) / 2.0 AS rb FROM met2)")
    + "SELECT count(*) AS n, round(corr(ra, rb), 5) AS spearman FROM rr",
)
def m17(spark, d):
    rho, _ = delta.rank_validation(*_two_ranks(spark, d))
    return rho.select("n", F.round("spearman", 5).alias("spearman"))


@query(
    "m13_top_overlap",
    with_(*_PRED, *_TWO_RANKS, "o AS (SELECT id, row_number() OVER (ORDER BY round(sp, 9) DESC, id) AS ra, row_number() OVER (ORDER BY round(st, 9) DESC, id) AS rb FROM met2)")
    + "SELECT k, count(*) FILTER (ra <= k AND rb <= k) AS overlap, round(count(*) FILTER (ra <= k AND rb <= k) * 100.0::DOUBLE / k, 4) AS overlap_pct FROM o, (SELECT unnest([10, 20, 50, 100])::BIGINT AS k) GROUP BY k HAVING count(*) >= k",
)
def m13(spark, d):
    _, overlap = delta.rank_validation(*_two_ranks(spark, d))
    return overlap.withColumn("overlap_pct", F.round("overlap_pct", 4))


@query("m17_validation_until_stable")
def m17b(spark, d):
    rho, _ = delta.rank_validation(*_two_ranks(spark, d, None))
    return rho.select("n", F.round("spearman", 5).alias("spearman"))


@query("m13_overlap_until_stable")
def m13b(spark, d):
    _, overlap = delta.rank_validation(*_two_ranks(spark, d, None))
    return overlap.withColumn("overlap_pct", F.round("overlap_pct", 4))


_DELTA = with_(
    INV,
    "ba AS (SELECT company AS id, (count(*) FILTER (ts <= 935193600) - 10)::DOUBLE / 100 AS s0, (count(*) FILTER (ts > 935193600) - 4)::DOUBLE / 100 AS s1 FROM inv GROUP BY 1)",
    """rep AS (SELECT *, dense_rank() OVER (ORDER BY score_before DESC) AS rank_before, dense_rank() OVER (ORDER BY score_after DESC) AS rank_after FROM (
      SELECT id, s0 AS score_before, s1 AS score_after, (s1 - s0) / (s0 + 1e-8) AS delta FROM ba WHERE s0 > 1e-6 AND id NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)))""",
)


def _delta(spark, d):
    rows = _before_after(spark, d)
    before = rows.select(F.col("company").alias("id"), ((F.col("s0") - 10) / 100).alias("score"))
    after = rows.select(F.col("company").alias("id"), ((F.col("s1") - 4) / 100).alias("score"))
    return delta.delta_report(before, after, exclude=t(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("id")))


@query("m16_delta_report", _DELTA + "SELECT id, score_before, score_after, round(delta, 6) AS delta, round(delta * 100, 4) AS delta_pct, rank_before, rank_after, rank_before - rank_after AS rank_change FROM rep")
def m16(spark, d):
    got = _delta(spark, d)
    return got.select("id", "score_before", "score_after", F.round("delta", 6).alias("delta"), F.round("delta_pct", 4).alias("delta_pct"), "rank_before", "rank_after", "rank_change")


@query("m16_delta_summary", _DELTA + "SELECT count(*) AS companies, count(*) FILTER (delta > 0) AS positive, count(*) FILTER (delta < 0) AS negative, count(*) FILTER (delta = 0) AS unchanged FROM rep")
def m16b(spark, d):
    return delta.delta_summary(_delta(spark, d))


@query("f10_promising_and_declining", _DELTA + "SELECT id, 'promising' AS kind, round(delta, 6) AS delta FROM rep WHERE delta > 0.5 UNION ALL SELECT id, 'declining', round(delta, 6) FROM rep WHERE delta < -0.5")
def f10(spark, d):
    rep = materialize(_delta(spark, d), "delta")
    up = delta.promising(rep, 0.5).withColumn("kind", F.lit("promising"))
    return up.unionByName(delta.declining(rep, 0.5).withColumn("kind", F.lit("declining"))).select("id", "kind", F.round("delta", 6).alias("delta"))


@query(
    "m18_external_comparison",
    """SELECT *, CAST(p_retailprice_rank - own AS BIGINT) AS p_retailprice_gap, CAST(p_size_rank - own AS BIGINT) AS p_size_gap, (p_retailprice_rank - own + p_size_rank - own) / 2.0::DOUBLE AS mean_gap FROM (
      SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS own, dense_rank() OVER (ORDER BY p_retailprice DESC) AS p_retailprice_rank, dense_rank() OVER (ORDER BY p_size) AS p_size_rank FROM part)""",
)
def m18(spark, d):
    p = ranking.global_rank(t(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), [F.col("p_partkey").asc()], "own")
    got = delta.divergence(delta.relative_ranks(p, {"p_retailprice": True, "p_size": False}), "own", ["p_retailprice", "p_size"])
    return got.drop("p_retailprice", "p_size")


@query(
    "m19_node_classification_auc",
    with_("x AS (SELECT round(value, 2) AS p, (event_type = (SELECT min(event_type) FROM events))::INT AS label FROM events)", _quality_sql("x")) + "SELECT * FROM q",
)
def m19(spark, d):
    x = fixtures.node_events(spark, d)
    first = x.agg(F.min("event_type").alias("e")).scalar()
    rows = x.select(F.round("value", 2).alias("p"), (F.col("event_type") == first).cast("int").alias("label"))
    return _rounded_quality(metrics.ranking_quality(rows, score="p"))


# ---- losses ----------------------------------------------------------------

_Q = "greatest(least(p, 1 - 1e-7), 1e-7)"
_BCE = f"(-(label * ln({_Q}) + (1 - label) * ln(1 - {_Q})))"


def _focal(alpha: str) -> str:
    pt = f"(label * {_Q} + (1 - label) * (1 - {_Q}))"
    return f"((label * ({alpha}) + (1 - label) * (1 - ({alpha}))) * pow(1 - {pt}, 2.0) * {_BCE})"


@query("l1_cross_entropy", SCORED + f"SELECT investor % 5 AS run, round(avg({_BCE}), 6) AS bce FROM scores GROUP BY 1")
def l1(spark, d):
    x = inputs.scores(spark, d).withColumn("run", F.col("investor") % 5)
    return losses.bce_loss(x, ("run",)).withColumn("bce", F.round("bce", 6))


@query("l2_focal_loss", SCORED + f"SELECT investor % 5 AS run, round(avg({_focal('0.25')}), 6) AS focal FROM scores GROUP BY 1")
def l2(spark, d):
    x = inputs.scores(spark, d).withColumn("run", F.col("investor") % 5)
    return losses.focal_loss(x, ("run",)).withColumn("focal", F.round("focal", 6))


@query(
    "l3_adaptive_focal_loss",
    SCORED + f", a AS (SELECT investor % 5 AS run, CASE WHEN sum(label) > 0 THEN 1 - sum(label) / count(*) ELSE 0.5 END AS al FROM scores GROUP BY 1) SELECT run, round(any_value(al), 6) AS alpha, round(avg({_focal('al')}), 6) AS adaptive_focal FROM scores JOIN a ON run = investor % 5 GROUP BY 1",
)
def l3(spark, d):
    x = inputs.scores(spark, d).withColumn("run", F.col("investor") % 5)
    return losses.adaptive_focal_loss(x, ("run",)).select("run", F.round("alpha", 6).alias("alpha"), F.round("adaptive_focal", 6).alias("adaptive_focal"))


_TRIPLES = with_(
    INV, EDGES, INTER, POOL, NEGS,
    "cd AS (SELECT company, count(*) AS n FROM inter GROUP BY 1)", "vd AS (SELECT investor, count(*) AS n FROM inter GROUP BY 1)",
    f"""tri AS MATERIALIZED (SELECT x.idx, x.company % 5 AS run, round({sql_uniform(14, 'x.company', 'x.investor')}, 6) AS ps, round({sql_uniform(14, 'x.company', 'x.negative')}, 6) AS ns, cd.n AS ds, a.n AS dp, b.n AS dn
      FROM negs x JOIN cd ON cd.company = x.company JOIN vd a ON a.investor = x.investor JOIN vd b ON b.investor = x.negative)""",
    """lo AS (SELECT run, (ln(exp(ps / 0.07 - greatest(ps, ns) / 0.07) + exp(ns / 0.07 - greatest(ps, ns) / 0.07)) + greatest(ps, ns) / 0.07 - ps / 0.07)
      * pow(greatest(ds, 1), -0.5) * (pow(greatest(dp, 1), -0.5) + pow(greatest(dn, 1), -0.5)) / 2 AS c,
      (0.25 * pow(1 - greatest(least(ps, 1 - 1e-7), 1e-7), 2.0) * -ln(greatest(least(ps, 1 - 1e-7), 1e-7)) + 0.75 * pow(greatest(least(ns, 1 - 1e-7), 1e-7), 2.0) * -ln(1 - greatest(least(ns, 1 - 1e-7), 1e-7))) / 2 AS f FROM tri)""",
)


def _triples(spark, d):
    inter = inputs.interactions(spark, d)
    neg = inputs.negatives(inter)
    deg = materialize(graph.degrees(inter), "degrees")
    c = deg.filter("side = 'company'").select(F.col("id").alias("company"), F.col("degree").alias("src_degree"))
    v = lambda col, name: deg.filter("side = 'investor'").select(F.col("id").alias(col), F.col("degree").alias(name))
    j = neg.join(c, "company").join(v("investor", "pos_degree"), "investor").join(v("negative", "neg_degree"), "negative")
    s = lambda x: F.round(draw_uniform(14, "company", x), 6)
    return j.select((F.col("company") % 5).alias("run"), s("investor").alias("pos_score"), s("negative").alias("neg_score"), "src_degree", "pos_degree", "neg_degree")


@query("l4_degree_contrastive_loss", _TRIPLES + "SELECT run, round(avg(c), 6) AS contrastive FROM lo GROUP BY 1")
def l4(spark, d):
    return losses.contrastive_loss(_triples(spark, d), ("run",)).withColumn("contrastive", F.round("contrastive", 6))


@query("l5_hybrid_loss", _TRIPLES + "SELECT run, round(avg(f), 6) AS focal, round(avg(c), 6) AS contrastive, round(0.5 * avg(f) + 0.5 * avg(c), 6) AS hybrid FROM lo GROUP BY 1")
def l5(spark, d):
    got = losses.hybrid_loss(_triples(spark, d), ("run",))
    return got.select("run", *[F.round(c, 6).alias(c) for c in ("focal", "contrastive", "hybrid")])


@query(
    "l6_sample_weights",
    SCORED + ", c AS (SELECT label, count(*) AS n FROM scores GROUP BY 1) SELECT company, investor, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * c.n), 8) AS weight FROM scores s JOIN c ON c.label = s.label",
)
def l6(spark, d):
    return losses.balanced_weights(inputs.scores(spark, d)).select("company", "investor", F.round("weight", 8).alias("weight"))


@query(
    "l6_inverse_degree_weights",
    with_(INV, EDGES, INTER) + "SELECT i.company, i.investor, round(pow(a.n, -0.5) * pow(b.n, -0.5), 8) AS weight FROM inter i JOIN (SELECT company, count(*) AS n FROM inter GROUP BY 1) a USING (company) JOIN (SELECT investor, count(*) AS n FROM inter GROUP BY 1) b USING (investor)",
)
def l6b(spark, d):
    e = inputs.edges(spark, d)
    a = e.groupBy("company").agg(F.count(F.lit(1)).alias("a"))
    b = e.groupBy("investor").agg(F.count(F.lit(1)).alias("b"))
    got = losses.inverse_degree_weights(e.join(a, "company").join(b, "investor"), "a", "b")
    return got.select("company", "investor", F.round("weight", 8).alias("weight"))


# ---- run comparison --------------------------------------------------------

_RUNS = "runs AS (SELECT o_orderpriority AS run, round(avg(o_totalprice), 4) AS ap, count(*)::DOUBLE AS mrr, round(min(o_totalprice), 2) AS avg_rank FROM orders GROUP BY 1)"
_LONG = "lng AS (SELECT run, 'ap' AS metric, ap AS value FROM runs UNION ALL SELECT run, 'mrr', mrr FROM runs UNION ALL SELECT run, 'avg_rank', avg_rank FROM runs)"
_BEST = "best AS (SELECT metric, run AS best, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'avg_rank' THEN value ELSE -value END, run) AS r FROM lng) WHERE r = 1)"


def _long(spark, d):
    o = t(spark, d, "orders")
    runs = o.groupBy(F.col("o_orderpriority").alias("run")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("ap"), F.count(F.lit(1)).cast("double").alias("mrr"), F.round(F.min("o_totalprice"), 2).alias("avg_rank")
    )
    return reports.unpivot_metrics(runs, "run", ["ap", "mrr", "avg_rank"])


@query("a17_best_per_metric", with_(_RUNS, _LONG, _BEST) + "SELECT metric, best, value FROM best")
def a17(spark, d):
    return reports.best_per_metric(_long(spark, d), "run", ["avg_rank"])


@query("a17_win_counts", with_(_RUNS, _LONG, _BEST) + "SELECT best, count(*) AS wins FROM best GROUP BY 1")
def a17b(spark, d):
    return reports.win_counts(reports.best_per_metric(_long(spark, d), "run", ["avg_rank"]))


@query(
    "a18_run_comparison",
    with_(_RUNS, _LONG, "l2 AS (SELECT * FROM lng UNION ALL SELECT run, 'gap', ap - avg_rank FROM runs)")
    + """SELECT metric, round(max(value) FILTER (run = '1-URGENT'), 4) AS "1-URGENT", round(max(value) FILTER (run = '2-HIGH'), 4) AS "2-HIGH", round(max(value) FILTER (run = '5-LOW'), 4) AS "5-LOW" FROM l2 GROUP BY 1""",
)
def a18(spark, d):
    got = reports.comparison(_long(spark, d), "run", ["1-URGENT", "2-HIGH", "5-LOW"], ("gap", "ap", "avg_rank"))
    return got.select("metric", *[F.round(f"`{c}`", 4).alias(c) for c in ("1-URGENT", "2-HIGH", "5-LOW")])


_W11 = """WITH series AS (SELECT event_type, floor(epoch(ts) / 86400) AS day, avg(value) AS v FROM events GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER w - 1 AS place, max(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM series WINDOW w AS (PARTITION BY event_type ORDER BY day)),
gains AS (SELECT *, CASE WHEN earlier IS NULL OR v - earlier > 1e-10 * abs(earlier) THEN place END AS g FROM placed),
held AS (SELECT *, max(g) OVER (PARTITION BY event_type ORDER BY day) AS best FROM gains),
ends AS (SELECT event_type, min(CASE WHEN place - best >= 3 THEN place END) AS stop_epoch FROM held GROUP BY 1),
chosen AS (SELECT h.event_type, coalesce(e.stop_epoch - 3, max(h.best)) AS best_epoch, e.stop_epoch FROM held h JOIN ends e USING (event_type) GROUP BY h.event_type, e.stop_epoch)
SELECT c.event_type, c.best_epoch, h.v AS best_value, c.stop_epoch FROM chosen c JOIN held h ON h.event_type = c.event_type AND h.place = c.best_epoch"""


@query("w11_early_stop", _W11)
def w11(spark, d):
    """Daily mean event value per event type as a metric series; patience 3."""
    x = fixtures.node_events(spark, d)
    series = x.groupBy("event_type", F.floor(F.col("ts") / 86400).alias("epoch")).agg(F.avg("value").alias("v"))
    return reports.early_stop(series, "event_type", "epoch", "v")


__all__ = ["ORGS"]
