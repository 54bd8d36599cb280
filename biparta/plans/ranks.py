"""Queries of influence ranking. SQL checks spell the iterations out as chained views."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from biparta import fixtures
from biparta.operators import block_ranking, montecarlo, ranking, settled
from biparta.plans import inputs
from biparta.plans.registry import COMPONENTS, EDGES, INTER, INV, NEGS, POOL, SCORED, SCORES, query, sql_uniform, with_

EPS = "1e-12"


def _floor(x: str) -> str:
    return f"(CASE WHEN {x} > {EPS} THEN {x} ELSE {EPS} END)"


def iterations_sql(source: str, weight: str, alpha: str, beta: str, n: int, by: str = "", last_only: bool = True) -> list[str]:
    """Views m, kc.., f0..fn, u0..un, and ``result(by, side, id, score)`` after n steps."""
    b = f"{by}, " if by else ""
    on = lambda a, c: f"{a}.{by} = {c}.{by} AND " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    out = [
        f"m AS (SELECT {b}company, investor, ({weight})::DOUBLE AS w, ({alpha})::DOUBLE AS al, ({beta})::DOUBLE AS be FROM {source})",
        f"kc AS (SELECT {b}company, sum(w) AS k FROM m GROUP BY ALL)",
        f"kv AS (SELECT {b}investor, sum(w) AS k FROM m GROUP BY ALL)",
        f"""g AS (SELECT {', '.join(f'm.{x}' for x in ([by] if by else []) + ['company', 'investor'])}, w * pow({_floor('kc.k')}, -be) AS a, w * pow({_floor('kv.k')}, -al) AS c
          FROM m JOIN kc ON {on('m', 'kc')} m.company = kc.company JOIN kv ON {on('m', 'kv')} m.investor = kv.investor)""",
        f"""gn AS MATERIALIZED (SELECT {b}company, investor, a / {_floor(f'(sum(a) OVER (PARTITION BY {b}investor))')} AS ct, c / {_floor(f'(sum(c) OVER (PARTITION BY {b}company))')} AS tc FROM g)""",
        f"f0 AS (SELECT {b}company, k / sqrt(sum(k * k) OVER ({part})) AS x FROM kc)",
        f"u0 AS (SELECT {b}investor, k / sqrt(sum(k * k) OVER ({part})) AS x FROM kv)",
    ]
    for i in range(1, n + 1):
        p = i - 1
        gb = f"gn.{by}, " if by else ""
        out.append(f"fr{i} AS (SELECT {gb}gn.company, sum(ct * x) AS x FROM gn JOIN u{p} ON {on('gn', f'u{p}')} gn.investor = u{p}.investor GROUP BY ALL)")
        out.append(f"ur{i} AS (SELECT {gb}gn.investor, sum(tc * x) AS x FROM gn JOIN f{p} ON {on('gn', f'f{p}')} gn.company = f{p}.company GROUP BY ALL)")
        out.append(f"f{i} AS MATERIALIZED (SELECT {b}company, x / sqrt(sum(x * x) OVER ({part})) AS x FROM fr{i})")
        out.append(f"u{i} AS MATERIALIZED (SELECT {b}investor, x / sqrt(sum(x * x) OVER ({part})) AS x FROM ur{i})")
    out.append(f"result AS (SELECT {b}'company' AS side, company AS id, x AS score FROM f{n} UNION ALL SELECT {b}'investor', investor, x FROM u{n})")
    return out


def tagged(views: list[str], tag: str) -> list[str]:
    """The same views under prefixed names, so that two runs fit into one statement."""
    return [re.sub(r"\b(m|kc|kv|g|gn|result|(?:fr?|ur?)\d+)\b", rf"{tag}_\1", v) for v in views]


def _rounded(df, *keys):
    return df.select(*keys, F.round("score", 6).alias("score"))


_FIVE = iterations_sql("edges", "1", "0.3", "-5", 5)


@query(
    "r1_zero_order",
    with_(INV, EDGES, *iterations_sql("edges", "n_rounds", "0.3", "-5", 1)) + "SELECT 'company' AS side, company AS id, round(x, 8) AS score FROM f0 UNION ALL SELECT 'investor', investor, round(x, 8) FROM u0",
)
def r1(spark, d):
    return ranking.RankGraph(inputs.edges(spark, d), weight="n_rounds").zero_order().select("side", "id", F.round("score", 8).alias("score"))


@query(
    "r2_transition_weights",
    with_(INV, EDGES, *iterations_sql("edges", "1", "0.8", "-0.6", 1)) + "SELECT company, investor, round(ct, 8) AS to_company, round(tc, 8) AS to_investor FROM gn",
)
def r2(spark, d):
    e = inputs.edges(spark, d)
    n = ranking.RankGraph(e, 0.8, -0.6).nodes
    c = n.filter("side = 'company'").select(F.col("id").alias("company"), F.col("penalty").alias("pc"), F.col("norm").alias("nc"))
    v = n.filter("side = 'investor'").select(F.col("id").alias("investor"), F.col("penalty").alias("pv"), F.col("norm").alias("nv"))
    j = e.join(c, "company").join(v, "investor")
    return j.select("company", "investor", F.round(F.col("pc") / F.col("nv"), 8).alias("to_company"), F.round(F.col("pv") / F.col("nc"), 8).alias("to_investor"))


@query("r3_one_step", with_(INV, EDGES, *iterations_sql("edges", "1", "0.3", "-5", 1)) + "SELECT side, id, round(score, 6) AS score FROM result")
def r3(spark, d):
    return _rounded(ranking.fixed_scores(inputs.edges(spark, d), 1), "side", "id")


@query("r4_fixed_iterations", with_(INV, EDGES, *iterations_sql("edges", "n_rounds", "0.8", "-0.6", 4)) + "SELECT side, id, round(score, 6) AS score FROM result")
def r4(spark, d):
    return _rounded(ranking.fixed_scores(inputs.edges(spark, d), 4, 0.8, -0.6, "n_rounds"), "side", "id")


@query("r5_convergence")
def r5(spark, d):
    """Iterations until each side is stable, and the unit length of its scores."""
    scores, stops = ranking.converge(ranking.RankGraph(inputs.edges(spark, d)))
    length = scores.groupBy("side").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sqrt(F.sum(F.col("score") * F.col("score"))), 6).alias("length"))
    return stops.join(length, "side").withColumn("iterations", F.col("iterations").cast("bigint"))


@query(
    "r5_settled_scores",
    "WITH RECURSIVE " + ",\n".join([INV, EDGES]) + ", " + COMPONENTS + """,
    kc AS (SELECT company, count(*) AS k FROM edges GROUP BY 1), kv AS (SELECT investor, count(*) AS k FROM edges GROUP BY 1),
    own AS (SELECT 'company' AS side, company AS id, any_value(c.k) AS k, pow(any_value(c.k), 5.0) * sum(pow(v.k, -0.3)) AS x FROM edges JOIN kc c USING (company) JOIN kv v USING (investor) GROUP BY 2
      UNION ALL SELECT 'investor', investor, any_value(v.k), pow(any_value(v.k), -0.3) * sum(pow(c.k, 5.0)) FROM edges JOIN kc c USING (company) JOIN kv v USING (investor) GROUP BY 2),
    part AS (SELECT side, id, x * sum(k) OVER (PARTITION BY side, component) / sum(x) OVER (PARTITION BY side, component) AS f FROM own JOIN lab ON node = side || ':' || id)
    SELECT side, id, round(f / sqrt(sum(f * f) OVER (PARTITION BY side)), 8) AS score FROM part""",
)
def r5b(spark, d):
    """The scores that the iteration of ``r5`` tends to, without iterating."""
    return settled.settled_scores(inputs.edges(spark, d)).select("side", "id", F.round("score", 8).alias("score"))


@query(
    "r6_ranked_output",
    with_(INV, EDGES, *_FIVE)
    + """SELECT r.side, r.id, round(r.score, 6) AS score, row_number() OVER (PARTITION BY r.side ORDER BY round(r.score, 9) DESC, r.id) AS rank,
    row_number() OVER (PARTITION BY r.side ORDER BY round(i.score, 9), r.id) - 1 AS initial_position FROM result r
    JOIN (SELECT 'company' AS side, company AS id, x AS score FROM f1 UNION ALL SELECT 'investor', investor, x FROM u1) i ON i.side = r.side AND i.id = r.id""",
)
def r6(spark, d):
    g = ranking.RankGraph(inputs.edges(spark, d))
    first = g.unit(g.step(g.start())).select("side", "id", F.round("score", 9).alias("one"))
    scores = g.run(5).join(first, ["side", "id"])
    placed = ranking.global_rank(scores, [F.col("one").asc(), F.col("id").asc()], "initial_position", start=0, by=("side",))
    return ranking.ranked(placed, digits=9).select("side", "id", F.round("score", 6).alias("score"), "rank", "initial_position")


_TRUTH = "truth AS (SELECT 'company' AS side, p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS ground_truth_rank FROM part)"


def _truth(spark, d):
    p = fixtures.table(spark, d, "part").select(F.lit("company").alias("side"), F.col("p_partkey").alias("id"), "p_retailprice")
    return ranking.global_rank(p, [F.col("p_retailprice").desc(), F.col("id").asc()], "ground_truth_rank").select("side", "id", "ground_truth_rank")


@query(
    "j14_ground_truth_attach",
    with_(INV, EDGES, *_FIVE, _TRUTH) + "SELECT r.side, r.id, round(r.score, 6) AS score, t.ground_truth_rank FROM result r LEFT JOIN truth t ON t.side = r.side AND t.id = r.id",
)
def j14(spark, d):
    return ranking.with_ground_truth(_rounded(ranking.fixed_scores(inputs.edges(spark, d), 5), "side", "id"), _truth(spark, d))


@query(
    "r7_ground_truth_correlation",
    with_(INV, EDGES, *_FIVE, _TRUTH, """x AS (SELECT row_number() OVER (ORDER BY round(r.score, 9) DESC, r.id) AS a, t.ground_truth_rank AS b FROM result r JOIN truth t ON t.side = r.side AND t.id = r.id)""")
    + "SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY a) AS a, rank() OVER (ORDER BY b) AS b FROM x)",
)
def r7(spark, d):
    from biparta.operators.metrics import spearman

    ranks = ranking.ranked(ranking.fixed_scores(inputs.edges(spark, d), 5), digits=9).filter("side = 'company'")
    both = ranking.with_ground_truth(ranks, _truth(spark, d))
    return spearman(both, "rank", "ground_truth_rank").select("n", F.round("spearman", 6).alias("spearman"))


@query(
    "r8_top_influence",
    with_(INV, EDGES, *_FIVE)
    + "SELECT side, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round(score, 9) DESC, id) AS rank FROM result) WHERE rank <= 20",
)
def r8(spark, d):
    scores = ranking.fixed_scores(inputs.edges(spark, d), 5)
    return ranking.ranked(scores, digits=9).filter("rank <= 20").select("side", "id", F.round("score", 6).alias("score"), "rank")


@query("r8_rank_until_stable")
def r8b(spark, d):
    return ranking.rank_graph(inputs.edges(spark, d), fixtures.company_nodes(spark, d))


@query(
    "w10_rank_changes",
    with_(INV, EDGES, *_FIVE)
    + """SELECT side, count(*) FILTER (a <> b) AS moved, count(*) AS nodes FROM (SELECT r.side, row_number() OVER (PARTITION BY r.side ORDER BY round(r.score, 9), r.id) AS a,
    row_number() OVER (PARTITION BY r.side ORDER BY round(i.score, 9), r.id) AS b FROM result r
    JOIN (SELECT 'company' AS side, company AS id, x AS score FROM f4 UNION ALL SELECT 'investor', investor, x FROM u4) i ON i.side = r.side AND i.id = r.id) GROUP BY 1""",
)
def w10(spark, d):
    g = ranking.RankGraph(inputs.edges(spark, d))
    order = [F.round("score", 9).asc(), F.col("id").asc()]
    four, five = g.run_to([4, 5])
    a = ranking.global_rank(five, order, "a", by=("side",)).select("side", "id", "a")
    b = ranking.global_rank(four, order, "b", by=("side",)).select("side", "id", "b")
    return a.join(b, ["side", "id"]).groupBy("side").agg(F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count(F.lit(1)).alias("nodes"))


_GRID = [(0.3, -5.0), (0.8, -0.6), (1.0, 0.0)]
_GRID_SQL = "grid AS (SELECT edges.*, param_id, al0, be0 FROM edges, (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_GRID)) + ") AS v(param_id, al0, be0))"


@query("r9_parameter_sweep", with_(INV, EDGES, _GRID_SQL, *iterations_sql("grid", "1", "al0", "be0", 3, by="param_id")) + "SELECT param_id::BIGINT AS param_id, side, id, round(score, 6) AS score FROM result")
def r9(spark, d):
    got = block_ranking.parameter_sweep(inputs.edges(spark, d), _GRID, 3)
    return got.select(F.col("param_id").cast("bigint"), "side", "id", F.round("score", 6).alias("score"))


@query("r9_sweep_until_stable")
def r9b(spark, d):
    """The sweep of ``r9_parameter_sweep`` with the stop rule in place of three steps."""
    got = block_ranking.parameter_sweep(inputs.edges(spark, d), _GRID)
    return got.select(F.col("param_id").cast("bigint"), "side", "id", F.round("score", 6).alias("score"))


_SAMPLES = 4
# samples of the whole job; the SQL checks spell out the small one
_ALL_SAMPLES = 500
_MC = [
    INV, EDGES, INTER, POOL, NEGS, SCORES,
    f"runs AS (SELECT s.*, sample_id FROM scores s, (SELECT unnest(range(0, {_SAMPLES})) AS sample_id) k WHERE {sql_uniform(5, 'sample_id', 'company', 'investor')} < p)",
]


@query("n6_bernoulli_edges", with_(*_MC) + "SELECT sample_id::BIGINT AS sample_id, company, investor, p FROM runs")
def n6(spark, d):
    from biparta.operators.negatives import bernoulli_edges

    edges = bernoulli_edges(inputs.scores(spark, d), _SAMPLES, 5)
    listed = edges.select("company", "investor", "p", F.posexplode(F.split("in_samples", "")).alias("sample_id", "bit")).filter("bit = '1'")
    return listed.select(F.col("sample_id").cast("bigint"), "company", "investor", "p")


@query(
    "n6_all_samples",
    with_(INV, EDGES, INTER, POOL, NEGS, SCORES, f"""drawn AS (SELECT company, investor, p,
      array_to_string(list_transform(range(0, {_ALL_SAMPLES}), lambda i: CASE WHEN {sql_uniform(5, 'i', 'company', 'investor')} < p THEN '1' ELSE '0' END), '') AS bits FROM scores)""")
    + "SELECT company, investor, p, len(replace(bits, '0', '')) AS n_samples, md5(bits) AS in_samples_md5 FROM drawn",
)
def n6b(spark, d):
    """All 500 random graphs: one row per edge, with a bit per graph (as a digest, to keep the check short)."""
    from biparta.operators.negatives import bernoulli_edges

    edges = bernoulli_edges(inputs.scores(spark, d), _ALL_SAMPLES, 5)
    return edges.select("company", "investor", "p", "n_samples", F.md5("in_samples").alias("in_samples_md5"))


@query(
    "r10_monte_carlo",
    with_(
        *_MC,
        *iterations_sql("runs", "1", "0.3", "-5", 3, by="sample_id"),
        f"""full_ AS (SELECT id, sample_id, coalesce(score, 0.0) AS score FROM (SELECT * FROM (SELECT DISTINCT company AS id FROM scores), (SELECT unnest(range(0, {_SAMPLES})) AS sample_id)) AS e
          LEFT JOIN (SELECT id, sample_id, score FROM result WHERE side = 'company') USING (id, sample_id))""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, id) AS rank FROM full_)",
    )
    + """SELECT id, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(quantile_cont(score, 0.025), 6) AS low,
    round(quantile_cont(score, 0.975), 6) AS high, avg((rank <= 50)::INT)::DOUBLE AS p_top FROM placed GROUP BY 1""",
)
def r10(spark, d):
    got = montecarlo.uncertainty(inputs.scores(spark, d), _SAMPLES, 3, 50, seed=5)
    return got.select("id", *[F.round(c, 6).alias(c) for c in ("mean_score", "std_score", "low", "high")], "p_top")


@query("r10_samples_until_stable")
def r10b(spark, d):
    """500 sampled graphs, each ranked until its order is stable."""
    got = montecarlo.uncertainty(inputs.scores(spark, d), _ALL_SAMPLES, None, 50, seed=5)
    return got.select("id", *[F.round(c, 6).alias(c) for c in ("mean_score", "std_score", "low", "high")], "rank_low", "rank_high", "p_top")


_THRESHOLDS = [0.3, 0.6, 0.9]
_TH_SQL = "cut AS (SELECT scores.*, param_id FROM scores JOIN (VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(_THRESHOLDS)) + ") AS v(param_id, th) ON p >= th)"


@query(
    "r11_threshold_sensitivity",
    with_(INV, EDGES, INTER, POOL, NEGS, SCORES, _TH_SQL, *iterations_sql("cut", "1", "0.3", "-5", 3, by="param_id")) + "SELECT param_id::BIGINT AS param_id, side, id, round(score, 6) AS score FROM result",
)
def r11(spark, d):
    got = block_ranking.threshold_sweep(inputs.scores(spark, d), _THRESHOLDS, 3)
    return got.select(F.col("param_id").cast("bigint"), "side", "id", F.round("score", 6).alias("score"))


@query("r11_thresholds_until_stable")
def r11b(spark, d):
    """The thresholds of ``r11_threshold_sensitivity`` with the stop rule in place of three steps."""
    got = block_ranking.threshold_sweep(inputs.scores(spark, d), _THRESHOLDS)
    return got.select(F.col("param_id").cast("bigint"), "side", "id", F.round("score", 6).alias("score"))


__all__ = ["SCORED"]
