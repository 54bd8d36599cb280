"""Queries of graph construction, diagnostics, and whole-table ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from biparta import fixtures
from biparta.operators import components, diagnostics, graph, projection, splits
from biparta.operators.metrics import average_ranks
from biparta.operators.ordering import exact_quantiles, global_dense_rank, global_rank
from biparta.plans import inputs
from biparta.plans.registry import BASE, CATS, COMPONENTS, CUTS, DEG, EDGES, ENDS, INTER, INTERACTIONS, INV, LABELLED, ORGS, SCORED, query, with_

t = fixtures.table

NODES = "nodes AS (SELECT 'company' AS side, p_partkey AS id FROM part UNION ALL SELECT 'investor', c_custkey FROM customer)"
FULLDEG = "fulldeg AS (SELECT n.side, n.id, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN deg d ON d.side = n.side AND d.id = n.id)"


def _companies(spark, d):
    return fixtures.organizations(spark, d).select(F.col("uuid").alias("id"), "category_list")


# ---- construction ----------------------------------------------------------


@query(
    "g1_bipartite_nodes",
    with_(INV, EDGES, DEG, NODES, FULLDEG, ORGS, CATS)
    + """SELECT f.side, f.id, degree, coalesce(c.n, 0) AS n_technologies, coalesce(c.listed, '') AS technologies FROM fulldeg f
    LEFT JOIN (SELECT 'company' AS side, company AS id, count(*) AS n, string_agg(category, '|' ORDER BY category) AS listed FROM cats GROUP BY 2) c ON c.side = f.side AND c.id = f.id""",
)
def g1(spark, d):
    got = graph.node_table(fixtures.company_nodes(spark, d), inputs.edges(spark, d), _companies(spark, d))
    return got.withColumn("technologies", F.array_join("technologies", "|"))


@query("g2_company_technology_edges", with_(ORGS, CATS) + "SELECT company, category AS technology FROM cats")
def g2(spark, d):
    return graph.technology_edges(_companies(spark, d))


@query("g2_technology_isolates", "SELECT p_partkey AS company FROM part WHERE p_size % 10 = 0")
def g2b(spark, d):
    x = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 != 0, F.col("p_type")).otherwise(" , ").alias("category_list"))
    return graph.technology_isolates(x)


@query(
    "g3_tripartite_edges",
    with_(INV, ORGS, CATS)
    + """SELECT DISTINCT company::VARCHAR AS src, round_id::VARCHAR AS dst, 'company_investment' AS edge_type FROM inv
    UNION ALL SELECT company::VARCHAR, category, 'company_technology' FROM cats
    UNION ALL SELECT DISTINCT round_id::VARCHAR, category, 'investment_technology' FROM inv JOIN cats USING (company)""",
)
def g3(spark, d):
    return graph.tripartite_edges(_companies(spark, d), fixtures.investments(spark, d))


@query(
    "g4_ground_truth_graph",
    SCORED + "SELECT s.company, s.investor, 1::BIGINT AS n_rounds, round(i.raised, 2) AS total_raised, i.ts AS first_ts FROM scores s JOIN inter i ON s.company = i.company AND s.investor = i.investor WHERE label > 0",
)
def g4(spark, d):
    inter = inputs.interactions(spark, d).select("company", "investor", "ts", "raised")
    rows = inputs.scores(spark, d).join(inter, ["company", "investor"], "left")
    _, e = graph.labelled_graph(rows, inputs.node_maps(spark, d))
    return e.select("company", "investor", "n_rounds", F.round("total_raised", 2).alias("total_raised"), "first_ts")


@query(
    "g5_predicted_graph",
    SCORED + "SELECT side, id, round(sum(p), 6) AS degree FROM (SELECT 'company' AS side, company AS id, p FROM scores WHERE p >= 0.45 UNION ALL SELECT 'investor', investor, p FROM scores WHERE p >= 0.45) GROUP BY 1, 2",
)
def g5(spark, d):
    deg = graph.degrees(graph.scored_graph(inputs.scores(spark, d), 0.45), weight="weight")
    return deg.withColumn("degree", F.round("degree", 6))


@query("g6_scored_graph", SCORED + "SELECT company, investor, p AS weight, 1::BIGINT AS n_rounds FROM scores")
def g6(spark, d):
    return graph.scored_graph(inputs.scores(spark, d))


@query(
    "g7_biadjacency",
    with_(INV, EDGES, "r AS (SELECT p_partkey AS company, row_number() OVER (ORDER BY p_partkey) - 1 AS row FROM part)", "c AS (SELECT c_custkey AS investor, row_number() OVER (ORDER BY c_custkey) - 1 AS col FROM customer)")
    + "SELECT row, col, n_rounds::DOUBLE AS w FROM edges JOIN r USING (company) JOIN c USING (investor)",
)
def g7(spark, d):
    return graph.biadjacency(inputs.edges(spark, d), fixtures.company_nodes(spark, d), "n_rounds")


_DENSITY = "s AS (SELECT (SELECT count(*) FROM part) AS n_companies, (SELECT count(*) FROM customer) AS n_investors, (SELECT count(*) FROM edges) AS edges)"


@query(
    "g8_density",
    with_(INV, EDGES, _DENSITY)
    + """SELECT n_companies, n_investors, edges, n_companies * n_investors AS possible_edges, round(edges::DOUBLE / (n_companies * n_investors), 8) AS density,
    round((1 - edges::DOUBLE / (n_companies * n_investors)) * 100, 6) AS sparsity_pct, round(edges::DOUBLE / n_investors, 6) AS edges_per_investor,
    round(edges::DOUBLE / n_companies, 6) AS edges_per_company, round(2.0::DOUBLE * edges / ((n_companies + n_investors) * (n_companies + n_investors - 1)), 8) AS unipartite_density FROM s""",
)
def g8(spark, d):
    got = diagnostics.density(inputs.edges(spark, d), fixtures.company_nodes(spark, d))
    digits = {"density": 8, "unipartite_density": 8}
    return got.select(*[F.round(c, digits.get(c, 6)).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes])


_DEGSTATS = """st AS (SELECT side, count(*) AS total, count(*) FILTER (degree = 0) AS isolated, avg(degree) AS mean, stddev_pop(degree) AS std, min(degree) AS min, max(degree) AS max,
  quantile_cont(degree::DOUBLE, 0.5) AS median FROM fulldeg GROUP BY 1),
  mo AS (SELECT f.side, avg(pow((degree - mean) / std, 3)) AS skewness, avg(pow((degree - mean) / std, 4)) - 3 AS kurtosis FROM fulldeg f JOIN st ON st.side = f.side GROUP BY 1),
  gi AS (SELECT side, sum((2 * r - n - 1) * degree)::DOUBLE / (max(n) * sum(degree)) AS gini FROM (SELECT side, degree, row_number() OVER (PARTITION BY side ORDER BY degree) AS r, count(*) OVER (PARTITION BY side) AS n FROM fulldeg) GROUP BY 1)"""


@query(
    "g9_degree_statistics",
    with_(INV, EDGES, DEG, NODES, FULLDEG, _DEGSTATS)
    + "SELECT side, total, isolated, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, median, round(gini, 6) AS gini FROM st JOIN mo USING (side) JOIN gi USING (side)",
)
def g9(spark, d):
    got = diagnostics.degree_statistics(inputs.edges(spark, d), fixtures.company_nodes(spark, d))
    return got.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes])


@query("g10_gini", with_(INV, EDGES, DEG, NODES, FULLDEG, _DEGSTATS) + "SELECT side, round(gini, 6) AS gini FROM gi")
def g10(spark, d):
    deg = graph.degrees(inputs.edges(spark, d), fixtures.company_nodes(spark, d))
    return diagnostics.gini(deg, "degree", ("side",)).withColumn("gini", F.round("gini", 6))


@query(
    "g11_imbalance",
    with_(INV, EDGES, _DENSITY)
    + """SELECT round(n_investors::DOUBLE / n_companies, 6) AS ratio_investors_companies, round((edges::DOUBLE / n_investors) / (edges::DOUBLE / n_companies), 6) AS ratio_avg_degree,
    round(edges::DOUBLE / (n_companies * n_investors), 6) AS avg_positive_rate, round((n_companies * n_investors - edges)::DOUBLE / edges, 6) AS negative_positive_ratio,
    round(abs(n_investors - n_companies)::DOUBLE / (n_investors + n_companies), 6) AS size_imbalance FROM s""",
)
def g11(spark, d):
    got = diagnostics.imbalance(inputs.edges(spark, d), fixtures.company_nodes(spark, d))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])




@query(
    "g12_component_sizes",
    """WITH RECURSIVE """ + ",\n".join([INV, EDGES])
    + ", " + COMPONENTS + """
    SELECT component, count(*) AS size FROM lab GROUP BY 1""",
)
def g12(spark, d):
    return components.component_sizes(components.components(inputs.edges(spark, d)))


@query(
    "g12_connectivity",
    """WITH RECURSIVE """ + ",\n".join([INV, EDGES, NODES])
    + ", " + COMPONENTS + """,
    everyone AS (SELECT coalesce(component, side || ':' || id) AS component FROM nodes LEFT JOIN lab ON node = side || ':' || id),
    sizes AS (SELECT component, count(*) AS size FROM everyone GROUP BY 1)
    SELECT count(*) AS n_components, max(size) AS largest_size, round(max(size) * 100.0::DOUBLE / sum(size), 6) AS largest_percentage, count(*) = 1 AS is_connected FROM sizes""",
)
def g12b(spark, d):
    got = components.connectivity(components.components(inputs.edges(spark, d), fixtures.company_nodes(spark, d)))
    return got.withColumn("largest_percentage", F.round("largest_percentage", 6))


@query("g13_isolates", with_(INV, EDGES, NODES) + "SELECT side, id FROM nodes WHERE (side = 'company' AND id NOT IN (SELECT company FROM edges)) OR (side = 'investor' AND id NOT IN (SELECT investor FROM edges))")
def g13(spark, d):
    return graph.isolates(fixtures.company_nodes(spark, d), inputs.edges(spark, d))


_TOP = "top AS (SELECT company FROM edges GROUP BY 1 ORDER BY count(*) DESC, company LIMIT 10)"


@query(
    "g14_neighbourhood",
    with_(INV, EDGES, _TOP) + "SELECT company, investor, n_rounds FROM edges WHERE investor IN (SELECT investor FROM edges WHERE company IN (SELECT company FROM top))",
)
def g14(spark, d):
    return graph.neighbourhood(inputs.edges(spark, d), 10).select("company", "investor", "n_rounds")


@query(
    "g14_induced_top_nodes",
    with_(INV, EDGES, "top_c AS (SELECT company FROM edges GROUP BY 1 ORDER BY count(*) DESC, company LIMIT 60)", "top_v AS (SELECT investor FROM edges GROUP BY 1 ORDER BY count(*) DESC, investor LIMIT 60)")
    + "SELECT company, investor FROM edges WHERE company IN (SELECT company FROM top_c) AND investor IN (SELECT investor FROM top_v)",
)
def g14b(spark, d):
    e = inputs.edges(spark, d)
    keep = graph.top_nodes(e, "company", 60).unionByName(graph.top_nodes(e, "investor", 60))
    return graph.induced(e, keep).select("company", "investor")


@query(
    "g15_low_degree_nodes",
    with_(INV, EDGES, DEG, "o AS (SELECT count(*) AS n, max(degree) AS top, avg(degree) AS mean FROM deg WHERE side = 'investor')")
    + "SELECT side, id, degree FROM deg, o WHERE side = 'company' AND degree <= CASE WHEN ceil(n / 50.0) > top THEN mean ELSE ceil(n / 50.0) END",
)
def g15(spark, d):
    return graph.low_degree_nodes(inputs.edges(spark, d), "company", 50)


def _two_colours(u: str, v: str) -> str:
    """Walk from one node of the (connected) graph; a node met at odd and even distance closes an odd cycle."""
    return (
        "WITH RECURSIVE " + ",\n".join([INV, EDGES])
        + f""", und AS (SELECT {u} AS a, {v} AS b FROM edges UNION SELECT {v}, {u} FROM edges),
        walk(node, parity) AS (SELECT min(a), 0 FROM und UNION SELECT u.b, 1 - w.parity FROM walk w JOIN und u ON u.a = w.node)
        SELECT max(n) = 1 AS is_bipartite FROM (SELECT node, count(*) AS n FROM walk GROUP BY 1)"""
    )


@query("g17_bipartite_check", _two_colours("'company:' || company", "'investor:' || investor"))
def g17(spark, d):
    e = inputs.edges(spark, d)
    key = lambda s: F.concat(F.lit(f"{s}:"), F.col(s).cast("string"))
    return components.is_bipartite(e.select(key("company").alias("u"), key("investor").alias("v")))


@query("g17_odd_cycle_check", _two_colours("company", "investor"))
def g17b(spark, d):
    # both sides in one id space: odd cycles appear
    e = inputs.edges(spark, d)
    return components.is_bipartite(e.select(F.col("company").alias("u"), F.col("investor").alias("v")))


_PROJ = """pe AS (SELECT DISTINCT a.company AS x, b.company AS y FROM edges a JOIN edges b ON a.investor = b.investor AND a.company <> b.company),
  pd AS (SELECT x, count(*) AS degree FROM pe GROUP BY 1)"""


@query("g18_projection_degrees", with_(INV, EDGES, _PROJ) + "SELECT company AS id, coalesce(degree, 0) AS degree FROM (SELECT DISTINCT company FROM edges) LEFT JOIN pd ON x = company")
def g18(spark, d):
    return projection.projection_degrees(inputs.edges(spark, d), "company")


@query("g18_assortativity", with_(INV, EDGES, _PROJ) + "SELECT 'company' AS side, round(corr(a.degree, b.degree), 6) AS assortativity FROM pe JOIN pd a ON a.x = pe.x JOIN pd b ON b.x = pe.y")
def g18b(spark, d):
    return projection.assortativity(inputs.edges(spark, d), "company").withColumn("assortativity", F.round("assortativity", 6))


@query(
    "g19_power_law",
    with_(INV, EDGES, DEG, """v AS (SELECT degree FROM deg WHERE side = 'company')""",
    """q AS (SELECT count(*) AS n, min(degree)::DOUBLE AS low, max(degree)::DOUBLE AS high, quantile_cont(degree::DOUBLE, 0.25) AS q1, quantile_cont(degree::DOUBLE, 0.75) AS q3 FROM v)""",
    """w AS (SELECT *, greatest(CASE WHEN q3 > q1 THEN least(2.0 * (q3 - q1) * pow(n, -1.0 / 3), (high - low) / (log2(n) + 1)) ELSE (high - low) / (log2(n) + 1) END, 1.0) AS width FROM q)""",
    """b AS (SELECT *, greatest(1, ceil((high - low) / width))::BIGINT AS bins FROM w)""",
    """h AS (SELECT low + (bin + 0.5) * (high - low) / bins AS x, y, bins FROM (SELECT least(floor((degree - low) / ((high - low) / bins)), bins - 1) AS bin, count(*) AS y, any_value(low) AS low, any_value(high) AS high, any_value(bins) AS bins FROM v, b GROUP BY 1))""")
    + """SELECT 'company' AS side, max(bins) AS bins, regr_r2(ln(y), ln(x)) > 0.8 AS is_power_law, round(-regr_slope(ln(y), ln(x)), 6) AS alpha, round(regr_r2(ln(y), ln(x)), 6) AS r_squared, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax FROM h WHERE x > 0""",
)
def g19(spark, d):
    got = diagnostics.power_law(inputs.edges(spark, d), "company")
    return got.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes])


@query(
    "g20_temporal_coverage",
    "SELECT count(*) AS events, round(min(epoch(ts)), 3) AS first_ts, round(max(epoch(ts)), 3) AS last_ts, round((max(epoch(ts)) - min(epoch(ts))) / 86400, 6) AS span_days, round(count(*) / ((max(epoch(ts)) - min(epoch(ts))) / 86400), 4) AS events_per_day FROM events",
)
def g20(spark, d):
    got = diagnostics.temporal_coverage(fixtures.node_events(spark, d))
    digits = {"first_ts": 3, "last_ts": 3, "events_per_day": 4}
    return got.select(*[F.round(c, digits.get(c, 6)).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes])


_HEALTH_CC = COMPONENTS + """,
    everyone AS (SELECT coalesce(component, side || ':' || id) AS component FROM nodes LEFT JOIN lab ON node = side || ':' || id),
    sizes AS (SELECT component, count(*) AS size FROM everyone GROUP BY 1),
    sdeg AS (SELECT 'company' AS side, company AS id, count(*) AS degree FROM edges GROUP BY 2 UNION ALL SELECT 'investor', investor, count(*) FROM edges GROUP BY 2),
    sfull AS (SELECT n.side, n.id, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN sdeg d ON d.side = n.side AND d.id = n.id),
    gi AS (SELECT side, sum((2 * r - n - 1) * degree)::DOUBLE / (max(n) * sum(degree)) AS gini FROM (SELECT side, degree, row_number() OVER (PARTITION BY side ORDER BY degree) AS r, count(*) OVER (PARTITION BY side) AS n FROM sfull) GROUP BY 1),
    ie AS (SELECT DISTINCT a.investor AS x, b.investor AS y FROM edges a JOIN edges b ON a.company = b.company AND a.investor <> b.investor),
    idg AS (SELECT x, count(*) AS degree FROM ie GROUP BY 1),
    m AS (SELECT (SELECT count(*) FROM edges)::DOUBLE / ((SELECT count(*) FROM part) * (SELECT count(*) FROM customer)) AS density, (SELECT max(gini) FROM gi) AS max_gini,
      (SELECT count(*) FILTER (degree = 0) * 100.0::DOUBLE / count(*) FROM sfull) AS isolated_pct, (SELECT count(*) FROM sizes) AS n_components, (SELECT max(size) * 100.0::DOUBLE / sum(size) FROM sizes) AS largest,
      (SELECT CASE WHEN var_pop(a.degree) > 1e-12 THEN abs(corr(a.degree, b.degree)) ELSE 0 END FROM ie JOIN idg a ON a.x = ie.x JOIN idg b ON b.x = ie.y) AS alike)"""


@query(
    "g21_health_score",
    "WITH RECURSIVE " + ",\n".join([INV, EDGES, NODES, _HEALTH_CC])
    + """ SELECT round(density, 8) AS density, round(max_gini, 6) AS max_gini, round(isolated_pct, 6) AS isolated_pct, n_components, round(alike, 6) AS abs_assortativity_investors, greatest(0, 100
      - CASE WHEN density < 0.0001 THEN 40 WHEN density < 0.001 THEN 20 WHEN density < 0.01 THEN 10 ELSE 0 END
      - CASE WHEN max_gini > 0.8 THEN 30 WHEN max_gini > 0.6 THEN 15 ELSE 0 END
      - CASE WHEN density < 0.01 THEN 25 WHEN density < 0.05 THEN 10 ELSE 0 END
      - CASE WHEN isolated_pct > 20 THEN 20 WHEN isolated_pct > 10 THEN 10 ELSE 0 END
      - CASE WHEN n_components > 1 AND largest < 50 THEN 15 ELSE 0 END)::BIGINT AS health_score FROM m""",
)
def g21(spark, d):
    got = diagnostics.health_score(diagnostics.health_metrics(inputs.edges(spark, d), fixtures.company_nodes(spark, d)))
    return got.select(F.round("density", 8).alias("density"), F.round("max_gini", 6).alias("max_gini"), F.round("isolated_pct", 6).alias("isolated_pct"), "n_components", F.round("abs_assortativity_investors", 6).alias("abs_assortativity_investors"), "health_score")


@query(
    "g21_health_findings",
    "WITH RECURSIVE " + ",\n".join([INV, EDGES, NODES, _HEALTH_CC])
    + """, f AS (SELECT CASE WHEN density < 0.0001 THEN 'hyper sparse' WHEN density < 0.001 THEN 'very sparse' END AS finding, CASE WHEN density < 0.0001 THEN 'problem' ELSE 'warning' END AS level FROM m
      UNION ALL SELECT CASE WHEN max_gini > 0.8 THEN 'extreme inequality' WHEN max_gini > 0.6 THEN 'strong inequality' END, CASE WHEN max_gini > 0.8 THEN 'problem' ELSE 'warning' END FROM m
      UNION ALL SELECT CASE WHEN density < 0.01 THEN 'extreme imbalance' WHEN density < 0.05 THEN 'strong imbalance' END, CASE WHEN density < 0.01 THEN 'problem' ELSE 'warning' END FROM m
      UNION ALL SELECT CASE WHEN isolated_pct > 20 THEN 'cold start' WHEN isolated_pct > 10 THEN 'many isolated nodes' END, CASE WHEN isolated_pct > 20 THEN 'problem' ELSE 'warning' END FROM m
      UNION ALL SELECT CASE WHEN n_components > 1 AND largest < 80 THEN 'fragmented graph' END, 'warning' FROM m
      UNION ALL SELECT CASE WHEN alike > 0.4 THEN 'strong investor assortativity' END, 'warning' FROM m)
    SELECT DISTINCT level, finding FROM f WHERE finding IS NOT NULL""",
)
def g21b(spark, d):
    return diagnostics.health_findings(diagnostics.health_metrics(inputs.edges(spark, d), fixtures.company_nodes(spark, d))).select("level", "finding").distinct()


@query(
    "g22_ranking_readiness",
    with_(INV, EDGES)
    + """SELECT c + v AS isolated, c AS zero_companies, v AS zero_investors, c + v = 0 AS is_ready FROM (SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT company FROM edges)) AS c,
    (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT investor FROM edges)) AS v)""",
)
def g22(spark, d):
    return diagnostics.readiness(inputs.edges(spark, d), fixtures.company_nodes(spark, d))


@query(
    "g23_pre_rank_report",
    with_(INV, EDGES)
    + """SELECT (SELECT count(*) FROM part) AS n_companies, (SELECT count(*) FROM customer) AS n_investors,
    (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT company FROM edges)) + (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT investor FROM edges)) AS isolated,
    count(*) AS edges, min(n_rounds)::DOUBLE AS min_weight, max(n_rounds)::DOUBLE AS max_weight, round(avg(n_rounds), 6) AS mean_weight, count(*) FILTER (n_rounds > 0) AS positive_weights FROM edges""",
)
def g23(spark, d):
    e = inputs.edges(spark, d).withColumn("weight", F.col("n_rounds").cast("double"))
    return diagnostics.pre_rank_report(e, fixtures.company_nodes(spark, d)).withColumn("mean_weight", F.round("mean_weight", 6))


@query(
    "g24_negative_overlap",
    SCORED + "SELECT count(*) AS draws, count(i.company) AS true_edges FROM negs n LEFT JOIN inter i ON i.company = n.company AND i.investor = n.negative",
)
def g24(spark, d):
    from biparta.operators.negatives import overlap_with_edges

    inter = inputs.interactions(spark, d)
    return overlap_with_edges(inputs.negatives(inter), inter)


@query(
    "g25_leakage_report",
    SCORED + """SELECT label, count(*) AS pairs, round(avg(r), 4) AS mean_raised, round(min(r), 2) AS min_raised, round(max(r), 2) AS max_raised, count(*) FILTER (r > 0) AS nonzero_raised,
      round(avg(k), 6) AS mean_rounds, count(*) FILTER (k > 0) AS nonzero_rounds, round(quantile_cont(r, 0.5), 4) AS median_raised
    FROM (SELECT label, coalesce(raised, 0.0) AS r, coalesce(n_rounds, 0) AS k FROM scores s LEFT JOIN inter i ON i.company = s.company AND i.investor = s.investor) GROUP BY 1""",
)
def g25(spark, d):
    inter = inputs.interactions(spark, d).select("company", "investor", F.col("raised").alias("total_raised"), "n_rounds")
    rows = inputs.scores(spark, d).join(inter, ["company", "investor"], "left").fillna(0)
    got = diagnostics.leakage_report(rows)
    digits = {"min_raised": 2, "max_raised": 2, "mean_rounds": 6}
    return got.select("label", *[F.round(c, digits.get(c, 4)).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes if c != "label"])


@query(
    "g26_degree_at_time",
    with_(INV, EDGES, INTER) + "SELECT idx, company, investor, (count(*) OVER (PARTITION BY company ORDER BY ts RANGE UNBOUNDED PRECEDING))::BIGINT AS company_degree, (count(*) OVER (PARTITION BY investor ORDER BY ts RANGE UNBOUNDED PRECEDING))::BIGINT AS investor_degree FROM inter",
)
def g26(spark, d):
    from biparta.operators.features import degree_features

    x = inputs.interactions(spark, d)
    return degree_features(x.select("idx", "company", "investor", "ts"), x).select("idx", "company", "investor", "company_degree", "investor_degree")


# ---- whole-table ranks and windows -----------------------------------------


@query("w1_ordinal_rank", BASE + "SELECT company, investor, row_number() OVER (ORDER BY round(total_raised, 2), company, investor) - 1 AS position FROM edges")
def w1(spark, d):
    return global_rank(inputs.edges(spark, d), [F.round("total_raised", 2).asc(), F.col("company").asc(), F.col("investor").asc()], "position", start=0).select("company", "investor", "position")


@query("w2_rank_by_score", with_(INV, EDGES, DEG) + "SELECT side, id, row_number() OVER (PARTITION BY side ORDER BY degree DESC, id) AS rank FROM deg")
def w2(spark, d):
    return global_rank(graph.degrees(inputs.edges(spark, d)), [F.col("degree").desc(), F.col("id").asc()], "rank", by=("side",)).select("side", "id", "rank")


_BA = """ba AS (SELECT company, count(*) FILTER (ts <= 935193600)::DOUBLE AS s0, count(*) FILTER (ts > 935193600)::DOUBLE AS s1 FROM inv GROUP BY 1)"""


def _before_after(spark, d):
    early = F.col("ts") <= 935193600
    return fixtures.investments(spark, d).groupBy("company").agg(F.count_if(early).cast("double").alias("s0"), F.count_if(~early).cast("double").alias("s1"))


@query(
    "w3_dense_ranks",
    with_(INV, _BA) + "SELECT company, dense_rank() OVER (ORDER BY s0 DESC) AS rank_before, dense_rank() OVER (ORDER BY s1 DESC) AS rank_after, dense_rank() OVER (ORDER BY s0 DESC) - dense_rank() OVER (ORDER BY s1 DESC) AS rank_change FROM ba",
)
def w3(spark, d):
    r = global_dense_rank(global_dense_rank(_before_after(spark, d), "s0", "rank_before"), "s1", "rank_after")
    return r.select("company", "rank_before", "rank_after", (F.col("rank_before") - F.col("rank_after")).alias("rank_change"))


@query("w4_relative_ranks", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_retailprice DESC) AS p_retailprice_rank, dense_rank() OVER (ORDER BY p_size) AS p_size_rank FROM part")
def w4(spark, d):
    from biparta.operators.delta import relative_ranks

    got = relative_ranks(t(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), {"p_retailprice": True, "p_size": False})
    return got.select("p_partkey", "p_retailprice_rank", "p_size_rank")


@query(
    "w5_inter_event_times",
    with_(INV) + """, g AS (SELECT 'company' AS side, ts - coalesce(lag(ts) OVER (PARTITION BY company ORDER BY ts), 0) AS gap FROM inv UNION ALL SELECT 'investor', ts - coalesce(lag(ts) OVER (PARTITION BY investor ORDER BY ts), 0) FROM inv)
    SELECT side, round(avg(gap), 3) AS mean_gap, round(stddev_pop(gap), 2) AS std_gap, count(*) AS events FROM g GROUP BY 1""",
)
def w5(spark, d):
    from biparta.operators.history import gap_statistics

    x = fixtures.investments(spark, d)
    out = gap_statistics(x, "company").withColumn("side", F.lit("company")).unionByName(gap_statistics(x, "investor").withColumn("side", F.lit("investor")))
    return out.select("side", F.round("mean_gap", 3).alias("mean_gap"), F.round("std_gap", 2).alias("std_gap"), "events")


_LOG = "log AS (SELECT event_id AS idx, user_id AS id, CASE WHEN event_id % 37 = 0 THEN 0.0::DOUBLE ELSE floor(epoch(ts) / 60) * 60 - CASE WHEN event_id % 53 = 0 THEN 600 ELSE 0 END END AS ts FROM events)"


def _log(spark, d):
    """Event log with some zero, repeated and backward times."""
    x = fixtures.node_events(spark, d)
    base = F.floor(F.col("ts") / 60) * 60 - F.when(F.col("idx") % 53 == 0, 600).otherwise(0)
    return x.select("idx", "id", F.when(F.col("idx") % 37 == 0, F.lit(0.0)).otherwise(base.cast("double")).alias("ts"))


@query(
    "w8_timestamp_checks",
    with_(_LOG, "l AS (SELECT *, lag(ts) OVER (ORDER BY idx) AS before, count(*) OVER (PARTITION BY ts) AS same FROM log)")
    + "SELECT count(*) AS events, count(*) FILTER (same > 1) AS duplicate_ts_events, count(*) FILTER (ts = 0) AS zero_ts_events, count(*) FILTER (ts < before) AS backward_steps, count(*) FILTER (ts < before) = 0 AS is_sorted FROM l",
)
def w8(spark, d):
    return diagnostics.timestamp_checks(_log(spark, d), "id", "id")


@query(
    "w8_batch_repeats",
    with_(_LOG) + "SELECT batch, count(*) AS distinct_nodes, count(*) FILTER (n > 1) AS repeated_nodes FROM (SELECT floor(idx / 200)::BIGINT AS batch, id, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1",
)
def w8b(spark, d):
    return diagnostics.batch_repeats(_log(spark, d), "id", 200)


@query(
    "a16_node_activity",
    with_(_LOG, "l AS (SELECT *, lag(ts) OVER (PARTITION BY id ORDER BY idx) AS before FROM log)") + "SELECT id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, coalesce(bool_or(ts < before), false) AS goes_back FROM l GROUP BY 1",
)
def a16(spark, d):
    return diagnostics.node_activity(_log(spark, d), "id")


@query(
    "w9_cumulative_distribution",
    with_(INV, _BA) + "SELECT company, s1 - s0 AS delta, round(row_number() OVER (ORDER BY s1 - s0, company) * 100.0::DOUBLE / count(*) OVER (), 6) AS cumulative_pct FROM ba",
)
def w9(spark, d):
    from biparta.operators.delta import cumulative_share

    rows = _before_after(spark, d).select("company", (F.col("s1") - F.col("s0")).alias("delta"))
    return cumulative_share(rows, "delta", "company").withColumn("cumulative_pct", F.round("cumulative_pct", 6))


@query("a15_split_metadata", with_(INV, EDGES, INTER, CUTS, LABELLED) + "SELECT split, count(*) AS rows, count(DISTINCT company) AS companies, count(DISTINCT investor) AS investors, min(ts) AS first_ts, max(ts) AS last_ts FROM labelled GROUP BY 1")
def a15(spark, d):
    return splits.split_metadata(splits.quantile_split(inputs.interactions(spark, d)))


@query("w_exact_quantiles", with_(INV, EDGES) + "SELECT round(quantile_cont(total_raised, 0.025), 4) AS q0, round(quantile_cont(total_raised, 0.5), 4) AS q1, round(quantile_cont(total_raised, 0.975), 4) AS q2 FROM edges")
def quantiles(spark, d):
    got = exact_quantiles(inputs.edges(spark, d), "total_raised", [0.025, 0.5, 0.975])
    return got.select(*[F.round(c, 4).alias(c) for c in got.columns])


@query(
    "w_average_ranks",
    with_(INV, EDGES, DEG) + "SELECT side, id, (rank() OVER w + (count(*) OVER (PARTITION BY side, degree) - 1) / 2.0)::DOUBLE AS avg_rank FROM deg WINDOW w AS (PARTITION BY side ORDER BY degree)",
)
def avg_ranks(spark, d):
    return average_ranks(graph.degrees(inputs.edges(spark, d)), "degree", "avg_rank", by=("side",)).select("side", "id", "avg_rank")


__all__ = ["ENDS", "INTERACTIONS"]
