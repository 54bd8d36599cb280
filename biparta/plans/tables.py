"""Queries of the scan, cleaning, filter, join, aggregate, order and set families."""

from __future__ import annotations

from pyspark.sql import functions as F

from biparta import fixtures
from biparta.functions import numeric, text, vectors
from biparta.operators import cleaning, graph, history, metrics, relational, splits
from biparta.operators.ordering import exact_quantiles, global_rank
from biparta.plans import inputs
from biparta.plans.registry import BASE, CATS, DEG, EDGES, INTER, INTERACTIONS, INV, LABELLED, CUTS, ORGS, SCORED, query, with_
from biparta.session import durable_path
from biparta.sources import readers, sinks

t = fixtures.table

# ---- scans, sources, sinks -------------------------------------------------


@query("s1_load_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def s1(spark, d):
    return readers.load_table(spark, "orders", d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("s2_load_csv", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def s2(spark, d):
    path = durable_path(spark, "csv")
    p = t(spark, d, "part")
    p.toDF(*[f" {c} " for c in p.columns]).write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    got = readers.load_csv(spark, path)
    return got.select(F.col("p_partkey").cast("bigint"), "p_name", "p_brand", "p_type", F.col("p_size").cast("bigint"), F.col("p_retailprice").cast("double"))


@query("s3_load_source", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def s3(spark, d):
    path = durable_path(spark, "orc")
    t(spark, d, "supplier").write.orc(f"{path}/supplier")
    return readers.load_source(spark, "supplier", "orc", path).select("s_suppkey", "s_name", F.col("s_nationkey").cast("bigint"), "s_acctbal")


@query(
    "s4_read_interactions",
    INTERACTIONS + "SELECT company AS u, investor AS i, ts, 1.0::DOUBLE AS label, idx, CAST(n_rounds AS DOUBLE) AS f1, CAST(company + investor AS DOUBLE) AS f2 FROM inter",
)
def s4(spark, d):
    path = durable_path(spark, "lines")
    x = inputs.interactions(spark, d)
    ts = F.col("ts").cast("bigint").cast("string")
    line = F.concat_ws(",", "company", "investor", ts, F.lit("1.0"), "n_rounds", (F.col("company") + F.col("investor")).cast("string"))
    x.repartitionByRange(4, "idx").sortWithinPartitions("idx").select(line.alias("item,customer,when,label,rounds,sum")).write.options(header=True, sep="\x01").csv(path)
    got = readers.read_interactions(spark, path)
    return got.select("u", "i", "ts", "label", "idx", F.col("feats")[0].alias("f1"), F.col("feats")[1].alias("f2"))


@query("s5_edge_dataset", INTERACTIONS + "SELECT company, investor, ts, idx, round(ln(1 + raised), 6) AS f1, n_rounds::DOUBLE AS f2 FROM inter")
def s5(spark, d):
    path = durable_path(spark, "dataset")
    x = inputs.interactions(spark, d).withColumn("feats", F.array(F.log1p("raised"), F.col("n_rounds").cast("double")))
    sinks.write_interactions(x, inputs.node_maps(spark, d), path)
    got, _ = readers.load_edge_dataset(spark, path)
    return got.select("company", "investor", "ts", "idx", F.round(F.col("feats")[0], 6).alias("f1"), F.col("feats")[1].alias("f2"))


@query(
    "s6_id_map",
    "SELECT 'company' AS side, p_partkey AS id, 'Part#' || p_partkey AS name FROM part UNION ALL SELECT 'investor', c_custkey, c_name FROM customer",
)
def s6(spark, d):
    path = durable_path(spark, "maps")
    maps = inputs.node_maps(spark, d)
    maps.filter("side = 'company'").select("id", "name").write.parquet(f"{path}/company_map")
    # the other side only as CSV, with the columns the other way round
    maps.filter("side = 'investor'").select(F.col("name").alias("Investor_Name"), F.col("id").alias("Investor_ID")).write.option("header", True).csv(f"{path}/investor_map.csv")
    return readers.load_id_map(spark, path, "company").unionByName(readers.load_id_map(spark, path, "investor"))


@query("s7_point_lookup", with_(ORGS) + "SELECT uuid, name, category_list FROM orgs WHERE uuid = 77")
def s7(spark, d):
    return relational.point_lookup(fixtures.organizations(spark, d), "uuid", 77).select("uuid", "name", "category_list")


@query(
    "s8_round_history",
    """SELECT o_custkey AS investor_uuid, o_orderkey AS uuid, strftime(o_orderdate, '%Y-%m-%d') AS announced_on, o_totalprice AS round_total
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def s8(spark, d):
    wanted = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("investor_uuid"))
    rows = relational.round_history(fixtures.funding_rounds(spark, d), wanted, "investor_uuid", ["investor_uuid", "announced_on", "uuid"])
    return rows.select("investor_uuid", "uuid", "announced_on", "round_total")


@query(
    "s9_read_results",
    "SELECT o_orderpriority AS run, round(avg(o_totalprice), 4) AS ap, count(*) AS n FROM orders GROUP BY 1",
)
def s9(spark, d):
    path = durable_path(spark, "results")
    rows = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("loss_function")).agg(F.round(F.avg("o_totalprice"), 4).alias("ap"), F.count(F.lit(1)).alias("n"))
    rows.withColumn("doc", F.col("loss_function")).write.partitionBy("doc").json(path)
    return readers.read_results(spark, path).select("run", "ap", "n")


@query(
    "s10_scan_metric_logs",
    """SELECT o_orderpriority AS run, round(avg(o_totalprice), 3) AS ap, count(*)::DOUBLE AS mrr, CAST(NULL AS DOUBLE) AS recall FROM orders GROUP BY 1""",
)
def s10(spark, d):
    path = durable_path(spark, "logs")
    rows = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.round(F.avg("o_totalprice"), 3).cast("decimal(20,3)").alias("ap"), F.count(F.lit(1)).alias("n"))
    lines = F.explode(F.array(F.lit("INFO start"), F.concat(F.lit("INFO test AP: "), F.col("ap").cast("string")), F.concat(F.lit("INFO test MRR = "), F.col("n").cast("string"))))
    rows.select("run", lines.alias("value")).write.partitionBy("run").text(path)
    return readers.scan_metric_logs(spark, path, {"ap": r"AP: ([0-9.]+)", "mrr": r"MRR = ([0-9]+)", "recall": r"Recall: ([0-9.]+)"}, r"run=([^/]+)/")


_GRAPH_ROWS = BASE + "SELECT company, investor, n_rounds, round(total_raised, 2) AS total_raised, first_ts FROM edges"


@query("s11_load_graph", _GRAPH_ROWS)
def s11(spark, d):
    path = durable_path(spark, "graph")
    sinks.write_graph(fixtures.company_nodes(spark, d), inputs.edges(spark, d), path)
    _, e = readers.load_graph(spark, path)
    return e.select("company", "investor", "n_rounds", F.round("total_raised", 2).alias("total_raised"), "first_ts")


@query("s12_interaction_sink", INTERACTIONS + "SELECT 'company' AS side, p_partkey AS id, 'Part#' || p_partkey AS name FROM part UNION ALL SELECT 'investor', c_custkey, c_name FROM customer")
def s12(spark, d):
    path = durable_path(spark, "interactions")
    sinks.write_interactions(inputs.interactions(spark, d), inputs.node_maps(spark, d), path)
    return readers.load_id_map(spark, path, "company").unionByName(readers.load_id_map(spark, path, "investor"))


@query(
    "s13_split_sink",
    with_(INV, EDGES, INTER, CUTS, LABELLED) + "SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM labelled GROUP BY 1",
)
def s13(spark, d):
    path = durable_path(spark, "splits")
    sinks.write_splits(splits.quantile_split(inputs.interactions(spark, d)), inputs.node_maps(spark, d), path)
    e = spark.read.parquet(f"{path}/edges")
    return e.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("s14_graph_csv_sink", _GRAPH_ROWS)
def s14(spark, d):
    path = durable_path(spark, "graph")
    sinks.write_graph(fixtures.company_nodes(spark, d), inputs.edges(spark, d), path)
    e = readers.load_csv(spark, f"{path}/edges_csv", ",")
    return e.select(
        F.col("company").cast("bigint"), F.col("investor").cast("bigint"), F.col("n_rounds").cast("bigint"), F.round(F.col("total_raised").cast("double"), 2).alias("total_raised"), F.col("first_ts").cast("double")
    )


@query(
    "s15_rank_sink",
    BASE + """SELECT side, id, rank, CAST(degree AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY degree DESC, id) AS rank FROM (
      SELECT 'company' AS side, company AS id, count(*) AS degree FROM edges GROUP BY 2 UNION ALL SELECT 'investor', investor, count(*) FROM edges GROUP BY 2))""",
)
def s15(spark, d):
    path = durable_path(spark, "ranks")
    deg = graph.degrees(inputs.edges(spark, d)).withColumn("score", F.col("degree").cast("double"))
    sinks.write_ranks(global_rank(deg, [F.col("score").desc(), F.col("id").asc()], "rank", by=("side",)), path)
    got = spark.read.option("header", True).csv(path)
    return got.select("side", F.col("id").cast("bigint"), F.col("rank").cast("bigint"), F.col("score").cast("double"))


@query(
    "s16_top_pairs_with_names",
    SCORED + """SELECT row_number() OVER (ORDER BY p DESC, company, investor) AS place, company, investor, 'Part#' || company AS company_name,
      coalesce(c_name, 'investor_' || investor) AS investor_name, p
    FROM (SELECT * FROM scores ORDER BY p DESC, company, investor LIMIT 100) LEFT JOIN customer ON c_custkey = investor""",
)
def s16(spark, d):
    o, i = fixtures.organizations(spark, d), fixtures.investors(spark, d)
    out = sinks.named_top_pairs(inputs.scores(spark, d), o.select(F.col("uuid").alias("id"), "name"), i.select(F.col("uuid").alias("id"), "name"), 100)
    return out.withColumn("place", F.col("place").cast("bigint"))


@query(
    "s17_error_table_sink",
    with_(INV, EDGES) + "SELECT investor, count(*) AS companies, round(sum(total_raised), 2) AS total FROM edges GROUP BY 1",
)
def s17(spark, d):
    path = durable_path(spark, "report")
    rows = inputs.edges(spark, d).groupBy("investor").agg(F.count(F.lit(1)).alias("companies"), F.round(F.sum("total_raised"), 2).alias("total"))
    sinks.write_csv(rows, path)
    return readers.load_csv(spark, path, ",").select(F.col("investor").cast("bigint"), F.col("companies").cast("bigint"), F.col("total").cast("double"))


@query("s18_summary_sink", "SELECT o_orderpriority AS run, round(avg(o_totalprice), 4) AS ap FROM orders GROUP BY 1")
def s18(spark, d):
    path, csv = durable_path(spark, "metrics"), durable_path(spark, "summary")
    rows = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.avg("o_totalprice").alias("ap"))
    sinks.write_json(rows, path)
    sinks.write_csv(spark.read.json(path).select("run", "ap"), csv, digits=4)
    return readers.load_csv(spark, csv, ",").select("run", F.col("ap").cast("double"))


# ---- projection and cleaning -----------------------------------------------


@query(
    "p1_clean",
    "SELECT l_orderkey AS round_id, l_partkey, l_returnflag AS flag FROM lineitem WHERE nullif(l_returnflag, 'N') IS NOT NULL",
)
def p1(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"), F.col("l_partkey").alias("copy"), "l_tax")
    return cleaning.clean(li, ["l_tax", "absent"], {"l_orderkey": "round_id", "l_returnflag": "flag", "gone": "x"}, {"l_partkey": "copy"}, ["flag", "absent"], "round_id")


@query("p2_drop_columns", "SELECT s_suppkey, s_name FROM supplier")
def p2(spark, d):
    return cleaning.drop_if_present(t(spark, d, "supplier"), ["s_nationkey", "s_acctbal", "not_there"])


@query("p3_rename", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def p3(spark, d):
    return cleaning.rename_present(t(spark, d, "nation"), {"n_nationkey": "id", "n_name": "name", "absent": "x"}).select("id", "name")


@query("p4_drop_equal_columns", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS holey FROM customer")
def p4(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_custkey").alias("copy"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END").alias("holey"))
    return cleaning.drop_equal_columns(cleaning.drop_equal_columns(c, {"c_custkey": "copy"}), {"c_custkey": "holey"})


@query("p5_drop_null_rows", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders WHERE o_orderstatus <> 'F'")
def p5(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("status"))
    return cleaning.drop_null_rows(o, ["status", "absent"])


@query("p6_require_columns", "SELECT p_partkey, p_name FROM part")
def p6(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name")
    cleaning.require_columns(p, ["p_partkey", "p_name"])
    return p


@query("p7_resolve_column", "SELECT p_partkey AS id, p_brand FROM part")
def p7(spark, d):
    p = t(spark, d, "part")
    return p.select(F.col(cleaning.resolve_column(p, ["organization_id", "uuid", "p_partkey", "p_name"])).alias("id"), "p_brand")


@query("p8_duplicate_columns", "SELECT s_suppkey, s_name FROM supplier")
def p8(spark, d):
    s = t(spark, d, "supplier")
    return cleaning.drop_duplicate_columns(s.select("s_suppkey", "s_name", F.upper("s_name").alias("s_name"), (F.col("s_suppkey") + 1).alias("s_suppkey")))


@query("p9_entity_presets", """SELECT o_orderkey AS funding_round_uuid, 'r' || o_orderkey AS name, o_orderpriority AS category_groups FROM orders WHERE o_orderstatus <> 'P'""")
def p9(spark, d):
    o = t(spark, d, "orders")
    name = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("r"), F.col("o_orderkey").cast("string")))
    raw = o.select(F.col("o_orderkey").alias("uuid"), name.alias("name"), F.col("o_orderpriority").alias("category_list"), F.lit("t").alias("type"), F.lit(1).alias("rank"), F.lit("u").alias("cb_url"))
    return cleaning.clean_funding_rounds(raw)


@query(
    "p10_merge_for_graph",
    """SELECT 'Part#' || l_partkey AS org_name, c_name AS investor_name, l_partkey AS org_uuid, o_custkey AS investor_uuid, l_extendedprice AS raised_amount_usd,
      strftime(o_orderdate, '%Y-%m-%d') AS announced_on FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey""",
)
def p10(spark, d):
    li = t(spark, d, "lineitem")
    rounds = li.select(
        F.col("l_orderkey").alias("funding_round_uuid"), F.col("l_partkey").alias("org_uuid"), F.concat(F.lit("Part#"), F.col("l_partkey").cast("string")).alias("org_name"), F.col("l_extendedprice").alias("raised_amount_usd"), "l_tax"
    )
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    inv = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("funding_round_uuid"), F.col("c_custkey").alias("investor_uuid"), F.col("c_name").alias("investor_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("announced_on")
    )
    return cleaning.merge_rounds(rounds, inv)


@query(
    "p11_node_keys",
    """SELECT company, 'COMPANY_' || coalesce(CASE WHEN company % 5 <> 0 THEN 'Part#' || company END, 'company_' || company) AS node_key,
      coalesce(CASE WHEN company % 5 <> 0 THEN 'Part#' || company END, 'company_' || company) AS display FROM (SELECT DISTINCT l_partkey AS company FROM lineitem)""",
)
def p11(spark, d):
    ids = t(spark, d, "lineitem").select(F.col("l_partkey").alias("company")).distinct()
    names = fixtures.organizations(spark, d).filter("uuid % 5 <> 0").select(F.col("uuid").alias("company"), "name")
    keyed = ids.join(names, "company", "left").withColumn("node_key", cleaning.node_key("company", F.col("name"), F.col("company")))
    return keyed.select("company", "node_key", cleaning.display_name(F.col("node_key")).alias("display"))


_MIXED = """mixed AS (SELECT CASE WHEN round_id % 3 = 0 THEN 'investor' ELSE 'company' END AS a_side, CASE WHEN round_id % 3 = 0 THEN investor ELSE company END AS a,
  CASE WHEN round_id % 7 = 0 THEN 'investor' WHEN round_id % 3 = 0 THEN 'company' ELSE 'investor' END AS b_side, CASE WHEN round_id % 3 = 0 THEN company ELSE investor END AS b, round_id FROM inv)"""


def _mixed(spark, d):
    turned = F.col("round_id") % 3 == 0
    return fixtures.investments(spark, d).select(
        F.when(turned, "investor").otherwise("company").alias("a_side"),
        F.when(turned, F.col("investor")).otherwise(F.col("company")).alias("a"),
        F.when(F.col("round_id") % 7 == 0, "investor").when(turned, "company").otherwise("investor").alias("b_side"),
        F.when(turned, F.col("company")).otherwise(F.col("investor")).alias("b"),
        "round_id",
    )


@query(
    "p12_orient_edges",
    with_(INV, _MIXED) + "SELECT CASE WHEN a_side = 'company' THEN a ELSE b END AS company, CASE WHEN a_side = 'company' THEN b ELSE a END AS investor, round_id FROM mixed WHERE a_side <> b_side",
)
def p12(spark, d):
    return graph.orient(_mixed(spark, d))


@query(
    "p13_dense_ids",
    with_(INV) + "SELECT company, first_ts, row_number() OVER (ORDER BY first_ts, company) - 1 AS dense_id FROM (SELECT company, min(ts) AS first_ts FROM inv GROUP BY 1)",
)
def p13(spark, d):
    return cleaning.dense_ids(fixtures.investments(spark, d), "company")


_DENSE = """du AS (SELECT company, row_number() OVER (ORDER BY company) - 1 AS u FROM (SELECT DISTINCT company FROM inv)),
  di AS (SELECT investor, row_number() OVER (ORDER BY investor) - 1 AS i FROM (SELECT DISTINCT investor FROM inv))"""


def _dense(spark, d):
    x = fixtures.investments(spark, d)
    u = global_rank(x.select("company").distinct(), [F.col("company").asc()], "u", start=0)
    i = global_rank(x.select("investor").distinct(), [F.col("investor").asc()], "i", start=0)
    return x.join(u, "company").join(i, "investor").select("u", "i", "ts", "round_id")


@query(
    "p14_bipartite_reindex",
    with_(INV, _DENSE) + "SELECT u + 1 AS u, i + (SELECT max(u) + 1 FROM du) + 1 AS i, ts, round_id FROM inv JOIN du USING (company) JOIN di USING (investor)",
)
def p14(spark, d):
    return cleaning.bipartite_reindex(_dense(spark, d))


@query(
    "p15_padding_row",
    with_(INV, EDGES, INTER) + "SELECT idx + 1 AS idx, round(ln(1 + raised), 6) AS f1, n_rounds::DOUBLE AS f2 FROM inter UNION ALL SELECT 0, 0.0, 0.0",
)
def p15(spark, d):
    x = inputs.interactions(spark, d).select("idx", F.array(F.log1p("raised"), F.col("n_rounds").cast("double")).alias("feats"))
    got = cleaning.with_padding_row(x, "idx", "feats", 2)
    return got.select("idx", F.round(F.col("feats")[0], 6).alias("f1"), F.col("feats")[1].alias("f2"))


# ---- filters ---------------------------------------------------------------

_ORG_COLS = ["uuid", "name", "category_list"]


@query(
    "f1_keyword_or_description",
    with_(ORGS) + "SELECT uuid, name, category_list FROM orgs WHERE lower(replace(category_list, ',', ' ')) LIKE '%brand#2%' OR lower(short_description) LIKE '%red%'",
)
def f1(spark, d):
    return relational.keyword_or_description(fixtures.organizations(spark, d), ["Brand#2", "RED"], "category_list", "short_description").select(*_ORG_COLS)


@query("f2_joined_keywords", with_(ORGS) + "SELECT uuid, name, category_list FROM orgs WHERE lower(replace(category_list, ',', ' ')) LIKE '%brand#1%' OR lower(replace(category_list, ',', ' ')) LIKE '%steel%'")
def f2(spark, d):
    return relational.joined_keyword_filter(fixtures.organizations(spark, d), ["brand#1", "Steel"], "category_list").select(*_ORG_COLS)


@query(
    "f2_matched_categories",
    with_(ORGS, CATS) + "SELECT category, count(*) AS rows FROM cats WHERE lower(category) LIKE '%brand#1%' OR lower(category) LIKE '%steel%' GROUP BY 1",
)
def f2b(spark, d):
    return relational.matched_categories(fixtures.organizations(spark, d), ["brand#1", "Steel"], "category_list")


@query("f3_case_sensitive_keywords", with_(ORGS, CATS) + "SELECT uuid, name, category_list FROM orgs WHERE uuid IN (SELECT company FROM cats WHERE contains(category, 'Brand#3') OR contains(category, 'brand#4'))")
def f3(spark, d):
    return relational.keyword_filter(fixtures.organizations(spark, d), ["Brand#3", "brand#4"], "category_list", case_sensitive=True).select(*_ORG_COLS)


_DATES = """dates AS (SELECT o_orderkey, o_orderdate::DATE AS day, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 2 THEN '' WHEN 3 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS announced FROM orders)"""


def _dates(spark, d):
    k = F.col("o_orderkey") % 5
    f = lambda p: F.date_format("o_orderdate", p)
    return t(spark, d, "orders").select(
        "o_orderkey", F.when(k == 0, f("dd.MM.yyyy")).when(k == 1, f("MM/dd/yyyy")).when(k == 2, "").when(k == 3, "unknown").otherwise(f("yyyy-MM-dd")).alias("announced")
    )


@query("f4_valid_dates", with_(_DATES) + "SELECT o_orderkey, announced, epoch(day)::DOUBLE AS ts FROM dates WHERE o_orderkey % 5 NOT IN (2, 3)")
def f4(spark, d):
    got = relational.valid_dates(_dates(spark, d), "announced")
    return got.select("o_orderkey", "announced", numeric.epoch_seconds(F.col("ts")).alias("ts"))


@query("f5_time_cutoff", BASE + "SELECT company, investor, first_ts FROM edges WHERE first_ts <= 900000000")
def f5(spark, d):
    return relational.up_to(inputs.edges(spark, d), "first_ts", F.lit(900000000.0)).select("company", "investor", "first_ts")


@query(
    "f6_after_horizon",
    with_(INV, EDGES, INTER, CUTS, LABELLED) + "SELECT company, investor, ts, idx FROM labelled WHERE ts > (SELECT max(ts) FROM labelled WHERE split = 'train')",
)
def f6(spark, d):
    x = splits.quantile_split(inputs.interactions(spark, d))
    return splits.after_horizon(x, x.filter("split = 'train'")).select("company", "investor", "ts", "idx").orderBy("ts", "idx")


@query("f7_positive_labels", SCORED + "SELECT company, investor, p FROM scores WHERE label > 0")
def f7(spark, d):
    return inputs.scores(spark, d).filter(F.col("label") > 0).select("company", "investor", "p")


@query("f8_probability_threshold", SCORED + "SELECT company, investor, p AS weight, 1::BIGINT AS n_rounds FROM scores WHERE p >= 0.45")
def f8(spark, d):
    return graph.scored_graph(inputs.scores(spark, d), 0.45)


@query("f9_score_and_exclusion", BASE + "SELECT company, n FROM (SELECT company, count(*) AS n FROM edges GROUP BY 1) WHERE n > 1e-6 AND company NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def f9(spark, d):
    n = inputs.edges(spark, d).groupBy("company").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1e-6)
    out = t(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("company"))
    return n.join(out, "company", "left_anti")


@query("f11_minimum_history", BASE + "SELECT investor, count(*) AS rows FROM inv GROUP BY 1 HAVING count(*) >= 40")
def f11(spark, d):
    return relational.with_history(fixtures.investments(spark, d), ["investor"], 40)


@query("f12_rejected_edges", with_(INV, _MIXED) + "SELECT a_side, a, b_side, b, round_id, 'same side' AS reason FROM mixed WHERE a_side = b_side")
def f12(spark, d):
    return graph.misaligned(_mixed(spark, d))


# ---- joins -----------------------------------------------------------------


@query("j1_rounds_join_investments", with_(INV) + "SELECT company, investor, ts, raised, round_id FROM inv")
def j1(spark, d):
    return fixtures.investments(spark, d)


@query(
    "j2_left_join_round_info",
    """SELECT l_orderkey, l_partkey, o_totalprice AS round_total FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON l_orderkey = o_orderkey""",
)
def j2(spark, d):
    info = fixtures.funding_rounds(spark, d).filter("status = 'O'").select(F.col("uuid").alias("l_orderkey"), "round_total")
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(info, "l_orderkey", "left")


@query(
    "j3_semi_joins",
    with_(INV, ORGS) + "SELECT company, investor, round_id FROM inv WHERE company IN (SELECT uuid FROM orgs WHERE contains(category_list, 'Brand#2')) AND investor IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
def j3(spark, d):
    orgs = relational.keyword_filter(fixtures.organizations(spark, d), ["Brand#2"], "category_list", case_sensitive=True).select(F.col("uuid").alias("company"))
    custs = t(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("investor"))
    return fixtures.investments(spark, d).select("company", "investor", "round_id").join(orgs, "company", "left_semi").join(custs, "investor", "left_semi")


@query("j4_lookup_with_default", with_(INV) + "SELECT company, round_id, CASE WHEN company % 4 <> 0 THEN 'Part#' || company ELSE 'company_' || company END AS name FROM inv")
def j4(spark, d):
    names = fixtures.organizations(spark, d).filter("uuid % 4 <> 0").select(F.col("uuid").alias("company"), "name")
    rows = fixtures.investments(spark, d).select("company", "round_id")
    return relational.lookup(rows, names, "company", "name", F.concat(F.lit("company_"), F.col("company").cast("string"))).select("company", "round_id", "name")


@query("j5_category_rounds", with_(INV, ORGS, CATS) + "SELECT DISTINCT round_id, category AS technology FROM inv JOIN cats USING (company)")
def j5(spark, d):
    companies = fixtures.organizations(spark, d).select(F.col("uuid").alias("id"), "category_list")
    return graph.round_technologies(fixtures.investments(spark, d).select("company", "round_id").distinct(), graph.technology_edges(companies))


_HALVES = """a AS (SELECT company, count(*) AS n_before FROM inv WHERE ts <= 935193600 AND company % 9 <> 0 GROUP BY 1), b AS (SELECT company, count(*) AS n_after FROM inv WHERE ts > 935193600 GROUP BY 1)"""


@query("j6_full_outer", with_(INV, _HALVES) + "SELECT coalesce(a.company, b.company) AS company, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after FROM a FULL JOIN b ON a.company = b.company")
def j6(spark, d):
    x = fixtures.investments(spark, d)
    a = x.filter("ts <= 935193600 AND company % 9 <> 0").groupBy("company").agg(F.count(F.lit(1)).alias("n_before"))
    b = x.filter("ts > 935193600").groupBy("company").agg(F.count(F.lit(1)).alias("n_after"))
    return a.join(b, "company", "full_outer").fillna(0)


@query("j7_inner_ranks", with_(INV, _HALVES) + "SELECT a.company, n_before, n_after FROM a JOIN b ON a.company = b.company")
def j7(spark, d):
    x = fixtures.investments(spark, d)
    a = x.filter("ts <= 935193600 AND company % 9 <> 0").groupBy("company").agg(F.count(F.lit(1)).alias("n_before"))
    b = x.filter("ts > 935193600").groupBy("company").agg(F.count(F.lit(1)).alias("n_after"))
    return a.join(b, "company")


@query(
    "j13_membership",
    SCORED + "SELECT s.company, s.investor, s.p, e.company IS NOT NULL AS is_true FROM scores s LEFT JOIN (SELECT company, investor FROM inter WHERE ts > 965088000) e ON s.company = e.company AND s.investor = e.investor",
)
def j13(spark, d):
    truth = inputs.interactions(spark, d).filter("ts > 965088000")
    return metrics.mark_true(inputs.scores(spark, d), truth).select("company", "investor", "p", "is_true")


# ---- aggregates ------------------------------------------------------------


@query("a1_edge_rollup", BASE + "SELECT company, investor, n_rounds, round(total_raised, 2) AS total_raised, first_ts, last_ts FROM edges")
def a1(spark, d):
    return inputs.edges(spark, d).withColumn("total_raised", F.round("total_raised", 2))


@query(
    "a1_edge_rounds",
    with_(INV) + "SELECT company, investor, 0 AS chunk, count(*) AS rounds, string_agg(ts::BIGINT || ':' || round_id, ';' ORDER BY ts, round_id) AS listed FROM inv GROUP BY 1, 2",
)
def a1b(spark, d):
    got = graph.edge_rounds(fixtures.investments(spark, d), ["ts", "round_id", "raised"])
    item = F.transform("rounds", lambda r: F.concat_ws(":", r["ts"].cast("bigint").cast("string"), r["round_id"].cast("string")))
    return got.select("company", "investor", "chunk", F.size("rounds").cast("bigint").alias("rounds"), F.array_join(item, ";").alias("listed"))


@query(
    "a2_last_row_edges",
    with_(INV) + "SELECT company, investor, ts, raised FROM (SELECT *, row_number() OVER (PARTITION BY company, investor ORDER BY ts DESC, round_id DESC, raised DESC) AS r FROM inv) WHERE r = 1",
)
def a2(spark, d):
    return graph.last_row_edges(fixtures.investments(spark, d), ["ts", "round_id", "raised"], ["ts", "raised"])


@query("a3_first_interaction", with_(INV) + "SELECT company, investor, min(ts) AS ts FROM inv GROUP BY 1, 2")
def a3(spark, d):
    return history.first_times(fixtures.investments(spark, d), ["company", "investor"])


@query("a4_group_count", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def a4(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "p_brand")


@query("a5_degrees", with_(INV, EDGES, DEG) + "SELECT side, id, degree FROM deg UNION ALL SELECT 'company', p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT company FROM edges) UNION ALL SELECT 'investor', c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT investor FROM edges)")
def a5(spark, d):
    return graph.degrees(inputs.edges(spark, d), fixtures.company_nodes(spark, d))


@query(
    "a6_weighted_degrees",
    BASE + "SELECT 'company' AS side, company AS id, sum(n_rounds)::BIGINT AS degree FROM edges GROUP BY 2 UNION ALL SELECT 'investor', investor, sum(n_rounds)::BIGINT FROM edges GROUP BY 2",
)
def a6(spark, d):
    return graph.degrees(inputs.edges(spark, d), weight="n_rounds")


@query(
    "a7_node_funding",
    BASE + "SELECT 'company' AS side, company AS id, round(sum(total_raised), 2) AS total_raised, sum(n_rounds)::BIGINT AS n_rounds FROM edges GROUP BY 2 UNION ALL SELECT 'investor', investor, round(sum(total_raised), 2), sum(n_rounds)::BIGINT FROM edges GROUP BY 2",
)
def a7(spark, d):
    return graph.node_funding(inputs.edges(spark, d)).withColumn("total_raised", F.round("total_raised", 2))


@query("a10_distinct_counts", with_(INV) + "SELECT count(DISTINCT company) AS companies, count(DISTINCT investor) AS investors, count(DISTINCT round_id) AS rounds FROM inv")
def a10(spark, d):
    return fixtures.investments(spark, d).agg(*[F.count_distinct(c).alias(n) for c, n in (("company", "companies"), ("investor", "investors"), ("round_id", "rounds"))])


@query(
    "a11_time_span",
    "SELECT epoch(min(o_orderdate))::DOUBLE AS first_ts, epoch(max(o_orderdate))::DOUBLE AS last_ts, datediff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days FROM orders",
)
def a11(spark, d):
    got = relational.time_span(t(spark, d, "orders"), "o_orderdate")
    return got.select(numeric.epoch_seconds(F.col("first_ts")).alias("first_ts"), numeric.epoch_seconds(F.col("last_ts")).alias("last_ts"), F.col("days").cast("bigint"))


@query("a14_weight_stats", SCORED + "SELECT count(*) AS edges, min(p) AS min_weight, max(p) AS max_weight, round(avg(p), 6) AS mean_weight, count(*) FILTER (p > 0) AS positive_weights FROM scores")
def a14(spark, d):
    from biparta.operators.diagnostics import weight_statistics

    return weight_statistics(inputs.scores(spark, d), "p").withColumn("mean_weight", F.round("mean_weight", 6))


@query("a19_adjacency", with_(INV) + "SELECT DISTINCT company, investor FROM inv")
def a19(spark, d):
    return relational.adjacency(fixtures.investments(spark, d))


# ---- order, limit, sets ----------------------------------------------------


@query("o1_sort", "SELECT p_partkey, p_retailprice FROM part")
def o1(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey")


@query("o2_head", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50")
def o2(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query("o3_top_scores", SCORED + "SELECT company, investor, p FROM scores ORDER BY p DESC, company, investor LIMIT 200")
def o3(spark, d):
    return metrics.top_pairs(inputs.scores(spark, d), 200).select("company", "investor", "p")


@query("o4_top_per_group", SCORED + "SELECT company, investor, p, place FROM (SELECT *, row_number() OVER (PARTITION BY investor ORDER BY p DESC, company) AS place FROM scores) WHERE place <= 3")
def o4(spark, d):
    got = relational.top_per_group(inputs.scores(spark, d), ["investor"], [F.col("p").desc(), F.col("company").asc()], 3)
    return got.select("company", "investor", "p", F.col("place").cast("bigint"))


@query("o5_top_degree_nodes", with_(INV, EDGES, DEG) + "SELECT side, id, degree FROM deg WHERE side = 'company' ORDER BY degree DESC, id LIMIT 15")
def o5(spark, d):
    return graph.top_nodes(inputs.edges(spark, d), "company", 15)


@query(
    "x1_union_history",
    with_(INV, EDGES, INTER, CUTS, LABELLED) + "SELECT company, investor, ts FROM labelled WHERE split <> 'test'",
)
def x1(spark, d):
    x = splits.quantile_split(inputs.interactions(spark, d)).select("company", "investor", "ts", "split")
    return x.filter("split = 'train'").unionByName(x.filter("split = 'val'")).drop("split")


@query("x2_distinct_links", with_(INV) + "SELECT DISTINCT company, investor FROM inv WHERE ts > 965088000")
def x2(spark, d):
    return fixtures.investments(spark, d).filter("ts > 965088000").select("company", "investor").distinct()


@query(
    "x3_new_nodes",
    with_(INV, EDGES, INTER) + """SELECT DISTINCT 'company' AS side, company AS id FROM inter WHERE company NOT IN (SELECT company FROM inter WHERE ts <= 820000000)
      UNION ALL SELECT DISTINCT 'investor', investor FROM inter WHERE investor NOT IN (SELECT investor FROM inter WHERE ts <= 820000000)""",
)
def x3(spark, d):
    x = inputs.interactions(spark, d)
    return splits.new_nodes(x, x.filter("ts <= 820000000"))


@query(
    "x4_top_overlap",
    with_(INV, EDGES, """f AS (SELECT company, count(*)::DOUBLE AS a, round(sum(total_raised), 2) AS b FROM edges GROUP BY 1),
      r AS (SELECT company, row_number() OVER (ORDER BY a DESC, company) AS ra, row_number() OVER (ORDER BY b DESC, company) AS rb FROM f)""")
    + "SELECT k, overlap, round(overlap * 100.0 / k, 4) AS overlap_pct FROM (SELECT k, (SELECT count(*) FROM r WHERE ra <= k AND rb <= k) AS overlap FROM (SELECT unnest([10, 20, 50, 100])::BIGINT AS k)) WHERE k <= (SELECT count(*) FROM f)",
)
def x4(spark, d):
    f = inputs.edges(spark, d).groupBy("company").agg(F.count(F.lit(1)).cast("double").alias("a"), F.round(F.sum("total_raised"), 2).alias("b"))
    return metrics.top_overlap(f, "a", "b", "company").withColumn("overlap_pct", F.round("overlap_pct", 4))


@query(
    "x5_jaccard",
    with_(ORGS, CATS, "n AS (SELECT company, count(*) AS n FROM cats GROUP BY 1)")
    + """, pairs AS (SELECT uuid AS a, uuid + 1 AS b FROM orgs WHERE uuid + 1 IN (SELECT uuid FROM orgs)),
    i AS (SELECT a, b, count(*) AS c FROM pairs JOIN cats x ON x.company = a JOIN cats y ON y.company = b AND x.category = y.category GROUP BY 1, 2)
    SELECT p.a, p.b, round(coalesce(i.c, 0)::DOUBLE / (na.n + nb.n - coalesce(i.c, 0)), 6) AS overlap FROM pairs p JOIN n na ON na.company = p.a JOIN n nb ON nb.company = p.b LEFT JOIN i ON i.a = p.a AND i.b = p.b""",
)
def x5(spark, d):
    c = inputs.categories(spark, d)
    nxt = c.select((F.col("company") - 1).alias("a"), F.col("company").alias("b"), F.col("categories").alias("cb"))
    both = c.select(F.col("company").alias("a"), F.col("categories").alias("ca")).join(nxt, "a")
    return both.select("a", "b", F.round(text.jaccard(F.col("ca"), F.col("cb")), 6).alias("overlap"))


@query(
    "x6_side_consistency",
    BASE + """SELECT dictionary_side, graph_side, count(*) AS n FROM (SELECT 'company' AS dictionary_side, p_partkey AS id FROM part UNION ALL SELECT 'investor', c_custkey FROM customer) d
      JOIN (SELECT DISTINCT 'company' AS graph_side, company AS id FROM edges UNION ALL SELECT DISTINCT 'investor', investor FROM edges) g ON d.id = g.id GROUP BY 1, 2""",
)
def x6(spark, d):
    from biparta.operators.diagnostics import side_consistency

    return side_consistency(graph.nodes_of(inputs.edges(spark, d)), inputs.node_maps(spark, d))


@query(
    "x7_nodes_per_split",
    with_(INV, EDGES, INTER, CUTS, LABELLED) + """SELECT split, side, id, name FROM (SELECT DISTINCT split, 'company' AS side, company AS id FROM labelled UNION ALL SELECT DISTINCT split, 'investor', investor FROM labelled)
      JOIN (SELECT 'company' AS side, p_partkey AS id, 'Part#' || p_partkey AS name FROM part UNION ALL SELECT 'investor', c_custkey, c_name FROM customer) USING (side, id)""",
)
def x7(spark, d):
    return splits.nodes_per_split(splits.quantile_split(inputs.interactions(spark, d)), inputs.node_maps(spark, d)).select("split", "side", "id", "name")


# ---- scalar functions ------------------------------------------------------


@query("c1_split_list", "SELECT p_partkey, string_agg(trim(c), '|' ORDER BY trim(c)) AS items, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(' ' || p_type || ' , ,' || p_name || ',', ',')) AS c FROM part) WHERE trim(c) <> '' GROUP BY 1")
def c1(spark, d):
    raw = F.concat(F.lit(" "), F.col("p_type"), F.lit(" , ,"), F.col("p_name"), F.lit(","))
    items = text.split_list(raw)
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(items), "|").alias("items"), F.size(items).cast("bigint").alias("n"))


@query("c2_safe_casts", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS as_long, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS as_double FROM customer")
def c2(spark, d):
    bad = F.col("c_custkey") % 3 == 0
    x = t(spark, d, "customer")
    return x.select(
        "c_custkey",
        numeric.safe_long(F.when(bad, "n/a").otherwise(F.col("c_custkey").cast("string"))).alias("as_long"),
        numeric.safe_double(F.when(bad, "").otherwise(F.col("c_acctbal").cast("string"))).alias("as_double"),
    )


@query("c3_date_formats", with_(_DATES) + "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (2, 3) THEN NULL ELSE epoch(day)::DOUBLE END AS ts FROM dates")
def c3(spark, d):
    return _dates(spark, d).select("o_orderkey", numeric.epoch_seconds(text.parse_date(F.col("announced"))).alias("ts"))


@query("c4_iso_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def c4(spark, d):
    return t(spark, d, "orders").select("o_orderkey", text.iso_date(F.col("o_orderdate")).alias("day"))


@query(
    "c5_epoch_and_days",
    "SELECT event_id, floor(epoch(ts))::BIGINT AS sec, strftime(make_timestamp((floor(epoch(ts)) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS back, floor((1735689600 - epoch(ts)) / 86400)::BIGINT AS days FROM events",
)
def c5(spark, d):
    s = numeric.epoch_seconds(F.col("ts"))
    back = F.date_format(numeric.from_epoch(F.floor(s)), "yyyy-MM-dd HH:mm:ss")
    return t(spark, d, "events").select("event_id", F.floor(s).cast("bigint").alias("sec"), back.alias("back"), numeric.whole_days(F.lit(1735689600.0), s).cast("bigint").alias("days"))


@query("c6_log1p", "SELECT o_orderkey, round(ln(1 + o_totalprice), 8) AS v FROM orders")
def c6(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.round(F.log1p("o_totalprice"), 8).alias("v"))


@query("c7_relative_delta", with_(INV, _HALVES) + "SELECT a.company, round((n_after::DOUBLE - n_before) / (n_before + 1e-8), 6) AS delta, round((n_after::DOUBLE - n_before) / (n_before + 1e-8) * 100, 4) AS pct FROM a JOIN b ON a.company = b.company")
def c7(spark, d):
    v = numeric.relative_delta(F.col("n_after").cast("double"), F.col("n_before"))
    return j7(spark, d).select("company", F.round(v, 6).alias("delta"), F.round(v * 100, 4).alias("pct"))


@query("c8_sigmoid_logit", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity, round(1 / (1 + exp(-l_discount * 10)), 8) AS s, round(ln(greatest(least(l_discount, 0.999), 0.001) / (1 - greatest(least(l_discount, 0.999), 0.001))), 8) AS g FROM lineitem")
def c8(spark, d):
    x = F.col("l_discount")
    return t(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_quantity", F.round(numeric.sigmoid(x * 10), 8).alias("s"), F.round(numeric.logit(numeric.clamp(x, 0.001, 0.999)), 8).alias("g")
    )


@query(
    "c9_softmax",
    "SELECT vec_id, label::BIGINT AS label, round(exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w, 8) AS weight FROM (SELECT *, max(s) OVER (PARTITION BY label) AS m FROM (SELECT vec_id, label, (embedding[1]::DOUBLE) / 0.1 AS s FROM embeddings)) WINDOW w AS (PARTITION BY label)",
)
def c9(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint"), (F.col("embedding")[0].cast("double") / 0.1).alias("s"))
    top = e.groupBy("label").agg(F.max("s").alias("m"))
    x = e.join(top, "label").withColumn("x", F.exp(F.col("s") - F.col("m")))
    z = x.groupBy("label").agg(F.sum("x").alias("z"))
    return x.join(z, "label").select("vec_id", "label", F.round(F.col("x") / F.col("z"), 8).alias("weight"))


@query(
    "c10_dot_product",
    "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def c10(spark, d):
    e = t(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@query("c11_time_encoding", "SELECT event_id, round(cos(value * pow(10, -0.0)), 6) AS e0, round(cos(value * pow(10, -3.0)), 6) AS e1, round(cos(value * pow(10, -6.0)), 6) AS e2, round(cos(value * pow(10, -9.0)), 6) AS e3 FROM events")
def c11(spark, d):
    enc = vectors.time_encoding(F.col("value"), 4)
    return t(spark, d, "events").select("event_id", *[F.round(enc[k], 6).alias(f"e{k}") for k in range(4)])


@query("c12_degree_weight", with_(INV, EDGES, DEG) + "SELECT side, id, round(pow(greatest(degree, 1), -0.5), 8) AS weight FROM deg")
def c12(spark, d):
    return graph.degrees(inputs.edges(spark, d)).select("side", "id", F.round(numeric.degree_weight(F.col("degree"), 0.5), 8).alias("weight"))


@query(
    "c13_labels",
    """SELECT l_orderkey, l_discount, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE 'ns' END AS stars,
      CASE WHEN x > 0.9 THEN 'Very strong positive correlation (rankings are very similar)' WHEN x > 0.7 THEN 'Strong positive correlation (rankings are similar)'
      WHEN x > 0.5 THEN 'Moderate positive correlation (some similarity in rankings)' WHEN x > 0.3 THEN 'Weak positive correlation (rankings differ significantly)'
      WHEN x > -0.3 THEN 'No correlation (rankings are independent)' ELSE 'Negative correlation (rankings are inverted)' END AS label
    FROM (SELECT *, 1 - l_quantity / 25 AS x FROM lineitem)""",
)
def c13(spark, d):
    x = 1 - F.col("l_quantity") / 25
    return t(spark, d, "lineitem").select("l_orderkey", "l_discount", numeric.significance_stars(F.col("l_discount")).alias("stars"), numeric.correlation_label(x).alias("label"))


__all__ = ["exact_quantiles"]
