"""Queries of splits, histories, temporal neighbours and negative sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from biparta import fixtures
from biparta.functions.vectors import time_encoding
from biparta.operators import features, graph, history, negatives, neighbors, relational, splits
from biparta.plans import inputs
from biparta.plans.registry import CUTS, EDGES, INTER, INTERACTIONS, INV, LABELLED, NEGS, POOL, SCORED, query, sql_draw, sql_gumbel, with_
from biparta.session import materialize

t = fixtures.table

# ---- splits ----------------------------------------------------------------

_SPLIT = with_(INV, EDGES, INTER, CUTS, LABELLED)


@query("t1_quantile_split", _SPLIT + "SELECT idx, company, investor, ts, split FROM labelled")
def t1(spark, d):
    return splits.quantile_split(inputs.interactions(spark, d)).select("idx", "company", "investor", "ts", "split")


@query(
    "t2_position_split",
    with_(INV, EDGES, "o AS (SELECT first_ts, row_number() OVER (ORDER BY first_ts) - 1 AS r, count(*) OVER () AS n FROM edges)",
    f"c AS (SELECT max(first_ts) FILTER (r = greatest(floor(n * 0.7::DOUBLE) - 1, 0)) AS a, max(first_ts) FILTER (r = floor(n * {0.7 + 0.15!r}::DOUBLE) - 1) AS b FROM o)")
    + "SELECT company, investor, CASE WHEN first_ts <= a THEN 'train' WHEN first_ts <= b THEN 'val' ELSE 'test' END AS split FROM edges, c",
)
def t2(spark, d):
    return splits.position_split(inputs.edges(spark, d), 0.7, 0.15).select("company", "investor", "split")


_PARTS = """test AS (SELECT * FROM labelled WHERE split = 'test'),
  placed AS (SELECT *, row_number() OVER (ORDER BY ts, idx) - 1 AS r, count(*) OVER () AS n FROM test),
  parts AS (SELECT *, CASE WHEN r < floor(n * 0.5::DOUBLE) THEN 'history' ELSE 'future' END AS part FROM placed)"""


def _parts(spark, d):
    labelled = splits.quantile_split(inputs.interactions(spark, d))
    return labelled, splits.history_future(labelled.filter("split = 'test'"), 0.5)


@query("t3_history_future", with_(INV, EDGES, INTER, CUTS, LABELLED, _PARTS) + "SELECT idx, company, investor, part, (SELECT min(ts) FROM parts WHERE part = 'future') AS split_ts FROM parts")
def t3(spark, d):
    return _parts(spark, d)[1].select("idx", "company", "investor", "part", "split_ts")


_HELD = f"""alln AS (SELECT DISTINCT 'company' AS side, company AS id FROM inter UNION ALL SELECT DISTINCT 'investor', investor FROM inter),
  late AS (SELECT DISTINCT 'company' AS side, company AS id FROM labelled WHERE split <> 'train' UNION ALL SELECT DISTINCT 'investor', investor FROM labelled WHERE split <> 'train'),
  drawn AS (SELECT side, id, row_number() OVER (ORDER BY {sql_draw(2020, 'side', 'id')}, side, id) - 1 AS r FROM late),
  cnt AS (SELECT floor(count(*) * 0.1::DOUBLE) AS n FROM alln),
  held AS (SELECT side, id, CASE WHEN r < floor(least(n, (SELECT count(*) FROM late)) / 2) THEN 'val' ELSE 'test' END AS half FROM drawn, cnt WHERE r < n)"""
_FLAGS = """flags AS (SELECT l.* EXCLUDE (split), hc.half AS ch, hv.half AS vh, CASE WHEN split = 'train' AND (hc.half IS NOT NULL OR hv.half IS NOT NULL) THEN 'dropped' ELSE split END AS split FROM labelled l
  LEFT JOIN held hc ON hc.side = 'company' AND hc.id = company LEFT JOIN held hv ON hv.side = 'investor' AND hv.id = investor)"""


@query(
    "t4_inductive_split",
    with_(INV, EDGES, INTER, CUTS, LABELLED, _HELD, _FLAGS)
    + """SELECT idx, split, split IN ('val', 'test') AND (company NOT IN (SELECT company FROM flags WHERE split = 'train') OR investor NOT IN (SELECT investor FROM flags WHERE split = 'train')) AS has_new_node FROM flags""",
)
def t4(spark, d):
    return splits.inductive_split(inputs.interactions(spark, d)).select("idx", "split", "has_new_node")


@query(
    "t5_separate_new_nodes",
    with_(INV, EDGES, INTER, CUTS, LABELLED, _HELD, _FLAGS) + "SELECT idx, split, coalesce(split IN ('val', 'test') AND (ch = split OR vh = split), false) AS has_new_node FROM flags",
)
def t5(spark, d):
    return splits.inductive_split(inputs.interactions(spark, d), separate=True).select("idx", "split", "has_new_node")


@query("t6_classification_split", _SPLIT + "SELECT idx, CASE WHEN split = 'val' THEN 'train' ELSE split END AS split FROM labelled")
def t6(spark, d):
    return splits.classification_split(inputs.interactions(spark, d), use_validation=False).select("idx", "split")


@query("t7_leak_free_history", with_(INV, EDGES, INTER, CUTS, LABELLED, _PARTS) + "SELECT idx, company, investor, ts FROM labelled WHERE split <> 'test' UNION ALL SELECT idx, company, investor, ts FROM parts WHERE part = 'history'")
def t7(spark, d):
    return splits.leak_free_history(*_parts(spark, d)).select("idx", "company", "investor", "ts")


@query("x2_future_links", with_(INV, EDGES, INTER, CUTS, LABELLED, _PARTS) + "SELECT DISTINCT company, investor FROM parts WHERE part = 'future'")
def future(spark, d):
    return splits.future_links(_parts(spark, d)[1])


# ---- temporal neighbours ---------------------------------------------------

ADJ = """adj AS (SELECT 'company' AS side, company AS id, investor AS other, ts, idx, raised, n_rounds FROM inter
  UNION ALL SELECT 'investor', investor, company, ts, idx, raised, n_rounds FROM inter)"""
PAST = """past AS (SELECT q.side, q.id, q.ts, q.idx, e.other AS neighbor, e.ts AS neighbor_ts, e.raised, e.n_rounds,
  row_number() OVER (PARTITION BY q.side, q.id, q.idx ORDER BY e.ts DESC, e.idx DESC) - 1 AS slot, count(*) OVER (PARTITION BY q.side, q.id, q.idx) AS n
  FROM adj q JOIN adj e ON e.side = q.side AND e.id = q.id AND e.ts < q.ts)"""
_NEAR = with_(INV, EDGES, INTER, ADJ, PAST)


def _adjacency(spark, d):
    return neighbors.temporal_adjacency(inputs.interactions(spark, d), "raised", "n_rounds")


def _recent_lists(spark, d, k=10, without_history=False):
    adj = _adjacency(spark, d)
    return neighbors.NeighborIndex(adj).recent_lists(adj.select("side", "id", "ts", "idx"), k, without_history=without_history)


@query("t8_temporal_adjacency", with_(INV, EDGES, INTER, ADJ) + "SELECT side, id, other, ts, idx FROM adj")
def t8(spark, d):
    return _adjacency(spark, d).select("side", "id", "other", "ts", "idx")


@query("w6_recent_neighbors", _NEAR + "SELECT side, id, idx, slot, neighbor, neighbor_ts FROM past WHERE slot < 10")
def w6(spark, d):
    adj = _adjacency(spark, d)
    got = neighbors.NeighborIndex(adj).recent(adj.select("side", "id", "ts", "idx"), 10)
    return got.select("side", "id", "idx", F.col("slot").cast("bigint"), "neighbor", "neighbor_ts")


@query(
    "w7_uniform_neighbors",
    _NEAR + f"""SELECT a.side, a.id, a.idx, k.slot, p.neighbor, p.neighbor_ts FROM (SELECT DISTINCT side, id, idx, ts, n FROM past) a, (SELECT unnest(range(0, 10)) AS slot) k, past p
    WHERE p.side = a.side AND p.id = a.id AND p.idx = a.idx AND p.slot = {sql_draw(3, 'a.side', 'a.id', 'CAST(a.ts AS BIGINT)', 'k.slot')} % a.n""",
)
def w7(spark, d):
    adj = _adjacency(spark, d)
    got = neighbors.NeighborIndex(adj).uniform(adj.select("side", "id", "ts", "idx"), 10, seed=3)
    return got.select("side", "id", "idx", F.col("slot").cast("bigint"), "neighbor", "neighbor_ts")


@query(
    "t9_two_hop_neighbors",
    with_(
        INV, EDGES, INTER, ADJ,
        "q AS (SELECT DISTINCT side, id, ts FROM adj)",
        """h1 AS (SELECT q.side AS root_side, q.id AS root, q.ts, e.other AS neighbor, row_number() OVER (PARTITION BY q.side, q.id, q.ts ORDER BY e.ts DESC, e.idx DESC) - 1 AS slot
          FROM q JOIN adj e ON e.side = q.side AND e.id = q.id AND e.ts < q.ts QUALIFY slot < 10)""",
        """h2 AS (SELECT h.root_side, h.root, h.ts, h.slot AS s1, e.other AS neighbor, row_number() OVER (PARTITION BY h.root_side, h.root, h.ts, h.slot ORDER BY e.ts DESC, e.idx DESC) - 1 AS s2
          FROM h1 h JOIN adj e ON e.side <> h.root_side AND e.id = h.neighbor AND e.ts < h.ts QUALIFY s2 < 10)""",
    )
    + """SELECT root_side, root, ts, 1::BIGINT AS hop, count(*) AS n, sum(neighbor)::BIGINT AS total FROM h1 GROUP BY 1, 2, 3
    UNION ALL SELECT root_side, root, ts, 2, count(*), sum(neighbor)::BIGINT FROM h2 GROUP BY 1, 2, 3""",
)
def t9(spark, d):
    adj = _adjacency(spark, d)
    got = neighbors.NeighborIndex(adj).hops(adj.select("side", "id", "ts").distinct(), 10, 2)
    return got.groupBy("root_side", "root", "ts", F.col("hop").cast("bigint").alias("hop")).agg(F.count(F.lit(1)).alias("n"), F.sum("neighbor").alias("total"))


@query(
    "t10_sum_pooling",
    _NEAR
    + """SELECT side, id, idx, round(greatest(sum(ln(1 + raised)), 0), 6) AS v0, greatest(sum(n_rounds), 0)::DOUBLE AS v1, round(greatest(sum(cos((ts - neighbor_ts) * pow(10, -0.0))), 0), 5) AS v2,
    round(greatest(sum(cos((ts - neighbor_ts) * pow(10, -9.0))), 0), 5) AS v3 FROM past WHERE slot < 10 GROUP BY 1, 2, 3""",
)
def t10(spark, d):
    near = _recent_lists(spark, d)
    vectors = F.transform("near", lambda x: F.concat(F.array(F.log1p(x.raised), x.n_rounds.cast("double")), time_encoding(F.col("ts") - x.neighbor_ts, 2)))
    got = near.withColumn("pooled", neighbors.summed(vectors, 4))
    v = F.col("pooled")
    return got.select("side", "id", "idx", F.round(v[0], 6).alias("v0"), v[1].alias("v1"), F.round(v[2], 5).alias("v2"), F.round(v[3], 5).alias("v3"))


@query(
    "t11_attention_pooling",
    _NEAR
    + """, l AS (SELECT *, (ln(1 + raised) / 10 * 0.5 + (ts - neighbor_ts) / 1e9 * 1.5) / sqrt(2.0) AS lg FROM past WHERE slot < 10),
    e AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY side, id, idx)) AS x FROM l),
    p AS (SELECT side, id, idx, sum(x * ln(1 + raised)) / sum(x) AS v0, sum(x * n_rounds) / sum(x) AS v1 FROM e GROUP BY 1, 2, 3)
    SELECT a.side, a.id, a.idx, round(coalesce(v0, 0.0), 6) AS v0, round(coalesce(v1, 0.0), 6) AS v1 FROM adj a LEFT JOIN p ON p.side = a.side AND p.id = a.id AND p.idx = a.idx""",
)
def t11(spark, d):
    near = _recent_lists(spark, d, without_history=True)
    keys = F.transform("near", lambda x: F.array(F.log1p(x.raised) / 10, (F.col("ts") - x.neighbor_ts) / 1e9))
    values = F.transform("near", lambda x: F.array(F.log1p(x.raised), x.n_rounds.cast("double")))
    got = neighbors.attended(near, F.array(F.lit(0.5), F.lit(1.5)), keys, values, 2)
    return got.select("side", "id", "idx", F.round(F.col("pooled")[0], 6).alias("v0"), F.round(F.col("pooled")[1], 6).alias("v1"))


@query(
    "t12_message_aggregation",
    with_(INV, EDGES, INTER, ADJ)
    + """SELECT side, id, round(arg_max(ln(1 + raised), ROW(ts, idx)), 6) AS last0, arg_max(n_rounds, ROW(ts, idx))::DOUBLE AS last1, round(avg(ln(1 + raised)), 6) AS mean0, round(avg(n_rounds), 6) AS mean1, max(ts) AS last_ts
    FROM adj GROUP BY 1, 2""",
)
def t12(spark, d):
    m = _adjacency(spark, d).withColumn("vec", F.array(F.log1p("raised"), F.col("n_rounds").cast("double")))
    last = neighbors.aggregate_messages(m, ["side", "id"], "vec", 2, "last")
    mean = neighbors.aggregate_messages(m, ["side", "id"], "vec", 2, "mean").withColumnRenamed("message", "mean").drop("last_ts")
    j = last.join(mean, ["side", "id"])
    return j.select("side", "id", F.round(F.col("message")[0], 6).alias("last0"), F.col("message")[1].alias("last1"), F.round(F.col("mean")[0], 6).alias("mean0"), F.round(F.col("mean")[1], 6).alias("mean1"), "last_ts")


_GAP = """gap AS (SELECT company, ts, ts - coalesce(lag(ts) OVER (PARTITION BY company ORDER BY ts), 0) AS gap, c FROM (SELECT company, ts, count(*) AS c FROM inter GROUP BY 1, 2))"""


@query(
    "t13_raw_messages",
    with_(INV, EDGES, INTER, _GAP, "dg AS (SELECT idx, count(*) OVER (PARTITION BY company ORDER BY ts RANGE UNBOUNDED PRECEDING) AS cd, count(*) OVER (PARTITION BY investor ORDER BY ts RANGE UNBOUNDED PRECEDING) AS vd FROM inter)")
    + """SELECT i.idx, 6::BIGINT AS width, cd::DOUBLE AS m0, vd::DOUBLE AS m1, round(ln(1 + raised), 6) AS m2, n_rounds::DOUBLE AS m3, round(cos(gap * pow(10, -0.0)), 5) AS m4, round(cos(gap * pow(10, -9.0)), 5) AS m5
    FROM inter i JOIN dg USING (idx) JOIN gap ON gap.company = i.company AND gap.ts = i.ts""",
)
def t13(spark, d):
    x = inputs.interactions(spark, d)
    rows = features.degree_features(x, x).join(history.gaps(x, "company").drop("repeats"), ["company", "ts"])
    one = lambda c: F.array(F.col(c).cast("double"))
    rows = rows.select("idx", one("company_degree").alias("s"), one("investor_degree").alias("v"), F.array(F.log1p("raised"), F.col("n_rounds").cast("double")).alias("f"), "gap")
    m = neighbors.raw_messages(rows, "s", "v", "f", "gap", 2)
    digits = {2: 6, 4: 5, 5: 5}
    return m.select("idx", F.size("message").cast("bigint").alias("width"), *[F.round(F.col("message")[k], digits.get(k, 6)).alias(f"m{k}") for k in range(6)])


@query(
    "t14_decayed_state",
    with_(INV, EDGES, INTER, _GAP, "st AS (SELECT sum(gap) / sum(c) AS mu, sqrt(sum(gap * gap) / sum(c) - pow(sum(gap) / sum(c), 2)) AS sd FROM gap)")
    + "SELECT i.idx, round(n_rounds * (1 + 0.5 * (gap - mu) / sd), 5) AS s0 FROM inter i JOIN gap ON gap.company = i.company AND gap.ts = i.ts, st",
)
def t14(spark, d):
    x = materialize(inputs.interactions(spark, d).select("idx", "company", "ts", "n_rounds"), "interactions")
    gaps = materialize(history.gaps(x, "company"), "gaps")
    # one row
    st = F.broadcast(history.statistics_of_gaps(gaps).select(F.col("mean_gap").alias("mu"), F.col("std_gap").alias("sd")))
    rows = x.join(gaps.drop("repeats"), ["company", "ts"]).join(st)
    state = neighbors.decayed_state(F.array(F.col("n_rounds").cast("double")), F.col("gap"), F.col("mu"), F.col("sd"), 0.5)
    return rows.select("idx", F.round(state[0], 5).alias("s0"))


@query(
    "t15_state_at_time",
    "SELECT event_id AS idx, user_id AS id, lag(value) OVER w AS state, lag(event_id) OVER w IS NOT NULL AS has_state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
)
def t15(spark, d):
    x = fixtures.node_events(spark, d).select("idx", F.lit("user").alias("side"), "id", "ts", F.col("value").alias("state"))
    got = neighbors.state_at(x.drop("state"), x, "state")
    return got.select("idx", "id", "state", F.col("state_ts").isNotNull().alias("has_state"))


# ---- histories and point-in-time features ----------------------------------


def _side_sql(side: str, other: str, op: str, idle: int) -> str:
    return (
        with_(INV)
        + f""", q AS (SELECT DISTINCT {side}, ts FROM inv)
    SELECT q.{side}, q.ts, round(coalesce(sum(e.raised), 0), 2) AS total, count(e.raised) AS events, count(DISTINCT e.{other}) AS partners,
    round(ln(1 + coalesce(sum(e.raised) / count(e.raised), 0)), 6) AS log_mean, coalesce(floor((q.ts - max(e.ts)) / 86400)::BIGINT, {idle}) AS idle_days
    FROM q LEFT JOIN inv e ON e.{side} = q.{side} AND e.ts {op} q.ts GROUP BY 1, 2"""
    )


def _side(spark, d, side, inclusive):
    x = fixtures.investments(spark, d)
    got = features.side_features(x, x, side, inclusive)
    return got.select(
        side, "ts", F.round(f"{side}_total", 2).alias("total"), F.col(f"{side}_events").alias("events"), F.col(f"{side}_partners").alias("partners"), F.round(F.log1p(f"{side}_mean"), 6).alias("log_mean"), F.col(f"{side}_idle_days").alias("idle_days")
    )


@query("a8_company_features", _side_sql("company", "investor", "<", 1825))
def a8(spark, d):
    return _side(spark, d, "company", False)


@query("a9_investor_features", _side_sql("investor", "company", "<=", 730))
def a9(spark, d):
    return _side(spark, d, "investor", True)


@query(
    "j10_point_in_time",
    "SELECT e.event_id AS idx, e.user_id AS id, coalesce(count(*) OVER w, 0) AS n_before, round(coalesce(sum(value) OVER w, 0), 4) AS total_before FROM events e WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def j10(spark, d):
    x = fixtures.node_events(spark, d).select("idx", "id", "ts", "value")
    seen = history.as_of(x, x, ["id"], sums={"n_before": F.lit(1), "total_before": F.col("value")})
    return x.join(seen, ["id", "ts"]).select("idx", "id", "n_before", F.round("total_before", 4).alias("total_before"))


@query("j9_never_funded", SCORED + "SELECT s.company, s.investor FROM scores s LEFT JOIN inter i ON i.company = s.company AND i.investor = s.investor AND i.ts <= 935193600 WHERE i.company IS NULL")
def j9(spark, d):
    asked = inputs.scores(spark, d).select("company", "investor").withColumn("ts", F.lit(935193600.0))
    return negatives.funded_before(asked, fixtures.investments(spark, d)).select("company", "investor")


_COIN = """known AS (SELECT DISTINCT company, investor FROM inv WHERE ts < 935193600),
  coin AS (SELECT DISTINCT a.investor AS v, b.investor AS w FROM known a JOIN known b ON a.company = b.company AND a.investor <> b.investor)"""


@query(
    "j11_common_coinvestors",
    with_(INV, EDGES, _COIN) + "SELECT e.company, e.investor, count(c.w) AS common_coinvestors FROM edges e LEFT JOIN known k ON k.company = e.company LEFT JOIN coin c ON c.v = e.investor AND c.w = k.investor GROUP BY 1, 2",
)
def j11(spark, d):
    x = fixtures.investments(spark, d)
    return features.common_coinvestors(inputs.edges(spark, d).select("company", "investor"), x, 935193600.0, inclusive=False)


@query("j11_coinvestors_of", with_(INV) + "SELECT investor, count(DISTINCT company) AS shared FROM inv WHERE company IN (SELECT company FROM inv WHERE investor = 100) AND investor <> 100 GROUP BY 1")
def j11b(spark, d):
    return relational.coinvestors_of(fixtures.investments(spark, d), 100)


@query(
    "m3_pair_history",
    with_(INV) + """, q AS (SELECT DISTINCT company, investor, ts FROM inv) SELECT q.company, q.investor, q.ts, round(ln(1 + sum(e.raised)), 6) AS log_pair_total, count(*) AS pair_rounds
    FROM q JOIN inv e ON e.company = q.company AND e.investor = q.investor AND e.ts <= q.ts GROUP BY 1, 2, 3""",
)
def m3(spark, d):
    x = fixtures.investments(spark, d)
    got = features.pair_history(x.select("company", "investor", "ts").distinct(), x)
    return got.select("company", "investor", "ts", F.round("log_pair_total", 6).alias("log_pair_total"), "pair_rounds")


# ---- negatives -------------------------------------------------------------


@query("n1_random_negatives", with_(INV, EDGES, INTER, POOL, NEGS) + "SELECT idx, company, investor, slot, negative FROM negs")
def n1(spark, d):
    return inputs.negatives(inputs.interactions(spark, d)).select("idx", "company", "investor", F.col("slot").cast("bigint"), "negative")


@query(
    "n2_negatives_per_positive",
    with_(INV, EDGES, INTER, POOL, f"draws AS MATERIALIZED (SELECT i.idx, {sql_draw(12, 'i.idx', 's.slot')} % c.n AS place FROM inter i, (SELECT unnest(range(0, 100)) AS slot) s, (SELECT count(*) AS n FROM pool) c)")
    + "SELECT idx, count(*) AS n, sum(negative)::BIGINT AS total, count(DISTINCT negative) AS distinct_n FROM draws JOIN pool USING (place) GROUP BY 1",
)
def n2(spark, d):
    x = inputs.interactions(spark, d)
    return negatives.draw_totals(x.select("idx"), negatives.destinations(x, "investor"), "investor", 100, 12)


def _prime(n: str) -> str:
    return f"(SELECT min(p) FROM (SELECT unnest(range({n}, {n} + 300)) AS p) WHERE NOT EXISTS (SELECT 1 FROM range(2, 2000) r(k) WHERE k * k <= p AND p % k = 0))"


def _plausible(seed: int, asked: str = "inter") -> str:
    """SQL of the candidates of each asked interaction in walk order; knows the first 80 steps."""
    return with_(
        INV, EDGES, INTER,
        "cpool AS (SELECT company AS negative, row_number() OVER (ORDER BY company) - 1 AS place FROM (SELECT DISTINCT company FROM inter))",
        f"pr AS (SELECT {_prime('(SELECT count(*) FROM cpool)')} AS p)",
        f"asked AS (SELECT * FROM {asked})",
        f"walk AS (SELECT idx, company AS positive, investor, ts, p, {sql_draw(seed, 'idx', chr(39) + 'step' + chr(39))} % (p - 1) + 1 AS step, {sql_draw(seed, 'idx', chr(39) + 'offset' + chr(39))} % p AS off FROM asked, pr)",
        "turns AS MATERIALIZED (SELECT w.*, turn, (w.step * turn + w.off) % w.p AS place FROM walk w, (SELECT unnest(range(0, 80)) AS turn) k)",
        """tries AS (SELECT w.idx, w.investor, w.positive, w.ts, c.negative, turn FROM turns w JOIN cpool c ON c.place = w.place
          WHERE c.negative <> w.positive AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.company = c.negative AND e.investor = w.investor AND e.first_ts <= w.ts))""",
        "slots AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY turn) - 1 AS slot FROM tries)",
    )


@query("n3_plausible_negatives", _plausible(4) + "SELECT idx, investor, positive, negative, slot FROM slots WHERE slot < 2")
def n3(spark, d):
    x = inputs.interactions(spark, d)
    return negatives.plausible_negatives(x, x, 2, seed=4).select("idx", "investor", "positive", "negative", "slot")


# Days of history before the first labelled interaction.
_HISTORY = 1825


@query(
    "m5_timed_groups",
    _plausible(14, f"inter WHERE ts >= (SELECT min(ts) FROM inter) + {_HISTORY} * 86400")
    + """SELECT idx, company, investor, ts, 1 AS label FROM asked
    UNION ALL SELECT idx, negative, investor, ts, 0 FROM slots WHERE slot < 4""",
)
def m5_timed(spark, d):
    """Later interactions, each with four companies that its investor had not funded by then."""
    x = inputs.interactions(spark, d)
    later = x.filter(F.col("ts") >= x.agg(F.min("ts")).scalar() + _HISTORY * 86400)
    return features.timed_groups(later, negatives.plausible_negatives(later, x, 4, seed=14))


_ALL_FREE = """ev AS (SELECT event_id AS idx, user_id, event_id % (SELECT count(*) FROM embeddings) AS positive FROM events),
  known AS (SELECT DISTINCT user_id, positive AS negative FROM ev),
  sims AS MATERIALIZED (SELECT a.vec_id AS positive, b.vec_id AS negative, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
    FROM embeddings a, embeddings b WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
  scored AS MATERIALIZED (SELECT e.idx, s.positive, s.negative, s.sim FROM ev e JOIN sims s USING (positive)
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.user_id = e.user_id AND k.negative = s.negative))"""


def _hard_sql(pool: str, seed: int) -> str:
    return with_(
        _ALL_FREE,
        f"base AS ({pool})",
        f"hard AS (SELECT idx, negative, sim, row_number() OVER (PARTITION BY idx ORDER BY round(sim / 0.1 + {sql_gumbel(seed, 'idx', 'negative')}, 9) DESC, negative) - 1 AS slot FROM base QUALIFY slot < 2)",
        "listed AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY negative) - 1 AS place, count(*) OVER (PARTITION BY idx) AS size FROM scored)",
    ) + f"""SELECT idx, 'hard' AS kind, slot, negative, round(sim, 5) AS similarity FROM hard
    UNION ALL SELECT l.idx, 'random', s.slot, l.negative, round(l.sim, 5) FROM listed l, (SELECT unnest(range(2, 4)) AS slot) s WHERE l.place = {sql_draw(seed, 'l.idx', 's.slot', chr(39) + 'r' + chr(39))} % l.size"""


def _hard(spark, d, top_k, seed):
    emb = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    n = emb.agg(F.count(F.lit(1)).alias("n")).scalar()
    ev = fixtures.node_events(spark, d).select("idx", F.col("id").alias("user_id"), (F.col("idx") % n).alias("positive"))
    known = ev.select("user_id", F.col("positive").alias("negative"))
    got = negatives.hard_negatives(ev, emb, 4, known, "user_id", ratio=0.5, temperature=0.1, top_k=top_k, seed=seed)
    return got.select("idx", "kind", F.col("slot").cast("bigint"), "negative", F.round("similarity", 5).alias("similarity"))


@query("n4_hard_negatives", _hard_sql("SELECT * FROM scored", 8))
def n4(spark, d):
    return _hard(spark, d, None, 8)


@query("n5_top_k_hard_negatives", _hard_sql("SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY idx ORDER BY round(sim, 9) DESC, negative) <= 100", 9))
def n5(spark, d):
    return _hard(spark, d, 100, 9)


__all__ = ["INTERACTIONS", "graph"]
