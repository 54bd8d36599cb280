"""Query registry, and SQL pieces shared by the check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its check."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def sql_draw(*parts: str | int) -> str:
    """The draw of ``functions.hashing.draw_int``; strings are SQL expressions."""
    items = ", ".join(f"'{p}'" if isinstance(p, int) else f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {items})), 1, 15) AS BIGINT)"


def sql_uniform(*parts: str | int) -> str:
    return f"(CAST({sql_draw(*parts)} AS DOUBLE) / 1152921504606846976.0)"


def sql_gumbel(*parts: str | int) -> str:
    return f"(-ln(-ln((CAST({sql_draw(*parts)} AS DOUBLE) + 0.5) / 1152921504606846976.0)))"


ORGS = """orgs AS (SELECT p_partkey AS uuid, 'Part#' || p_partkey AS name,
  p_type || ',' || p_brand || ',' || replace(p_name, ' ', ',') AS category_list,
  p_retailprice AS rank, p_name AS short_description FROM part)"""
CATS = """cats AS (SELECT DISTINCT uuid AS company, trim(c) AS category FROM (SELECT uuid, unnest(string_split(category_list, ',')) AS c FROM orgs) WHERE trim(c) <> '')"""
INV = """inv AS (SELECT l_partkey AS company, o_custkey AS investor, epoch(o_orderdate)::DOUBLE AS ts,
  l_extendedprice AS raised, o_orderkey AS round_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EDGES = """edges AS (SELECT company, investor, count(*) AS n_rounds, sum(raised) AS total_raised,
  min(ts) AS first_ts, max(ts) AS last_ts FROM inv GROUP BY 1, 2)"""
# smallest node of each component: labels go over edges until no label falls any more
COMPONENTS = """und AS MATERIALIZED (SELECT 'company:' || company AS a, 'investor:' || investor AS b FROM edges UNION ALL SELECT 'investor:' || investor, 'company:' || company FROM edges),
    walk(node, component) USING KEY (node) AS (SELECT a, a FROM und GROUP BY 1
      UNION SELECT u.a, min(w.component) FROM walk w JOIN und u ON u.b = w.node JOIN recurring.walk r ON r.node = u.a WHERE w.component < r.component GROUP BY 1),
    lab AS (SELECT node, component FROM walk)"""
INTER = """inter AS MATERIALIZED (SELECT company, investor, first_ts AS ts, total_raised AS raised, n_rounds,
  row_number() OVER (ORDER BY first_ts, company, investor) - 1 AS idx FROM edges)"""
ENDS = """ends AS (SELECT 'company' AS side, company AS id, investor AS other, * FROM inter
  UNION ALL SELECT 'investor', investor, company, * FROM inter)"""
DEG = """deg AS (SELECT 'company' AS side, company AS id, count(*) AS degree FROM edges GROUP BY 2
  UNION ALL SELECT 'investor', investor, count(*) FROM edges GROUP BY 2)"""
CUTS = """cuts AS (SELECT quantile_cont(ts, 0.70) AS t1, quantile_cont(ts, 0.85) AS t2 FROM inter)"""
LABELLED = """labelled AS (SELECT inter.*, CASE WHEN ts <= t1 THEN 'train' WHEN ts <= t2 THEN 'val' ELSE 'test' END AS split FROM inter, cuts)"""
NEGATIVE_SEED = 11
POOL = "pool AS (SELECT investor AS negative, row_number() OVER (ORDER BY investor) - 1 AS place FROM (SELECT DISTINCT investor FROM inter))"
NEGS = f"""draws AS MATERIALIZED (SELECT i.company, i.investor, i.idx, i.ts, s.slot, {sql_draw(NEGATIVE_SEED, 'i.idx', 's.slot')} % c.n AS place
  FROM inter i, (SELECT unnest(range(0, 1)) AS slot) s, (SELECT count(*) AS n FROM pool) c),
  negs AS MATERIALIZED (SELECT d.* EXCLUDE (place), p.negative FROM draws d JOIN pool p ON p.place = d.place)"""
# scored pairs: late positives and their random negatives, with a hash-made probability
SCORE_SEED = 7
SCORES = f"""scores AS MATERIALIZED (SELECT company, investor, max(label) AS label, round({sql_uniform(SCORE_SEED, 'company', 'investor')}, 6) AS p FROM (
  SELECT company, investor, 1.0::DOUBLE AS label FROM inter UNION ALL SELECT company, negative, 0.0::DOUBLE FROM negs) GROUP BY company, investor)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = with_(INV, EDGES)
INTERACTIONS = with_(INV, EDGES, INTER)
SCORED = with_(INV, EDGES, INTER, POOL, NEGS, SCORES)
