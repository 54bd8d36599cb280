"""Bipartite graph tables: ``edges(company, investor, ...)`` and ``nodes(side, id, ...)``.

Sides are named, never numbered, and a node key is (side, id): the same id may
exist on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.functions.text import split_list
from biparta.operators.ordering import global_rank
from biparta.session import materialize, shuffle_width

COMPANY, INVESTOR = "company", "investor"
# Rounds listed in one row of ``edge_rounds``; longer lists continue in further rows.
ROUNDS_PER_ROW = 1000
# Rows of a company in a round that one task expands to the company's technologies.
EXPANDED_ROWS = 250_000


def edge_rollup(investments: DataFrame, amount: str = "raised", time: str = "ts") -> DataFrame:
    """One row per (company, investor): rounds, total amount, first and last time."""
    return investments.filter(F.col(COMPANY).isNotNull() & F.col(INVESTOR).isNotNull()).groupBy(COMPANY, INVESTOR).agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.sum(F.coalesce(F.col(amount), F.lit(0.0))).alias("total_raised"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
    )


def edge_rounds(investments: DataFrame, round_fields: list[str], key: str = "round_id") -> DataFrame:
    """The rounds of each pair as sorted lists: row ``chunk`` of a pair holds its rounds from place ``chunk * ROUNDS_PER_ROW`` on.

    Rounds are placed by ``round_fields``, then ``key``. The rule is the same for pairs of
    all sizes, and the places come from a global order, so a hot pair is not one task's work.
    """
    named = investments.filter(F.col(COMPANY).isNotNull() & F.col(INVESTOR).isNotNull())
    fields = list(dict.fromkeys([COMPANY, INVESTOR, *round_fields, key]))
    order = [F.col(c).asc() for c in fields[2:]]
    placed = global_rank(named.select(*fields), order, "__place", start=0, by=(COMPANY, INVESTOR))
    chunk = F.floor(F.col("__place") / F.lit(ROUNDS_PER_ROW)).cast("int")
    return placed.groupBy(COMPANY, INVESTOR, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(*round_fields))).alias("rounds"))


def last_row_edges(investments: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """One row per pair holding the values of its last row in the given order."""
    latest = F.max(F.struct(*order, *[F.col(k).alias(f"__v_{k}") for k in keep])).alias("s")
    return investments.groupBy(COMPANY, INVESTOR).agg(latest).select(COMPANY, INVESTOR, *[F.col(f"s.__v_{k}").alias(k) for k in keep])


def endpoints(edges: DataFrame, *extra: str) -> DataFrame:
    """Both ends of each edge as ``(side, id, other, ...)``, from one scan."""
    ends = F.explode(
        F.array(
            F.struct(F.lit(COMPANY).alias("side"), F.col(COMPANY).alias("id"), F.col(INVESTOR).alias("other")),
            F.struct(F.lit(INVESTOR).alias("side"), F.col(INVESTOR).alias("id"), F.col(COMPANY).alias("other")),
        )
    )
    return edges.select(ends.alias("e"), *extra).select("e.*", *extra)


def nodes_of(edges: DataFrame) -> DataFrame:
    return endpoints(edges).select("side", "id").distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """``(side, id, degree)``; with ``nodes`` the isolates appear with degree 0."""
    w = F.col(weight) if weight else F.lit(1)
    found = endpoints(edges, *([weight] if weight else [])).groupBy("side", "id").agg(F.sum(w).alias("degree"))
    if nodes is None:
        return found
    return nodes.select("side", "id").join(found, ["side", "id"], "left").fillna(0, ["degree"])


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(nodes_of(edges), ["side", "id"], "left_anti")


def node_table(nodes: DataFrame, edges: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Nodes with degree and, for companies, their technologies (sorted union over all rows).

    ``categories(id, category_list)`` may repeat a company; the union is taken.
    """
    out = degrees(edges, nodes)
    if categories is None:
        return out
    items = categories.select("id", F.explode(split_list(F.col("category_list"))).alias("t")).distinct()
    # a company's own category list: short by nature
    lists = items.groupBy("id").agg(F.sort_array(F.collect_set("t")).alias("technologies")).withColumn("side", F.lit(COMPANY))
    empty = F.array().cast("array<string>")
    return out.join(lists, ["side", "id"], "left").withColumn("technologies", F.coalesce("technologies", empty)).withColumn(
        "n_technologies", F.size("technologies").cast("bigint")
    )


def technology_edges(companies: DataFrame, category_col: str = "category_list") -> DataFrame:
    """Company-technology edges; companies without any technology are in ``technology_isolates``."""
    return companies.select(F.col("id").alias("company"), F.explode(split_list(F.col(category_col))).alias("technology")).distinct()


def technology_isolates(companies: DataFrame, category_col: str = "category_list") -> DataFrame:
    return companies.filter(F.size(split_list(F.col(category_col))) == 0).select(F.col("id").alias("company")).distinct()


def round_technologies(rounds: DataFrame, technologies: DataFrame) -> DataFrame:
    """Distinct ``(round_id, technology)`` of the companies of each round.

    ``rounds(company, round_id)`` and ``technologies(company, technology)`` hold no row twice. Lists are expanded
    after the shuffle, in as many tasks as the number of rows asks for.
    """
    # a company's own list: short by nature
    lists = technologies.groupBy("company").agg(F.collect_list("technology").alias("listed"))
    rows = materialize(rounds.join(lists, "company").select("round_id", "listed"), "round-lists")
    tasks = max(shuffle_width(rows.sparkSession), -(-rows.count() // EXPANDED_ROWS))
    return rows.repartition(tasks, "round_id").select("round_id", F.explode("listed").alias("technology")).distinct()


def tripartite_edges(companies: DataFrame, rounds: DataFrame) -> DataFrame:
    """Typed edges between companies, rounds and technologies.

    ``companies(id, category_list)``, ``rounds(company, round_id)``.
    """
    ct = technology_edges(companies)
    kept = rounds.filter(F.col("company").isNotNull() & F.col("round_id").isNotNull()).select("company", "round_id").distinct()
    text = lambda c: F.col(c).cast("string")
    ci = kept.join(companies.select(F.col("id").alias("company")), "company", "left_semi")
    it = round_technologies(kept, ct)
    return (
        ci.select(text("company").alias("src"), text("round_id").alias("dst"), F.lit("company_investment").alias("edge_type"))
        .unionByName(ct.select(text("company").alias("src"), text("technology").alias("dst"), F.lit("company_technology").alias("edge_type")))
        .unionByName(it.select(text("round_id").alias("src"), text("technology").alias("dst"), F.lit("investment_technology").alias("edge_type")))
    )


def labelled_graph(interactions: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ground-truth graph: rolled-up positive interactions, and every mapped node (isolates included)."""
    edges = edge_rollup(interactions.filter(F.col("label") > 0))
    return maps.select("side", "id").distinct(), edges


def scored_graph(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Graph of scored pairs; with a threshold only ``p >= threshold`` stays."""
    kept = scores if threshold is None else scores.filter(F.col("p") >= threshold)
    return kept.groupBy(COMPANY, INVESTOR).agg(F.max("p").alias("weight"), F.count(F.lit(1)).alias("n_rounds"))


def node_funding(edges: DataFrame) -> DataFrame:
    """Total amount and number of rounds per node, both sides."""
    return endpoints(edges, "total_raised", "n_rounds").groupBy("side", "id").agg(
        F.sum("total_raised").alias("total_raised"), F.sum("n_rounds").alias("n_rounds")
    )


def biadjacency(edges: DataFrame, nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """Coordinate list ``(row, col, w)`` with dense 0-based positions per side.

    Isolated nodes keep their position, so the positions fit the full matrix.
    """
    places = global_rank(nodes.select("side", "id"), [F.col("id").asc()], "place", start=0, by=("side",))
    rows = places.filter(F.col("side") == COMPANY).select(F.col("id").alias(COMPANY), F.col("place").alias("row"))
    cols = places.filter(F.col("side") == INVESTOR).select(F.col("id").alias(INVESTOR), F.col("place").alias("col"))
    w = F.col(weight) if weight else F.lit(1.0)
    return edges.join(rows, COMPANY).join(cols, INVESTOR).select("row", "col", w.cast("double").alias("w"))


def orient(edges: DataFrame) -> DataFrame:
    """``(a_side, a, b_side, b, ...)`` to ``(company, investor, ...)``; reversed edges are turned, same-side ones dropped."""
    rest = [c for c in edges.columns if c not in ("a_side", "a", "b_side", "b")]
    straight = F.col("a_side") == COMPANY
    return edges.filter(_two_sided()).select(
        F.when(straight, F.col("a")).otherwise(F.col("b")).alias(COMPANY), F.when(straight, F.col("b")).otherwise(F.col("a")).alias(INVESTOR), *rest
    )


def misaligned(edges: DataFrame) -> DataFrame:
    """The edges ``orient`` drops, with the reason."""
    known = F.coalesce(F.col("a_side").isin(COMPANY, INVESTOR) & F.col("b_side").isin(COMPANY, INVESTOR), F.lit(False))
    return edges.filter(~_two_sided()).withColumn("reason", F.when(known, "same side").otherwise("unknown side"))


def _two_sided() -> Column:
    ok = ((F.col("a_side") == COMPANY) & (F.col("b_side") == INVESTOR)) | ((F.col("a_side") == INVESTOR) & (F.col("b_side") == COMPANY))
    return F.coalesce(ok, F.lit(False))


def top_nodes(edges: DataFrame, side: str, k: int) -> DataFrame:
    deg = degrees(edges).filter(F.col("side") == side)
    return deg.orderBy(F.col("degree").desc(), F.col("id").asc()).limit(k)


def neighbourhood(edges: DataFrame, k: int) -> DataFrame:
    """Edges around the k best-connected companies: their investors, and those investors' other companies."""
    seeds = top_nodes(edges, COMPANY, k).select(F.col("id").alias(COMPANY))
    investors = edges.join(seeds, COMPANY, "left_semi").select(INVESTOR).distinct()
    return edges.join(investors, INVESTOR, "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(side, id)``."""
    for side in (COMPANY, INVESTOR):
        keep = nodes.filter(F.col("side") == side).select(F.col("id").alias(side))
        edges = edges.join(keep, side, "left_semi")
    return edges


def low_degree_nodes(edges: DataFrame, side: str, percentage: float) -> DataFrame:
    """Nodes of ``side`` whose degree is at most ceil(size of other side / percentage).

    When that bound exceeds the other side's largest degree, its mean degree is the bound.
    """
    deg = degrees(edges)
    other = deg.filter(F.col("side") != side)
    stats = other.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("degree").alias("top"), F.avg("degree").alias("mean")).alias("s")).scalar()
    bound = F.ceil(stats["n"] / F.lit(float(percentage)))
    bound = F.when(bound > stats["top"], stats["mean"]).otherwise(bound)
    return deg.filter((F.col("side") == side) & (F.col("degree") <= bound))
