"""Connected components and what follows from them.

Rounds of contraction: every node goes to the smallest of itself and its partners, in an order that a
hash deals anew each round, and pairs become pairs of the nodes gone to. Pairs inside one node and
repeated pairs are dropped, so the tables of nodes and pairs shrink by a factor per round, and the number
of rounds grows with the logarithm of the number of nodes. A round is one aggregate (combined before the
shuffle), two spread joins and a distinct. Pairs carry a parity, which tells whether two colours fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biparta.operators.graph import COMPANY, INVESTOR, endpoints, nodes_of
from biparta.operators.ranking import NodeCode
from biparta.operators.skew import HOT_ROWS, hot_keys, spread_join
from biparta.session import materialize

MAX_ROUNDS = 200


def _targets(edges: DataFrame, turn: int) -> DataFrame:
    """Per node where it goes: ``(node, to, flip, n)``; ``flip`` tells whether it has the other colour, ``n`` counts its pairs."""
    at = lambda c: F.xxhash64(F.lit(turn), F.col(c))
    end = lambda a, b: F.struct(F.col(a).alias("node"), F.struct(at(b).alias("h"), F.col(b).alias("node"), "odd").alias("t"))
    ends = edges.select(F.explode(F.array(end("u", "v"), end("v", "u"))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"))
    own = F.struct(at("node").alias("h"), F.col("node").alias("node"), F.lit(0).cast("tinyint").alias("odd"))
    best = F.least(own, F.col("t"))
    return per.select("node", best["node"].alias("to"), best["odd"].alias("flip"), "n")


def _moved(edges: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """Pairs between the nodes gone to; of pairs inside one node those stay whose ends have different colours."""
    for end in ("u", "v"):
        to = targets.select(F.col("node").alias(end), "to", "flip", "n")
        if n <= HOT_ROWS:
            # no node can be hot
            edges = edges.join(to.drop("n"), end)
        else:
            other = "v" if end == "u" else "u"
            edges = spread_join(edges, to.drop("n"), [end], hot_keys(to, [end], "n", HOT_ROWS), [F.col(other)])
        edges = edges.withColumn(end, F.col("to")).withColumn("odd", F.col("odd").bitwiseXOR(F.col("flip"))).drop("to", "flip")
    kept = edges.filter((F.col("u") != F.col("v")) | (F.col("odd") == 1))
    return kept.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "odd").distinct()


def _contract(edges: DataFrame) -> tuple[list[DataFrame], bool]:
    """The targets of each round, and whether two colours fit; the rounds end early where they do not.

    ``edges(u, v, odd)`` are distinct pairs of different nodes.
    """
    rounds: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        n = edges.count()
        if n == 0:
            return rounds, True
        if not edges.filter(F.col("u") == F.col("v")).isEmpty():
            return rounds, False
        rounds.append(materialize(_targets(edges, turn), "targets"))
        edges = materialize(_moved(edges, rounds[-1], n), "cc")
    raise RuntimeError("components did not settle")


def _groups(pairs: DataFrame) -> DataFrame:
    """``(node, group)`` of all nodes of pairs ``(u, v)`` of different nodes; the group is some node of the component."""
    odd = F.lit(0).cast("tinyint").alias("odd")
    edges = materialize(pairs.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), odd).distinct(), "cc")
    rounds, _ = _contract(edges)
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("group"))
    # from the last round back: tables grow to the nodes of the first
    found = rounds[-1].select("node", F.col("to").alias("group"))
    for targets in reversed(rounds[:-1]):
        later = found.withColumnsRenamed({"node": "to", "group": "later"})
        found = targets.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("group"))
    return materialize(found, "groups")


def _named(groups: DataFrame, name) -> DataFrame:
    """``(node, component)``: the smallest name inside each group."""
    heads = materialize(groups.groupBy("group").agg(F.min(name).alias("component"), F.count(F.lit(1)).alias("n")), "heads")
    # a giant component is the rule, so its nodes are spread
    return spread_join(groups, heads.drop("n"), ["group"], hot_keys(heads, ["group"], "n", HOT_ROWS), [F.col("node")]).select("node", "component")


def star_components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` for pairs ``(u, v)``; the component is its smallest node."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = _named(_groups(pairs), F.col("node"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


class _Wide(NodeCode):
    """The string code, for whole numbers that do not fit twice into 64 bits."""

    def __init__(self, edges: DataFrame):
        super().__init__(edges)
        self.numeric = False


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(side, id, component)``; the label is ``side:id`` of the component's first node.

    Isolated ``nodes`` are components of their own.
    """
    pairs = materialize(edges.select(COMPANY, INVESTOR), "pairs")
    code = NodeCode(pairs)
    if code.numeric:
        ids = pairs.agg(*[f(c).cast("bigint") for c in (COMPANY, INVESTOR) for f in (F.min, F.max)]).first()
        if any(x is not None and not -(1 << 62) <= x < 1 << 62 for x in ids):
            code = _Wide(pairs)
    groups = _groups(pairs.select(code.encode(COMPANY, F.col(COMPANY)).alias("u"), code.encode(INVESTOR, F.col(INVESTOR)).alias("v")))
    node = F.col("node")
    found = _named(groups, F.concat_ws(":", code.side(node), code.node_id(node).cast("string")))
    found = found.select(code.side(node).alias("side"), code.node_id(node).alias("id"), "component")
    everyone = nodes_of(pairs) if nodes is None else nodes.select("side", "id")
    own = F.concat_ws(":", "side", F.col("id").cast("string"))
    return everyone.join(found, ["side", "id"], "left").select("side", "id", F.coalesce("component", own).alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def connectivity(labels: DataFrame) -> DataFrame:
    """One row: number of components, size and percentage of the largest, connected or not."""
    sizes = component_sizes(labels)
    total = F.sum("size")
    return sizes.agg(
        F.count(F.lit(1)).alias("n_components"),
        F.max("size").alias("largest_size"),
        (F.max("size") / total * 100).alias("largest_percentage"),
        (F.count(F.lit(1)) == 1).alias("is_connected"),
    )


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes of the largest component (ties: smallest label)."""
    top = component_sizes(labels).orderBy(F.col("size").desc(), F.col("component").asc()).limit(1).select("component")
    return labels.join(F.broadcast(top), "component", "left_semi")


def is_bipartite(pairs: DataFrame) -> DataFrame:
    """One row: whether the pairs ``(u, v)`` allow two sides.

    Every pair asks for different colours at its ends. The pairs are contracted until none is left, or
    until one inside a single node asks for different colours: then there is an odd cycle.
    """
    odd = F.lit(1).cast("tinyint").alias("odd")
    edges = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), odd).distinct(), "cc")
    _, fits = _contract(edges)
    return pairs.sparkSession.createDataFrame([(fits,)], "is_bipartite boolean")


__all__ = ["components", "component_sizes", "connectivity", "endpoints", "is_bipartite", "largest_component", "star_components"]
