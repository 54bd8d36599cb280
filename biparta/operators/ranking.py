"""Iterative degree-penalised influence of both sides of a bipartite graph.

For weights w, company strength kc and investor strength kv (row and column sums):

    f'(c) = kc(c)^-beta  * sum_v w(c,v) * u(v) / nv(v),   nv(v) = sum_c w(c,v) * kc(c)^-beta
    u'(v) = kv(v)^-alpha * sum_c w(c,v) * f(c) / nc(c),   nc(c) = sum_v w(c,v) * kv(v)^-alpha

Both new vectors come from both previous ones. All penalties and normalisers belong
to nodes, so an edge carries its weight only, and one step is one join plus one sum
over both directions. A common factor of a vector cancels in every step, hence the
unit norm is applied to results only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biparta.operators.graph import COMPANY, INVESTOR
from biparta.operators.ordering import global_rank
from biparta.operators.skew import SALTS, hot_keys
from biparta.session import materialize

EPS = 1e-12
ALPHA, BETA = 0.3, -5.0
MAX_ITERATIONS = 1000
STABLE_SHARE = 0.01
STABLE_RUN = 20
BLOCK = 22  # iterations per convergence check: the shortest possible run to a stop is 21
CUT_EVERY = 5  # steps per written vector in the fixed-iteration form


def _floor(x: Column) -> Column:
    return F.when(x > EPS, x).otherwise(F.lit(EPS))


class NodeCode:
    """One key column for a node of either side.

    Whole-number ids become ``2 * id`` or ``2 * id + 1``, so that joins and sums run on a
    single long; other ids become a string with a side prefix.
    """

    def __init__(self, edges: DataFrame):
        types = {edges.schema[c].dataType.typeName() for c in (COMPANY, INVESTOR)}
        self.numeric = types <= {"byte", "short", "integer", "long"}
        self.id_type = edges.schema[COMPANY].dataType.simpleString() if self.numeric else "string"

    def encode(self, side: str, node_id: Column) -> Column:
        bit = int(side == INVESTOR)
        return node_id.cast("bigint") * 2 + bit if self.numeric else F.concat(F.lit(f"{bit}:"), node_id.cast("string"))

    def encode_by(self, side: Column, node_id: Column) -> Column:
        return F.when(side == COMPANY, self.encode(COMPANY, node_id)).otherwise(self.encode(INVESTOR, node_id))

    def side(self, node: Column) -> Column:
        is_company = node.bitwiseAND(F.lit(1)) == 0 if self.numeric else node.startswith("0:")
        return F.when(is_company, COMPANY).otherwise(INVESTOR)

    def node_id(self, node: Column) -> Column:
        plain = F.shiftright(node, 1) if self.numeric else F.substring(node, 3, 1 << 30)
        return plain.cast(self.id_type)


class RankGraph:
    """Prepared graph: arcs in both directions, and per-node penalties and normalisers."""

    def __init__(
        self,
        edges: DataFrame,
        alpha: float | str = ALPHA,
        beta: float | str = BETA,
        weight: str | None = None,
        by: tuple[str, ...] = (),
    ):
        """``by`` names run columns (sample, parameter set); runs are ranked side by side.

        ``alpha`` and ``beta`` may name columns, which must be constant inside a run.
        """
        self.by, self.code = by, NodeCode(edges)
        self.keys = [*by, "node"]
        a = F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
        b = F.col(beta) if isinstance(beta, str) else F.lit(float(beta))
        self.weighted = weight is not None
        w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
        c, v = self.code.encode(COMPANY, F.col(COMPANY)), self.code.encode(INVESTOR, F.col(INVESTOR))
        ends = F.explode(
            F.array(F.struct(c.alias("node"), v.alias("other"), b.alias("power")), F.struct(v.alias("node"), c.alias("other"), a.alias("power")))
        )
        # an arc sends the value of ``node`` to ``other`` on the opposite side
        arcs = materialize(edges.select(*by, ends.alias("e"), w.alias("w")).select(*by, "e.*", "w"), "arcs")
        strength = materialize(
            arcs.groupBy(*self.keys).agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("n"), F.first("power").alias("power")), "strength"
        ).withColumn("penalty", F.pow(_floor(F.col("k")), -F.col("power")))
        self.hot = hot_keys(strength, self.keys, "n")
        self.any_hot = not self.hot.isEmpty()
        self.arcs = self._spread(arcs.drop("power"))
        norms = self._send(strength.select(*self.keys, F.col("penalty").alias("x"))).withColumnRenamed("x", "norm")
        self.table = materialize(
            strength.join(norms, self.keys).withColumn("norm", _floor(F.col("norm"))).select(*self.keys, "k", "penalty", "norm"), "nodes"
        )

    @property
    def nodes(self) -> DataFrame:
        """``(by, side, id, k, penalty, norm)``"""
        return self.decode(self.table)

    def decode(self, df: DataFrame) -> DataFrame:
        node = F.col("node")
        rest = [x for x in df.columns if x not in self.keys]
        return df.select(*self.by, self.code.side(node).alias("side"), self.code.node_id(node).alias("id"), *rest)

    def _spread(self, arcs: DataFrame) -> DataFrame:
        if not self.any_hot:
            return arcs
        # hot keys: at most 1 / HOT_SHARE rows by definition
        flagged = arcs.join(F.broadcast(self.hot.withColumn("hot", F.lit(True))), self.keys, "left")
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        return materialize(flagged.withColumn("salt", salt).drop("hot"), "arcs")

    def _send(self, x: DataFrame) -> DataFrame:
        """Sum of ``w * x`` over the arcs that reach each node."""
        keys = self.keys
        if self.any_hot:
            slots = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            x = x.join(F.broadcast(self.hot.withColumn("hot", F.lit(True))), keys, "left").withColumn("salt", F.explode(slots)).drop("hot")
            keys = [*keys, "salt"]
        return self.arcs.join(x, keys).groupBy(*self.by, F.col("other").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))

    def start(self) -> DataFrame:
        """Zero-order vector; ``m`` is the value divided by the node's normaliser, as sent in the next step."""
        return self.table.select(*self.keys, F.col("k").alias("x"), (F.col("k") / F.col("norm")).alias("m"))

    def step(self, x: DataFrame) -> DataFrame:
        got = self._send(x.select(*self.keys, F.col("m").alias("x")))
        value = F.col("x") * F.col("penalty")
        return got.join(self.table, self.keys).select(*self.keys, value.alias("x"), (value / F.col("norm")).alias("m"))

    def unit(self, x: DataFrame) -> DataFrame:
        """``(by, side, id, score)``: each side of each run scaled to unit length (zero vectors stay)."""
        rows = self.decode(x) if "node" in x.columns else x
        group = [*self.by, "side"]
        length = rows.groupBy(*group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
        return rows.join(length, group).withColumn(
            "score", F.when(F.col("length") > EPS, F.col("x") / F.col("length")).otherwise(F.col("x"))
        ).drop("x", "m", "length")

    def run(self, iterations: int) -> DataFrame:
        """Unit-length scores after a fixed number of steps."""
        return self.run_to([iterations])[0]

    def run_to(self, stops: list[int]) -> list[DataFrame]:
        """Unit-length scores after each of some numbers of steps, in rising order; every step is done once."""
        x, out = self.start(), [self.unit(self.start())] * stops.count(0)
        for i in range(1, max(stops) + 1):
            x = self.step(x)
            if i % CUT_EVERY == 0 or i in stops:
                x = materialize(x, "vector")
            out += [self.unit(x)] * stops.count(i)
        return out

    def zero_order(self) -> DataFrame:
        return self.unit(self.start())


def fixed_scores(edges: DataFrame, iterations: int, alpha=ALPHA, beta=BETA, weight=None, by=()) -> DataFrame:
    return RankGraph(edges, alpha, beta, weight, tuple(by)).run(iterations)


def scores_of(edges: DataFrame, iterations: int | None = None, alpha=ALPHA, beta=BETA, weight=None, by=()) -> DataFrame:
    """``(by, side, id, score)``; without ``iterations`` each side of each run goes on until its order is stable."""
    if iterations is not None:
        return fixed_scores(edges, iterations, alpha, beta, weight, by)
    scores, _ = converge(RankGraph(edges, alpha, beta, weight, tuple(by)))
    return scores.select(*by, "side", "id", "score")


def converge(
    graph: RankGraph,
    nodes: DataFrame | None = None,
    max_iterations: int = MAX_ITERATIONS,
    stable_share: float = STABLE_SHARE,
    stable_run: int = STABLE_RUN,
    block: int = BLOCK,
    compat: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Iterate until each side of each run has kept its order.

    A side stops when for ``stable_run`` iterations in a row fewer than
    ``stable_share`` of its nodes changed place. Steps run on packed cells (see
    ``cell_steps``), places are counted per block (see ``moves``) by
    value to 40 bits, then id, so that equal neighbourhoods tie. ``compat`` returns the scores of the
    iteration before the stop (the order is always that of the stop).

    Returns scores ``(by, side, id, initial_position, position, score)`` and
    ``stops(by, side, iterations)``. ``nodes`` adds isolates with score 0.
    """
    if graph.by:
        return _converge_runs(graph, nodes, max_iterations, stable_share, stable_run, block, compat)
    from biparta.operators.block_ranking import moves
    from biparta.operators.cell_steps import CellGraph

    spark, keys = graph.table.sparkSession, ["side", "id"]
    known = graph.nodes.select(*keys)
    isolated = known.limit(0)
    if nodes is not None:
        isolated = materialize(nodes.select(*keys).distinct().join(known, keys, "left_anti"), "isolated")
    if known.isEmpty() and isolated.isEmpty():
        raise ValueError("no nodes to rank")
    cells = CellGraph(graph)
    x = cells.start()
    streak: dict[str, int] = {}
    stop: dict[str, int] = {}
    picked: list[DataFrame] = []
    first_places, before, done, count = None, None, 0, min(block, max_iterations)
    while True:
        vectors = [] if before is None else [(done, before)]
        for i in range(done + 1, done + count + 1):
            x = cells.step(x)
            vectors.append((i, x))
        zeros = F.array_repeat(F.lit(0.0), len(vectors))
        rows = cells.lists(vectors).unionByName(isolated.select(F.lit(0).alias("run"), *keys, zeros.alias("xs")))
        rows = materialize(rows, "block")
        start = vectors[0][0]
        sizes, moved = moves(rows, len(vectors))
        if first_places is None:
            first = rows.select(*keys, F.element_at("xs", 1).alias("x"))
            first_places = global_rank(first, [F.col("x").asc(), F.col("id").asc()], "initial_position", start=0, by=("side",)).drop("x")
        fresh = []
        for (_, side), n in sizes.items():
            if side in stop:
                continue
            for i in range(done + 1, done + count + 1):
                share = 1.0 if i == 1 else moved[0, side][i - start] / n
                streak[side] = streak.get(side, 0) + 1 if share < stable_share else 0
                if streak[side] >= stable_run or i >= max_iterations:
                    stop[side] = i
                    # a run that ends at the iteration limit has already stored its last scores
                    back = max(i - 1, 1) if compat and i < max_iterations else i
                    fresh.append((side, i - start + 1, back - start + 1))
                    break
        if fresh:
            # one row per side
            at = F.broadcast(spark.createDataFrame(fresh, "side string, at int, back int"))
            ends = rows.join(at, "side").select(*keys, F.element_at("xs", F.col("at")).alias("last"), F.element_at("xs", F.col("back")).alias("x"))
            picked.append(materialize(ends, "stopped"))
        before, done = x, done + count
        still = [stable_run - streak[side] for _, side in sizes if side not in stop]
        if not still:
            break
        # no side can stop before its run of stable iterations is full
        count = min(max(still), max_iterations - done)
    cells.close()
    stops = spark.createDataFrame(list(stop.items()), graph.nodes.select("side").schema.add("iterations", "integer"))
    final = global_rank(reduce(DataFrame.unionByName, picked), [F.col("last").asc(), F.col("id").asc()], "position", start=0, by=("side",)).drop("last")
    scores = graph.unit(final).join(first_places, keys)
    return scores.select(*keys, "initial_position", "position", "score"), stops


def _converge_runs(
    graph: RankGraph, nodes: DataFrame | None, max_iterations: int, stable_share: float, stable_run: int, block: int, compat: bool
) -> tuple[DataFrame, DataFrame]:
    """``converge`` for graphs with several runs: the ranks of a whole block are taken in one global sort."""
    by = list(graph.by)
    group, keys = [*by, "side"], [*by, "side", "id"]
    spark = graph.table.sparkSession
    x = graph.start()
    known = graph.nodes.select(*keys)
    isolated = known.limit(0)
    if nodes is not None:
        wanted = nodes.select("side", "id")
        if by:
            wanted = wanted.withColumn("__run", F.explode(_run_list(graph))).select("__run.*", "side", "id")
        isolated = materialize(wanted.select(*keys).distinct().join(known, keys, "left_anti"), "isolated")
    everyone = known.unionByName(isolated)
    sizes = {tuple(r[g] for g in group): r["n"] for r in everyone.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).collect()}
    streak = dict.fromkeys(sizes, 0)
    stop: dict[tuple, int] = {}
    vectors: list[DataFrame] = []
    first_ranks = last_ranks = None
    picked_scores: list[DataFrame] = []
    done = 0
    while len(stop) < len(sizes) and done < max_iterations:
        count = min(block, max_iterations - done)
        fresh: list[DataFrame] = []
        for i in range(done + 1, done + count + 1):
            x = materialize(graph.step(x), "vector")
            fresh.append(x.select(*graph.keys, "x", F.lit(i).alias("iteration")))
        table = graph.decode(reduce(DataFrame.unionByName, fresh))
        missing = isolated.select(
            *keys, F.lit(0.0).alias("x"), F.explode(F.sequence(F.lit(done + 1), F.lit(done + count))).alias("iteration")
        )
        ranks = global_rank(
            table.unionByName(missing), [F.col("x").asc(), F.col("id").asc()], "position", start=0, by=(*by, "side", "iteration")
        )
        ranks = materialize(ranks, "ranks")
        chain = ranks.select(*keys, "iteration", "position")
        if last_ranks is not None:
            chain = chain.unionByName(last_ranks)
        else:
            first_ranks = ranks.filter(F.col("iteration") == 1).select(*keys, F.col("position").alias("initial_position"))
        along = Window.partitionBy(*keys).orderBy("iteration")
        moved = chain.withColumn("before", F.lag("position").over(along)).filter(
            (F.col("iteration") > done) & (F.col("before").isNull() | (F.col("before") != F.col("position")))
        )
        changes = {(tuple(r[g] for g in group), r["iteration"]): r["n"] for r in moved.groupBy(*group, "iteration").agg(F.count(F.lit(1)).alias("n")).collect()}
        for i in range(done + 1, done + count + 1):
            for g, n in sizes.items():
                if g in stop:
                    continue
                share = (n if i == 1 else changes.get((g, i), 0)) / n
                streak[g] = streak[g] + 1 if share < stable_share else 0
                if streak[g] >= stable_run or i >= max_iterations:
                    stop[g] = i
        vectors.append(ranks)
        last_ranks = ranks.filter(F.col("iteration") == done + count).select(*keys, "iteration", "position")
        done += count
    stops = spark.createDataFrame([(*g, i) for g, i in stop.items()], graph.nodes.select(*group).schema.add("iterations", "integer"))
    every = reduce(DataFrame.unionByName, vectors)
    # one row per side and run
    at = every.join(F.broadcast(stops), group).filter(F.col("iteration") == F.col("iterations"))
    final = at.select(*keys, "position", "x", "iteration")
    if compat:
        # a run that ends at the iteration limit has already stored its last scores
        back = F.when(F.col("iterations") < max_iterations, F.greatest(F.col("iterations") - 1, F.lit(1))).otherwise(F.col("iterations"))
        old = every.join(F.broadcast(stops), group).filter(F.col("iteration") == back)
        final = final.drop("x", "iteration").join(old.select(*keys, "x", "iteration"), keys)
    scores = graph.unit(final).drop("iteration").join(first_ranks, keys)
    return scores.select(*keys, "initial_position", "position", "score"), stops


def _run_list(graph: RankGraph) -> Column:
    """The runs as an array literal: a parameter or sample list, short by contract."""
    rows = graph.table.select(*graph.by).distinct().collect()
    return F.array(*[F.struct(*[F.lit(r[b]).alias(b) for b in graph.by]) for r in rows])


def ranked(scores: DataFrame, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Add the 1-based rank (best score first) per side; ``digits`` ranks on rounded scores."""
    value = F.round("score", digits) if digits is not None else F.col("score")
    return global_rank(scores, [value.desc(), F.col("id").asc()], "rank", by=(*by, "side"))


def rank_graph(
    edges: DataFrame,
    nodes: DataFrame | None = None,
    alpha: float = ALPHA,
    beta: float = BETA,
    weight: str | None = None,
    iterations: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """Both sides ranked in one run: ``(side, id, score, rank, initial_position)``.

    Without ``iterations`` the run goes on until the order is stable.
    """
    graph = RankGraph(edges, alpha, beta, weight)
    if iterations is None:
        scores, _ = converge(graph, nodes, compat=compat)
        return ranked(scores).drop("position")
    first = graph.unit(graph.step(graph.start())).withColumnRenamed("score", "__one")
    scores = graph.run(iterations).join(first, ["side", "id"])
    if nodes is not None:
        scores = nodes.select("side", "id").join(scores, ["side", "id"], "left").fillna(0.0, ["score", "__one"])
    placed = global_rank(scores, [F.col("__one").asc(), F.col("id").asc()], "initial_position", start=0, by=("side",))
    return ranked(placed.drop("__one"))


def with_ground_truth(ranks: DataFrame, truth: DataFrame) -> DataFrame:
    """Attach ``truth(side, id, ground_truth_rank, ground_truth_score)`` by id."""
    return ranks.join(truth, ["side", "id"], "left")
