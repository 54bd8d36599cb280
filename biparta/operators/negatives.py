"""Negative pairs. All draws are hashes of (seed, query, slot), hence repeatable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biparta.functions.digests import draws
from biparta.functions.hashing import DRAW_RANGE, draw_int, gumbel
from biparta.functions.vectors import dot
from biparta.operators.graph import COMPANY, INVESTOR
from biparta.operators.history import as_of
from biparta.operators.ordering import global_rank
from biparta.session import materialize, shuffle_width

# Destinations of a block, and queries of a part, that meet in one task; queries whose scores are held at once.
DESTINATIONS = 512
QUERIES = 4000
SCORED_QUERIES = 1000
# Destinations that are held by every executor (some 40 bytes each), so that draws are not shuffled; larger pools are joined by place.
HELD_POOL = 8_000_000
# Turns of a walk that are listed at once.
TURNS = 1000
# Edges whose draws in all samples are held at once.
DRAWN_EDGES = 4096


def destinations(events: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column with dense 0-based positions ``place``."""
    return global_rank(events.select(col).distinct(), [F.col(col).asc()], "place", start=0)


def random_negatives(queries: DataFrame, pool: DataFrame, col: str, k: int = 1, seed: int = 0, key: str = "idx", known: DataFrame | None = None) -> DataFrame:
    """k uniform draws (with replacement) per query from ``pool(col, place)`` as ``negative``.

    Draws may hit true edges, as the plain sampler does; ``known(company, investor)``
    drops such hits.
    """
    n = pool.count()
    if k > 1:
        drawn = _listed_draws(queries, n, k, seed, key).select("*", F.posexplode("__places").alias("slot", "place")).drop("__places")
    else:
        drawn = queries.withColumn("slot", F.lit(0)).withColumn("place", F.pmod(draw_int(seed, key, "slot"), F.lit(n)))
    out = _at_places(drawn, pool, n, col).drop("place")
    if known is None:
        return out
    other = INVESTOR if col == COMPANY else COMPANY
    return out.join(known.select(F.col(other), F.col(col).alias("negative")).distinct(), [other, "negative"], "left_anti")


def _listed_draws(queries: DataFrame, n: int, k: int, seed: int, key: str) -> DataFrame:
    """Queries with the list ``__places`` of their k draws, each as ``draw_int`` of seed, key and slot modulo n.

    They are dealt over all tasks: a small table lies in one or two files, yet has k draws for each row.
    """
    tails = [str(slot).encode() for slot in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [f"{seed}|" if x is None else f"{seed}|{x}|" for x in batch.column("__key").to_pylist()]
            drawn = draws([x.encode() for x in heads], tails).reshape(-1) % n
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1) * k, pa.int32()), pa.array(drawn))
            yield pa.record_batch([*batch.columns[:-1], places], names=[*batch.schema.names[:-1], "__places"])

    asked = queries.repartition(shuffle_width(queries.sparkSession), key)
    schema = T.StructType([*queries.schema.fields, T.StructField("__places", T.ArrayType(T.LongType()))])
    return asked.withColumn("__key", F.col(key).cast("string")).mapInArrow(run, schema)


def _at_places(drawn: DataFrame, pool: DataFrame, n: int, col: str) -> DataFrame:
    """Draws with the ``negative`` at their ``place``."""
    pool = pool.withColumnRenamed(col, "negative")
    return drawn.join(F.broadcast(pool) if n <= HELD_POOL else pool, "place")


def draw_totals(queries: DataFrame, pool: DataFrame, col: str, k: int = 1, seed: int = 0, key: str = "idx") -> DataFrame:
    """Per query: number, sum and distinct number of the draws that ``random_negatives`` makes.

    Equal draws are equal places, so distinct ones are counted in a query's own list.
    """
    n = pool.count()
    listed = _listed_draws(queries.select(key), n, k, seed, key)
    # counted before the list is taken apart, hence once per query
    listed = listed.withColumn("__distinct", F.size(F.array_distinct("__places")).cast("bigint"))
    drawn = listed.select(key, "__distinct", F.explode("__places").alias("place"))
    # a missing destination is drawn, but neither summed nor counted as a value
    missing = F.max(F.col("negative").isNull().cast("bigint"))
    found = _at_places(drawn, pool, n, col).groupBy(key)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("negative").alias("total"), (F.max("__distinct") - missing).alias("distinct_n"))


def overlap_with_edges(negatives: DataFrame, edges: DataFrame, col: str = INVESTOR) -> DataFrame:
    """One row: draws in total and draws that are true edges."""
    other = INVESTOR if col == COMPANY else COMPANY
    known = edges.select(F.col(other), F.col(col).alias("negative"), F.lit(1).alias("hit")).distinct()
    return negatives.join(known, [other, "negative"], "left").agg(F.count(F.lit(1)).alias("draws"), F.count("hit").alias("true_edges"))


def smallest_prime_from(n: int) -> int:
    p = max(2, n)
    while any(p % d == 0 for d in range(2, int(p**0.5) + 1)):
        p += 1
    return p


def _walk(seed: int, key: Column, prime: int) -> tuple[Column, Column]:
    """Multiplier in 1..p-1 and offset in 0..p-1 of a query's walk over the places."""
    step = F.pmod(draw_int(seed, key, F.lit("step")), F.lit(prime - 1)) + 1
    offset = F.pmod(draw_int(seed, key, F.lit("offset")), F.lit(prime))
    return step, offset


def _turns(walk: DataFrame, low: int, high: int) -> DataFrame:
    """Every row with each ``turn`` from low to high - 1; no list in a row grows with the number of turns by more than a part of TURNS."""
    first = walk.select("*", F.explode(F.sequence(F.lit(low), F.lit(high - 1), F.lit(TURNS))).alias("__first"))
    last = F.least(F.col("__first") + TURNS, F.lit(high)) - 1
    return first.select("*", F.explode(F.sequence("__first", last)).alias("turn")).drop("__first")


def _place(prime: int) -> Column:
    """Place of a turn of the walk; products beyond a long are taken as decimals, which changes no value."""
    wide = "bigint" if prime < 1 << 31 else "decimal(19,0)"
    return F.pmod(F.col("__step").cast(wide) * F.col("turn").cast(wide) + F.col("__offset"), F.lit(prime)).cast("bigint")


def plausible_negatives(queries: DataFrame, events: DataFrame, k: int, seed: int = 0, key: str = "idx", time: str = "ts") -> DataFrame:
    """k companies per query that its investor has not funded up to the query time, without replacement.

    Each query walks the companies in its own pseudo-random order (a full cycle modulo
    a prime), so draws never repeat. Accepted draws fill the slots in walk order; queries
    still short go on in rounds of doubled length until they are full or have seen every
    company, so the result does not depend on the round length.
    """
    first = materialize(events.groupBy(COMPANY, INVESTOR).agg(F.min(time).alias("first_ts")), "first")
    pool = materialize(destinations(events, COMPANY), "pool")
    size = pool.count()
    prime = smallest_prime_from(max(size, 3))
    asked = materialize(queries.select(key, INVESTOR, F.col(COMPANY).alias("positive"), time), "asked")
    step, offset = _walk(seed, F.col(key), prime)
    walk = asked.withColumn("__step", step).withColumn("__offset", offset).withColumn("__have", F.lit(0).cast("bigint"))
    done: DataFrame | None = None
    low, width = 0, 2 * k
    while low < prime:
        high = min(low + width, prime)
        tries = _turns(walk, low, high).withColumn("place", _place(prime))
        drawn = tries.join(pool, "place").filter(F.col(COMPANY) != F.col("positive"))
        taken = F.col("first_ts") <= F.col(time)
        free = drawn.join(first, [COMPANY, INVESTOR], "left").filter(~F.coalesce(taken, F.lit(False)))
        turns = Window.partitionBy(key).orderBy("turn")
        free = free.withColumn("slot", F.col("__have") + F.row_number().over(turns) - 1).filter(F.col("slot") < k)
        free = materialize(free.select(key, INVESTOR, "positive", time, F.col(COMPANY).alias("negative"), F.col("slot").cast("bigint"), "turn"), "free")
        done = free if done is None else done.unionByName(free)
        got = done.groupBy(key).agg(F.count(F.lit(1)).alias("__got"))
        walk = walk.drop("__have").join(got, key, "left").withColumn("__have", F.coalesce("__got", F.lit(0)).cast("bigint")).drop("__got")
        walk = materialize(walk.filter(F.col("__have") < k), "walk")
        if walk.isEmpty():
            break
        low, width = high, width * 2
    return done.drop("turn")


def _blocks_of_destinations(embeddings: DataFrame, block: int) -> tuple[DataFrame, int]:
    """``__block, place, id, vec`` in id order, ``block`` destinations a block, and the number of blocks."""
    placed = global_rank(embeddings.filter(F.col("vec").isNotNull()).select("id", "vec"), [F.col("id").asc()], "place", start=0)
    placed = materialize(placed.select("id", "vec", "place", F.floor(F.col("place") / block).cast("int").alias("__block")), "destinations")
    return placed, placed.agg(F.coalesce(F.max("__block") + 1, F.lit(0)).alias("n")).first()["n"]


def _kept(merit: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` largest values of each row, in column order; of equal ones the first."""
    if merit.shape[1] <= keep:
        return np.tile(np.arange(merit.shape[1]), (len(merit), 1))
    limit = np.partition(merit, merit.shape[1] - keep, axis=1)[:, merit.shape[1] - keep, None]
    above, ties = merit > limit, merit == limit
    room = keep - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (ties & (np.cumsum(ties, axis=1) <= room)))[1].reshape(len(merit), keep)


class _Part:
    """The queries of a part with the best destinations met so far: merit, place and similarity."""

    def __init__(self, rows: pa.Table, keep: int, temperature: float | None):
        self.keys, self.keep, self.temperature = rows.column("key").combine_chunks(), keep, temperature
        self.text = [x.encode() for x in rows.column("text").to_pylist()]
        self.vec = np.array(rows.column("vec").to_pylist(), float)
        self.of: dict[object, list[int]] = {}
        for i, x in enumerate(rows.column("source").to_pylist()):
            self.of.setdefault(x, []).append(i)
        n = len(self.text)
        self.merit, self.place, self.sim = np.zeros((n, 0)), np.zeros((n, 0), np.int64), np.zeros((n, 0))

    def _noisy(self, begin: int, sim: np.ndarray, free: np.ndarray, names: list[bytes]) -> np.ndarray:
        """Similarity with Gumbel noise as the column function makes it; the noise of draws too low for the best is left out."""
        out = np.full(sim.shape, -np.inf)
        scaled = np.where(free & ~np.isnan(sim), sim / self.temperature, -np.inf)
        drawn = (draws(self.text[begin : begin + len(sim)], names) + 0.5) / DRAW_RANGE
        least = self.merit[begin : begin + len(sim)].min(axis=1) if self.merit.shape[1] >= self.keep else np.full(len(sim), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            # even on the most similar one, less noise than this is not enough (but for rounding, of either side)
            lowest = np.exp(-np.exp(-(least - scaled.max(axis=1, initial=-np.inf) - 1e-6))) - 1e-12
            lowest = np.where(np.isnan(lowest), 0.0, lowest)
            row, col = np.nonzero((drawn >= lowest[:, None]) & (scaled > -np.inf))
            out[row, col] = np.round(scaled[row, col] - np.log(-np.log(drawn[row, col])), 9)
        return out

    def meet(self, places: np.ndarray, names: list[bytes], vecs: np.ndarray, taken: list[tuple[object, list[int]]]) -> None:
        """Take in a block of destinations, which come later in id order than those before."""
        free = np.ones((len(self.text), len(places)), bool)
        for source, at in taken:
            if source in self.of:
                free[np.ix_(self.of[source], np.searchsorted(places, at))] = False
        merits, at, sims = [], [], []
        for lo in range(0, len(self.text), SCORED_QUERIES):
            some = slice(lo, lo + SCORED_QUERIES)
            sim = self.vec[some] @ vecs.T
            new = np.where(free[some] & ~np.isnan(sim), np.round(sim, 9), -np.inf) if self.temperature is None else self._noisy(lo, sim, free[some], names)
            merit = np.hstack([self.merit[some], new])
            best = _kept(merit, self.keep)
            merits.append(np.take_along_axis(merit, best, 1))
            at.append(np.take_along_axis(np.hstack([self.place[some], np.broadcast_to(places, sim.shape)]), best, 1))
            sims.append(np.take_along_axis(np.hstack([self.sim[some], sim]), best, 1))
        self.merit, self.place, self.sim = np.vstack(merits), np.vstack(at), np.vstack(sims)

    def found(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.text), SCORED_QUERIES):
            row, col = np.nonzero(self.merit[lo : lo + SCORED_QUERIES] > -np.inf)
            row = row + lo
            yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(row)), *[pa.array(x[row, col]) for x in (-self.merit, self.place, self.sim)]], names=["key", "m", "place", "sim"])


def _best_of_blocks(asked: DataFrame, placed: DataFrame, links: DataFrame, key: str, source: str, keep: int, temperature: float | None, seed: int) -> DataFrame:
    """``(key, m, id, sim)``: each query's ``keep`` best destinations that its source is not linked to.

    ``m`` is minus the rounded similarity, or with a temperature minus the noisy one. Rows of a part come in one
    stream: its queries, then per block the destinations and the links of its sources into the block.
    """
    parts = max(1, -(-asked.count() // QUERIES))
    asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "queries")
    text = F.concat(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), F.lit("|"))
    vec = F.col("vec").cast("array<double>")
    long, none = "bigint", lambda t: F.lit(None).cast(t)
    key_type, source_type = asked.schema[key].dataType, asked.schema[source].dataType
    rows = asked.select(
        "part", F.lit(-1).alias("block"), F.lit(0).alias("turn"), F.col(key).alias("key"), text.alias("text"), F.col(source).alias("source"), F.col("__p").cast("array<double>").alias("vec"), none(long).alias("place"), none("array<bigint>").alias("taken")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    ends = placed.select(every.alias("part"), F.col("__block").alias("block"), F.lit(0).alias("turn"), none(key_type).alias("key"), F.col("id").cast("string").alias("text"), none(source_type).alias("source"), vec.alias("vec"), "place", none("array<bigint>").alias("taken"))
    into = links.join(placed.select("id", "place", "__block"), "id").join(asked.select("part", source).distinct(), source).groupBy("part", "__block", source).agg(F.collect_list("place").alias("taken"))
    into = into.select("part", F.col("__block").alias("block"), F.lit(1).alias("turn"), none(key_type).alias("key"), none("string").alias("text"), F.col(source).alias("source"), none("array<double>").alias("vec"), none(long).alias("place"), "taken")
    # blocks of a part are met in order; a part without queries is passed over
    rows = rows.unionByName(ends).unionByName(into).repartition(min(parts, 16 * shuffle_width(asked.sparkSession)), "part").sortWithinPartitions("part", "block", "turn", "place")
    schema = T.StructType([T.StructField("key", key_type), T.StructField("m", T.DoubleType()), T.StructField("place", T.LongType()), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: _Part | None = None
        held: list[pa.RecordBatch] = []
        now = None

        def end_of_block() -> None:
            nonlocal part
            if not held:
                return
            rows = pa.Table.from_batches(held)
            if now[1] < 0:
                part = _Part(rows, keep, temperature)
            elif part is not None:
                turn = rows.column("turn").to_numpy()
                ends, links = rows.filter(pa.array(turn == 0)), rows.filter(pa.array(turn == 1))
                taken = list(zip(links.column("source").to_pylist(), links.column("taken").to_pylist(), strict=True))
                names = [x.encode() for x in ends.column("text").to_pylist()]
                part.meet(ends.column("place").to_numpy(), names, np.array(ends.column("vec").to_pylist(), float), taken)

        for b in batches:
            p, k = b.column("part").to_numpy(), b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(k) != 0)) + 1), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                at = (int(p[lo]), int(k[lo]))
                if at != now:
                    end_of_block()
                    held.clear()
                    if now is not None and at[0] != now[0]:
                        if part is not None:
                            yield from part.found()
                        part = None
                    now = at
                held.append(b.slice(lo, hi - lo))
        end_of_block()
        if part is not None:
            yield from part.found()

    found = rows.mapInArrow(run, schema)
    return found.withColumnRenamed("key", key).join(placed.select("place", "id"), "place").select(key, "m", "id", "sim")


def _free_at(asked: DataFrame, ids: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """The destination at position ``__at`` among the query's free ones, in id order.

    Counts of free destinations per block name the block; only there are they listed.
    """
    free = asked.join(ids.select("__block", F.size("ids").alias("__size")), "__block").withColumn("__free", F.col("__size") - F.size("__taken"))
    upto = F.sum("__free").over(Window.partitionBy(key).orderBy("__block"))
    free = free.withColumn("__low", upto - F.col("__free")).select(key, "__block", "__taken", "__free", "__low")
    at = slots.join(free, key).filter((F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__low") + F.col("__free")))
    at = at.join(ids, "__block").withColumn("negative", F.array_except("ids", "__taken")[(F.col("__at") - F.col("__low")).cast("int")])
    return at.select(key, "slot", "negative")


def hard_negatives(
    queries: DataFrame,
    embeddings: DataFrame,
    n_negatives: int,
    known: DataFrame,
    source: str,
    ratio: float = 0.5,
    temperature: float = 0.1,
    top_k: int | None = None,
    seed: int = 0,
    key: str = "idx",
    positive: str = "positive",
    block: int = DESTINATIONS,
) -> DataFrame:
    """Hard and random negatives of each query ``(key, source, positive)`` among all destinations its source is not linked to.

    The hard part, ``int(n * ratio)`` rows, is drawn without replacement with probability
    proportional to softmax(similarity / temperature): the largest values of
    similarity / temperature + Gumbel noise. ``top_k`` first keeps the most similar
    destinations. The rest is drawn uniformly with replacement.
    ``embeddings(id, vec)`` lists the destinations, ``known(source, negative)`` the links.
    Destinations without a vector take no part, nor do queries whose positive has none.

    A part of the queries meets one block of destinations after the other in one task, and
    of all its pairs only the best of each query leave it.
    """
    n_hard = int(n_negatives * ratio)
    placed, blocks = _blocks_of_destinations(embeddings, block)
    links = known.select(source, F.col("negative").alias("id")).distinct()
    taken = links.join(placed.select("id", "__block"), "id").groupBy(source, "__block").agg(F.collect_list("id").alias("__taken"))
    vec = placed.select(F.col("id").alias(positive), F.col("vec").alias("__p"))
    asked = queries.select(key, source, positive).join(vec.select(positive), positive, "left_semi")
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("__block")).join(taken, [source, "__block"], "left")
    none = F.array().cast(taken.schema["__taken"].dataType)
    asked = materialize(asked.withColumn("__taken", F.coalesce("__taken", none)).drop(source), "asked")

    noisy = lambda sim, other: F.round(sim / temperature + gumbel(seed, key, other), 9)
    keep = n_hard if top_k is None else top_k
    best = _best_of_blocks(queries.select(key, source, positive).join(vec, positive), placed, links, key, source, max(keep, 1), None if top_k is not None else temperature, seed)
    order = Window.partitionBy(key).orderBy("m", "id")
    pool = best.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= keep)
    if top_k is not None:
        pool = pool.withColumn("m", -noisy(F.col("sim"), F.col("id")))
    hard = pool.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < n_hard)
    hard = hard.select(key, "slot", F.col("id").alias("negative"), F.col("sim").alias("similarity"), F.lit("hard").alias("kind"))

    ids = placed.groupBy("__block").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    counts = asked.join(ids.select("__block", F.size("ids").alias("n")), "__block").groupBy(key).agg(F.sum(F.col("n") - F.size("__taken")).alias("__size"))
    start = F.least(F.lit(n_hard), F.col("__size")).cast("int")
    slots = counts.filter((F.col("__size") > 0) & (start < n_negatives)).select(key, "__size", F.explode(F.sequence(start, F.lit(n_negatives - 1))).alias("slot"))
    slots = slots.select(key, "slot", F.pmod(draw_int(seed, key, "slot", F.lit("r")), F.col("__size")).alias("__at"))
    rand = _free_at(asked, ids, slots, key).join(queries.select(key, positive), key).join(vec, positive)
    rand = rand.join(placed.select(F.col("id").alias("negative"), "vec"), "negative")
    rand = rand.select(key, "slot", "negative", dot(F.col("__p"), F.col("vec")).alias("similarity"), F.lit("random").alias("kind"))
    return hard.unionByName(rand)


def bernoulli_edges(scores: DataFrame, samples: int, seed: int = 0, p: str = "p") -> DataFrame:
    """``samples`` random graphs as one row per edge: ``in_samples`` has a 1 for each sample with the edge, in
    order, and ``n_samples`` counts them. An edge is in a sample when its hash-uniform draw is below p; the
    draws are those of ``draw_uniform(seed, sample, company, investor)``, many at a time.
    """
    schema = T.StructType([*scores.schema.fields, T.StructField("in_samples", T.StringType()), T.StructField("n_samples", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [f"{seed}|{i}|".encode() for i in range(samples)]
        for b in batches:
            for lo in range(0, b.num_rows, DRAWN_EDGES):
                some = b.slice(lo, DRAWN_EDGES)
                tails = [f"{c}|{v}".encode() for c, v in zip(some.column(COMPANY).to_pylist(), some.column(INVESTOR).to_pylist(), strict=True)]
                limits = np.array([0.0 if x is None else x for x in some.column(p).to_pylist()], float)
                inside = draws(heads, tails).T / DRAW_RANGE < limits[:, None]
                digits = (inside + ord("0")).astype(np.uint8)
                texts = pa.array([x.tobytes().decode() for x in digits], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, texts, pa.array(inside.sum(axis=1), pa.int64())], names=schema.names)

    # the draws cost far more than the rows, which may lie in a few small files
    return scores.repartition(shuffle_width(scores.sparkSession), COMPANY, INVESTOR).mapInArrow(run, schema)


def funded_before(queries: DataFrame, events: DataFrame, time: str = "ts") -> DataFrame:
    """Queries ``(company, investor, ts)`` whose pair has no event up to the query time."""
    first = events.groupBy(COMPANY, INVESTOR).agg(F.min(time).alias("__first"))
    joined = queries.join(first, [COMPANY, INVESTOR], "left")
    return joined.filter(F.col("__first").isNull() | (F.col("__first") > F.col(time))).drop("__first")


__all__ = [
    "as_of",
    "bernoulli_edges",
    "destinations",
    "funded_before",
    "hard_negatives",
    "overlap_with_edges",
    "plausible_negatives",
    "draw_totals",
    "random_negatives",
]
