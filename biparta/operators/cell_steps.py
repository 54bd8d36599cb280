"""Steps of the influence ranking on numbered nodes, for runs of many steps.

Nodes are numbered in a hash order; a chunk is a run of numbers, and a vector has one blob of values per chunk. Arcs
lie packed in cells (a range of senders by a range of receivers) that are dealt once and stay where they are. A step
sends each chunk to the cells of its range, adds up inside the cells, and shuffles one blob of sums per cell and chunk.
So a step moves values of nodes, not arcs, and a task holds one cell and two ranges of values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biparta.operators.block_ranking import _add_up, settled
from biparta.operators.graph import COMPANY
from biparta.operators.ordering import global_rank
from biparta.operators.ranking import RankGraph
from biparta.session import materialize

# Nodes of a chunk at most, arcs of a cell on average at most, and arcs that a task packs at once.
CHUNK = 4096
CELL_ARCS = 16_000_000
PACKED_ARCS = 1_000_000


def own_partitions(spark: SparkSession, n: int) -> list[int]:
    """One number for each of n partitions, so that each hashes to a partition of its own."""
    # n times the logarithm of n numbers are enough on average
    found = spark.range(n * (20 + 4 * n.bit_length())).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
    rows = {r["p"]: r["id"] for r in found.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [rows[p] for p in range(n)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs (cell, s, r, w) as one row of blobs per cell and some arcs."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        cell, s, r = (t[c].to_numpy() for c in ("cell", "s", "r"))
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        parts = np.split(order, cuts)
        w = None if t["w"].null_count == t.num_rows else t["w"].to_numpy()
        blobs = [[x[p].astype(kind).tobytes() for p in parts] for x, kind in ((s, "<i4"), (r, "<i4"))]
        ws = [None] * len(parts) if w is None else [w[p].astype("<f8").tobytes() for p in parts]
        return pa.record_batch([pa.array([int(cell[p[0]]) for p in parts], pa.int32()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary()), pa.array(ws, pa.binary())], names=["cell", "s", "r", "w"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= PACKED_ARCS:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def _chunked(width: int, key: pa.DataType):
    """Rows (chunk, node, k, penalty, norm), sorted by number, as one row per chunk; unused places keep the value 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            blank = width - t.num_rows
            k, penalty, norm = (np.pad(t[c].to_numpy(), (0, blank), constant_values=v) for c, v in (("k", 0.0), ("penalty", 0.0), ("norm", 1.0)))
            blobs = [pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (np.concatenate([penalty, norm]), k, k / norm)]
            nodes = pa.array([t["node"].to_pylist()], pa.list_(key))
            return pa.record_batch([pa.array([last], pa.int32()), nodes, *blobs], names=["chunk", "nodes", "facts", "x", "m"])

        for b in batches:
            chunks = b.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end == at:
                    continue
                if held and chunks[at] != last:
                    yield close()
                    held = []
                held.append(b.slice(at, end - at))
                last = int(chunks[at])
        if held:
            yield close()

    return run


class CellGraph:
    """A prepared graph (one run) whose nodes are numbered and whose arcs lie in cells."""

    def __init__(self, graph: RankGraph):
        spark = graph.table.sparkSession
        self.code = graph.code
        self.key = pa.int64() if graph.code.numeric else pa.string()
        self.key_type = "bigint" if graph.code.numeric else "string"
        size, arcs = graph.table.count(), graph.arcs.count()
        self.ranges = math.ceil(math.sqrt(max(spark.sparkContext.defaultParallelism, arcs / CELL_ARCS)))
        self.chunks = max(1, math.ceil(size / (self.ranges * CHUNK)))
        self.width = max(1, math.ceil(size / (self.ranges * self.chunks)))
        self.used = math.ceil(size / self.width)
        labels = own_partitions(spark, self.ranges**2)
        self.labels = F.array(*[F.lit(x) for x in labels])
        self.place_of = {x: divmod(i, self.ranges) for i, x in enumerate(labels)}
        # in hash order, so that nodes with many arcs spread over the ranges
        places = materialize(global_rank(graph.table, [F.xxhash64("node").asc(), F.col("node").asc()], "place", start=0), "places")
        numbered = places.withColumn("chunk", F.floor(F.col("place") / self.width).cast("int"))
        order = numbered.repartition("chunk").sortWithinPartitions("chunk", "place").select("chunk", "node", F.col("k").cast("double").alias("k"), "penalty", "norm")
        schema = f"chunk int, nodes array<{self.key_type}>, facts binary, x binary, m binary"
        self.table = materialize(order.mapInArrow(_chunked(self.width, self.key), schema), "chunks")
        self.facts = self.table.select(F.col("chunk").alias("node"), F.lit(0).alias("part"), F.col("facts").alias("x"))
        self.cells = self._deal(graph, places).persist(StorageLevel.DISK_ONLY)

    def _deal(self, graph: RankGraph, places: DataFrame) -> DataFrame:
        # each pair has an arc of either direction
        w = F.col("w") if graph.weighted else F.lit(None).cast("double")
        pairs = graph.arcs.filter(graph.code.side(F.col("node")) == COMPANY).select("node", "other", w.alias("w"))
        first, second = places.select("node", F.col("place").alias("a")), places.select(F.col("node").alias("other"), F.col("place").alias("b"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("r")), F.struct(F.col("b").alias("s"), F.col("a").alias("r"))))
        arcs = pairs.join(first, "node").join(second, "other").select("w", ends.alias("e")).select("w", "e.*")
        span = self.width * self.chunks
        cell = F.element_at(self.labels, (F.floor(F.col("s") / span) * self.ranges + F.floor(F.col("r") / span) + 1).cast("int"))
        inside = lambda c: (F.col(c) % span).cast("int").alias(c)
        packed = arcs.select(cell.alias("cell"), inside("s"), inside("r"), "w").mapInArrow(_pack, "cell int, s binary, r binary, w binary")
        return packed.repartition(self.ranges**2, "cell")

    def start(self) -> DataFrame:
        """Zero-order vector ``(chunk, x, m)``."""
        return self.table.select("chunk", "x", "m")

    def step(self, vector: DataFrame) -> DataFrame:
        chunks, width, span, place_of = self.chunks, self.width, self.chunks * self.width, self.place_of

        def send(key: tuple, arcs: pa.Table, sent: pa.Table) -> pa.Table:
            sender, receiver = place_of[key[0].as_py()]
            values = np.zeros(span)
            for chunk, m in zip(sent["chunk"].to_pylist(), sent["m"], strict=True):
                at = (chunk - sender * chunks) * width
                values[at : at + width] = np.frombuffer(m.as_buffer(), "<f8")
            sums = np.zeros(span)
            # pieces of a cell, so that no copy of all its arcs is made; their number is bounded by the arcs
            held, n = [], 0
            rows = list(zip(arcs["s"], arcs["r"], arcs["w"], strict=True))
            for i, row in enumerate(rows):
                held.append(row)
                n += len(row[0].as_buffer()) // 4
                if n < PACKED_ARCS and i < len(rows) - 1:
                    continue
                s, r = (np.frombuffer(b"".join([h[c].as_buffer() for h in held]), "<i4") for c in (0, 1))
                x = values[s]
                if held[0][2].is_valid:
                    x = x * np.frombuffer(b"".join([h[2].as_buffer() for h in held]), "<f8")
                sums += np.bincount(r, x, span)
                held, n = [], 0
            blobs = [sums[i * width : (i + 1) * width].tobytes() for i in range(chunks)] if rows else []
            ids = [receiver * chunks + i for i in range(len(blobs))]
            return pa.table([pa.array(ids, pa.int32()), pa.array([1] * len(ids), pa.int32()), pa.array(blobs, pa.binary())], names=["node", "part", "x"])

        first = F.floor(F.col("chunk") / chunks).cast("int") * self.ranges + 1
        messages = vector.select("chunk", "m", F.explode(F.slice(self.labels, first, F.lit(self.ranges))).alias("cell")).repartition(self.ranges**2, "cell")
        sums = self.cells.groupBy("cell").cogroup(messages.groupBy("cell")).applyInArrow(send, "node int, part int, x binary")
        # ranges are rounded up, so the last one may have chunks without nodes
        rows = sums.filter(F.col("node") < self.used).unionByName(self.facts)
        out = rows.repartition("node").sortWithinPartitions("node", "part").mapInArrow(_add_up(width, pa.int32(), True), "node int, x binary, m binary")
        return materialize(out.withColumnRenamed("node", "chunk"), "vector")

    def lists(self, vectors: list[tuple[int, DataFrame]]) -> DataFrame:
        """``(run, side, id, xs)``: each node's values, to 40 bits, in the order of the iterations; ``run`` is 0."""
        marked = [v.select("chunk", F.struct(F.lit(i).alias("i"), F.col("x")).alias("v")) for i, v in vectors]
        rows = reduce(DataFrame.unionByName, marked).groupBy("chunk").agg(F.sort_array(F.collect_list("v")).alias("v"))
        key = self.key

        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for nodes, blobs in zip(b.column("nodes"), b.column("xs"), strict=True):
                    n = len(nodes)
                    values = np.stack([np.frombuffer(x, "<f8")[:n] for x in blobs.as_py()], axis=1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], pa.int32()), pa.array(settled(values.reshape(-1))))
                    yield pa.record_batch([nodes.values.cast(key), lists], names=["node", "xs"])

        # a row holds the values of a chunk in the iterations of a block
        joined = rows.select("chunk", F.col("v.x").alias("xs")).join(self.table.select("chunk", "nodes"), "chunk")
        out = joined.mapInArrow(turn, f"node {self.key_type}, xs array<double>")
        return out.select(F.lit(0).alias("run"), self.code.side(F.col("node")).alias("side"), self.code.node_id(F.col("node")).alias("id"), "xs")

    def close(self) -> None:
        self.cells.unpersist()

