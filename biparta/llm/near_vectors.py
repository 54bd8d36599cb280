"""Embedding near-duplicates by collision-counting projections.

Vectors of length one are projected on many random directions. On one direction two
vectors collide if the second lies in a window centred on the first; at the threshold
cosine the projections differ by a normal variable of known spread, so the number of
collisions over all directions is binomial, and the least count that a pair must reach is
calibrated to the wanted recall. Pairs that reach it are verified by the cosine itself.

To meet at all, vectors are sorted into cells: each of ``TABLES`` tables cuts ``DEPTH``
directions at the cell width and keys a vector by the cells it falls into. Both the chance
to share a cell and the count are functions of the threshold, not of the data. A pair that
shares cells in several tables belongs to the first of them, so each pair is counted once,
tasks can add up links on their own, and no table of pairs exists: a task hands back, per
vector, the number of its links and one edge of a local spanning forest.

Equal vectors of a label form one class that carries their number. Cells with many classes
are cut into blocks, and each pair of blocks is its own task.

Defined cases: a null label, or a vector that is null, empty, zero or holds a component
that is null or not finite, links with nothing and is its own component; vectors of
different length do not link; labels of any plain type are compared as they are; a repeated id counts as often as it occurs; rows without an
id link like others but never name a component unless all of it lacks ids; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.llm.arrow_groups import in_groups
from biparta.llm.vectors import is_vector, matrix
from biparta.operators.components import star_components
from biparta.session import materialize

COSINE = 0.93
TABLES = 20
DEPTH = 8
# In units of the spread of a unit vector's projection.
CELL = 2.0
WINDOW = 0.5
COUNT_RECALL = 0.9999
SEED = 29
BLOCK = 1_000
PAIRS = 50_000


def least_count(cosine: float, directions: int, window: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with the wanted probability."""
    spread = math.sqrt(2 - 2 * cosine)
    p = math.erf(window / spread / math.sqrt(2)) if spread > 0 else 1.0
    tail = 0.0
    for c in range(directions, -1, -1):
        tail += math.comb(directions, c) * p**c * (1 - p) ** (directions - c)
        if tail >= recall:
            return c
    return 0


class Directions:
    """Random directions and cell offsets for vectors of one length."""

    def __init__(self, d: int, tables: int = TABLES, depth: int = DEPTH, seed: int = SEED):
        draw = np.random.default_rng([seed, d])
        self.tables, self.depth = tables, depth
        self.a = draw.standard_normal((d, tables * depth))
        self.offset = draw.random(tables * depth) * CELL

    def project(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.a

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One number per row and table for the cells of its directions."""
        cells = np.floor((self.project(unit) + self.offset) / CELL).astype(np.int64).reshape(len(unit), self.tables, self.depth)
        key = np.zeros(cells.shape[:2], np.int64)
        for i in range(self.depth):
            key = (key ^ cells[:, :, i]) * np.int64(0x2545F4914F6CDD1D)
            key ^= key >> 29
        return key


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; an exact scaling by a power of two keeps squares from overflowing."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def local_forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(directions: dict[int, Directions], cosine: float, count: int):
    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        d = directions[held[0][0].shape[1]]
        unit = unit_rows(np.concatenate([h[0] for h in held]))
        node, mult, keys = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        at = d.project(unit).astype(np.float32)
        shift, us, vs, tables = 0, [], [], []
        for x, _, _, _, own, table, i, j in held:
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            u, v = np.repeat(a, len(b)), np.tile(b, len(a))
            if i == j:
                u, v = u[u < v], v[u < v]
            us.append(u + shift)
            vs.append(v + shift)
            tables.append(np.full(len(u), table))
            shift += len(x)
        u, v, table = np.concatenate(us), np.concatenate(vs), np.concatenate(tables)
        found_u, found_v = [], []
        for s in range(0, len(u), PAIRS):
            a, b, t = u[s : s + PAIRS], v[s : s + PAIRS], table[s : s + PAIRS]
            # a pair belongs to the first table whose cells it shares
            first = (keys[a] == keys[b]).argmax(axis=1) == t
            a, b = a[first], b[first]
            close = (np.abs(at[a] - at[b]) <= WINDOW).sum(axis=1) >= count
            a, b = a[close], b[close]
            linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            found_u.append(a[linked])
            found_v.append(b[linked])
        u, v = np.concatenate(found_u), np.concatenate(found_v)
        links = np.bincount(u, weights=mult[v], minlength=len(node)) + np.bincount(v, weights=mult[u], minlength=len(node))
        root = local_forest(u, v, len(node))
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some].astype(np.int64))], names=["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        width = 0
        for t in in_groups(batches, ["label", "d", "table", "key", "i", "j"]):
            x = matrix(t["v"])
            if held and (held[0][0].shape[1] != x.shape[1] or width >= 4 * PAIRS):
                yield from settle(held)
                held, width = [], 0
            keys = np.frombuffer(b"".join(t["keys"].to_pylist()), np.int64).reshape(len(x), -1)
            held.append((x, t["node"].to_numpy(), t["mult"].to_numpy(), keys, t["own"].to_numpy(), t["table"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()))
            width += len(x) ** 2
        if held:
            yield from settle(held)

    return run


def label_text(vectors: DataFrame, label_col: str) -> Column:
    """Equal labels have equal texts, labels that differ have not, whatever their type."""
    label = F.col(label_col)
    if vectors.schema[label_col].dataType.typeName() in ("float", "double"):
        label = label + F.lit(0.0)  # one zero
    return label.cast("string")


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, depth: int = DEPTH, block: int = BLOCK
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), label_text(vectors, label_col).alias("label"))
    good = F.col("label").isNotNull() & is_vector(F.col("v"))
    classes = rows.filter(good).groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("mult"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "vector-classes")
    lengths = [r["d"] for r in classes.select("d").distinct().collect()]
    directions = {d: Directions(d, tables, depth) for d in lengths}
    count = least_count(cosine, tables * depth, WINDOW, COUNT_RECALL)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(1).to_numpy()
            keys = [b""] * b.num_rows
            for length in np.unique(d).tolist():
                at = np.flatnonzero(d == length)
                k = directions[length].keys(unit_rows(matrix(b.column(2).take(pa.array(at)))))
                for i, row in zip(at.tolist(), k, strict=True):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], names=["node", "keys"])

    keyed = materialize(classes.select("node", "d", "v").mapInArrow(place, "node bigint, keys binary"), "vector-keys")
    full = materialize(classes.join(keyed, "node").select("node", "label", "d", "v", "mult", "keys"), "vectors")
    spots = full.select("node", "label", "d", "v", "mult", "keys", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table"))
    spots = spots.withColumn("key", F.conv(F.hex(F.substring("keys", F.col("table") * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))
    sizes = spots.groupBy("label", "d", "table", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    dealt = spots.join(sizes, ["label", "d", "table", "key"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts").cast("bigint")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("label", "d", "table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "mult", "v", "keys")
    group = ["label", "d", "table", "key", "i", "j"]
    dealt = dealt.repartition(*group).sortWithinPartitions("d", *[g for g in group if g != "d"])
    partial = materialize(dealt.mapInArrow(_links(directions, cosine, count), "node bigint, root bigint, links bigint"), "vector-links")
    totals = partial.groupBy("node").agg(F.sum("links").alias("links"))
    edges = partial.filter(F.col("node") != F.col("root")).select(F.col("root").alias("u"), F.col("node").alias("v")).distinct()
    labels = materialize(star_components(edges), "vector-labels")
    named = classes.select("node", "label", "v", "first_id", "mult").join(labels, "node", "left").join(totals, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = materialize(
        named.join(smallest, "component").select(F.col("label").alias("c_label"), F.col("v").alias("c_v"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), "component_id"), "vector-found"
    )
    key = F.when(good, F.col("v"))
    out = rows.join(found, (key == F.col("c_v")) & (F.col("label") == F.col("c_label")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
