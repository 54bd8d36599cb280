"""Merkle manifest of a dataset: a content-addressed store of digest-to-children records, and proofs by descent.

Rows are leaves of one tree per group (``lang``); the roots of the groups are the leaves of a top
tree. H is the lower-case hex sha256 of its inputs' concatenation; digests enter as hex text. Nodes
are paired in rank order until one remains; a last node without a partner is hashed alone.

The store is cut into segments of ``HEIGHT`` levels. A segment is one row: the digest of its top, and
the records (digest, children) of the inner nodes below it. Equal segments have equal digests and are
kept once. A request names a leaf by tree and rank; it starts at the root and joins the store on the
digest that it stands at, then goes down the segment: each binary digit of its rank picks a child, and
the child not picked is collected. Leaves below one node share its descent, so the work of a round is
one row per segment, and there are as many rounds as segments between root and leaf. Collected segments
are reversed at the end, so that a path runs from the leaf to the root.

A task holds one segment: at most 2 ** HEIGHT nodes, whatever the size of a group.

Defined cases: a null field enters a leaf as ``-``; a null group comes first; rows with a null order
column come first in their group, equal order columns go by leaf digest; equal rows are leaves each on
its own; a table of one row has its leaf as root and an empty path; an empty table has no root and no
rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.operators.ordering import global_rank
from biparta.session import materialize

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
# Levels of one segment of the store.
HEIGHT = 8
# The one tree above the groups' roots.
TOP = ""


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each as byte count, colon, value; ``-`` for null."""

    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return hashed(*[framed(c) for c in fields])


def tree_key(group: Column) -> Column:
    """A key that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def _segments(height: int):
    """Rows (tree, block, nodes, whether the tree has one block) to (tree, block, top, digests, children)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops, digests, children = [], [], []
            for i, single in enumerate(b.column("alone").to_pylist()):
                nodes = b.column("nodes")[i].as_py()
                records: dict[str, str] = {}
                level = 0
                while len(nodes) > 1 if single else level < height:
                    pairs = [a + c for a, c in zip(nodes[::2], [*nodes[1::2], ""], strict=False)]
                    nodes = [sha256(p.encode()).hexdigest() for p in pairs]
                    records.update(zip(nodes, pairs, strict=True))
                    level += 1
                tops.append(nodes[0])
                digests.append(list(records))
                children.append(list(records.values()))
            texts = pa.list_(pa.string())
            columns = [b.column("tree"), b.column("block"), pa.array(tops, pa.string()), pa.array(digests, texts), pa.array(children, texts)]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "digest", "digests", "children"])

    return run


@dataclass
class Forest:
    """Trees by their key: ``tops(tree, digest, level)``, and the segments of each level, lowest first."""

    tops: DataFrame
    levels: list[DataFrame]


def build_forest(nodes: DataFrame, height: int = HEIGHT) -> Forest:
    """Hash ``nodes(tree, rank, digest)``, ranks from 0 without gaps, to one digest per tree."""
    levels, tops = [], []
    while True:
        blocks = nodes.groupBy("tree", F.shiftright("rank", height).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("items"))
        counts = nodes.groupBy("tree").agg((F.max("rank") < (1 << height)).alias("alone"))
        rows = blocks.join(counts, "tree").select("tree", "block", F.col("items.digest").alias("nodes"), "alone")
        schema = "tree string, block bigint, digest string, digests array<string>, children array<string>"
        made = materialize(rows.mapInArrow(_segments(height), schema), "segments")
        store = made.groupBy("digest").agg(F.first(F.struct("digests", "children")).alias("s"))
        levels.append(materialize(store.select("digest", "s.digests", "s.children"), "store"))
        several = made.filter("block = 1").select("tree")
        tops.append(made.join(several, "tree", "left_anti").select("tree", "digest", F.lit(len(levels) - 1).alias("level")))
        nodes = made.join(several, "tree", "left_semi").select("tree", F.col("block").alias("rank"), "digest")
        if nodes.isEmpty():
            break
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return Forest(materialize(every, "tops"), levels)


def _descend():
    """Rows with a segment, the places asked for, and the path above to one row per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (row,) = b.slice(i, 1).to_pylist()
                out: dict[str, list] = {k: [] for k in ("tree", "rank", "digest", "siblings", "right")}
                children = dict(zip(row["digests"], row["children"], strict=True))
                depth, at = 0, row["digest"]
                while at in children:
                    depth, at = depth + 1, children[at][:64]
                above, above_right = row["siblings"], row["right"]
                for rank in row["ranks"]:
                    at, path, right = row["digest"], [], []
                    for bit in range(depth - 1, -1, -1):
                        pair, digit = children[at], rank >> bit & 1
                        at = pair[64 * digit : 64 * digit + 64]
                        path.append((pair[:64] if digit else pair[64:]) or None)
                        right.append(bool(digit))
                    out["tree"].append(row["tree"])
                    out["rank"].append(rank)
                    out["digest"].append(at)
                    out["siblings"].append(path[::-1] + above)
                    out["right"].append(right[::-1] + above_right)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["tree"], pa.string()),
                        pa.array(out["rank"], pa.int64()),
                        pa.array(out["digest"], pa.string()),
                        pa.array(out["siblings"], pa.list_(pa.string())),
                        pa.array(out["right"], pa.list_(pa.bool_())),
                    ],
                    names=list(out),
                )

    return run


_PATH = "tree string, rank bigint, digest string, siblings array<string>, right array<boolean>"


def find_paths(forest: Forest, wanted: DataFrame, starts: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """Path of each leaf in ``wanted(tree, rank)``: ``(tree, rank, digest, siblings, right)``, from the leaf up.

    ``siblings`` holds null where a node was hashed alone; ``right`` says whether the node on the path was
    the second of its pair. ``starts(tree, siblings, right)`` gives the path above each tree's root.
    """
    none = [F.array().cast("array<string>").alias("siblings"), F.array().cast("array<boolean>").alias("right")]
    heads = forest.tops.select("*", *none) if starts is None else forest.tops.join(starts, "tree")
    asked = wanted.select("tree", "rank").distinct()
    below = None
    for level in range(len(forest.levels) - 1, -1, -1):
        here = heads.filter(F.col("level") == level).select("tree", F.lit(0).cast("bigint").alias("block"), "digest", "siblings", "right")
        if below is not None:
            here = here.unionByName(below.withColumnRenamed("rank", "block"))
        places = asked.select("tree", F.shiftright("rank", height * level).alias("place")).distinct()
        # at most 2 ** height places of a block
        places = places.groupBy("tree", F.shiftright("place", height).alias("block")).agg(F.collect_list("place").alias("ranks"))
        rows = here.join(places, ["tree", "block"]).join(forest.levels[level], "digest")
        below = rows.mapInArrow(_descend(), _PATH)
        if level:
            below = materialize(below, "paths")
    return below


def fold(leaf: Column, siblings: Column, right: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def step(acc: Column, s: Column) -> Column:
        sibling = s["sibling"]
        return F.sha2(F.when(sibling.isNull(), acc).when(s["right"], F.concat(sibling, acc)).otherwise(F.concat(acc, sibling)), 256)

    return F.aggregate(F.zip_with(siblings, right, lambda a, b: F.struct(a.alias("sibling"), b.alias("right"))), leaf, step)


def proof_digest(siblings: Column) -> Column:
    """H of the siblings of a path."""
    return F.sha2(F.array_join(siblings, ""), 256)


@dataclass
class Manifest:
    """``leaves(tree, rank, leaf, ..)``, the groups' forest, and the top tree over ``groups(tree, rank, digest)``."""

    leaves: DataFrame
    forest: Forest
    groups: DataFrame
    top: Forest

    def root(self) -> DataFrame:
        return self.top.tops.select(F.col("digest").alias("root"))

    def records(self) -> DataFrame:
        """The whole store as ``(digest, children)``, one row per distinct inner node."""
        every = None
        for level in [*self.forest.levels, *self.top.levels]:
            pairs = level.select(F.explode(F.arrays_zip("digests", "children")).alias("r")).select(F.col("r.digests").alias("digest"), F.col("r.children").alias("children"))
            every = pairs if every is None else every.unionByName(pairs)
        return every.distinct()


def build_manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """Hash all rows; ``carry`` names further values that stay with a row's leaf."""
    rows = docs.select(
        tree_key(F.col(group)).alias("tree"),
        F.col(order).alias("place"),
        leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        *[c.alias(n) for n, c in (carry or {}).items()],
    )
    # the number breaks ties of equal rows and is written before it is sorted by, so that reruns agree
    rows = materialize(rows.withColumn("turn", F.monotonically_increasing_id()), "leaves")
    ranked = global_rank(rows, [F.col("place").asc_nulls_first(), F.col("leaf").asc(), F.col("turn").asc()], "rank", start=0, by=("tree",))
    leaves = materialize(ranked.drop("turn"), "ranked-leaves")
    forest = build_forest(leaves.select("tree", "rank", F.col("leaf").alias("digest")), height)
    ordered = global_rank(forest.tops.select(F.col("tree").alias("group"), "digest"), [F.col("group").asc()], "rank", start=0)
    groups = materialize(ordered.select("group", F.lit(TOP).alias("tree"), "rank", "digest"), "groups")
    return Manifest(leaves, forest, groups, build_forest(groups.select("tree", "rank", "digest"), height))


def prove(manifest: Manifest, wanted: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Path from each leaf in ``wanted(tree, rank)`` to the root, with the root and the root of its tree:
    ``(tree, rank, digest, siblings, right, subroot, root)``."""
    above = find_paths(manifest.top, manifest.groups, height=height).select(F.col("rank").alias("at"), "siblings", "right")
    starts = manifest.groups.select(F.col("group").alias("tree"), F.col("rank").alias("at"), F.col("digest").alias("subroot")).join(above, "at").drop("at")
    starts = materialize(starts, "starts")
    paths = find_paths(manifest.forest, wanted, starts.drop("subroot"), height)
    # the root is one row
    return paths.join(starts.select("tree", "subroot"), "tree").withColumn("root", manifest.root().scalar())


def verify(docs: DataFrame, tampered: Column, changed: Column, height: int = HEIGHT) -> DataFrame:
    """Prove every row, then fold the paths of leaves of which some are tampered with.

    ``changed`` stands in for ``n_chars`` where ``tampered`` holds. Returns
    ``doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified``.
    """
    other = leaf_digest([F.when(tampered, changed).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in FIELDS])
    hit = F.coalesce(tampered, F.lit(False))
    m = build_manifest(docs, carry={"shown": F.when(hit, other)}, height=height)
    rows = m.leaves.join(prove(m, m.leaves, height), ["tree", "rank"])
    folded = fold(F.coalesce("shown", "leaf"), F.col("siblings"), F.col("right"))
    return rows.select(
        F.col("place").alias("doc_id"), "leaf", "subroot", "root", F.col("siblings").alias("proof"), proof_digest(F.col("siblings")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

