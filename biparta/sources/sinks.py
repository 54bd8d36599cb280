"""Writers for the tables the jobs hand on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biparta.operators.graph import COMPANY, INVESTOR
from biparta.operators.metrics import top_pairs
from biparta.operators.relational import lookup
from biparta.operators.splits import nodes_per_split, split_metadata


def write_interactions(interactions: DataFrame, maps: DataFrame, path: str) -> None:
    """Interactions with their features, and one id map per side."""
    interactions.write.mode("overwrite").parquet(f"{path}/interactions")
    for side in (COMPANY, INVESTOR):
        maps.filter(F.col("side") == side).select("id", "name").write.mode("overwrite").parquet(f"{path}/{side}_map")


def write_splits(labelled: DataFrame, nodes: DataFrame, path: str) -> None:
    """Edges and node attributes partitioned by split, and the split figures."""
    labelled.write.mode("overwrite").partitionBy("split").parquet(f"{path}/edges")
    nodes_per_split(labelled, nodes).write.mode("overwrite").partitionBy("split").parquet(f"{path}/nodes")
    split_metadata(labelled, "first_ts" if "first_ts" in labelled.columns else "ts").write.mode("overwrite").parquet(f"{path}/metadata")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as parquet, and the flat edge columns as CSV."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    flat = [f.name for f in edges.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    edges.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/edges_csv")


# Column order of a rank file.
RANK_COLUMNS = ["side", "rank", "id", "score", "ground_truth_rank", "ground_truth_score", "initial_position"]


def write_ranks(ranks: DataFrame, path: str) -> None:
    """Rank table, the columns that exist, one folder per side."""
    cols = [c for c in RANK_COLUMNS if c in ranks.columns]
    ranks.select(*cols).write.mode("overwrite").partitionBy("side").option("header", True).csv(path)


def named_top_pairs(scores: DataFrame, companies: DataFrame, investors: DataFrame, k: int) -> DataFrame:
    """The k best pairs with names; unmapped ids get a default name."""
    best = top_pairs(scores, k)
    for side, names in ((COMPANY, companies), (INVESTOR, investors)):
        table = names.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
        best = lookup(best, table, side, f"{side}_name", F.concat(F.lit(f"{side}_"), F.col(side).cast("string")))
    return best.select("place", COMPANY, INVESTOR, f"{COMPANY}_name", f"{INVESTOR}_name", "p")


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with header; with ``digits`` doubles are rounded."""
    if digits is not None:
        df = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
