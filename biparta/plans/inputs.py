"""Derived inputs that several registered queries share; the Spark side of the SQL pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biparta import fixtures
from biparta.functions.hashing import draw_uniform
from biparta.operators.graph import edge_rollup
from biparta.operators.negatives import destinations, random_negatives
from biparta.operators.ordering import global_rank
from biparta.plans.registry import NEGATIVE_SEED, SCORE_SEED


def edges(spark: SparkSession, d: str) -> DataFrame:
    return edge_rollup(fixtures.investments(spark, d))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """First meeting of each pair, numbered in time order."""
    e = edges(spark, d).select("company", "investor", F.col("first_ts").alias("ts"), F.col("total_raised").alias("raised"), "n_rounds")
    return global_rank(e, [F.col("ts").asc(), F.col("company").asc(), F.col("investor").asc()], "idx", start=0)


def negatives(inter: DataFrame) -> DataFrame:
    return random_negatives(inter, destinations(inter, "investor"), "investor", 1, NEGATIVE_SEED)


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs seen and pairs drawn, with label and a hash-made probability."""
    inter = interactions(spark, d)
    neg = negatives(inter).select("company", F.col("negative").alias("investor"), F.lit(0.0).alias("label"))
    both = inter.select("company", "investor", F.lit(1.0).alias("label")).unionByName(neg)
    p = F.round(draw_uniform(SCORE_SEED, "company", "investor"), 6)
    return both.groupBy("company", "investor").agg(F.max("label").alias("label")).withColumn("p", p)


def categories(spark: SparkSession, d: str) -> DataFrame:
    from biparta.functions.text import split_list

    return fixtures.organizations(spark, d).select(F.col("uuid").alias("company"), split_list(F.col("category_list")).alias("categories"))


def node_maps(spark: SparkSession, d: str) -> DataFrame:
    """``(side, id, name)`` of every part and customer."""
    o, i = fixtures.organizations(spark, d), fixtures.investors(spark, d)
    return o.select(F.lit("company").alias("side"), F.col("uuid").alias("id"), "name").unionByName(
        i.select(F.lit("investor").alias("side"), F.col("uuid").alias("id"), "name")
    )
