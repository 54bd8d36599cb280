"""The test tables seen as investment data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biparta.functions.numeric import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as companies; type, brand and name words are their categories."""
    p = table(spark, sf_dir, "part")
    cats = F.concat_ws(",", "p_type", "p_brand", F.replace(F.col("p_name"), F.lit(" "), F.lit(",")))
    return p.select(
        F.col("p_partkey").alias("uuid"),
        F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")).alias("name"),
        cats.alias("category_list"),
        F.col("p_retailprice").alias("rank"),
        F.col("p_name").alias("short_description"),
    )


def investors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.col("c_name").alias("name"))


def funding_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("uuid"),
        F.col("o_custkey").alias("investor_uuid"),
        epoch_seconds(F.col("o_orderdate")).alias("announced_ts"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("announced_on"),
        F.col("o_totalprice").alias("round_total"),
        F.col("o_orderstatus").alias("status"),
    )


def investments(spark: SparkSession, sf_dir: str, company: str = "l_partkey") -> DataFrame:
    """Merged rounds: company, investor, ts, raised, round_id."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col(company).alias("company"),
        F.col("o_custkey").alias("investor"),
        epoch_seconds(F.col("o_orderdate")).alias("ts"),
        F.col("l_extendedprice").alias("raised"),
        F.col("o_orderkey").alias("round_id"),
    )


def node_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), F.col("user_id").alias("id"), epoch_seconds(F.col("ts")).alias("ts"), "event_type", "value", F.col("ts").cast("timestamp").alias("time")
    )


def company_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.lit("company").alias("side"), F.col("p_partkey").alias("id"))
    return parts.unionByName(table(spark, sf_dir, "customer").select(F.lit("investor").alias("side"), F.col("c_custkey").alias("id")))
