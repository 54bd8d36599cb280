"""Filters, joins and grouped reports that are not tied to one graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biparta.functions.text import any_item_contains, contains_any, parse_date, split_list
from biparta.operators.graph import COMPANY, INVESTOR


def keyword_or_description(df: DataFrame, keywords: list[str], categories: str, description: str) -> DataFrame:
    """Rows whose category list or description holds a keyword, in any case."""
    joined = F.concat_ws(" ", split_list(F.col(categories)))
    return df.filter(contains_any(joined, keywords) | contains_any(F.col(description), keywords))


def keyword_filter(df: DataFrame, keywords: list[str], categories: str, case_sensitive: bool = False) -> DataFrame:
    """Rows with a category that holds a keyword."""
    return df.filter(any_item_contains(split_list(F.col(categories)), keywords, case_sensitive))


def joined_keyword_filter(df: DataFrame, keywords: list[str], categories: str) -> DataFrame:
    """Rows whose categories, joined by blanks, hold a keyword (may span two categories)."""
    return df.filter(contains_any(F.concat_ws(" ", split_list(F.col(categories))), keywords))


def matched_categories(df: DataFrame, keywords: list[str], categories: str) -> DataFrame:
    """The distinct categories that hold a keyword, with their number of rows."""
    items = df.select(F.explode(F.array_distinct(split_list(F.col(categories)))).alias("category"))
    return items.filter(contains_any(F.col("category"), keywords)).groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


def valid_dates(df: DataFrame, col: str, name: str = "ts") -> DataFrame:
    """Rows whose date parses, with the parsed value."""
    return df.withColumn(name, parse_date(F.col(col))).filter(F.col(name).isNotNull())


def up_to(df: DataFrame, time: str, cutoff: Column | float) -> DataFrame:
    return df.filter(F.col(time) <= cutoff)


def with_history(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys with at least n rows, most rows first."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= n)
    return counts.orderBy(F.col("rows").desc(), *[F.col(k).asc() for k in keys])


def lookup(df: DataFrame, names: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    """Attach a name by key, or the default. Spark broadcasts ``names`` when it is small enough."""
    return df.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), default))


def round_history(rounds: DataFrame, companies: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rounds of the wanted companies in date order: one semi-join instead of a query per company."""
    return rounds.join(companies.select(key).distinct(), key, "left_semi").orderBy(*order)


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group; Spark cuts each group to k rows before the shuffle too."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def time_span(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.datediff(F.to_date(F.max(time)), F.to_date(F.min(time))).alias("days"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (company, investor) rows: the adjacency sets, one member per row."""
    return edges.select(COMPANY, INVESTOR).distinct()


def coinvestors_of(edges: DataFrame, investor) -> DataFrame:
    """Investors that share a company with one given investor, with the number shared."""
    own = edges.filter(F.col(INVESTOR) == F.lit(investor)).select(COMPANY).distinct()
    near = edges.join(own, COMPANY, "left_semi").filter(F.col(INVESTOR) != F.lit(investor))
    return near.groupBy(INVESTOR).agg(F.count_distinct(COMPANY).alias("shared"))
