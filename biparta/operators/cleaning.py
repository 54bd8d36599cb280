"""Table cleaning and column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns the entity presets drop, rename or require.
INVESTMENT_DROPS = ["uuid", "permalink", "funding_round_name", "cb_url", "created_at", "updated_at", "rank"]
ORGANIZATION_DROPS = (
    "type permalink cb_url rank created_at updated_at legal_name roles domain homepage_url country_code state_code region city "
    "address postal_code status category_groups_list total_funding total_funding_currency_code founded_on last_funding_on closed_on "
    "employee_count email phone facebook_url twitter_url linkedin_url logo_url alias1 alias2 alias3 primary_role num_exits"
).split()
FUNDING_DROPS = (
    "type permalink cb_url rank funding_round_name created_at updated_at investor_type raised_amount is_lead_investor "
    "post_money_valuation_usd post_money_valuation post_money_valuation_currency_code"
).split()
FUNDING_RENAMES = {"category_list": "category_groups", "uuid": "funding_round_uuid"}
GRAPH_COLUMNS = ["org_name", "investor_name", "org_uuid", "investor_uuid", "raised_amount_usd", "num_investments", "announced_on"]


def drop_if_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def drop_equal_columns(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Drop ``pairs[a]`` where it equals ``a`` on every row; a null makes them differ.

    All pairs are compared in one pass.
    """
    present = [(a, b) for a, b in pairs.items() if a in df.columns and b in df.columns]
    if not present:
        return df
    same = [F.coalesce(F.bool_and(F.coalesce(F.col(a) == F.col(b), F.lit(False))), F.lit(True)).alias(str(i)) for i, (a, b) in enumerate(present)]
    row = df.agg(*same).first()
    return df.drop(*[b for i, (_, b) in enumerate(present) if row[str(i)]])


def drop_null_rows(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.na.drop(subset=present) if present else df


def clean(
    df: DataFrame,
    to_drop: Iterable[str] = (),
    to_rename: dict[str, str] | None = None,
    to_check_double: dict[str, str] | None = None,
    drop_if_nan: Iterable[str] = (),
    sort_by: str = "",
) -> DataFrame:
    """Drop, rename, drop redundant columns, drop incomplete rows, sort; absent columns are skipped."""
    df = rename_present(drop_if_present(df, to_drop), to_rename or {})
    df = drop_null_rows(drop_equal_columns(df, to_check_double or {}), drop_if_nan)
    return df.orderBy(sort_by) if sort_by and sort_by in df.columns else df


def clean_investments(df: DataFrame) -> DataFrame:
    return clean(df, INVESTMENT_DROPS)


def clean_organizations(df: DataFrame) -> DataFrame:
    return clean(df, ORGANIZATION_DROPS)


def clean_funding_rounds(df: DataFrame) -> DataFrame:
    return clean(df, FUNDING_DROPS, FUNDING_RENAMES, drop_if_nan=["name"])


def merge_rounds(rounds: DataFrame, investments: DataFrame, on: str = "funding_round_uuid") -> DataFrame:
    """Rounds joined to their investments, cut to the graph columns, both names present."""
    require_columns(rounds, ["org_name"])
    require_columns(investments, ["investor_name"])
    dup = [c for c in investments.columns if c in rounds.columns and c != on]
    merged = rounds.join(investments.drop(*dup), on)
    return drop_null_rows(keep_existing(merged, GRAPH_COLUMNS), ["org_name", "investor_name"])


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str:
    """First candidate the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {', '.join(candidates)} exists")


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with the same name."""
    names = [f"_{i}" for i in range(len(df.columns))]
    first: dict[str, str] = {}
    for unique, name in zip(names, df.columns, strict=True):
        first.setdefault(name, unique)
    return df.toDF(*names).select(*[F.col(u).alias(n) for n, u in first.items()])


def keep_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def node_key(side: str, name: Column, node_id: Column) -> Column:
    """Prefixed display key; an unmapped node is named after its id."""
    return F.concat(F.lit(f"{side.upper()}_"), F.coalesce(name.cast("string"), F.concat(F.lit(f"{side.lower()}_"), node_id.cast("string"))))


def display_name(key: Column) -> Column:
    """Prefixed key without its side."""
    return F.replace(F.replace(key, F.lit("COMPANY_"), F.lit("")), F.lit("INVESTOR_"), F.lit(""))


def dense_ids(events: DataFrame, col: str, time: str = "ts") -> DataFrame:
    """0-based ids in order of first appearance (time, then name)."""
    from biparta.operators.ordering import global_rank

    seen = events.groupBy(col).agg(F.min(time).alias("first_ts"))
    return global_rank(seen, [F.col("first_ts").asc(), F.col(col).asc()], "dense_id", start=0)


def bipartite_reindex(interactions: DataFrame, user: str = "u", item: str = "i") -> DataFrame:
    """Shift items behind users and start all ids at 1; ids must be contiguous on both sides."""
    row = interactions.agg(
        *[f(c).alias(f"{n}_{c}") for c in (user, item) for n, f in (("max", F.max), ("min", F.min), ("n", F.count_distinct))]
    ).first()
    for c in (user, item):
        if row[f"max_{c}"] - row[f"min_{c}"] + 1 != row[f"n_{c}"]:
            raise ValueError(f"ids of {c} are not contiguous")
    shift = row[f"max_{user}"] + 1
    return interactions.withColumn(user, F.col(user) + 1).withColumn(item, F.col(item) + F.lit(shift) + 1)


def with_padding_row(features: DataFrame, idx: str, vec: str, width: int) -> DataFrame:
    """Feature rows moved to 1.. with a zero row 0 in front."""
    zero = features.sparkSession.range(1).select(F.lit(0).cast("bigint").alias(idx), F.array_repeat(F.lit(0.0), width).alias(vec))
    return features.select((F.col(idx) + 1).cast("bigint").alias(idx), vec).unionByName(zero)
