"""String and list columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy"]


def split_list(col: Column, sep: str = ",") -> Column:
    """Split, trim, drop empties; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def contains_any(col: Column, keywords: list[str], case_sensitive: bool = False) -> Column:
    """True when the text holds any of the keywords."""
    text = col if case_sensitive else F.lower(col)
    hits = [text.contains(k if case_sensitive else k.strip().lower()) for k in keywords]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def any_item_contains(items: Column, keywords: list[str], case_sensitive: bool = False) -> Column:
    """True when any element of an array holds any of the keywords."""
    return F.coalesce(F.exists(items, lambda x: contains_any(x, keywords, case_sensitive)), F.lit(False))


def parse_date(col: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """First layout that fits; null otherwise."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats])


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets given as arrays; 0 when either one is empty or null."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    filled = (F.size(F.coalesce(a, F.array())) > 0) & (F.size(F.coalesce(b, F.array())) > 0)
    return F.when(filled, both / either).otherwise(F.lit(0.0))
