"""Scalar numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(col: Column, default: float = 0.0) -> Column:
    """Parse as double; null, bad or NaN values give the default."""
    value = col.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value)


def safe_long(col: Column, default: int = 0) -> Column:
    """Parse as a number and cut to a whole one; null or bad values give the default."""
    value = col.try_cast("double")
    whole = F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value)
    return F.coalesce(whole.try_cast("bigint"), F.lit(default).cast("bigint"))


def epoch_seconds(ts: Column) -> Column:
    """Timestamp (with or without zone, session zone UTC) to epoch seconds."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1000000.0)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1000000).cast("bigint"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two epoch-second values, rounded down."""
    return F.floor((later - earlier) / 86400.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def relative_delta(after: Column, before: Column, epsilon: float = 1e-8) -> Column:
    return (after - before) / (before + F.lit(epsilon))


def degree_weight(degree: Column, alpha: float) -> Column:
    """``max(degree, 1) ** -alpha``"""
    return F.pow(F.greatest(degree.cast("double"), F.lit(1.0)), F.lit(-alpha))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


# Lower bounds and wording of the correlation classes.
CORRELATION_CLASSES = [
    (0.9, "Very strong positive correlation (rankings are very similar)"),
    (0.7, "Strong positive correlation (rankings are similar)"),
    (0.5, "Moderate positive correlation (some similarity in rankings)"),
    (0.3, "Weak positive correlation (rankings differ significantly)"),
    (-0.3, "No correlation (rankings are independent)"),
]
CORRELATION_BELOW = "Negative correlation (rankings are inverted)"


def correlation_label(rho: Column) -> Column:
    (first, text), *rest = CORRELATION_CLASSES
    label = F.when(rho > first, text)
    for bound, text in rest:
        label = label.when(rho > bound, text)
    return label.otherwise(CORRELATION_BELOW)
