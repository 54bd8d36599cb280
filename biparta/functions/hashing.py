"""Reproducible draws: md5 based, so that any engine gives the same numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hex digits of the digest, hence draws lie in [0, 2^60).
HEX_DIGITS = 15
DRAW_RANGE = float(16**HEX_DIGITS)


def draw_int(*parts: Column | str | int) -> Column:
    """60-bit non-negative integer drawn from the parts' string forms."""
    cols = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint")


def draw_uniform(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(*parts).cast("double") / F.lit(DRAW_RANGE)


def gumbel(*parts: Column | str | int) -> Column:
    """Standard Gumbel noise; the draw is moved off zero so that its log exists."""
    u = (draw_int(*parts).cast("double") + F.lit(0.5)) / F.lit(DRAW_RANGE)
    return -F.log(-F.log(u))
