"""Rounding and KPI text formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c: Column, places: int) -> Column:
    """Half-even rounding as the report tables use (``round`` is half-up)."""
    return F.bround(c, places)


def fmt_fixed(c: Column, places: int) -> Column:
    """``0.35`` style text."""
    return F.format_string(f"%.{places}f", c)


def fmt_count(c: Column) -> Column:
    """``1,234`` style text."""
    return F.format_number(c.cast("double"), 0)


def fmt_percent(c: Column, places: int = 2) -> Column:
    """``6.64%`` style text."""
    return F.concat(F.format_string(f"%.{places}f", c * 100), F.lit("%"))


def fmt_mean_std(mean: Column, std: Column, places: int = 3) -> Column:
    """``mean ± std`` text."""
    return F.format_string(f"%.{places}f ± %.{places}f", mean, std)
