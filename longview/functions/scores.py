"""Clamps, bands and weighted sums as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def band(x: Column, cuts: list[tuple[float, str]], top: str) -> Column:
    """The name of the first cut that x is below, else top."""
    out = F.lit(top)
    for cut, name in reversed(cuts):
        out = F.when(x < cut, name).otherwise(out)
    return out


def weighted(parts: dict[str, float], digits: int = 4) -> Column:
    """The sum of columns by weight, in the order given."""
    total = None
    for name, w in parts.items():
        term = F.col(name) * F.lit(w)
        total = term if total is None else total + term
    return F.round(total, digits)


def level(x: Column) -> Column:
    return band(x, [(0.34, "LOW"), (0.67, "MODERATE")], "HIGH")


def window_state(x: Column) -> Column:
    return band(x, [(0.25, "STABLE"), (0.5, "LOW_ACTIVITY"), (0.75, "MODERATE_ACTIVITY")], "HIGH_ACTIVITY")


def pct(n: Column, d: Column) -> Column:
    """100 * n / d to two digits; 0 where d is 0."""
    return F.when(d > 0, F.round(F.lit(100.0) * n / d, 2)).otherwise(F.lit(0.0))


def signed(x: Column) -> Column:
    return F.format_string("Δ%+.4f", x)
