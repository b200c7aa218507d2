"""Numeric bins and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(value: Column, width: float, n_bins: int, low: float = 0.0) -> Column:
    """0-based bin, closed on the left, the last one closed on both sides; NULL outside."""
    high = low + width * n_bins
    k = F.floor((value - F.lit(low)) / F.lit(width))
    return F.when((value >= low) & (value <= high), F.least(k, F.lit(n_bins - 1).cast("long")))


def bin_label(value: Column, width: int, n_bins: int) -> Column:
    """``lo_hi`` label of :func:`bin_index`."""
    k = bin_index(value, width, n_bins)
    return F.concat_ws("_", (k * width).cast("string"), ((k + 1) * width).cast("string"))


def bin_labels(width: int, n_bins: int) -> list[str]:
    edges = [i * width for i in range(n_bins + 1)]
    return [f"{lo}_{hi}" for lo, hi in zip(edges[:-1], edges[1:])]


def bin_columns(width: int, n_bins: int, periods: int, prefix: str = "count") -> list[str]:
    """Column names of the distance x period block, distance varying fastest."""
    return [f"{prefix}_{label}_{p}" for p in range(1, periods + 1) for label in bin_labels(width, n_bins)]


def spaced(low: float, high: float, n: int) -> list[float]:
    """``n`` equally spaced numbers from ``low`` to ``high``."""
    return [low + i * (high - low) / (n - 1) for i in range(n)]
