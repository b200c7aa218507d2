"""Log-density of all data per draw, from statistics of the data.

A draw changes parameters, not data, so every term of the log-density is
written in sums over the data that hold for all draws. Each set of sums is one
aggregate with one row; draws meet that row only, whatever the data's size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import density
from tallyfield.operators.detection import distance_detection, distance_total, removal_detection, removal_total


def count_statistics(df: DataFrame, count: str) -> DataFrame:
    """Sum, number and log-factorials of counts with one common rate."""
    y = F.col(count)
    return df.agg(F.sum(y).alias("sum"), F.count(y).alias("n"), F.sum(density.log_factorial(y)).alias("factorials"))


def poisson_term(stats: Column, mu: Column) -> Column:
    """Poisson log-density of all counts."""
    return stats.getField("sum") * F.ln(mu) - stats.getField("n") * mu - stats.getField("factorials")


def visit_statistics(df: DataFrame, total: str, size: str) -> DataFrame:
    """Detected, present and log-coefficients of visits that detect ``total`` of ``size`` animals."""
    y, n = F.col(total), F.col(size)
    ways = density.log_factorial(n) - density.log_factorial(y) - density.log_factorial(n - y)
    return df.agg(F.sum(y).alias("detected"), F.sum(n).alias("present"), F.sum(ways).alias("ways"))


def binomial_term(stats: Column, p: Column) -> Column:
    """Binomial log-density of all visit totals with detection ``p``."""
    y, n = stats.getField("detected"), stats.getField("present")
    return stats.getField("ways") + y * F.ln(p) + (n - y) * F.ln(1 - p)


def block_statistics(cells: DataFrame, visit: Sequence[str], count: str, n_bins: int, periods: int) -> DataFrame:
    """Totals per distance bin ``d`` and period ``r`` over all visits, and the log-coefficients of the blocks.

    ``cells`` has one row per visit, bin and period; visits are reduced first.
    """
    y = F.col(count)
    margins = {f"d{d}": F.col("d") == d for d in range(1, n_bins + 1)} | {f"r{r}": F.col("r") == r for r in range(1, periods + 1)}
    sums = [F.sum(F.when(is_in, y).otherwise(0)).alias(name) for name, is_in in margins.items()]
    visits = cells.groupBy(*visit).agg(*sums, F.sum(y).alias("_n"), F.sum(density.log_factorial(y)).alias("_f"))
    return visits.agg(
        *[F.sum(name).alias(name) for name in margins], F.sum(density.log_factorial(F.col("_n")) - F.col("_f")).alias("ways")
    )


def multinomial_term(stats: Column, sigma: Column, theta: Column, cutoff: float, n_bins: int, periods: int) -> Column:
    """Multinomial log-density of all blocks; shares are products, so their logarithms part into bins and periods."""
    width = cutoff / n_bins
    out = stats.getField("ways")
    for d in range(1, n_bins + 1):
        ring = distance_detection(sigma, F.lit((d - 1) * width), F.lit(d * width), cutoff)
        out = out + stats.getField(f"d{d}") * F.ln(ring / distance_total(sigma, cutoff))
    for r in range(1, periods + 1):
        out = out + stats.getField(f"r{r}") * F.ln(removal_detection(theta, F.lit(r)) / removal_total(theta, periods))
    return out


def effect_statistics(df: DataFrame, effect: str) -> DataFrame:
    """Number and sum of squares of group effects around zero."""
    e = F.col(effect)
    return df.agg(F.count(e).alias("n"), F.sum(e * e).alias("squares"))


def effect_term(stats: Column, sd: Column) -> Column:
    """Normal log-density of all group effects with the draw's spread."""
    n = stats.getField("n")
    return -n * (0.5 * math.log(2 * math.pi) + F.ln(sd)) - stats.getField("squares") / (2 * sd * sd)


def neighbour_term(stats: Column, tau: Column) -> Column:
    """Intrinsic autoregressive log-density with the draw's precision, from ``energy`` and ``rank``."""
    return stats.getField("rank") / 2 * (F.ln(tau) - math.log(2 * math.pi)) - tau / 2 * stats.getField("energy")


def one_row(stats: DataFrame) -> Column:
    """A table of one row as a struct other plans can use."""
    return stats.select(F.struct(*stats.columns)).scalar()


def staged_total(draws: DataFrame, keys: Sequence[str], terms: Mapping[str, Column]) -> DataFrame:
    """Each term per draw, and their sum as ``total``."""
    parts = draws.select(*keys, *[term.alias(name) for name, term in terms.items()])
    total = F.lit(0.0)
    for name in terms:
        total = total + F.col(name)
    return parts.withColumn("total", total)
