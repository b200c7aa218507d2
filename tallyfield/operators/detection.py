"""Detection by distance and removal period; effort and logistic models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import density


def distance_detection(sigma: Column, low: Column, high: Column, cutoff: float) -> Column:
    """Half-normal detection mass of the ring from ``low`` to ``high``."""
    s2 = sigma * sigma
    mass = s2 * (F.exp(-(low * low) / (2 * s2)) - F.exp(-(high * high) / (2 * s2)))
    return 2 * mass / (cutoff * cutoff)


def distance_total(sigma: Column, cutoff: float) -> Column:
    """Sum of :func:`distance_detection` over all rings; the inner terms cancel."""
    return distance_detection(sigma, F.lit(0.0), F.lit(float(cutoff)), cutoff)


def removal_detection(theta: Column, period: Column) -> Column:
    """First detected in ``period`` (1, 2, ...)."""
    return F.pow(1 - theta, period - 1) * theta


def removal_total(theta: Column, periods: int) -> Column:
    return 1 - F.pow(1 - theta, F.lit(periods))


def detection_table(df: DataFrame, sigma: Column, theta: Column, cutoff: float, n_bins: int, periods: int) -> DataFrame:
    """One row per distance bin and period for each row of ``df``, with shares and their product.

    ``sigma`` and ``theta`` may be columns of ``df`` (say, posterior draws).
    ``cell`` numbers the block with distance varying fastest.
    """
    width = cutoff / n_bins
    bins = df.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(n_bins)))).withColumn(
        "r", F.explode(F.sequence(F.lit(1), F.lit(periods)))
    )
    d, r = F.col("d"), F.col("r")
    psi = distance_detection(sigma, (d - 1) * width, d * width, cutoff)
    phi = removal_detection(theta, r)
    shares = bins.withColumns({
        "cell": (r - 1) * n_bins + d,
        "psi_share": psi / distance_total(sigma, cutoff),
        "phi_share": phi / removal_total(theta, periods),
    })
    return shares.withColumn("pi", F.col("psi_share") * F.col("phi_share"))


def binomial_totals(df: DataFrame, total: str, size: str, sigma: Column, theta: Column, cutoff: float, periods: int) -> DataFrame:
    """Log-density of visit totals given abundance and overall detection."""
    p = distance_total(sigma, cutoff) * removal_total(theta, periods)
    return df.withColumn("log_density", density.binomial(F.col(total), F.col(size), p))


def multinomial_blocks(cells: DataFrame, keys: Sequence[str], count: str, share: str) -> DataFrame:
    """Log-density of each visit's bin counts given its total, from long rows.

    Bins without a count add nothing, so they need no rows.
    """
    y = F.col(count)
    sums = cells.groupBy(*keys).agg(
        F.sum(y).alias("n"), F.sum(density.times_log(y, F.col(share)) - density.log_factorial(y)).alias("_s")
    )
    return sums.select(*keys, "n", (F.col("_s") + density.log_factorial(F.col("n"))).alias("log_density"))


def effort_columns(protocol: Column, duration: Column, observers: Column, stationary: str = "Stationary") -> dict[str, Column]:
    """0/1 travel flag, log minutes and log party size; logs of 0 are missing."""
    return {
        "type": F.when(protocol == stationary, 0).otherwise(1),
        "log_duration": F.ln(duration),
        "log_observers": F.ln(observers),
    }


def effort_scale(weights: Sequence[float], covariates: Sequence[Column], *effects: Column) -> Column:
    """``exp(w1 + w2 c1 + ... + effects)``."""
    eta = F.lit(weights[0])
    for w, c in zip(weights[1:], covariates):
        eta = eta + w * c
    for e in effects:
        eta = eta + e
    return F.exp(eta)


def logistic_detection(intercept: float, slopes: Sequence[tuple[float, Column]], *effects: Column) -> Column:
    eta = F.lit(intercept)
    for b, c in slopes:
        eta = eta + b * c
    for e in effects:
        eta = eta + e
    return density.inv_logit(eta)


def gather(df: DataFrame, effects: DataFrame, key: str, effect: str, name: str) -> DataFrame:
    """Look a group effect up by key; a row whose key has no effect is an error that names the key."""
    table = effects.select(F.col(key), F.col(effect).alias(name), F.lit(True).alias("_held"))
    absent = F.raise_error(F.concat(F.lit(f"no {effect} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    joined = df.join(table, key, "left")
    kept = F.when(F.col("_held"), F.col(name)).otherwise(absent.cast(effects.schema[effect].dataType))
    return joined.withColumn(name, kept).drop("_held")
