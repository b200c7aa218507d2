"""Draws of a sampler: thinning, summaries, convergence, maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import density
from tallyfield.functions.text import index_of
from tallyfield.operators.ranks import exact_quantiles


def kept_draws(draws: DataFrame, iteration: str, burn_in: int, thin: int, parameter: str | None = None,
               monitors: Sequence[str] | None = None) -> DataFrame:
    """Draws after the burn-in, every ``thin``-th one, of the monitored parameters."""
    kept = draws.where((F.col(iteration) > burn_in) & ((F.col(iteration) - burn_in) % thin == 0))
    return kept if monitors is None else kept.where(F.col(parameter).isin(*monitors))


def summarise(draws: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median, sample sd and the central 95 % bounds per group.

    Group by the parameter for all chains together, or by parameter and chain.
    """
    by = list(by)
    moments = draws.groupBy(*by).agg(
        F.count(value).alias("n_draws"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    return moments.join(exact_quantiles(draws, by, value, {"median": 0.5, "low": 0.025, "high": 0.975}), by)


def potential_scale(draws: DataFrame, parameter: str, chain: str, value: str) -> DataFrame:
    """Potential scale reduction per parameter (Gelman and Rubin 1992).

    ``rhat`` is the plain ratio of pooled to within-chain variance; ``psrf``
    adds the sampling variance of the grand mean and the correction for the
    degrees of freedom of the pooled variance; ``upper`` is its upper 97.5 % limit, from the
    F distribution of the between-chain share. Chains are reduced to their
    moments first, so the second aggregate sees one row per chain.
    """
    chains = draws.groupBy(parameter, chain).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_samp(value).alias("_v")
    )
    m, v = F.col("_m"), F.col("_v")
    sums = chains.groupBy(parameter).agg(
        F.count("*").alias("n_chains"), F.avg("_n").alias("_n"), F.avg(m).alias("_mean"),
        F.avg(v).alias("within"), F.var_samp(m).alias("_b"), F.var_samp(v).alias("_vv"),
        F.covar_samp(v, m * m).alias("_c2"), F.covar_samp(v, m).alias("_c1"),
    )
    n, k, w, b = F.col("_n"), F.col("n_chains"), F.col("within"), F.col("_b") * F.col("_n")
    grow = 1 + 1 / k
    pooled = w * (n - 1) / n + grow * b / n
    cov = n / k * (F.col("_c2") - 2 * F.col("_mean") * F.col("_c1"))
    spread = (
        (n - 1) * (n - 1) * F.col("_vv") / k + grow * grow * 2 * b * b / (k - 1) + 2 * (n - 1) * grow * cov
    ) / (n * n)
    freedom = 2 * pooled * pooled / spread
    quantile = density.f_quantile(0.975, (k - 1).cast("double"), 2 * w * w * k / F.col("_vv"))
    return sums.select(
        parameter, "n_chains", "within", b.alias("between"),
        F.sqrt((w * (n - 1) / n + F.col("_b")) / w).alias("rhat"),
        F.sqrt((freedom + 3) / (freedom + 1) * pooled / w).alias("psrf"),
        F.sqrt((freedom + 3) / (freedom + 1) * ((n - 1) / n + quantile * grow * b / (n * w))).alias("upper"),
    )


def indexed_parameters(summary: DataFrame, parameter: str, prefix: str) -> DataFrame:
    """Rows of one indexed node, its two indices as columns."""
    rows = summary.where(F.col(parameter).rlike(rf"^{prefix}\["))
    return rows.withColumns({"site": index_of(parameter, 1), "year": index_of(parameter, 2)})


def derived_totals(draws: DataFrame, parameter: str, prefix: str, value: str, by: Sequence[str]) -> DataFrame:
    """``prefix[site, year]`` summed over sites, per draw (``by``) and year: the draws of a total."""
    indexed = indexed_parameters(draws, parameter, prefix)
    return indexed.groupBy(*by, "year").agg(F.sum(value).alias("total"))


def to_grid(summary: DataFrame, cells: DataFrame, site: str = "site") -> DataFrame:
    """Summary rows with the cell they belong to and the log1p mean maps use."""
    return summary.join(cells, site, "left").withColumn("log_mean", F.log1p("mean"))
