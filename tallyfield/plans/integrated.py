"""Three feeds on one site and one year index."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.ranks import factor_ids, numbered, with_factor_ids
from tallyfield.session import cut_lineage


def site_index(covariates: DataFrame, site: str, feeds: Mapping[str, DataFrame], year: str) -> DataFrame:
    """Sites of the covariate table seen in any feed, numbered in site order, with their first year.

    Each feed is reduced to one row per site before anything is joined.
    """
    spans = [f.groupBy(site).agg(F.min(year).alias("_first")) for f in feeds.values()]
    seen = reduce(lambda a, b: a.unionByName(b), spans).groupBy(site).agg(F.min("_first").alias("first_year"))
    known = seen.join(covariates.select(site).distinct(), site, "left_semi")
    return numbered(known, [site], name="site_no")


def harmonise(covariates: DataFrame, feeds: Mapping[str, DataFrame], site: str, year: str) -> dict[str, DataFrame]:
    """Each feed with ``site_no`` and ``year_no`` (1 = first year of any feed).

    A feed is read twice: once for the sites, once for the join.
    """
    info = site_index(covariates, site, feeds, year)
    first = info.agg(F.min("first_year")).scalar()
    sites = info.select(site, "site_no")
    return {name: f.join(sites, site).withColumn("year_no", F.col(year) - first + 1) for name, f in feeds.items()}


def harmonise_records(
    covariates: DataFrame, feeds: Mapping[str, DataFrame], site: str, year: str, factors: Mapping[str, Mapping[str, str]]
) -> dict[str, DataFrame]:
    """Each feed row by row, at sites of the covariate table: ``site_no``, ``year_no`` (1 = first year of any kept row), and the ids of its ``factors``.

    Feeds are written once at known sites. Sites, years and all factors of
    all feeds are then numbered from their distinct values together, so the
    number of passes does not grow with the number of factors.
    """
    known = covariates.select(site).distinct()
    kept = {name: cut_lineage(feed.join(known, site, "left_semi")) for name, feed in feeds.items()}
    spans = [f.select(site, F.col(year).alias("_year")).distinct() for f in kept.values()]
    sites = reduce(DataFrame.unionByName, spans).groupBy(site).agg(F.min("_year").alias("_first"))
    info = cut_lineage(numbered(sites, [site], name="site_no"))
    first = info.agg(F.min("_first")).scalar()
    ids = cut_lineage(factor_ids(kept, factors))
    out = {}
    for name, feed in kept.items():
        placed = feed.join(info.select(site, "site_no"), site).withColumn("year_no", (F.col(year) - first + 1).cast("bigint"))
        out[name] = with_factor_ids(placed, name, ids, factors.get(name, {}))
    return out
