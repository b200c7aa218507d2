"""Checklist feeds: filters, group checklists, zero-fill, thinning, taxon roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.geo import in_box
from tallyfield.operators.joins import with_every
from tallyfield.operators.ranks import first_per_key, one_at_random


def comparable(
    lon: Column, lat: Column, duration: Column, protocol: Column, complete: Column,
    box: tuple[float, float, float, float], minutes: tuple[int, int], protocols: Sequence[str],
) -> Column:
    """Complete checklists of the given protocols inside a box and an effort range."""
    return in_box(lon, lat, *box) & duration.between(*minutes) & protocol.isin(*protocols) & complete


def counted(df: DataFrame, count_text: str, name: str) -> DataFrame:
    """Rows with a count (``X`` marks presence without one), the count as a number."""
    return df.where(F.col(count_text) != "X").withColumn(name, F.col(count_text).try_cast("int"))


def collapse_groups(df: DataFrame, event: str, group: str, per: Sequence[str], name: str) -> DataFrame:
    """One copy of each checklist shared by a group; the copy with the smallest event stays."""
    tagged = df.withColumn(
        name, F.coalesce(F.col(group), F.concat(F.lit("S"), F.col(event).cast("string")))
    )
    return first_per_key(tagged, [name, *per], [event])


def zero_fill(checklists: DataFrame, observations: DataFrame, species: DataFrame, key: str, name: str, count: str) -> DataFrame:
    """Every checklist with every species, count 0 where it was not observed.

    A species seen without any count is ``observed`` with a missing count, not
    an absence. Rows without a species name are no observation of one.

    Counts are packed into one map per checklist (as many entries as it has
    species) and joined by checklist; only then do rows multiply, and nothing
    is shuffled after that.
    """
    per_species = observations.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.sum(count).alias("_c"))
    packed = per_species.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(name, "_c"))).alias("_counts")
    )
    names = species.select(name).where(F.col(name).isNotNull()).distinct()
    filled = with_every(checklists.join(packed, key, "left"), names, [key])
    seen = F.coalesce(F.map_contains_key("_counts", F.col(name)), F.lit(False))
    counts = F.when(seen, F.try_element_at("_counts", F.col(name))).otherwise(F.lit(0))
    return filled.withColumns({count: counts, "observed": seen}).drop("_counts")


def roll_up_taxa(observations: DataFrame, taxonomy: DataFrame, key: str, taxon: str, species: str, count_text: str) -> DataFrame:
    """Subspecies counts summed to species; one uncounted ``X`` makes the sum ``X``."""
    named = observations.join(taxonomy, taxon)
    total = F.sum(F.col(count_text).try_cast("long"))
    any_x = F.max((F.col(count_text) == "X").cast("int")) == 1
    return named.groupBy(key, species).agg(
        F.when(any_x, F.lit("X")).otherwise(total.cast("string")).alias(count_text)
    )


def thin_zero_sites(
    df: DataFrame, site: str, year: str, count: str, row_id: str, min_years: int = 11, seed: str = ""
) -> DataFrame:
    """Positive rows, plus one random zero row per site and year.

    Sites that never had a positive count stay only when zeros were recorded in
    at least ``min_years`` different years. Rows are reduced to site years, then
    to sites, to tell which sites stay; only zero rows are joined to that.
    """
    seen, none = F.col(count) > 0, F.col(count) == 0
    years = df.where(seen | none).groupBy(site, year).agg(F.max(seen).alias("_pos"), F.max(none).cast("int").alias("_zero"))
    sites = years.groupBy(site).agg(F.max("_pos").alias("_pos"), F.sum("_zero").alias("_years"))
    keep = sites.where(F.col("_pos") | (F.col("_years") >= min_years)).select(site)
    kept_zero = df.where(none).join(keep, site, "left_semi")
    return df.where(seen).unionByName(one_at_random(kept_zero, [site, year], row_id, seed))
