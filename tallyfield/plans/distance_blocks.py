"""Distance survey: cleaning, species gate, distance x period blocks, on points and on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.aggregates import sufficient_keys
from tallyfield.operators.joins import keep_known, with_every
from tallyfield.operators.pivots import distance_period_block, usable_distances
from tallyfield.operators.spatial import complete_grid

# fixed values: years kept, bin width, bins, periods
YEARS = (2010, 2015)
WIDTH, N_BINS, PERIODS = 50, 5, 6


def clean_survey(survey: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """Rows with a species, a year in range, a usable distance and a known period."""
    named = survey.withColumn("alpha", F.lower("species"))
    ok = F.col("alpha").isNotNull() & F.col("yr").between(*years)
    return named.where(ok & usable_distances(F.col("distance"), F.col("time_period")))


def visit_blocks(clean: DataFrame, at_least: int = 30) -> DataFrame:
    """Blocks per species and visit, for species with enough positive rows."""
    enough = sufficient_keys(clean, "alpha", "cnt", at_least)
    kept = keep_known(clean, enough, ["alpha"], nulls_match=False)
    return distance_period_block(kept, ["alpha", "yr", "transect", "point"], "distance", "time_period", "cnt", WIDTH, N_BINS, PERIODS)


def cell_blocks(clean: DataFrame, cells_of: DataFrame, cells: DataFrame, at_least: int = 30) -> DataFrame:
    """Blocks per species, cell and visit; every species that passes the gate has the whole grid, empty cells with zeros.

    A transect lies in one cell, so rows are folded to visits before the join.
    """
    blocks = visit_blocks(clean, at_least).join(cells_of, "transect")
    species = sufficient_keys(clean, "alpha", "cnt", at_least).select("alpha")
    full = complete_grid(blocks, with_every(cells.select("cell_id"), species, ["cell_id"]), ["cell_id", "alpha"])
    return full.na.fill(0, [c for c in full.columns if c.startswith("count_")])
