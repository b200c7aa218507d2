"""Checklists to species points: filter, reduce, gate, project, date parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.geo import Albers
from tallyfield.operators.aggregates import sufficient_keys
from tallyfield.operators.checklists import collapse_groups, comparable, counted, zero_fill
from tallyfield.operators.joins import keep_common, keep_known, natural_join
from tallyfield.operators.ranks import first_per_key
from tallyfield.session import cut_lineage

# fixed values: study box in degrees (west, south, east, north), minutes, protocols
STUDY_BOX = (-128.41723, 24.75365, -98.37560, 54.61227)
MINUTES = (0, 300)
PROTOCOLS = ("Stationary",)


def usable_checklists(checklists: DataFrame) -> DataFrame:
    return checklists.where(comparable(
        F.col("lon"), F.col("lat"), F.col("duration"), F.col("protocol"), F.col("complete"),
        STUDY_BOX, MINUTES, PROTOCOLS,
    ))


def species_points(
    checklists: DataFrame, observations: DataFrame, species: Sequence[str] | None = None,
    at_least: int = 30, projection: Albers | None = None,
) -> DataFrame:
    """All species in one plan; species with too few positive rows are left out.

    The filtered rows are needed for the gate and for the result, so they are
    written once; the filters leave a small part of the feed.
    """
    wanted = observations if species is None else observations.where(F.col("species").isin(*species))
    usable = usable_checklists(checklists)
    rows = natural_join(wanted.select("event_id", "species", "count_text"), usable, "inner", ["event_id"], False)
    positive = cut_lineage(counted(rows, "count_text", "count"))
    enough = sufficient_keys(positive, "species", "count", at_least)
    kept = keep_known(positive, enough, ["species"], nulls_match=False)
    return _located(kept, projection)


def _located(rows: DataFrame, projection: Albers | None) -> DataFrame:
    x, y = (projection or Albers()).project(F.col("lon"), F.col("lat"))
    return rows.withColumns({
        "x": x, "y": y, "year": F.year("obs_date"), "month": F.month("obs_date"), "day": F.dayofmonth("obs_date"),
    })


def zero_filled_points(
    checklists: DataFrame, observations: DataFrame, at_least: int = 30, projection: Albers | None = None
) -> DataFrame:
    """The whole feed: first row per event, both feeds cut to common events, one checklist per group, zeros, gate, points.

    A group's checklist is its copy with the smallest event, and a species'
    count on it that of the group's smallest event that saw the species.
    Species seen without a count on a checklist have no row there; absences
    are rows with count 0. Rows of one event are ordered by all their columns.
    """
    usable = usable_checklists(checklists)
    single = first_per_key(usable, ["event_id"], [c for c in usable.columns if c != "event_id"])
    seen, lists = keep_common(observations.select("event_id", "species", "count_text"), single, ["event_id"])
    lists, seen = cut_lineage(lists), cut_lineage(seen)
    shared = collapse_groups(lists, "event_id", "group_id", [], "checklist_id")
    placed = natural_join(seen, lists.select("event_id", "group_id"), "inner", ["event_id"], nulls_match=False)
    once = collapse_groups(placed, "event_id", "group_id", ["species"], "checklist_id")
    counts = once.select("checklist_id", "species", F.col("count_text").try_cast("int").alias("count"))
    filled = zero_fill(shared, counts, seen, "checklist_id", "species", "count")
    # read for the gate and for the result
    known = cut_lineage(filled.where(F.col("count").isNotNull()))
    kept = keep_known(known, sufficient_keys(known, "species", "count", at_least), ["species"], nulls_match=False)
    return _located(kept, projection)
