"""Route counts to model inputs: stops folded, observers flagged, grid completed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.geo import Grid
from tallyfield.operators.joins import natural_join, with_every
from tallyfield.operators.pivots import fold_stops, wide_counts
from tallyfield.operators.ranks import flag_first, id_by_first_seen, numbered
from tallyfield.operators.spatial import complete_grid, to_cells
from tallyfield.session import cut_lineage


def stop_columns(n: int = 50) -> list[str]:
    return [f"stop{i}" for i in range(1, n + 1)]


def widen_stops(stops: DataFrame, keys: Sequence[str], stop: str, count: str, n: int = 50) -> DataFrame:
    return wide_counts(stops, keys, stop, count, dict(enumerate(stop_columns(n), 1)))


def located_routes(wide: DataFrame, routes: DataFrame, grid: Grid) -> DataFrame:
    """Route rows with the cell and a composite route id.

    ``routes`` has ``route``, ``x``, ``y``; rows without coordinates are dropped.
    """
    placed = natural_join(wide, routes.where("x is not null and y is not null"), "inner", ["route"], nulls_match=False)
    cells = to_cells(placed, grid).drop("x", "y")
    return cells.withColumn("route_id", F.concat_ws("-", F.col("cell_id").cast("string"), F.col("route").cast("string")))


def of_codes(stops: DataFrame, taxa: DataFrame, code: str, text_code: str, carry: Sequence[str]) -> DataFrame:
    """Stop rows whose numeric ``code`` is that of a taxon, whose ``text_code`` is text (leading zeros or not), with the columns ``carry`` of it.

    A text that is no number is no taxon's code.
    """
    wanted = taxa.select(F.col(text_code).try_cast("bigint").alias("_code"), *carry).where("_code IS NOT NULL").distinct()
    return stops.join(wanted, F.col(code).cast("bigint") == F.col("_code")).drop("_code")


def route_points(
    wide: DataFrame, routes: DataFrame, grid: Grid, year: str = "yr", observer: str = "obs_n", by: Sequence[str] = ()
) -> DataFrame:
    """Ten stop groups, total, first-year-of-observer flag and observer id per route and year, all apart for each group of ``by``.

    The folded rows are written once: flags and ids read three of their columns.
    """
    by = list(by)
    folded = fold_stops(wide, stop_columns())
    placed = cut_lineage(located_routes(folded, routes, grid))
    flagged = flag_first(placed, [*by, "route_id", observer], [year], "new")
    return id_by_first_seen(flagged, observer, ["route_id", year, observer], "obs_id", by)


def on_grid(
    points: DataFrame, cells: DataFrame, year: str = "yr", observer: str = "obs_n", by: Sequence[str] = (), at_least: int = 0
) -> DataFrame:
    """Route rows on the whole grid with observed flag, time step and rows per cell.

    With ``by``, say the species, every group of at least ``at_least`` rows with a positive total has the whole grid and its own
    steps; the other groups are left out.
    """
    by = list(by)
    cells = cells.select("cell_id")
    if by:
        seen = F.count_if(F.col("total_count") > 0)
        groups = cut_lineage(points.groupBy(*by).agg(seen.alias("_n")).where(F.col("_n") >= at_least).drop("_n"))
        points = points.join(groups, by, "left_semi")
        cells = with_every(cells, groups, ["cell_id"])
    full = complete_grid(points, cells, ["cell_id", *by])
    flagged = full.withColumn("is_observed", F.coalesce(F.col("total_count") > 0, F.lit(False)))
    return numbered(flagged, ["route_id", year, observer], [*by, "cell_id"], "time_step", "nyears_site")
