"""Grids, rings and point-in-region tests on plain coordinate columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tallyfield.functions.geo import Grid, distance
from tallyfield.operators.joins import drop_known
from tallyfield.session import cut_lineage


def fitted_grid(df: DataFrame, x: str, y: str, size: float) -> Grid:
    """The grid that starts at the smallest coordinates and covers them all."""
    low_x, low_y, high_x, high_y = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    nx = math.floor((high_x - low_x) / size) + 1
    ny = math.floor((high_y - low_y) / size) + 1
    return Grid(float(low_x), float(low_y), float(size), nx, ny)


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells with bounds and centroid; rows of cells are made in parallel."""
    rows = spark.range(grid.ny).withColumnRenamed("id", "iy")
    cells = rows.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.nx - 1).cast("long"))))
    x0, y0 = F.col("ix") * grid.size + grid.x0, F.col("iy") * grid.size + grid.y0
    return cells.select(
        grid.cell_of(F.col("ix"), F.col("iy")).alias("cell_id"), "ix", "iy",
        x0.alias("xmin"), y0.alias("ymin"),
        (x0 + grid.size / 2).alias("x"), (y0 + grid.size / 2).alias("y"),
    )


def to_cells(df: DataFrame, grid: Grid, x: str = "x", y: str = "y", name: str = "cell_id") -> DataFrame:
    """Points with their cell number; points outside the grid are dropped."""
    return df.withColumn(name, grid.cell(F.col(x), F.col(y))).where(F.col(name).isNotNull())


def complete_grid(observations: DataFrame, cells: DataFrame, on: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Observations plus one row for every cell without any; ``on`` may add keys that get a grid each.

    Observations pass as they are; only their distinct keys are joined.
    """
    empty = drop_known(cells.select(*on), observations, on, nulls_match=False)
    return observations.unionByName(empty, allowMissingColumns=True)


def ring_edges(vertices: DataFrame, ring: str, seq: str, x: str, y: str) -> DataFrame:
    """Edges of closed rings from vertices numbered 1..n.

    Each vertex meets its successor by an equi-join on (ring, number), which is
    unique, so a ring of any length is spread over tasks; the closing edge
    comes from an aggregate.
    """
    here = vertices.select(F.col(ring), F.col(seq).cast("long").alias("_k"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    after = vertices.select(
        F.col(ring), (F.col(seq).cast("long") - 1).alias("_k"), F.col(x).alias("x2"), F.col(y).alias("y2")
    )
    point = F.struct(F.col(x), F.col(y))
    ends = vertices.groupBy(ring).agg(F.max_by(point, seq).alias("_last"), F.min_by(point, seq).alias("_first"))
    closing = ends.select(
        ring, F.col(f"_last.{x}").alias("x1"), F.col(f"_last.{y}").alias("y1"),
        F.col(f"_first.{x}").alias("x2"), F.col(f"_first.{y}").alias("y2"),
    )
    return here.join(after, [ring, "_k"]).drop("_k").unionByName(closing)


def ring_shape(edges: DataFrame, ring: str) -> DataFrame:
    """Area and centroid per ring by the shoelace sum."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy(ring).agg(
        (F.sum(cross) / 2).alias("_a"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("_x"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("_y"),
    )
    six = F.when(F.col("_a") != 0, F.col("_a") * 6)
    return sums.select(
        ring, F.abs("_a").alias("area"), (F.col("_x") / six).alias("cx"), (F.col("_y") / six).alias("cy")
    )


def ring_cell_width(edges: DataFrame) -> float:
    """A cell width for :func:`inside_rings`: about two edges long, between 1/32768 and 1/64 of the rings' extent."""
    length = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    row = edges.agg(
        F.avg(length).alias("mean"), (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"),
        (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h"),
    ).first()
    extent = max(row.w or 0.0, row.h or 0.0) or 1.0
    return min(max(2 * (row.mean or 0.0), extent / 32768), extent / 64)


def _ring_cells(edges: DataFrame, ring: str, at: Column, up: Column, size: float) -> tuple[DataFrame, DataFrame]:
    """Crossed cells of every ring with the edges in them and the parity of their right border, and the runs of whole cells inside."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    hair = size * 1e-9  # cells an edge only brushes are taken too
    column = lambda x: F.floor(x / size - at)
    row = lambda y: F.floor(y / size - up)
    cut = edges.withColumn("_ix", F.explode(F.sequence(column(left - hair), column(right + hair))))
    slope = F.when(x1 != x2, (y2 - y1) / (x2 - x1))
    from_x = F.least(F.greatest(left, (F.col("_ix") + at) * size), right)
    to_x = F.greatest(F.least(right, (F.col("_ix") + 1 + at) * size), left)
    ya, yb = (F.coalesce(y1 + slope * (x - x1), y) for x, y in ((from_x, y1), (to_x, y2)))
    cells = cut.withColumn("_iy", F.explode(F.sequence(row(F.least(ya, yb) - hair), row(F.greatest(ya, yb) + hair))))
    cells = cut_lineage(cells)  # read for the parities and for the points
    middle = (F.col("_iy") + 0.5 + up) * size
    meets = F.try_divide((x2 - x1) * (middle - y1), y2 - y1) + x1
    here = F.coalesce((y1 > middle) != (y2 > middle), F.lit(False)) & (column(meets) == F.col("_ix"))
    counted = cells.groupBy(ring, "_iy", "_ix").agg(F.count_if(here).alias("_n"))
    # a row of one ring has at most as many crossed cells as the grid has columns
    line = Window.partitionBy(ring, "_iy").orderBy("_ix")
    beyond = F.coalesce(F.sum("_n").over(line.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    parity = counted.withColumns({"_odd": beyond % 2, "_next": F.lead("_ix").over(line)})
    crossed = cells.join(parity.select(ring, "_iy", "_ix", "_odd"), [ring, "_iy", "_ix"])
    inner = parity.where("_odd = 1 AND _next > _ix + 1")
    return crossed, inner.select(ring, "_iy", (F.col("_ix") + 1).alias("_a"), F.col("_next").alias("_b"))


_LEVELS = 17  # runs are cut at powers of two up to this one; the extent has at most 2**15 cells and a few


def _blocks(runs: DataFrame) -> DataFrame:
    """Runs ``[_a, _b)`` as aligned blocks of 2**_level cells, at most a few of each level."""
    at_level = runs.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))))
    ceil_, floor_ = (lambda c, k: f"shiftright({c} + shiftleft(1L, {k}) - 1, {k})"), (lambda c, k: f"shiftright({c}, {k})")
    own = at_level.withColumns({
        "_lo": F.expr(ceil_("_a", "_level")), "_hi": F.expr(floor_("_b", "_level")),
        "_up_lo": F.expr("2 * " + ceil_("_a", "_level + 1")), "_up_hi": F.expr("2 * " + floor_("_b", "_level + 1")),
    }).where("_lo < _hi")
    ends = F.expr("if(_level < %d AND _up_lo < _up_hi, array_distinct(array(_lo, _hi - 1)), sequence(_lo, _hi - 1))" % _LEVELS)
    blocks = own.withColumn("_block", F.explode(ends))
    return blocks.where(f"_level = {_LEVELS} OR _up_lo >= _up_hi OR _block < _up_lo OR _block >= _up_hi").drop(
        "_a", "_b", "_lo", "_hi", "_up_lo", "_up_hi"
    )


def inside_rings(
    points: DataFrame, ids: Sequence[str], x: str, y: str, edges: DataFrame, ring: str, size: float | None = None
) -> DataFrame:
    """(point, ring) rows for points inside a ring, by the even-odd rule.

    The plane is cut into cells of width ``size`` (fitted to the edges if not
    given). A cell that no edge of a ring passes lies inside or outside as a
    whole; such cells are runs along a row, cut into blocks at powers of two, and
    the occupied cells find their block by an equi-join. Only points in crossed
    cells meet edges, those of their own cell: the crossings to the right
    inside the cell, those of its right border up to the row's middle, and the
    known parity there. Points on an outline follow the half-open rule of a ray to
    the right. The cells start at an odd fraction of ``size``, so that borders
    keep clear of round coordinates.

    Points on the same coordinates should be passed once.
    """
    size = float(size or ring_cell_width(edges))
    at, up = F.lit(0.2360679774997898), F.lit(0.4142135623730951)
    py, px = F.col(y), F.col(x)
    placed = points.select(*ids, x, y, F.floor(px / size - at).alias("_ix"), F.floor(py / size - up).alias("_iy"))
    crossed, runs = _ring_cells(edges.select(ring, "x1", "y1", "x2", "y2"), ring, at, up, size)
    occupied = placed.select("_ix", "_iy").distinct()
    asked = occupied.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))))
    asked = asked.withColumn("_block", F.expr("shiftright(_ix, _level)"))
    whole = asked.join(_blocks(runs), ["_iy", "_level", "_block"]).select("_ix", "_iy", ring)
    inner = placed.join(whole, ["_ix", "_iy"]).select(*ids, ring)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    border, middle = (F.col("_ix") + 1 + at) * size, (F.col("_iy") + 0.5 + up) * size
    meets_x = F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1
    meets_y = F.try_divide((y2 - y1) * (border - x1), x2 - x1) + y1
    ahead = ((y1 > py) != (y2 > py)) & (px < meets_x) & (meets_x <= border)
    beside = ((x1 > border) != (x2 > border)) & (meets_y > F.least(py, middle)) & (meets_y <= F.greatest(py, middle))
    yes = lambda c: F.when(c, 1).otherwise(0)
    near = placed.join(crossed, ["_ix", "_iy"]).groupBy(*ids, ring)
    odd = near.agg((F.sum(yes(ahead) + yes(beside)) + F.max("_odd")).alias("_n")).where("_n % 2 = 1")
    return inner.unionByName(odd.select(*ids, ring))


def inside_any(
    points: DataFrame, ids: Sequence[str], x: str, y: str, edges: DataFrame, ring: str, size: float | None = None
) -> DataFrame:
    """Points inside the union of all rings, once each; the merged outline is not needed."""
    return inside_rings(points, ids, x, y, edges, ring, size).select(*ids).distinct()


def crossed_cells(edges: DataFrame, grid: Grid, keep: Sequence[str] = ()) -> DataFrame:
    """Cells an edge passes through.

    An edge is cut at the columns of the grid it spans; inside one column it
    covers one run of rows. The number of rows made is the number of crossings.
    """
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    cut = edges.withColumn("ix", F.explode(F.sequence(grid.ix(left), grid.ix(right))))
    slope = F.when(F.col("x1") != F.col("x2"), (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    at = lambda x: F.col("y1") + slope * (x - F.col("x1"))
    from_x = F.greatest(left, F.col("ix") * grid.size + grid.x0)
    to_x = F.least(right, (F.col("ix") + 1) * grid.size + grid.x0)
    ya = F.when(slope.isNull(), F.least("y1", "y2")).otherwise(F.least(at(from_x), at(to_x)))
    yb = F.when(slope.isNull(), F.greatest("y1", "y2")).otherwise(F.greatest(at(from_x), at(to_x)))
    runs = cut.withColumn("iy", F.explode(F.sequence(grid.iy(ya), grid.iy(yb))))
    cell = grid.cell_of(F.col("ix"), F.col("iy")).alias("cell_id")
    return runs.select(*keep, cell).where(F.col("cell_id").isNotNull()).distinct()


def region_cells(cells: DataFrame, edges: DataFrame, ring: str, grid: Grid) -> DataFrame:
    """Cells whose centre lies inside a ring or that a ring's outline crosses, per ring."""
    inner = inside_rings(cells, ["cell_id"], "x", "y", edges, ring).select(ring, "cell_id")
    return inner.union(crossed_cells(edges, grid, [ring]).select(ring, "cell_id")).distinct()


def lattice_pairs(cells: DataFrame, radius: int, cell: str = "cell_id", ix: str = "ix", iy: str = "iy") -> DataFrame:
    """Ordered pairs of occupied cells at most ``radius`` cell widths apart, itself included.

    Each cell looks up a disc of offsets by an equi-join on (column, row), so
    the work per cell depends on the radius only, not on how many points it holds.
    """
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    there = cells.select(F.col(cell).alias("dst"), F.col(ix).alias("_x"), F.col(iy).alias("_y"))
    i, j = F.col("_i"), F.col("_j")
    asks = (
        cells.select(F.col(cell).alias("src"), ix, iy)
        .withColumn("_i", F.explode(reach))
        .withColumn("_j", F.explode(reach))
        .where(i * i + j * j <= radius * radius)
        .select("src", (F.col(ix) + i).alias("_x"), (F.col(iy) + j).alias("_y"),
                F.sqrt((i * i + j * j).cast("double")).alias("steps"))
    )
    return asks.join(there, ["_x", "_y"]).select("src", "dst", "steps")


CROWD = 2048  # points of one tile in one block of the radius join, and of those that come to meet them in one array
PLACE = ["tile_x", "tile_y", "block"]  # where a pair's first point was dealt to


def radius_pairs(
    points: DataFrame, ids: Sequence[str], x: str, y: str, radius: float, others: DataFrame | None = None, placed: bool = False
) -> DataFrame:
    """Ordered pairs of points at most ``radius`` apart, themselves included: ids as ``src_*`` and ``dst_*``, and ``distance``.

    Points stand in cells as wide as the radius and in tiles of two by two
    cells. A point is sent to the tiles that its cell and the eight around it
    are part of, four in all, and the points of a tile are held against all that
    came, packed in arrays; the exact distance decides. So pairs are made where
    they are used and only points are sent. A tile with more than ``CROWD``
    points is dealt over several blocks, so a crowded place is many tasks' work.
    Points without coordinates meet nothing.

    ``others`` are the points to meet (``dst``), the points themselves by default;
    their further columns come along. ``placed`` adds the columns ``PLACE``: who
    groups pairs by them and the ``src`` ids needs no shuffle. They are left out
    if points of the same ids stand in several tiles.
    """
    ids, tile = list(ids), PLACE[:2]
    mine = [f"src_{c}" for c in ids]
    cell = lambda of: F.floor(F.col(of) / radius)
    halo = lambda of: F.explode(F.array(F.floor((cell(of) - 1) / 2), F.floor((cell(of) + 1) / 2)))
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    here = points.where(known).select(
        *[F.col(c).alias(f"src_{c}") for c in ids], F.col(x).alias("_hx"), F.col(y).alias("_hy"),
        F.floor(cell(x) / 2).alias("tile_x"), F.floor(cell(y) / 2).alias("tile_y"),
    )
    more = [c for c in others.columns if c not in (*ids, x, y)] if others is not None else []
    come = (points if others is None else others).where(known)
    come = come.withColumn("tile_x", halo(x)).withColumn("tile_y", halo(y)).select(
        *[F.col(c).alias(f"dst_{c}") for c in ids], *more, F.col(x).alias("_px"), F.col(y).alias("_py"), *tile
    )
    crowds = here.groupBy(*tile).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("_blocks")).where("_blocks > 1")
    crowds, blocks = cut_lineage(crowds), F.coalesce("_blocks", F.lit(1))
    # few bytes are many pairs, so parts keep their number whatever their size
    parts = 8 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    come = come.join(crowds, tile, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    here = here.join(crowds, tile, "left").withColumn("block", F.pmod(F.xxhash64(*mine), blocks).cast("int")).drop("_blocks")
    row = F.shiftright(F.monotonically_increasing_id(), CROWD.bit_length() - 1).alias("_array")
    held = come.repartition(parts, *PLACE).sortWithinPartitions(*PLACE).select("*", row)
    arrays = held.groupBy(*PLACE, "_array").agg(F.collect_list(F.struct(*[c for c in come.columns if c not in PLACE])).alias("_come"))
    met = here.repartition(parts, *PLACE).join(arrays, PLACE).select(*mine, "_hx", "_hy", *PLACE, F.inline("_come"))
    far = distance(F.col("_hx"), F.col("_hy"), F.col("_px"), F.col("_py"))
    pairs = met.withColumn("distance", far).where(F.col("distance") <= radius)
    stands = here.groupBy(*mine).agg(F.count_distinct(F.struct(*PLACE)).alias("_n"))
    place = PLACE if placed and stands.where("_n > 1").isEmpty() else []
    return pairs.select(*mine, *[f"dst_{c}" for c in ids], "distance", *more, *place)


TILE = 64  # cells along the side of a raster tile


def terrain(raster: DataFrame, size: float, ix: str = "ix", iy: str = "iy", elev: str = "elev",
            sun_height: float = 45.0, sun_direction: float = 300.0) -> DataFrame:
    """Slope, aspect (radians) and hillshade 0-255 from a regular elevation raster, one row per cell.

    The raster is dealt out once, in tiles with a halo of one cell, so a cell is
    sent 1.06 times on average. Horn's weights are a product of a row and a
    column part: differences and smoothed heights along the rows of a tile
    first, the same along its columns then, both in windows over rows of one
    tile. Cells with an incomplete neighbourhood keep their height and get no
    slope.
    """
    def reach(of: Column) -> Column:
        # the tiles a row or column number stands in: its own, and a neighbour's halo at an edge
        own, place = F.floor(of / TILE), F.pmod(of, F.lit(TILE))
        return F.when(place == 0, F.array(own - 1, own)).when(place == TILE - 1, F.array(own, own + 1)).otherwise(F.array(own))

    sent = (
        raster.where(F.col(elev).isNotNull()).select(ix, iy, elev)
        .withColumn("_tx", F.explode(reach(F.col(ix)))).withColumn("_ty", F.explode(reach(F.col(iy))))
        .repartition("_tx", "_ty")
    )
    rows = Window.partitionBy("_tx", "_ty", iy).orderBy(ix)
    cols = Window.partitionBy("_tx", "_ty", ix).orderBy(iy)

    def beside(window: WindowSpec, at: str, value: str, step: int) -> Column:
        # the value one cell on, missing where the next row of the window is farther away
        return F.when(F.lag(at, step).over(window) == F.col(at) - step, F.lag(value, step).over(window))

    along = sent.withColumns({"_w": beside(rows, ix, elev, 1), "_e": beside(rows, ix, elev, -1)})
    along = along.withColumns({"_d": F.col("_e") - F.col("_w"), "_s": F.col("_w") + 2 * F.col(elev) + F.col("_e")})
    sides = {f"{v}{n}": beside(cols, iy, v, k) for v in ("_d", "_s") for n, k in (("_below", 1), ("_above", -1))}
    both = along.withColumns(sides).where((F.col("_tx") == F.floor(F.col(ix) / TILE)) & (F.col("_ty") == F.floor(F.col(iy) / TILE)))
    sums = both.select(
        ix, iy, elev,
        ((F.col("_d_below") + 2 * F.col("_d") + F.col("_d_above")) / (8 * size)).alias("_gx"),
        ((F.col("_s_above") - F.col("_s_below")) / (8 * size)).alias("_gy"),
        # all nine heights: the middle row's smoothed height is in neither gradient, but needs its three
        (F.col("_s").isNotNull() & F.col("_s_below").isNotNull() & F.col("_s_above").isNotNull()).alias("_full"),
    )
    pi = F.pi()
    slope = F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))
    aspect = F.pmod(pi / 2 - F.atan2(-F.col("_gy"), -F.col("_gx")), pi * 2)
    shaped = sums.withColumns({"slope": F.when(F.col("_full"), slope), "aspect": F.when(F.col("_full"), aspect)})
    zenith, azimuth = F.radians(F.lit(90.0 - sun_height)), F.radians(F.lit(sun_direction))
    light = F.cos("slope") * F.cos(zenith) + F.sin("slope") * F.sin(zenith) * F.cos(azimuth - F.col("aspect"))
    shade = F.when(F.col("slope").isNotNull(), F.greatest(light, F.lit(0.0)) * 255)
    return shaped.withColumn("hillshade", shade).drop("_full", "_gx", "_gy")
