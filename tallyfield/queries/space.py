"""Grids, regions, neighbours, knots and terrain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.columns import rounded
from tallyfield.functions.geo import Albers, Grid, in_box, require_same_crs
from tallyfield.operators.knots import (
    exponential_covariance,
    grid_knots,
    interpolate,
    kmeans_knots,
    site_knot_distances,
)
from tallyfield.operators.neighbours import (
    car_log_density,
    island_count,
    nearest_cells,
    neighbour_lists,
    symmetric_edges,
)
from tallyfield.operators.spatial import (
    fitted_grid,
    grid_cells,
    inside_any,
    inside_rings,
    lattice_pairs,
    radius_pairs,
    region_cells,
    ring_edges,
    ring_shape,
    terrain,
    to_cells,
)
from tallyfield.queries.counts import COARSE, FINE, cell_sql
from tallyfield.queries.feeds import albers_sql
from tallyfield.queries.registry import Tables, query
from tallyfield.session import cut_lineage

# the unit square of the point table: a lattice for neighbours, coarse cells for knots
LATTICE = Grid(-1.0, -1.0, 0.02, 100, 100)
KNOT_CELLS = Grid(-1.0, -1.0, 2 / 14, 14, 14)

_X, _Y = albers_sql("lon", "lat")


@query("project_points", f"""
SELECT event_id, lon, lat, round({_X}, 3) + 0.0 AS x, round({_Y}, 3) + 0.0 AS y FROM v_checklists""")
def project_points(t: Tables) -> DataFrame:
    x, y = Albers().project(F.col("lon"), F.col("lat"))
    return t.v_checklists.select("event_id", "lon", "lat", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@query("common_crs_points", f"""
WITH p AS (SELECT 'checklist' AS feed, event_id AS id, {_X} AS x, {_Y} AS y FROM v_checklists UNION ALL SELECT 'site', site, x, y FROM v_sites)
SELECT feed, id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM p""")
def common_crs_points(t: Tables) -> DataFrame:
    """Checklists and survey sites as one point table, put together only where both use one coordinate system."""
    of_lists, of_sites = Albers(), Albers()
    x, y = require_same_crs(of_lists, of_sites).project(F.col("lon"), F.col("lat"))
    lists = t.v_checklists.select(F.lit("checklist").alias("feed"), F.col("event_id").alias("id"), x.alias("x"), y.alias("y"))
    sites = t.v_sites.select(F.lit("site").alias("feed"), F.col("site").alias("id"), "x", "y")
    return lists.unionByName(sites).withColumns({c: rounded(F.col(c), 3) for c in ("x", "y")})


# fixed values: the study rectangle in projected metres, cut to its inner part
_BOX = (-2350000.0, 330000.0, -1240000.0, 2500000.0)


@query("bbox_crop", f"SELECT site, x, y FROM v_sites WHERE x BETWEEN {_BOX[0]} AND {_BOX[2]} AND y BETWEEN {_BOX[1]} AND {_BOX[3]}")
def bbox_crop(t: Tables) -> DataFrame:
    return t.v_sites.where(in_box(F.col("x"), F.col("y"), *_BOX)).select("site", "x", "y")


@query("make_grid", """
WITH e AS (SELECT min(x) AS x0, min(y) AS y0, CAST(floor((max(x) - min(x)) / 200000) + 1 AS BIGINT) AS nx,
  CAST(floor((max(y) - min(y)) / 200000) + 1 AS BIGINT) AS ny FROM v_sites),
c AS (SELECT unnest(generate_series(0, nx * ny - 1)) AS cell_id, x0, y0, nx FROM e),
n AS (SELECT CAST(floor((y - y0) / 200000) * nx + floor((x - x0) / 200000) AS BIGINT) AS cell_id, count(*) AS n_sites FROM v_sites, e GROUP BY 1)
SELECT c.cell_id, x0 + (c.cell_id % nx) * 200000 AS xmin, y0 + (c.cell_id // nx) * 200000 AS ymin,
  x0 + (c.cell_id % nx) * 200000 + 100000 AS x, y0 + (c.cell_id // nx) * 200000 + 100000 AS y, coalesce(n_sites, 0) AS n_sites
FROM c LEFT JOIN n ON n.cell_id = c.cell_id""")
def make_grid(t: Tables) -> DataFrame:
    """A numbered grid over the extent of the sites, with centroids and sites per cell."""
    grid = fitted_grid(t.v_sites, "x", "y", 200000.0)
    held = to_cells(t.v_sites, grid).groupBy("cell_id").agg(F.count("*").alias("n_sites"))
    cells = grid_cells(t.spark, grid).select("cell_id", "xmin", "ymin", "x", "y").join(held, "cell_id", "left")
    return cells.withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))


@query("point_to_cell", f"""
WITH p AS (SELECT site, {cell_sql(FINE)} AS cell_id FROM v_sites)
SELECT site, cell_id, {FINE.x0}::DOUBLE + (cell_id % {FINE.nx}) * 20000 AS xmin, {FINE.y0}::DOUBLE + (cell_id // {FINE.nx}) * 20000 AS ymin FROM p""")
def point_to_cell(t: Tables) -> DataFrame:
    """Cells are computed from coordinates, then met by an equi-join."""
    placed = to_cells(t.v_sites, FINE).select("site", "cell_id")
    return placed.join(grid_cells(t.spark, FINE).select("cell_id", "xmin", "ymin"), "cell_id")


def _corner_rings(t: Tables, by: str) -> DataFrame:
    """A four-cornered ring per group: its westernmost, northernmost, easternmost and southernmost site."""
    xy, yx = F.struct("x", "y"), F.struct("y", "x")
    ends = t.v_sites.groupBy(F.col(by).cast("string").alias("ring")).agg(
        F.min(xy).alias("w"), F.max(yx).alias("n"), F.max(xy).alias("e"), F.min(yx).alias("s")
    )
    corners = F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")) for i, c in enumerate("wnes", 1)])
    return ends.select("ring", F.inline(corners))


def _rings_sql(by: str) -> str:
    cols = ", ".join(
        f"first(x ORDER BY {a} {w}, {b} {w}) AS x{i}, first(y ORDER BY {a} {w}, {b} {w}) AS y{i}"
        for i, (a, b, w) in enumerate([("x", "y", "ASC"), ("y", "x", "DESC"), ("x", "y", "DESC"), ("y", "x", "ASC")])
    )
    edges = " UNION ALL ".join(
        f"SELECT ring, x{i} AS x1, y{i} AS y1, x{(i + 1) % 4} AS x2, y{(i + 1) % 4} AS y2 FROM rings" for i in range(4)
    )
    return f"rings AS (SELECT CAST({by} AS VARCHAR) AS ring, {cols} FROM v_sites GROUP BY 1), edges AS ({edges})"


@query("point_in_polygon", f"""
WITH {_rings_sql('stratum')}
SELECT p.site, e.ring FROM v_sites p JOIN edges e
  ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_polygon(t: Tables) -> DataFrame:
    """Sites inside the ring of each stratum."""
    edges = ring_edges(_corner_rings(t, "stratum"), "ring", "k", "x", "y")
    return inside_rings(t.v_sites, ["site"], "x", "y", edges, "ring")


@query("point_in_region", f"""
WITH {_rings_sql('state')}, hit AS (SELECT p.site, e.ring FROM v_sites p JOIN edges e
  ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT DISTINCT site FROM hit""")
def point_in_region(t: Tables) -> DataFrame:
    """Sites inside the union of the state rings."""
    edges = ring_edges(_corner_rings(t, "state"), "ring", "k", "x", "y")
    return inside_any(t.v_sites, ["site"], "x", "y", edges, "ring")


@query("ring_area_filter", f"""
WITH {_rings_sql('state')},
a AS (SELECT ring, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS sy
  FROM edges GROUP BY 1)
SELECT ring, round(abs(a) / 1e6, 3) + 0.0 AS area_km2, round(sx / (6 * a), 3) + 0.0 AS cx, round(sy / (6 * a), 3) + 0.0 AS cy
FROM a WHERE abs(a) >= 2.6e12""")
def ring_area_filter(t: Tables) -> DataFrame:
    """Rings below an area are dropped; centroids come from the same sums."""
    shapes = ring_shape(ring_edges(_corner_rings(t, "state"), "ring", "k", "x", "y"), "ring")
    return shapes.where(F.col("area") >= 2.6e12).select(
        "ring", rounded(F.col("area") / 1e6, 3).alias("area_km2"), rounded(F.col("cx"), 3).alias("cx"), rounded(F.col("cy"), 3).alias("cy")
    )


_S = COARSE.size


@query("grid_region_cells", f"""
WITH {_rings_sql('stratum')},
cells AS (SELECT c AS cell_id, {COARSE.x0} + (c % 11 + 0.5) * {_S} AS x, {COARSE.y0} + (c // 11 + 0.5) * {_S} AS y FROM (SELECT unnest(generate_series(0, 175)) AS c)),
inner_cells AS (SELECT e.ring, p.cell_id FROM cells p JOIN edges e
  ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY 1, 2 HAVING count(*) % 2 = 1),
cut AS (SELECT *, unnest(generate_series(CAST(floor((least(x1, x2) - {COARSE.x0}) / {_S}) AS BIGINT), CAST(floor((greatest(x1, x2) - {COARSE.x0}) / {_S}) AS BIGINT))) AS ix FROM edges),
part AS (SELECT *, greatest(least(x1, x2), ix * {_S} + {COARSE.x0}) AS xa, least(greatest(x1, x2), (ix + 1) * {_S} + {COARSE.x0}) AS xb FROM cut),
ends AS (SELECT ring, ix, CASE WHEN x1 = x2 THEN y1 ELSE y1 + (y2 - y1) / (x2 - x1) * (xa - x1) END AS ya,
  CASE WHEN x1 = x2 THEN y2 ELSE y1 + (y2 - y1) / (x2 - x1) * (xb - x1) END AS yb FROM part),
crossed AS (SELECT ring, ix, unnest(generate_series(CAST(floor((least(ya, yb) - {COARSE.y0}) / {_S}) AS BIGINT), CAST(floor((greatest(ya, yb) - {COARSE.y0}) / {_S}) AS BIGINT))) AS iy FROM ends)
SELECT ring, CAST(cell_id AS BIGINT) AS cell_id FROM inner_cells
UNION SELECT ring, iy * 11 + ix FROM crossed WHERE ix BETWEEN 0 AND 10 AND iy BETWEEN 0 AND 15""")
def grid_region_cells(t: Tables) -> DataFrame:
    """Grid cells whose centre lies in a ring or that its outline passes."""
    edges = ring_edges(_corner_rings(t, "stratum"), "ring", "k", "x", "y")
    return region_cells(grid_cells(t.spark, COARSE), edges, "ring", COARSE)


_RASTER_SQL = """r AS (SELECT l_partkey % 101 AS ix, l_orderkey % 103 AS iy, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS elev
  FROM lineitem GROUP BY 1, 2)"""


@query("terrain_hillshade", f"""
WITH {_RASTER_SQL},
g AS (SELECT c.ix, c.iy, c.elev, count(*) AS k,
    sum(b.elev * sign(b.ix - c.ix) * (CASE WHEN b.iy = c.iy THEN 2 ELSE 1 END)) / 800 AS gx,
    sum(b.elev * sign(b.iy - c.iy) * (CASE WHEN b.ix = c.ix THEN 2 ELSE 1 END)) / 800 AS gy
  FROM r c JOIN r b ON b.ix BETWEEN c.ix - 1 AND c.ix + 1 AND b.iy BETWEEN c.iy - 1 AND c.iy + 1 GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN k = 9 THEN atan(sqrt(gx * gx + gy * gy)) END AS slope,
  CASE WHEN k = 9 THEN CASE WHEN atan2(-gx, -gy) < 0 THEN atan2(-gx, -gy) + 2 * pi() ELSE atan2(-gx, -gy) END END AS aspect FROM g)
SELECT ix, iy, ix * 100.0::DOUBLE + 50 AS x, iy * 100.0::DOUBLE + 50 AS y, elev, round(slope, 5) + 0.0 AS slope, round(aspect, 5) + 0.0 AS aspect,
  round(CASE WHEN slope IS NOT NULL THEN greatest(cos(slope) * cos(radians(45)) + sin(slope) * sin(radians(45)) * cos(radians(300) - aspect), 0) * 255 END, 4) + 0.0 AS hillshade
FROM s""")
def terrain_hillshade(t: Tables) -> DataFrame:
    """Slope, aspect and hillshade of a raster with holes, heights averaged from the line items."""
    raster = t.lineitem.groupBy(
        (F.col("l_partkey") % 101).alias("ix"), (F.col("l_orderkey") % 103).alias("iy")
    ).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count("*") / 10000).alias("elev"))
    digits = {"slope": 5, "aspect": 5, "hillshade": 4}
    shaped = terrain(raster, 100.0).withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})
    at = {"x": F.col("ix") * 100.0 + 50, "y": F.col("iy") * 100.0 + 50}  # centres of the cells
    return shaped.withColumns(at)


def lattice_cells(t: Tables) -> DataFrame:
    """Occupied lattice cells with their points and mean label, written once as they are read often."""
    x, y = F.col("x"), F.col("y")
    placed = t.v_points.select(LATTICE.ix(x).alias("ix"), LATTICE.iy(y).alias("iy"), "label")
    cells = placed.groupBy("ix", "iy").agg(F.count("*").alias("n"), (F.sum("label") / F.count("*")).alias("label"))
    return cut_lineage(cells.withColumn("cell_id", LATTICE.cell_of(F.col("ix"), F.col("iy"))))


_CELLS_SQL = f"""cells AS (SELECT CAST(floor((x - (-1.0)) / 0.02) AS BIGINT) AS ix, CAST(floor((y - (-1.0)) / 0.02) AS BIGINT) AS iy,
  CAST(floor((y - (-1.0)) / 0.02) * 100 + floor((x - (-1.0)) / 0.02) AS BIGINT) AS cell_id, count(*) AS n, CAST(sum(label) AS DOUBLE) / count(*) AS label
  FROM v_points GROUP BY 1, 2, 3)"""
NEAREST_SQL = f"""{_CELLS_SQL}, pairs AS (SELECT a.cell_id AS src, b.cell_id AS dst, (a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy) AS d2
  FROM cells a JOIN cells b ON a.cell_id <> b.cell_id),
near AS (SELECT src, dst, d2 FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) = 1),
edges AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near)"""


@query("pairwise_distance", f"""
WITH {_CELLS_SQL}
SELECT a.cell_id AS src, b.cell_id AS dst, round(0.02 * sqrt((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy)), 8) + 0.0 AS distance
FROM cells a JOIN cells b ON (a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy) <= 64""")
def pairwise_distance(t: Tables) -> DataFrame:
    """Distances between occupied cells up to eight cell widths."""
    pairs = lattice_pairs(lattice_cells(t), 8)
    return pairs.select("src", "dst", rounded(F.col("steps") * LATTICE.size, 8).alias("distance"))


@query("points_within_radius", """
SELECT a.pt AS src, b.pt AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 8) + 0.0 AS distance
FROM v_points a JOIN v_points b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02""")
def points_within_radius(t: Tables) -> DataFrame:
    """Distances between all points at most 0.02 apart, on their own coordinates."""
    pairs = radius_pairs(t.v_points, ["pt"], "x", "y", 0.02)
    return pairs.select(F.col("src_pt").alias("src"), F.col("dst_pt").alias("dst"), rounded(F.col("distance"), 8).alias("distance"))


@query("knn_k1", f"WITH {NEAREST_SQL} SELECT src, dst, round(0.02 * sqrt(d2), 8) + 0.0 AS distance FROM near")
def knn_k1(t: Tables) -> DataFrame:
    """The nearest occupied cell of every occupied cell."""
    near = nearest_cells(lattice_cells(t), "cell_id", "ix", "iy")
    return near.select("src", "dst", rounded(F.col("steps") * LATTICE.size, 8).alias("distance"))


@query("neighbour_graph", f"""
WITH {NEAREST_SQL}
SELECT c.cell_id, coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '') AS adj, CAST(count(e.dst) AS INTEGER) AS num, CAST(count(e.dst) AS DOUBLE) AS weight
FROM cells c LEFT JOIN edges e ON e.src = c.cell_id GROUP BY 1""")
def neighbour_graph(t: Tables) -> DataFrame:
    """Neighbours in both directions with binary weights."""
    cells = lattice_cells(t)
    lists = neighbour_lists(cells, "cell_id", symmetric_edges(nearest_cells(cells, "cell_id", "ix", "iy")))
    weight = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    return lists.select("cell_id", F.array_join(F.col("adj").cast("array<string>"), ",").alias("adj"), "num", weight.alias("weight"))


@query("car_energy", f"""
WITH {NEAREST_SQL}, m AS (SELECT avg(label / 10) AS mean, count(*) AS n FROM cells),
p AS (SELECT sum((a.label / 10 - b.label / 10) * (a.label / 10 - b.label / 10)) AS energy, count(*) AS n_pairs
  FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE e.src < e.dst),
i AS (SELECT n - (SELECT count(*) // 2 FROM near x JOIN near y ON y.src = x.dst AND y.dst = x.src) - (n - (SELECT count(*) FROM near)) AS rank FROM m)
SELECT round(energy, 6) + 0.0 AS energy, n_pairs, rank,
  round(rank / 2.0 * (ln(2.5) - ln(2 * pi())) - 1.25 * energy, 5) + 0.0 AS log_density FROM p, i""")
def car_energy(t: Tables) -> DataFrame:
    """Log-density of cell effects under the neighbour graph."""
    cells = lattice_cells(t)
    near = nearest_cells(cells, "cell_id", "ix", "iy")
    effects = cells.select("cell_id", (F.col("label") / 10).alias("s"))
    out = car_log_density(symmetric_edges(near), effects, "cell_id", "s", 2.5, island_count(near, cells))
    return out.select(rounded(F.col("energy")).alias("energy"), "n_pairs", "rank", rounded(F.col("log_density"), 5).alias("log_density"))


_KNOT_CELL = f"(floor((y - (-1.0)) / {KNOT_CELLS.size!r}) * 14 + floor((x - (-1.0)) / {KNOT_CELLS.size!r}))"
_KNOTS_SQL = f"""knots AS (SELECT CAST({_KNOT_CELL} AS BIGINT) AS knot_cell, pt, x, y, label FROM v_points
  QUALIFY row_number() OVER (PARTITION BY {_KNOT_CELL} ORDER BY pt) = 1)"""


@query("select_knots", f"WITH {_KNOTS_SQL} SELECT knot_cell, pt, x, y FROM knots")
def select_knots(t: Tables) -> DataFrame:
    """The first point of each coarse cell."""
    return grid_knots(t.v_points, "pt", KNOT_CELLS).select("knot_cell", "pt", "x", "y")


_ROUNDS = 5


def _lloyd_sql(rounds: int) -> str:
    """Rounds of nearest centre and mean, as one common table each; the last one holds the clusters."""
    parts = ["places AS MATERIALIZED (SELECT x, y, min(pt) AS pt FROM v_points GROUP BY 1, 2)",
             "c0 AS MATERIALIZED (SELECT knot_cell, x, y FROM knots)"]
    for r in range(rounds + 1):
        parts.append(f"""h{r} AS MATERIALIZED (SELECT p.pt, p.x, p.y, first(c.knot_cell ORDER BY sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), c.knot_cell) AS knot_cell
  FROM places p CROSS JOIN c{r} c GROUP BY 1, 2, 3)""")
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.knot_cell, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{r} c
  LEFT JOIN (SELECT knot_cell, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM h{r} GROUP BY 1) m USING (knot_cell))""")
    return ", ".join(parts[:-1])


@query("select_knots_kmeans", f"""
WITH {_KNOTS_SQL}, {_lloyd_sql(_ROUNDS)}
SELECT knot_cell, pt, x, y FROM h{_ROUNDS} QUALIFY row_number() OVER (PARTITION BY knot_cell ORDER BY pt) = 1""")
def select_knots_kmeans(t: Tables) -> DataFrame:
    """The first point of each k-means cluster, started from the grid knots."""
    starts = grid_knots(t.v_points, "pt", KNOT_CELLS)
    return kmeans_knots(t.v_points, "pt", starts, "knot_cell", _ROUNDS).select("knot_cell", "pt", "x", "y")


@query("site_knot_distance", f"""
WITH {_KNOTS_SQL}, d AS (SELECT p.pt, k.pt AS knot, sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) AS d FROM v_points p CROSS JOIN knots k)
SELECT pt, knot, round(d, 8) + 0.0 AS distance, round(1.5 * exp(-d / 0.5), 8) + 0.0 AS covariance FROM d""")
def site_knot_distance(t: Tables) -> DataFrame:
    """All points to at most 196 knots, with the exponential covariance."""
    knots = grid_knots(t.v_points, "pt", KNOT_CELLS)
    far = site_knot_distances(t.v_points, "pt", knots, "pt")
    return far.select(
        "pt", "knot", rounded(F.col("distance"), 8).alias("distance"),
        rounded(exponential_covariance(F.col("distance"), 1.5, 0.5), 8).alias("covariance"),
    )


@query("kernel_interpolation", f"""
WITH {_KNOTS_SQL}, d AS (SELECT p.pt, k.label / 10.0 AS w, sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) AS d FROM v_points p CROSS JOIN knots k)
SELECT pt, round(sum(exp(-d / 0.1) * w) / sum(exp(-d / 0.1)), 8) + 0.0 AS s, round(min(d), 8) + 0.0 AS nearest_knot FROM d GROUP BY 1""")
def kernel_interpolation(t: Tables) -> DataFrame:
    """Knot effects carried to every point by distance weights."""
    knots = grid_knots(t.v_points.withColumn("w", F.col("label") / 10.0), "pt", KNOT_CELLS)
    out = interpolate(t.v_points, "pt", knots, "pt", "w", 0.1)
    return out.select("pt", rounded(F.col("s"), 8).alias("s"), rounded(F.col("nearest_knot"), 8).alias("nearest_knot"))
