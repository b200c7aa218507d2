"""Spatial operators against brute force in plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfield.functions.geo import Albers, Grid, require_same_crs
from tallyfield.operators import spatial
from tallyfield.operators.knots import BLOCK, grid_knots, interpolate, kmeans_knots, nearest_knots, site_knot_distances
from tallyfield.operators.neighbours import car_log_density, island_count, nearest_cells, neighbour_lists, symmetric_edges
from tallyfield.operators.spatial import (
    complete_grid,
    crossed_cells,
    fitted_grid,
    grid_cells,
    inside_rings,
    lattice_pairs,
    radius_pairs,
    region_cells,
    ring_edges,
    ring_shape,
    terrain,
    to_cells,
)


def _lattice(seed: int):
    """A crowded block, a sparse rest, and one site far away."""
    rng = random.Random(seed)
    cells = {(rng.randrange(12), rng.randrange(12)) for _ in range(70)}
    cells |= {(rng.randrange(200), rng.randrange(200)) for _ in range(40)} | {(400, 399)}
    return [(i, x, y) for i, (x, y) in enumerate(sorted(cells, key=lambda c: rng.random()))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_neighbours_are_exact(spark, seed):
    sites = _lattice(seed)
    near = nearest_cells(spark.createDataFrame(sites, "site int, ix int, iy int"), "site", "ix", "iy").collect()
    want = {}
    for i, x, y in sites:
        d2, j = min(((x - u) ** 2 + (y - v) ** 2, k) for k, u, v in sites if k != i)
        want[i] = (j, math.sqrt(d2))
    assert {r.src: (r.dst, r.steps) for r in near} == want


@pytest.mark.parametrize("seed", [1, 5])
def test_graph_lists_and_islands(spark, seed):
    sites = _lattice(seed)
    df = spark.createDataFrame(sites, "site int, ix int, iy int")
    near = nearest_cells(df, "site", "ix", "iy")
    edges = symmetric_edges(near)
    pairs = {(r.src, r.dst) for r in edges.collect()}
    assert pairs == {(b, a) for a, b in pairs}
    parent = {i: i for i, _, _ in sites}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(a)] = root(b)
    islands = len({root(i) for i in parent})
    assert spark.range(1).select(island_count(near, df)).first()[0] == islands
    extra = df.union(spark.createDataFrame([(9999, -50, -50)], "site int, ix int, iy int"))
    lists = {r.site: r for r in neighbour_lists(extra, "site", edges).collect()}
    assert lists[9999].num == 0 and lists[9999].adj == []
    assert sum(r.num for r in lists.values()) == len(pairs)
    values = {i: float(i % 7) for i, _, _ in sites}
    mean = sum(values.values()) / len(values)
    effects = spark.createDataFrame(list(values.items()), "site int, s double")
    row = car_log_density(edges, effects, "site", "s", 2.0, F.lit(islands)).first()
    energy = sum((values[a] - mean - values[b] + mean) ** 2 for a, b in pairs if a < b)
    assert row.energy == pytest.approx(energy)
    rank = len(sites) - islands
    assert row.log_density == pytest.approx(rank / 2 * (math.log(2.0) - math.log(2 * math.pi)) - energy)


def test_no_neighbour_for_a_single_site(spark):
    one = spark.createDataFrame([(1, 5, 5)], "site int, ix int, iy int")
    assert nearest_cells(one, "site", "ix", "iy").count() == 0
    assert nearest_cells(one.where("site > 1"), "site", "ix", "iy").count() == 0


def test_lattice_pairs(spark):
    sites = _lattice(9)
    df = spark.createDataFrame(sites, "cell_id int, ix int, iy int")
    got = {(r.src, r.dst): r.steps for r in lattice_pairs(df, 5).collect()}
    want = {(a, b): math.hypot(x - u, y - v) for a, x, y in sites for b, u, v in sites if math.hypot(x - u, y - v) <= 5}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


RING = [(0.0, 0.0), (10.0, 1.0), (6.0, 5.0), (9.0, 9.0), (1.0, 8.0), (4.0, 4.0)]


def _ring(spark, points=RING, name="r"):
    return spark.createDataFrame([(name, i + 1, *p) for i, p in enumerate(points)], "ring string, k int, x double, y double")


def _inside(px, py, ring=RING):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_points_in_a_concave_ring(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-2, 12), rng.uniform(-2, 12)) for i in range(500)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    edges = ring_edges(_ring(spark), "ring", "k", "x", "y")
    got = {r.id for r in inside_rings(df, ["id"], "x", "y", edges, "ring", 0.7).collect()}
    assert got == {i for i, x, y in points if _inside(x, y)}


def test_ring_shape_and_edges(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    edges = ring_edges(_ring(spark, square).union(_ring(spark, [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)], "t")), "ring", "k", "x", "y")
    assert edges.count() == 7
    shapes = {r.ring: r for r in ring_shape(edges, "ring").collect()}
    assert (shapes["r"].area, shapes["r"].cx, shapes["r"].cy) == (8.0, 2.0, 1.0) and shapes["t"].area == 0.5


def _touched(cell, grid):
    """Whether an edge of the ring meets the closed cell, by clipping it to the cell."""
    lo = (grid.x0 + cell % grid.nx * grid.size, grid.y0 + cell // grid.nx * grid.size)
    for a, b in zip(RING, RING[1:] + RING[:1]):
        t0, t1 = 0.0, 1.0
        for k in (0, 1):
            d, low, high = b[k] - a[k], lo[k] - a[k] - 1e-9, lo[k] + grid.size - a[k] + 1e-9
            if d == 0:
                t0, t1 = (t0, t1) if low <= 0 <= high else (1.0, 0.0)
            else:
                t0, t1 = max(t0, min(low / d, high / d)), min(t1, max(low / d, high / d))
        if t0 <= t1:
            return True
    return False


def test_crossed_and_region_cells(spark):
    grid = Grid(-1.0, -1.0, 0.75, 16, 16)
    edges = ring_edges(_ring(spark), "ring", "k", "x", "y")
    got = {r.cell_id for r in crossed_cells(edges, grid).collect()}
    dense = set()
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]):
        for s in range(4001):
            x, y = x1 + (x2 - x1) * s / 4000, y1 + (y2 - y1) * s / 4000
            dense.add(math.floor((y + 1) / 0.75) * 16 + math.floor((x + 1) / 0.75))
    assert dense <= got
    assert all(_touched(c, grid) for c in got)
    cells = grid_cells(spark, grid)
    region = {r.cell_id for r in region_cells(cells, edges, "ring", grid).collect()}
    centres = {r.cell_id for r in cells.collect() if _inside(r.x, r.y)}
    assert region == centres | got


def test_grid_and_completion(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.9, 3.0), (3, 10.0, 4.9)], "id int, x double, y double")
    grid = fitted_grid(df, "x", "y", 5.0)
    assert (grid.nx, grid.ny) == (3, 1)
    placed = to_cells(df, grid)
    assert [r.cell_id for r in placed.orderBy("id").collect()] == [0, 1, 2]
    wide = Grid(0.0, 0.0, 5.0, 3, 2)
    cells = grid_cells(spark, wide)
    full = complete_grid(placed, cells.select("cell_id"))
    assert full.count() == 6 and full.where("id is null").count() == 3
    r = cells.where("cell_id = 4").first()
    assert (r.x, r.y, r.xmin, r.ymin) == (7.5, 7.5, 5.0, 5.0)
    c = cells.select("cell_id", "x", "y", wide.centre_x(F.col("cell_id")).alias("cx"), wide.centre_y(F.col("cell_id")).alias("cy"))
    assert c.where("x <> cx or y <> cy").isEmpty()


def test_projection_centre_and_area(spark):
    a = Albers()
    x, y = a.project(F.col("lon"), F.col("lat"))
    df = spark.createDataFrame([(-96.0, 37.5), (-106.0, 37.5), (-86.0, 37.5)], "lon double, lat double").select(x.alias("x"), y.alias("y"))
    (x0, y0), (x1, y1), (x2, y2) = (tuple(r) for r in df.collect())
    assert abs(x0) < 1e-6 and abs(y0) < 1e-6
    assert x1 == pytest.approx(-x2) and y1 == pytest.approx(y2) and 850_000 < x2 < 900_000


def test_terrain_on_a_plane(spark):
    plane = spark.range(36).selectExpr("id % 6 AS ix", "id div 6 AS iy").withColumn("elev", F.col("ix") * 10.0)
    out = terrain(plane, 10.0)
    inner = out.where("slope is not null").collect()
    assert len(inner) == 16 and out.count() == 36
    assert all(r.slope == pytest.approx(math.pi / 4) for r in inner)
    # the plane rises to the east, so it looks west
    assert all(r.aspect == pytest.approx(3 * math.pi / 2) for r in inner)
    light = math.cos(math.pi / 4) ** 2 + math.sin(math.pi / 4) ** 2 * math.cos(math.radians(300) - 3 * math.pi / 2)
    assert all(r.hillshade == pytest.approx(light * 255) for r in inner)
    north = spark.range(9).selectExpr("id % 3 AS ix", "id div 3 AS iy").withColumn("elev", F.col("iy") * 10.0)
    assert terrain(north, 10.0).where("slope is not null").first().aspect == pytest.approx(math.pi)


def test_terrain_tiles_agree_with_whole_raster(spark, monkeypatch):
    rng = random.Random(5)
    heights = {(i, j): rng.random() * 30 for i in range(-7, 12) for j in range(-5, 9) if rng.random() < 0.93}
    frame = spark.createDataFrame([(i, j, z) for (i, j), z in heights.items()] + [(3, 20, None)], "ix int, iy int, elev double")
    kernel = [(-1, 1), (0, 2), (1, 1)]
    for tile in (4, 64):
        monkeypatch.setattr(spatial, "TILE", tile)
        got = {(r.ix, r.iy): r for r in terrain(frame, 10.0).collect()}
        assert set(got) == set(heights)
        for (i, j), r in got.items():
            near = [heights.get((i + a, j + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            if None in near:
                assert r.slope is None and r.hillshade is None
                continue
            gx = sum(w * (heights[i - 1, j + k] - heights[i + 1, j + k]) for k, w in kernel) / 80
            gy = sum(w * (heights[i + k, j - 1] - heights[i + k, j + 1]) for k, w in kernel) / 80
            assert r.slope == pytest.approx(math.atan(math.hypot(gx, gy)))
            assert math.cos(r.aspect - math.atan2(gx, gy)) == pytest.approx(1)


def test_interpolation(spark):
    rng = random.Random(8)
    sites = spark.createDataFrame([(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(60)] + [(99, 1e6, 1e6)], "pt int, x double, y double")
    grid = Grid(0.0, 0.0, 0.25, 4, 4)
    knots = grid_knots(sites, "pt", grid)
    flat = interpolate(sites, "pt", knots.withColumn("w", F.lit(3.5)), "pt", "w", 0.01)
    assert flat.where(F.abs(F.col("s") - 3.5) > 1e-9).isEmpty() and flat.count() == 61
    slope = {r.pt: r.s for r in interpolate(sites, "pt", knots.withColumn("w", F.col("x")), "pt", "w", 0.2).collect()}
    held = knots.collect()
    for r in sites.where("pt < 90").collect():
        w = [math.exp(-math.hypot(r.x - k.x, r.y - k.y) / 0.2) for k in held]
        assert slope[r.pt] == pytest.approx(sum(a * k.x for a, k in zip(w, held)) / sum(w))
    assert site_knot_distances(sites, "pt", knots, "pt").count() == 61 * len(held)


def test_knots_of_several_blocks(spark):
    rng = random.Random(9)
    held = [(k, rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(-1, 1)) for k in range(4 * BLOCK)] + [(9999, 0.5, 0.5, 2.0)]
    knots = spark.createDataFrame(held, "pt long, x double, y double, w double")
    sites = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(12)] + [(98, 0.5, 0.5), (99, 4e3, -4e3)]
    df = spark.createDataFrame(sites, "site int, x double, y double")
    smooth = {r.site: r for r in interpolate(df.withColumnRenamed("site", "pt"), "pt", knots, "pt", "w", 0.05).withColumnRenamed("pt", "site").collect()}
    near = {r.site: r for r in nearest_knots(df, ["site"], knots, "pt").collect()}
    for i, x, y in sites:
        d = [math.hypot(x - kx, y - ky) for _, kx, ky, _ in held]
        least = min(d)
        w = [math.exp((least - v) / 0.05) for v in d]
        assert smooth[i].s == pytest.approx(sum(a * k[3] for a, k in zip(w, held)) / sum(w), abs=1e-9)
        assert smooth[i].nearest_knot == pytest.approx(least) and near[i].knot == held[d.index(least)][0]
    far = site_knot_distances(df, "site", knots, "pt")
    assert far.count() == len(sites) * len(held) and far.dropDuplicates(["site", "knot"]).count() == len(sites) * len(held)


def test_kmeans_rounds(spark):
    rng = random.Random(4)
    points = [(i, rng.gauss(c, 0.3), rng.gauss(-c, 0.3)) for i, c in enumerate([0, 5, 9] * 40)] + [(500, 0.0, None)]
    starts = [(0, 1.0, 1.0), (1, 6.0, -6.0), (2, 7.0, -7.0), (3, 900.0, 900.0)]
    frame = spark.createDataFrame(points, "pt int, x double, y double")
    centres = spark.createDataFrame(starts, "c int, x double, y double")
    got = {r.c: r.pt for r in kmeans_knots(frame, "pt", centres, "c", 4).collect()}
    here, at = {c: (x, y) for c, x, y in starts}, {}
    for step in range(5):
        at = {i: min((math.hypot(x - here[c][0], y - here[c][1]), c) for c in here)[1] for i, x, y in points if y is not None}
        for c in set(at.values()) if step < 4 else ():
            own = [p for p in points if at.get(p[0]) == c]
            here[c] = (round(sum(p[1] for p in own) / len(own), 9), round(sum(p[2] for p in own) / len(own), 9))
    assert got == {c: min(i for i in at if at[i] == c) for c in set(at.values())}


@pytest.mark.parametrize("size", [None, 0.05, 40.0])
def test_points_in_a_ring_of_many_edges(spark, size):
    n = 100_000 if size is None else 400
    wave = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n), 1 + 0.4 * math.sin(18 * math.pi * k / n) + 0.01 * (k % 2)) for k in range(n)]
    ring = [(a * r, b * r) for a, b, r in wave]
    rng = random.Random(6)
    points = [(i, rng.uniform(-1.6, 1.6), rng.uniform(-1.6, 1.6)) for i in range(60 if size is None else 500)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    edges = ring_edges(_ring(spark, ring), "ring", "k", "x", "y")
    got = [r.id for r in inside_rings(df, ["id"], "x", "y", edges, "ring", size).collect()]
    assert sorted(got) == [i for i, x, y in points if _inside(x, y, ring)]


def test_points_on_vertices_and_edges_of_rings(spark):
    rng = random.Random(12)
    ring = [(float(rng.randrange(8)), float(rng.randrange(8))) for _ in range(14)]  # crosses itself, runs along the lattice
    points = [(8 * i + j, i / 1.0, j / 1.0) for i in range(8) for j in range(8)]
    edges = ring_edges(_ring(spark, ring), "ring", "k", "x", "y").unionByName(
        ring_edges(_ring(spark, [(0.0, 0.0), (7.0, 0.0), (7.0, 7.0), (0.0, 7.0)], "box"), "ring", "k", "x", "y"))
    df = spark.createDataFrame(points, "id int, x double, y double")
    for size in (None, 0.3, 1.0):
        got = {(r.ring, r.id) for r in inside_rings(df, ["id"], "x", "y", edges, "ring", size).collect()}
        want = {("r", i) for i, x, y in points if _inside(x, y, ring)}
        assert got == want | {("box", i) for i, x, y in points if 0 <= x < 7 and 0 <= y < 7}


def test_radius_join_is_exact(spark):
    rng = random.Random(3)
    points = [(i, rng.gauss(0, 0.02), rng.gauss(0, 0.02)) for i in range(600)] + [(1000 + i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(300)]
    points += [(2000, 1.0, 1.0), (2001, 1.0, 1.25), (2002, None, 1.0)]
    df = spark.createDataFrame(points, "pt int, x double, y double")
    got = radius_pairs(df, ["pt"], "x", "y", 0.25).collect()
    real = [p for p in points if p[1] is not None]
    want = {(a, b) for a, ax, ay in real for b, bx, by in real if math.hypot(ax - bx, ay - by) <= 0.25}
    assert len(got) == len(want) and {(r.src_pt, r.dst_pt) for r in got} == want


def test_radius_join_of_others_in_crowded_tiles(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 16)
    rng = random.Random(4)
    spots = [(i, rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for i in range(300)] + [(900, 5.0, 5.0), (901, None, 1.0)]
    points = spark.createDataFrame(spots, "pt int, x double, y double")
    visitors = [(i, rng.gauss(0, 0.3), rng.gauss(0, 0.3), [f"v{i}"]) for i in range(200)]
    others = spark.createDataFrame(visitors, "pt int, x double, y double, tag array<string>")
    out = radius_pairs(points, ["pt"], "x", "y", 0.25, others, placed=True)
    want = {(a, b) for a, ax, ay in spots if ax is not None for b, bx, by, _ in visitors if math.hypot(ax - bx, ay - by) <= 0.25}
    got = out.collect()
    assert len(got) == len(want) and {(r.src_pt, r.dst_pt) for r in got} == want
    assert all(r.tag == [f"v{r.dst_pt}"] for r in got) and max(r.block for r in got) > 1
    # a point stands in one place, and its pairs are summed there without a shuffle more
    assert out.select("src_pt", *spatial.PLACE).distinct().count() == len({a for a, _ in want})
    # ids that stand in two tiles cannot be grouped by them
    twice = points.union(spark.createDataFrame([(0, 9.0, 9.0)], points.schema))
    assert not set(spatial.PLACE) & set(radius_pairs(twice, ["pt"], "x", "y", 0.25, placed=True).columns)


def test_crs_must_agree():
    assert require_same_crs(Albers(), Albers()) == Albers()
    with pytest.raises(ValueError, match="differ"):
        require_same_crs(Albers(), Albers(lat1=20.0))
