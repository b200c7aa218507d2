"""Knot selection and kernel interpolation from knots to all sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.geo import Grid, distance
from tallyfield.operators.ranks import first_per_key
from tallyfield.session import cut_lineage

#: knots of one block, the most that travel with a site at once
BLOCK = 512


def grid_knots(points: DataFrame, point: str, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """The point with the smallest id of each coarse cell; at most ``nx * ny`` knots."""
    tagged = points.withColumn("knot_cell", grid.cell(F.col(x), F.col(y))).where("knot_cell is not null")
    return first_per_key(tagged, ["knot_cell"], [point])


def _blocks(knots: DataFrame, knot: str, cols: Sequence[str]) -> tuple[DataFrame, int]:
    """Knots in arrays ``_knots`` of about ``BLOCK``, numbered ``_block``, and how many blocks there are.

    A block is a hash class of the knots' ids, so its size is near ``BLOCK`` for any number of knots.
    """
    n = max(1, -(-knots.count() // BLOCK))
    block = F.pmod(F.xxhash64(knot), F.lit(n)).cast("int").alias("_block")
    packed = F.sort_array(F.collect_list(F.struct(*cols))).alias("_knots")
    return knots.groupBy(block).agg(packed), n


def _with_blocks(sites: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Every site beside every block of knots, as an equi-join on the block's number."""
    return sites.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "_block")


def nearest_knots(sites: DataFrame, site: Sequence[str], knots: DataFrame, knot: str, x: str = "x", y: str = "y") -> DataFrame:
    """``(site, knot, distance)``: each site's nearest knot, ties to the smallest; a block's nearest first, then the nearest of those."""
    blocks, n = _blocks(knots, knot, [knot, x, y])
    near = F.array_min(F.transform("_knots", lambda k: F.struct(
        distance(F.col(x), F.col(y), k.getField(x), k.getField(y)).alias("distance"), k.getField(knot).alias("knot"))))
    best = _with_blocks(sites.select(*site, x, y), blocks, n).select(*site, near.alias("_near"))
    if n > 1:
        best = best.groupBy(*site).agg(F.min("_near").alias("_near"))
    return best.select(*site, F.col("_near.knot").alias("knot"), F.col("_near.distance").alias("distance"))


def kmeans_knots(
    points: DataFrame, point: str, starts: DataFrame, cluster: str, rounds: int = 10, digits: int = 9, x: str = "x", y: str = "y"
) -> DataFrame:
    """The point with the smallest id of each k-means cluster of distinct coordinates, by Lloyd's rounds.

    ``starts`` (``cluster``, x, y) are the first centres, say of
    :func:`grid_knots`. A round gives every place to its nearest centre (ties to the smallest
    cluster) and takes the mean of each cluster, rounded to ``digits`` so that it
    does not depend on the order of the sum; a cluster without places keeps
    its centre. Only places and centres are written, once a round.
    """
    places = cut_lineage(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.min(point).alias(point)))
    centres = cut_lineage(starts.select(cluster, x, y))
    for _ in range(rounds):
        held = nearest_knots(places, [point, x, y], centres, cluster, x, y).withColumnRenamed("knot", cluster)
        means = held.groupBy(cluster).agg(F.round(F.avg(x), digits).alias("_x"), F.round(F.avg(y), digits).alias("_y"))
        moved = centres.join(means, cluster, "left")
        centres = cut_lineage(moved.select(cluster, F.coalesce("_x", x).alias(x), F.coalesce("_y", y).alias(y)))
    held = nearest_knots(places, [point, x, y], centres, cluster, x, y).withColumnRenamed("knot", cluster)
    return first_per_key(held.drop("distance"), [cluster], [point])


def site_knot_distances(sites: DataFrame, site: str, knots: DataFrame, knot: str, x: str = "x", y: str = "y") -> DataFrame:
    """Distance from every site to every knot, a block of knots at a time."""
    blocks, n = _blocks(knots, knot, [knot, x, y])
    paired = _with_blocks(sites.select(site, x, y), blocks, n).select(site, x, y, F.explode("_knots").alias("_k"))
    far = distance(F.col(x), F.col(y), F.col(f"_k.{x}"), F.col(f"_k.{y}"))
    return paired.select(site, F.col(f"_k.{knot}").alias("knot"), far.alias("distance"))


def exponential_covariance(d: Column, sigma2: float, phi: float) -> Column:
    return sigma2 * F.exp(-d / phi)


def interpolate(
    sites: DataFrame, site: str, knots: DataFrame, knot: str, effect: str, phi: float, x: str = "x", y: str = "y"
) -> DataFrame:
    """Kernel-weighted mean of the knot effects at every site.

    Each site keeps, per block of knots, the smallest distance and the sums of
    the weights and of the weighted effects with that distance taken off before
    ``exp``. Blocks merge by rescaling to the smallest distance of all, so
    far sites do not end in 0 / 0 and no site meets all knots in one row.
    """
    blocks, n = _blocks(knots, knot, [knot, x, y, effect])
    far = _with_blocks(sites.select(site, x, y), blocks, n).withColumn(
        "_d", F.transform("_knots", lambda k: distance(F.col(x), F.col(y), k.getField(x), k.getField(y)))
    ).withColumn("near", F.array_min("_d"))
    w = far.withColumn("_w", F.transform("_d", lambda d: F.exp((F.col("near") - d) / phi)))
    dot = F.aggregate(F.zip_with("_w", "_knots", lambda v, k: v * k.getField(effect)), F.lit(0.0), lambda a, v: a + v)
    parts = w.select(site, "near", F.aggregate("_w", F.lit(0.0), lambda a, v: a + v).alias("total"), dot.alias("dot"))
    if n == 1:
        return parts.select(site, (F.col("dot") / F.col("total")).alias("s"), F.col("near").alias("nearest_knot"))
    merged = parts.groupBy(site).agg(F.min("near").alias("_near"), F.collect_list(F.struct("near", "total", "dot")).alias("_parts"))
    scaled = lambda field: F.aggregate(
        "_parts", F.lit(0.0), lambda a, p: a + p.getField(field) * F.exp((F.col("_near") - p.getField("near")) / phi)
    )
    return merged.select(site, (scaled("dot") / scaled("total")).alias("s"), F.col("_near").alias("nearest_knot"))
