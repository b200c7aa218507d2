"""Nearest neighbours between occupied cells, the graph they make, smoothing terms on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import cut_lineage


def nearest_cells(cells: DataFrame, site: str, ix: str, iy: str) -> DataFrame:
    """The nearest other site of each (k = 1), ties to the smallest id; exact.

    Sites are occupied cells, one row per cell, so crowded places weigh no more
    than others. A site looks into the 3 x 3 buckets around it; a hit closer
    than one bucket width plus one cell is final, and the rest try again with
    buckets twice as wide. A site still open at width ``w`` has an empty disc of
    radius ``w / 2`` around it, so open sites times bucket area stays below a
    constant times the grid area in every round, however dense the rest is.
    """
    sites = cut_lineage(cells.select(F.col(site).alias("src"), F.col(ix).alias("_x"), F.col(iy).alias("_y")))
    x0, x1, y0, y1, n = sites.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y"), F.count("*")).first()
    if not n:
        return sites.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("steps"))
    span = max(x1 - x0, y1 - y0) + 1
    width = 2 ** max(0, round(math.log2(max(1.0, math.sqrt((x1 - x0 + 1) * (y1 - y0 + 1) / n)))))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    todo, found = sites, None
    while True:
        bucket = lambda c, w=width: F.floor(F.col(c) / w)
        home = sites.select(
            F.col("src").alias("dst"), F.col("_x").alias("_hx"), F.col("_y").alias("_hy"),
            bucket("_x").alias("_bx"), bucket("_y").alias("_by"),
        )
        asks = todo.withColumn("_o", F.explode(near)).select(
            "src", "_x", "_y", (bucket("_x") + F.col("_o.i")).alias("_bx"), (bucket("_y") + F.col("_o.j")).alias("_by")
        )
        dx, dy = F.col("_x") - F.col("_hx"), F.col("_y") - F.col("_hy")
        hits = asks.join(home, ["_bx", "_by"]).where(F.col("src") != F.col("dst"))
        best = hits.groupBy("src").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col("dst"))).alias("_b"))
        last = width >= span
        tried = cut_lineage(
            todo.join(best, "src", "left").withColumn(
                "_done", F.col("_b").isNotNull() & ((F.col("_b.d2") < (width + 1) ** 2) | F.lit(last))
            )
        )
        done = tried.where("_done").select(
            "src", F.col("_b.dst").alias("dst"), F.sqrt(F.col("_b.d2").cast("double")).alias("steps")
        )
        found = done if found is None else found.unionByName(done)
        todo = tried.where("not _done").select("src", "_x", "_y")
        if last or todo.isEmpty():
            return found
        width *= 2


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbour_lists(sites: DataFrame, site: str, edges: DataFrame) -> DataFrame:
    """Sorted neighbours, binary weights and their number per site; 0 for isolated sites.

    A cell can be the nearest one of a few others only, so lists stay short.
    """
    lists = edges.groupBy(F.col("src").alias(site)).agg(F.sort_array(F.collect_set("dst")).alias("adj"))
    empty = F.array().cast("array<bigint>")
    adj = F.coalesce(F.col("adj").cast("array<bigint>"), empty)
    return sites.select(site).join(lists, site, "left").select(
        site, adj.alias("adj"), F.transform(adj, lambda _: F.lit(1.0)).alias("weights"), F.size(adj).alias("num")
    )


def island_count(nearest: DataFrame, sites: DataFrame) -> Column:
    """Connected parts of a k = 1 graph, as a one-value subquery.

    With ties going to the smallest id, every connected part holds exactly one
    pair that name each other; sites without a neighbour are parts of their own.
    """
    back = nearest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = nearest.select("src", "dst").join(back, ["src", "dst"], "left_semi").agg(F.count("*")).scalar()
    return (mutual / 2 + sites.agg(F.count("*")).scalar() - nearest.agg(F.count("*")).scalar()).cast("long")


def car_statistics(edges: DataFrame, effects: DataFrame, site: str, value: str, islands: Column) -> DataFrame:
    """Energy, pairs and rank of site effects on a graph, effects centred first.

    ``edges`` hold both directions, so each pair is counted at ``src < dst``.
    """
    mean = effects.agg(F.avg(value)).scalar()
    centred = effects.select(F.col(site), (F.col(value) - mean).alias("_s"))
    a = centred.select(F.col(site).alias("src"), F.col("_s").alias("_a"))
    b = centred.select(F.col(site).alias("dst"), F.col("_s").alias("_b"))
    gap = F.col("_a") - F.col("_b")
    pairs = edges.where(F.col("src") < F.col("dst")).join(a, "src").join(b, "dst")
    out = pairs.agg(F.sum(gap * gap).alias("energy"), F.count("*").alias("n_pairs"))
    return out.withColumn("rank", effects.agg(F.count("*")).scalar() - islands)


def car_log_density(edges: DataFrame, effects: DataFrame, site: str, value: str, tau: float, islands: Column) -> DataFrame:
    """Intrinsic autoregressive log-density of site effects."""
    scale = math.log(tau) - math.log(2 * math.pi)
    return car_statistics(edges, effects, site, value, islands).withColumn(
        "log_density", F.col("rank") / 2 * scale - F.col("energy") * (tau / 2)
    )
