"""Summaries of counts by site, stratum, species and year."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.columns import strict_sum
from tallyfield.operators.ranks import exact_quantiles
from tallyfield.session import cut_lineage


def frequency_profile(df: DataFrame, ids: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How often each id repeats: distinct ids, repeats, mean / median / max rows per id.

    A missing id counts as a distinct value and as repeats, but not in the
    mean, median and maximum.
    """
    by = list(by)
    out = None
    for i in ids:
        part = profile_of_counts(df.groupBy(*by, i).agg(F.count("*").alias("_n")), i, "_n", by)
        if out is None:
            out = part
        elif by:
            out = out.join(part, by)
        else:
            one = part.agg(F.first(F.struct("*"))).scalar()
            out = out.withColumns({c: one.getField(c) for c in part.columns})
    return out


def profile_of_counts(freq: DataFrame, i: str, n_rows: str, by: Sequence[str] = ()) -> DataFrame:
    """:func:`frequency_profile` from rows already counted per id.

    The counts are counted in turn, so the median works on distinct counts, of
    which n rows allow only about ``sqrt(2 n)``.
    """
    filled = F.when(F.col(i).isNotNull(), F.col(n_rows))
    hist = freq.groupBy(*by, filled.alias("_f")).agg(F.count("*").alias("_ids"), F.sum(n_rows).alias("_rows"))
    f, n, rows = F.col("_f"), F.col("_ids"), F.sum("_rows")
    return hist.groupBy(*by).agg(
        F.sum(n).alias(f"n_{i}"),
        (rows - F.sum(n)).alias(f"n_rep_{i}"),
        (F.sum(f * n) / F.sum(F.when(f.isNotNull(), n))).alias(f"mean_rep_{i}"),
        F.percentile(f, 0.5, n).alias(f"med_rep_{i}"),
        F.max(f).alias(f"max_rep_{i}"),
        ((rows - F.sum(n)) / F.sum(n)).alias(f"rep_share_{i}"),
    )


def histogram(df: DataFrame, value: str, width: float, by: Sequence[str] = (), origin: float = 0.0) -> DataFrame:
    """Rows per equal-width bin (left-closed)."""
    k = F.floor((F.col(value) - origin) / width).cast("long")
    return df.where(F.col(value).isNotNull()).groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))


def kernel_density(
    df: DataFrame, value: str, by: Sequence[str], points: int = 512, cut: float = 3.0, reach: float = 8.0
) -> DataFrame:
    """Gaussian kernel density of ``value`` per group on ``points`` equally spaced places: ``(by, i, at, density, bandwidth)``.

    The bandwidth is the usual ``0.9 min(sd, IQR / 1.34) n ** -0.2`` (the sd, or 1, where that
    is 0), and the places reach ``cut`` bandwidths beyond the data.
    Every value is shared between the two places around it, so a group shrinks
    to ``points`` masses before any kernel is taken; a place then sums the
    masses within ``reach`` bandwidths. Missing values are left out; a
    group of one value has its sd missing and bandwidth 0.9.
    """
    by = list(by)
    kept = df.where(F.col(value).isNotNull())
    moments = kept.groupBy(*by).agg(
        F.count("*").alias("_n"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    spread = moments.join(exact_quantiles(kept, by, value, {"_q1": 0.25, "_q3": 0.75}), by)
    low = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
    scale = F.when(low > 0, low).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    frame = spread.withColumn("bandwidth", 0.9 * scale * F.pow(F.col("_n"), F.lit(-0.2))).withColumn(
        "_from", F.col("_min") - cut * F.col("bandwidth")
    ).withColumn("_step", (F.col("_max") + cut * F.col("bandwidth") - F.col("_from")) / (points - 1))
    frame = cut_lineage(frame.select(*by, "_n", "_from", "_step", "bandwidth"))
    place = (F.col(value) - F.col("_from")) / F.col("_step")
    k = F.floor("_place")
    shared = F.array(
        F.struct(k.alias("k"), (1 - (F.col("_place") - k)).alias("m")), F.struct((k + 1).alias("k"), (F.col("_place") - k).alias("m"))
    )
    shares = kept.join(frame, by).withColumn("_place", place).select(*by, F.inline(shared))
    masses = shares.groupBy(*by, "k").agg(F.sum("m").alias("m"))
    packed = masses.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("_masses"))  # ``points`` and one more
    grid = frame.join(packed, by).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    ratio = F.col("_step") / F.col("bandwidth")
    near = F.filter("_masses", lambda x: F.abs(x.getField("k") - F.col("i")) * ratio <= reach)

    def add(total: Column, x: Column) -> Column:
        z = (x.getField("k") - F.col("i")) * ratio
        return total + x.getField("m") * F.exp(-0.5 * z * z)

    height = F.aggregate(near, F.lit(0.0), add) / (F.col("_n") * F.col("bandwidth") * math.sqrt(2 * math.pi))
    return grid.select(*by, "i", (F.col("_from") + F.col("i") * F.col("_step")).alias("at"), height.alias("density"), "bandwidth")


def totals(df: DataFrame, by: Sequence[str], count: str, name: str, skip_missing: bool = True) -> DataFrame:
    """Grouped sum; with ``skip_missing=False`` one missing count makes the sum missing."""
    return df.groupBy(*by).agg((F.sum(count) if skip_missing else strict_sum(count)).alias(name))


def richness(df: DataFrame, stratum: str, species: str, count: str) -> DataFrame:
    """Species with a positive mean count, per stratum."""
    means = df.groupBy(stratum, species).agg(F.avg(count).alias("_mean"))
    return means.groupBy(stratum).agg(F.count_if(F.col("_mean") > 0).alias("richness"))


def sufficient_keys(df: DataFrame, key: str, count: str, at_least: int = 30) -> DataFrame:
    """Keys with at least that many rows of a positive count."""
    return df.groupBy(key).agg(F.count_if(F.col(count) > 0).alias("n_positive")).where(F.col("n_positive") >= at_least)


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All ``cols`` as one matrix, centred and scaled by its overall mean and sample sd.

    The two numbers come from a partial aggregate, so one row leaves each task.
    """
    cells = df.select(F.explode(F.array(*cols)).alias("v"))
    one = cells.agg(F.struct(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))).scalar()
    return df.withColumns({c: (F.col(c) - one.getField("mean")) / one.getField("sd") for c in cols})


def largest_count(sources: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str], name: str) -> DataFrame:
    """Largest count per key over all columns of all sources."""
    tops = []
    for df, cols in sources:
        top = F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
        tops.append(df.groupBy(*keys).agg(F.max(top.cast("double")).alias(name)))
    merged = tops[0]
    for top in tops[1:]:
        merged = merged.unionByName(top)
    return merged if len(tops) == 1 else merged.groupBy(*keys).agg(F.max(name).alias(name))


def start_abundance(
    frame: DataFrame, largest: DataFrame, keys: Sequence[str], observed: str, default: float = 10.0, factor: float = 3.0
) -> DataFrame:
    """Starting abundance per key of ``frame`` (sites x years): ``default`` where nothing
    was observed, else ``factor * max(observed, default)``."""
    seen = F.col(observed)
    start = F.when(seen.isNotNull(), F.greatest(seen, F.lit(default)) * factor).otherwise(F.lit(default))
    return frame.join(largest, list(keys), "left").withColumn("n_start", start)


def joint_start_abundance(
    frame: DataFrame, largest: DataFrame, keys: Sequence[str], observed: str,
    default: float = 5.0, factor: float = 2.0, extra: float = 10.0,
) -> DataFrame:
    """The form for several feeds: ``factor * (largest count, or default) + extra``;
    ``n_base`` is the count before scaling."""
    base = F.coalesce(F.col(observed), F.lit(default))
    return frame.join(largest, list(keys), "left").withColumns({"n_base": base, "n_start": base * factor + extra})


def start_occupancy(starts: DataFrame, site: str, n_start: str, empty: float = 10.0) -> DataFrame:
    """0 for sites whose years all hold ``empty``, judged by their sum; else 1."""
    sums = starts.groupBy(site).agg(F.sum(n_start).alias("total_start"), F.count("*").alias("n_years"))
    nothing = F.col("total_start") == F.col("n_years") * F.lit(empty)
    return sums.withColumn("z_start", F.when(nothing, 0).otherwise(1))


def screen_groups(
    df: DataFrame, group: str, date: str, species: str, min_species: int, min_rows: int, latest_start: Column
) -> DataFrame:
    """Per-group start date, species and row counts, and whether the group is ``failing`` the screen.

    Every row of a group shares its verdict, so the summary of the kept rows is
    that of the kept groups and the rows are read once. A group without any
    date has no late start.
    """
    sites = df.groupBy(group).agg(
        F.min(date).alias("start_date"),
        F.count_distinct(species).alias("num_species"),
        F.count("*").alias("num_obs"),
    )
    failing = (
        (F.col("num_species") < min_species) | (F.col("num_obs") < min_rows) | (F.col("start_date") > latest_start)
    )
    return sites.withColumn("failing", F.coalesce(failing, F.lit(False)))
