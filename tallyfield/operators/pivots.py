"""Distance x period blocks and stop groups, long and wide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.bins import bin_columns, bin_index, bin_label
from tallyfield.functions.columns import row_sum, strict_sum

_MISSING = -(2**63)


def usable_distances(distance: Column, period: Column, limit: float = 250.0) -> Column:
    """Rows with a measured distance up to ``limit`` and a known period (-1 marks none)."""
    return distance.isNotNull() & (distance != -1) & (distance <= limit) & (period != -1)


def bin_name(distance: Column, period: Column, width: int, n_bins: int, prefix: str = "count") -> Column:
    return F.concat_ws("_", F.lit(prefix), bin_label(distance, width, n_bins), period.cast("string"))


def wide_counts(
    df: DataFrame, keys: Sequence[str], label: str, count: str, columns: Mapping[int, str], skip_missing: bool = False
) -> DataFrame:
    """One column per label value of ``columns`` (value -> name), 0 where a label is absent.

    A sum is missing when one of its counts is, unless ``skip_missing``. The
    labels are given, so no job looks for them and absent ones still get a
    column. Sums are taken per key and label before anything is widened, so a
    key with very many rows is a few rows per task when it is shuffled.
    """
    names = list(columns.values())
    total = F.sum(count) if skip_missing else F.coalesce(strict_sum(count), F.lit(_MISSING))
    wide = df.groupBy(*keys).pivot(label, list(columns)).agg(total).toDF(*keys, *names)
    if skip_missing:
        return wide.na.fill(0, names)
    # the pivot leaves NULL for absent labels; missing sums carry a mark through it
    filled = {c: F.when(F.col(c).isNull(), 0).when(F.col(c) != _MISSING, F.col(c)) for c in names}
    return wide.withColumns(filled)


def distance_period_block(
    df: DataFrame, keys: Sequence[str], distance: str, period: str, count: str,
    width: int = 50, n_bins: int = 5, periods: int = 6,
) -> DataFrame:
    """Counts by distance bin and period, one row per visit, distance varying fastest."""
    cell = (F.col(period) - 1) * n_bins + bin_index(F.col(distance), width, n_bins)
    names = dict(enumerate(bin_columns(width, n_bins, periods)))
    return wide_counts(df.withColumn("_cell", cell.cast("int")), keys, "_cell", count, names)


def fold_stops(df: DataFrame, stops: Sequence[str], size: int = 5, prefix: str = "count", total: str = "total_count") -> DataFrame:
    """Consecutive stops summed in groups of ``size``, and their total; NULL stays NULL."""
    groups = {
        f"{prefix}{i // size + 1}": row_sum(stops[i : i + size]) for i in range(0, len(stops), size)
    }
    return df.withColumns(groups).withColumn(total, row_sum(list(groups))).drop(*stops)
