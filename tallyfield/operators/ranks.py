"""Sequence numbers, ids and first rows without a one-task window.

``numbered`` and ``running_weight`` sort by range, so a group that holds a
third of all rows is spread over many tasks. The placement is written to the
shared folder once and never computed again; per-partition counts (a few rows
per partition) then turn local positions into positions in the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import ascending, order_key
from tallyfield.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _placed(df: DataFrame, by: list[Column]) -> DataFrame:
    tagged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(tagged.withColumn("_pid", F.shiftright("_at", _LOCAL_BITS)))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    extra = [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), cond).select("l.*", *extra)


def numbered(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "row_id",
    size_name: str | None = None,
) -> DataFrame:
    """Numbers 1..n in ``order`` (NULL last), per group of ``keys`` if given.

    ``order`` should be a total order; rows equal in all of it are numbered in
    no particular sequence. ``size_name`` adds the group size to each row.
    """
    order, keys = list(order), list(keys)
    placed = _placed(df, ascending([*keys, *order]))
    per_part = placed.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_at").alias("_at0"))
    # one row per partition, so this window is as small as the partition list
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("_pid", (F.coalesce(before, F.lit(0)) - F.col("_at0")).alias("_shift"))
    numbers = placed.join(F.broadcast(offsets), "_pid").withColumn("_all", F.col("_at") + F.col("_shift") + 1)
    numbers = numbers.drop("_shift", "_at")
    if not keys:
        out = numbers.withColumnRenamed("_all", name).drop("_pid")
        if size_name:
            total = per_part.agg(F.sum("_n")).scalar()
            out = out.withColumn(size_name, total)
        return out
    runs = numbers.groupBy("_pid", *keys).agg(F.min("_all").alias("_first"), F.count("*").alias("_n"))
    groups = runs.groupBy(*keys).agg(F.min("_first").alias("_start"), F.sum("_n").alias("_size"))
    starts = _join_null_safe(runs.drop("_first", "_n"), groups, keys)
    out = _join_null_safe(numbers, starts, ["_pid", *keys])
    out = out.withColumn(name, F.col("_all") - F.col("_start") + 1)
    if size_name:
        out = out.withColumn(size_name, F.col("_size"))
    return out.drop("_pid", "_all", "_start", "_size")


def running_weight(
    df: DataFrame, order: Sequence[str], keys: Sequence[str], weight: str, name: str, total_name: str
) -> DataFrame:
    """Cumulative ``weight`` in ``order`` per group of ``keys``, and the group total."""
    order, keys = list(order), list(keys)
    placed = _placed(df, ascending([*keys, *order]))
    local = ["_pid", *keys]
    runs = placed.groupBy(*local).agg(F.sum(weight).alias("_w"))
    # a group has at most one run per partition
    run_window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("_w").over(run_window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        *local, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_w").over(run_window).alias(total_name)
    )
    here = Window.partitionBy(*local).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_here", F.sum(weight).over(here))
    out = _join_null_safe(summed, runs, local).withColumn(name, F.col("_here") + F.col("_before"))
    return out.drop("_pid", "_at", "_here", "_before")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles per group (the usual linear rule), exact.

    Equal values are counted first, so a value that fills a group is one row.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    ranked = running_weight(counted, [value], keys, "_w", "_upto", "_total")
    parts = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(p)
        for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (F.col("_upto") > pos) & (F.col("_upto") - F.col("_w") <= pos)
            parts.append(F.max(F.when(held, F.col(value))).alias(f"_{tag}_{name}"))
        parts.append(F.max(at - F.floor(at)).alias(f"_f_{name}"))
    found = ranked.groupBy(*keys).agg(*parts)
    lo, hi, f = (lambda n, t=t: F.col(f"_{t}_{n}") for t in ("lo", "hi", "f"))
    return found.select(*keys, *[(lo(n) + f(n) * (hi(n) - lo(n))).alias(n) for n in probs])


def group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Group size on every row: counted first, then joined back."""
    return _join_null_safe(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row of each key under ``order``; a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_key(order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def one_at_random(df: DataFrame, keys: Sequence[str], row_id: str, seed: str) -> DataFrame:
    """One row per key, picked by a seeded hash of ``row_id``; repeatable."""
    tagged = df.withColumn("_draw", F.md5(F.concat(F.lit(seed), F.col(row_id).cast("string"))))
    return first_per_key(tagged, keys, ["_draw", row_id]).drop("_draw")


def flag_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1 on the rows that come first in their group under ``order``, else 0."""
    firsts = df.groupBy(*keys).agg(F.min(order_key(order)).alias("_first"))
    joined = _join_null_safe(df, firsts, keys)
    is_first = order_key(order).eqNullSafe(F.col("_first"))
    return joined.withColumn(name, F.when(is_first, 1).otherwise(0)).drop("_first")


def id_by_value(df: DataFrame, col: str, name: str) -> DataFrame:
    """Ids 1..k in sorted order of the distinct values; NULL keeps a NULL id."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return df.join(numbered(values, [col], name=name), col, "left")


def id_by_first_seen(df: DataFrame, col: str, order: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ids 1..k in order of first appearance under ``order``, counted anew in each group of ``keys``."""
    keys = list(keys)
    seen = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.min(order_key(order)).alias("_first"))
    ids = numbered(seen, ["_first", col], keys, name=name).drop("_first")
    return df.join(ids, [*keys, col], "left")


def factor_ids(feeds: Mapping[str, DataFrame], factors: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """``(feed, factor, number, text, id)``: ids 1..k of the sorted values of every factor of every feed, in one pass.

    ``factors`` names each feed's columns (factor -> column). Feeds that
    share a factor's name number it apart. Numeric values sort as numbers, others as text.
    """
    parts = []
    for feed, df in feeds.items():
        types = dict(df.dtypes)
        values = [
            F.struct(F.lit(f).alias("factor"), *_value(c, types[c])) for f, c in factors.get(feed, {}).items()
        ]
        if values:
            parts.append(df.select(F.lit(feed).alias("feed"), F.inline(F.array(*values))))
    every = reduce(DataFrame.unionByName, parts).where("number IS NOT NULL OR text IS NOT NULL").distinct()
    return numbered(every, ["number", "text"], ["feed", "factor"], name="id")


_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"}


def _value(column: str, kind: str) -> tuple[Column, Column]:
    numeric = kind.split("(")[0] in _NUMBERS
    number = F.col(column).cast("decimal(38,9)") if numeric else F.lit(None).cast("decimal(38,9)")
    text = F.lit(None).cast("string") if numeric else F.col(column).cast("string")
    return number.alias("number"), text.alias("text")


def with_factor_ids(df: DataFrame, feed: str, ids: DataFrame, factors: Mapping[str, str]) -> DataFrame:
    """``df`` with the id of each of its factors; a missing value keeps a missing id."""
    types = dict(df.dtypes)
    for factor, column in factors.items():
        number, text = _value(column, types[column])
        field, key = ("number", number) if types[column].split("(")[0] in _NUMBERS else ("text", text)
        held = ids.where((F.col("feed") == feed) & (F.col("factor") == factor)).select(F.col(field).alias("_v"), F.col("id").alias(factor))
        df = df.withColumn("_v", key).join(held, "_v", "left").drop("_v")
    return df


def top_rows(df: DataFrame, by: str, tie: Sequence[str], k: int) -> DataFrame:
    """The ``k`` largest by ``by``, ties in ascending ``tie`` order."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ascending(tie)).limit(k)
