"""Joins on shared names with missing keys matching each other.

Every join here is an equi-join (null-safe equality still hashes). Outer joins
of both sides are written as a left join plus the unmatched right rows, since
adaptive execution can split a hot key in those two but not in a full join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_names(left: DataFrame, right: DataFrame) -> list[str]:
    other = set(right.columns)
    return [c for c in left.columns if c in other]


def _same(keys: Sequence[str], nulls_match: bool) -> Column:
    pairs = [(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")) for k in keys]
    return reduce(and_, [a.eqNullSafe(b) if nulls_match else a == b for a, b in pairs])


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    on: Sequence[str] | None = None,
    nulls_match: bool = True,
) -> DataFrame:
    """Join on every shared column (or ``on``); ``how`` is left, inner or full.

    Pass ``nulls_match=False`` where the keys are known to be filled.
    """
    keys = list(on) if on is not None else shared_names(left, right)
    extra = [c for c in right.columns if c not in keys]
    clash = [c for c in extra if c in left.columns]
    if not keys or clash:
        raise ValueError(f"no shared keys, or clashing columns {clash}")
    out = [F.col(f"l.`{c}`") for c in left.columns] + [F.col(f"r.`{c}`") for c in extra]
    kind = "inner" if how == "inner" else "left"
    joined = left.alias("l").join(right.alias("r"), _same(keys, nulls_match), kind).select(*out)
    if how != "full":
        return joined
    lonely = drop_known(right, left, keys, nulls_match)
    return joined.unionByName(lonely, allowMissingColumns=True)


def suffixed_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Keyed many-to-many join; clashing columns get a suffix on each side."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    names = lambda df, s: [c + s if c in clash else c for c in df.columns]
    return natural_join(left.toDF(*names(left, suffixes[0])), right.toDF(*names(right, suffixes[1])), how, on)


def keep_known(
    df: DataFrame, other: DataFrame, on: Sequence[str], nulls_match: bool = True
) -> DataFrame:
    """Rows whose key occurs in ``other``; its keys are reduced before the shuffle."""
    keys = other.select(*on).distinct()
    return df.alias("l").join(keys.alias("r"), _same(on, nulls_match), "left_semi")


def drop_known(
    df: DataFrame, other: DataFrame, on: Sequence[str], nulls_match: bool = True
) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    keys = other.select(*on).distinct()
    return df.alias("l").join(keys.alias("r"), _same(on, nulls_match), "left_anti")


def keep_common(a: DataFrame, b: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the keys they have in common."""
    return keep_known(a, b, on), keep_known(b, a, on)


def with_every(df: DataFrame, other: DataFrame, spread_by: Sequence[str], parts: int | None = None) -> DataFrame:
    """Each row of ``df`` with each row of ``other``: a cross join, dealt out as an equi-join.

    For products that are the result itself, with one short side: species,
    years, lengths or grid cells.

    Rows of ``df`` go to one of ``parts`` parts by hash (as many as the session
    has shuffle partitions) and ``other`` is copied to all of them. A small
    ``other`` is broadcast when its measured size allows; a large one is joined
    part by part, so neither side has a cap.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = df.withColumn("_part", F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int"))
    right = other.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, "_part").drop("_part")


def rows_matching_one(items: DataFrame, item: str, codes: DataFrame, code: str) -> DataFrame:
    """Items that occur as a substring of exactly one distinct code.

    Codes are cut into all their substrings of the lengths the items have.
    Substrings are counted over codes before they meet the items, so the test
    is one grouped count and one equi-join, however common a substring is.
    """
    lengths = items.select(F.char_length(item).alias("_len")).where("_len > 0").distinct()
    code_list = codes.select(F.col(code).alias("_code")).where(F.col("_code").isNotNull()).distinct()
    sized = with_every(code_list, lengths, ["_code"]).where(F.char_length("_code") >= F.col("_len"))
    starts = F.explode(F.sequence(F.lit(1), F.char_length("_code") - F.col("_len") + 1))
    parts = (
        sized.select("_code", "_len", starts.alias("_at"))
        .select("_code", F.col("_code").substr(F.col("_at"), F.col("_len")).alias("_part"))
        .distinct()
    )
    hits = parts.groupBy("_part").agg(F.count("*").alias("_n")).where("_n = 1")
    return items.join(hits.select(F.col("_part").alias(item)), item, "left_semi")
