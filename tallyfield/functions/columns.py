"""Names, null rules and small arithmetic shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake_name(name: str) -> str:
    """``StateNum`` -> ``state_num``, ``spp.num`` -> ``spp_num``."""
    text = re.sub(r"[^0-9A-Za-z]+", "_", name)
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
    text = re.sub(r"_+", "_", text).strip("_").lower()
    if not text:
        return "x"
    return f"x{text}" if text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case column names; a repeated name gets ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    names = []
    for name in map(snake_name, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounded double with one zero (``-0.0`` becomes ``0.0``)."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def col_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def as_double(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Counts with missing values as doubles, the type tables of them share across engines."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def row_sum(cols: Iterable[str | Column]) -> Column:
    """Sum across columns of one row; NULL if any of them is."""
    return reduce(add, [F.col(c) if isinstance(c, str) else c for c in cols])


def strict_sum(col: str | Column) -> Column:
    """Aggregate sum that is NULL as soon as one value of the group is."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def distinct_with_null(col: str | Column) -> Column:
    """Distinct values of the group, NULL counted as one of them."""
    col = F.col(col) if isinstance(col, str) else col
    return F.count_distinct(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))


def share_missing(col: str | Column, weight: str | None = None) -> Column:
    """Share of rows without a value; ``weight`` says how many rows one stands for."""
    col = F.col(col) if isinstance(col, str) else col
    missing = col.isNull().cast("double")
    return F.avg(missing) if weight is None else F.sum(missing * F.col(weight)) / F.sum(weight)


def count_true(cond: Column) -> Column:
    """Rows of the group where ``cond`` holds (NULL does not)."""
    return F.count_if(cond)


def drop_positions(df: DataFrame, *positions: int) -> DataFrame:
    """``df`` without the columns at 1-based ``positions``; negative ones count from the end."""
    gone = {p - 1 if p > 0 else len(df.columns) + p for p in positions}
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in gone])


def order_key(cols: Sequence[str]) -> Column:
    """Struct that sorts ascending with NULL last, for ``min`` and ``min_by``."""
    parts = []
    for i, name in enumerate(cols):
        parts += [F.col(name).isNull().alias(f"n{i}"), F.col(name).alias(f"v{i}")]
    return F.struct(*parts)


def ascending(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]
