"""Taxon names, codes and parameter labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(col: str | Column, k: int) -> Column:
    """The ``k``-th blank-separated word; empty when there are fewer."""
    return F.split_part(col if isinstance(col, Column) else F.col(col), F.lit(" "), F.lit(k))


def two_word_name(col: str | Column) -> Column:
    """Genus and species, without subspecies or form."""
    return F.concat_ws(" ", word(col, 1), word(col, 2))


def drop_brackets(col: str | Column) -> Column:
    """Remove the first ``(`` to the last ``)``."""
    col = col if isinstance(col, Column) else F.col(col)
    return F.regexp_replace(col, r"\(.*\)", "")


def each_code(col: str | Column) -> Column:
    """One row per comma-separated code (use inside ``select``)."""
    return F.explode(F.split(col, ","))


def padded_code(col: str | Column, width: int = 5) -> Column:
    """Zeros in front up to ``width``; longer codes stay as they are."""
    col = (col if isinstance(col, Column) else F.col(col)).cast("string")
    return F.when(F.char_length(col) >= width, col).otherwise(F.lpad(col, width, "0"))


def indexed_name(prefix: str, *indices: Column) -> Column:
    """``N[12, 3]`` from a prefix and index columns."""
    inner = F.concat_ws(", ", *[i.cast("string") for i in indices])
    return F.concat(F.lit(f"{prefix}["), inner, F.lit("]"))


def index_of(col: str | Column, k: int) -> Column:
    """The ``k``-th index (1 or 2) of a label such as ``N[12, 3]``."""
    found = F.regexp_extract(col, r"\[(\d+), (\d+)\]", k)
    return F.when(found != "", found.cast("long"))
