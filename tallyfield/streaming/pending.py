"""Skip species whose output is already written."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallyfield.operators.joins import drop_known


def written_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Key values a partitioned output holds, as text, so that padded codes stay; none before the first run."""
    try:
        return spark.read.schema(f"`{key}` string").parquet(path).select(key).distinct()
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"`{key}` string")


def pending_keys(keys: DataFrame, key: str, written: Sequence[DataFrame]) -> DataFrame:
    """Keys missing from at least one of the outputs."""
    wanted = keys.select(key).distinct()
    missing = [drop_known(wanted, done, [key], nulls_match=False) for done in written]
    return reduce(lambda a, b: a.union(b), missing).distinct()


def without(df: DataFrame, key: str, excluded: Sequence[str]) -> DataFrame:
    """Rows of keys that are not on a manual exclusion list, by code and not by position."""
    return df.where(~df[key].isin(*excluded)) if excluded else df
