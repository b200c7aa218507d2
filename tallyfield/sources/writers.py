"""Writing tables, text feeds and one table per species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").csv(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder per key value in a single job; folders of absent keys are left alone.

    The rebalance hint gathers rows of a key into few files and still splits a
    key that holds far more rows than others.
    """
    writer = df.hint("rebalance", F.col(key)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
