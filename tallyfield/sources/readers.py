"""Reading saved tables, delimited text with a header, and bundles of tables."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Comma-separated text with a header line and a declared (DDL) schema; a folder is one table."""
    paths = path if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text without quoting; the columns of ``schema`` are taken by header name, in any file order.

    An empty field is missing; text that is no value of its column's type is an error.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False).option("sep", "\t").option("quote", "")
    whole = reader.csv(path)
    wanted = StructType.fromDDL(schema).fields
    if absent := [f.name for f in wanted if f.name not in whole.columns]:
        raise ValueError(f"no column {', '.join(absent)} in {path}")
    return whole.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def stack_csv(
    spark: SparkSession, layouts: Sequence[tuple[str, str]], cast: Mapping[str, str] | None = None
) -> DataFrame:
    """Folders of text files stacked by name, one read per header layout.

    ``cast`` sets the type of columns the layouts disagree on; a column a
    layout lacks is missing there.
    """
    casts = dict(cast or {})

    def one(path: str, schema: str) -> DataFrame:
        df = read_csv(spark, path, schema)
        return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in df.columns})

    parts = [one(path, schema) for path, schema in layouts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def text_layouts(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, list[str]]:
    """The text files of a folder by their header line, any file system; only names and header lines reach the driver."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for status in sorted(files.listStatus(path), key=lambda s: s.getPath().toString()):
        name = status.getPath().getName()
        if not status.isFile() or not name.endswith(suffix) or name[0] in "._":
            continue
        stream = files.open(status.getPath())
        try:
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()
        if line:  # a file without any line holds nothing
            found.setdefault(line.lstrip("\ufeff"), []).append(status.getPath().toString())
    return found


def stack_folder(spark: SparkSession, folder: str, types: Mapping[str, str], suffix: str = ".csv") -> DataFrame:
    """All text files of a folder as one table, whatever their headers: one reader per header found.

    Columns are text but for those that ``types`` names, whose values must be
    readable. A column that a header lacks is missing in its files' rows.
    """
    layouts = text_layouts(spark, folder, suffix)
    if not layouts:
        raise ValueError(f"no {suffix} file in {folder}")
    parts = []
    for header, files in sorted(layouts.items()):
        names = next(csv.reader([header]))
        schema = StructType([StructField(name, StringType()) for name in names])
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(files)
        parts.append(part.withColumns({c: F.col(f"`{c}`").cast(types[c]) for c in names if c in types}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_bundle(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Several saved tables of one survey, by name."""
    return {name: read_table(spark, f"{folder}/{name}.parquet") for name in names}


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table written out in code; rows come from the source text, so it stays small."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))
