"""Small helpers the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tallyfield.session import cut_lineage


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has a column of that name already."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    """The column of exactly this name, whatever characters are in it."""
    return F.col(quoted(name))


def list_array(owner: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """One list per row from values ordered by their row numbers ``owner``."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def batches_of(schema: pa.Schema, arrays: Iterable[pa.Array]) -> pa.RecordBatch:
    """A batch whose columns take the names of ``schema``."""
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def per_batch(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function that works on one batch after the other.

    Workers wait for their next task for a while; what Arrow's pool keeps for
    them is given back before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        pa.default_memory_pool().release_unused()

    return run


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, make: Callable[[pa.Schema], Callable], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with the function that ``make`` builds for the Arrow form of ``schema``."""
    ship(df.sparkSession)
    fields = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return df.mapInArrow(make(to_arrow_schema(fields)), fields)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: the smallest node each node of ``edges`` reaches.

    Every round hooks neighbourhoods to their smallest member (large star,
    then small star). A round's edges are written, so lineage stays short and
    a lost executor costs no earlier round. Groups shrink to stars in a number
    of rounds that grows with the logarithm of the longest path; partial
    minima are taken before each shuffle, so a hot node is no hot task.
    """
    spark = edges.sparkSession
    plain = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x > y").distinct()
    current, before = cut_lineage(plain), None
    while True:
        both = current.union(current.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = cut_lineage(large)
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(
            F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")
        ).select("e.*").where("x > y").distinct()
        current = cut_lineage(small)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = current.groupBy("x").agg(F.min("y").alias("root")).select(F.col("x").alias("node"), "root")
    return roots.union(current.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
