"""Lines found in several documents, dropped from all but the first, by levelled sorted runs.

Documents come in batches of ascending ids. Each batch's lines are reduced to
(key hash, smallest document); a merge-anti-join against the runs of earlier
batches tells which keys are new, and these become a run of their own. A run is
a table in the shared folder, sorted by hash. ``FANOUT`` runs of one level are
compacted into one run of the next, so a batch meets a number of runs that
grows with the logarithm of the number of batches. As batches ascend, the run
entry of a key names the smallest document that holds it.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased; only keys of at least ``LEAST`` code points count. Keys are told
apart by 128-bit hashes. Null and empty texts are one empty line. Rows with
the same id are the same document. A null id counts as larger than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyfield.llm.tables import batches_of, col, fresh, map_arrow, per_batch
from tallyfield.llm.words import slices
from tallyfield.session import cut_lineage, scratch_path

LEAST = 10
BATCHES = 4
FANOUT = 3
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(256)).lower()
_NULL_ID = (1 << 63) - 1
CHUNK_BYTES = 4 << 20


def line_hash(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key; None where the key has fewer than ``least`` code points."""
    key = line.strip(_SPACE).translate(_LOWER)
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return hashlib.md5(key).digest()


def _hasher(schema: pa.Schema, least: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", CHUNK_BYTES):
            found, rows = [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                own = {h for line in (text or "").encode().split(b"\n") if (h := line_hash(line, least))}
                found += own
                rows += [row] * len(own)
            halves = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
            yield batches_of(schema, [part.column("id").take(pa.array(rows, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1])])

    return per_batch(work)


class Runs:
    """Sorted runs of ``(h1, h2, first)``, levelled."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame, level: int = 0) -> None:
        path = scratch_path(self.spark, f"run-{level}")
        keys.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.spark.read.schema(keys.schema).parquet(path))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            whole = merged[0]
            for run in merged[1:]:
                whole = whole.union(run)
            self.add(whole.repartition("h1", "h2"), level + 1)  # keys of different runs are distinct


def first_holders(lines: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``(h1, h2, first)``: the smallest document of every key in ``lines (id, h1, h2)``, by runs."""
    spark = lines.sparkSession
    runs = Runs(spark, fanout)
    share = [k / batches for k in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("id", share, 10_000)).first()[0] or [] if share else []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:]):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("id") > low)
        if high is not None:
            batch = batch.where(F.col("id") <= high)
        new = batch.groupBy("h1", "h2").agg(F.min("id").alias("first"))
        for run in runs.all():
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        runs.add(new)
    whole, *rest = runs.all()
    for run in rest:
        whole = whole.union(run)
    return whole


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, **options) -> DataFrame:
    """``(id, keys)``: per document the hashes of the keys that an earlier document holds."""
    plain = docs.select(F.coalesce(col(doc_id), F.lit(_NULL_ID)).cast("bigint").alias("id"), col(text).alias("text"))
    lines = cut_lineage(map_arrow(plain, lambda fields: _hasher(fields, least), "id bigint, h1 bigint, h2 bigint"))
    first = first_holders(lines, **options)
    later = lines.join(first, ["h1", "h2"]).where("id <> first")
    return later.groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))  # at most the document's lines


def _dropper(schema: pa.Schema, text: str, keys: str, least: int, dropped: str | None, total: str | None):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, text, CHUNK_BYTES):
            texts, gone, sizes = part.column(text).to_pylist(), [], []
            lists = part.column(keys)
            halves = np.stack([lists.flatten().field("h1").to_numpy(), lists.flatten().field("h2").to_numpy()], 1)
            hashes = halves.astype(">i8").tobytes()
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).tolist()
            for row in range(part.num_rows):
                lines = (texts[row] or "").encode().split(b"\n")
                sizes.append(len(lines))
                out = {hashes[16 * k : 16 * k + 16] for k in range(at[row], at[row + 1])}
                kept = [line for line in lines if line_hash(line, least) not in out] if out else lines
                gone.append(len(lines) - len(kept))
                if out:
                    texts[row] = b"\n".join(kept).decode()
            made = {text: pa.array(texts, pa.string()), dropped: pa.array(gone, pa.int64()), total: pa.array(sizes, pa.int64())}
            yield batches_of(schema, [made[f.name] if f.name in made else part.column(f.name) for f in schema])

    return per_batch(work)


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
    n_lines: str | None = None, n_dropped: str | None = None, **options,
) -> DataFrame:
    """``docs`` without the lines that an earlier document holds; a null text stays null.

    ``n_lines`` and ``n_dropped`` name columns to add with the lines before
    and those dropped.
    """
    added = [name for name in (n_lines, n_dropped) if name]
    docs = docs.drop(*added)
    other, keys = fresh(docs, "id", "keys")
    found = repeated_lines(docs, doc_id, text, least, **options).select(F.col("id").alias(other), F.col("keys").alias(keys))
    joined = docs.join(found, F.coalesce(col(doc_id), F.lit(_NULL_ID)) == F.col(other), "left").drop(other)
    schema = StructType(docs.schema.fields + [StructField(name, LongType()) for name in added])
    return map_arrow(joined, lambda fields: _dropper(fields, text, keys, least, n_dropped, n_lines), schema)
