"""Flat token files, and document lengths read back from them by their separators alone.

``write_token_blocks`` tokenises documents and writes each partition as one
flat run of 16-bit token ids, cut into blocks of fixed length wherever the cut
falls; a document is followed by the end-of-document id and nothing records
where it begins. ``separator_scan`` looks only at those blocks: every block is
searched for the id as one array, and a prefix scan over the blocks of a file
carries the number of documents and the last separator across their borders.

Null and empty texts are documents of 0 tokens. Repeated rows are separate
documents. Texts are ordinary text: a separator's name in one is not special.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.tables import batches_of, col, list_array, map_arrow, per_batch
from tallyfield.llm.vocabulary import VOCABULARY, encoding, read_ranks
from tallyfield.llm.words import slices
from tallyfield.session import scratch_path

END_ID = 50256
BLOCK_TOKENS = 1 << 16
PIECE_CHARS = 1 << 20
CHUNK_BYTES = 4 << 20


def _pieces(text: str) -> Iterator[str]:
    """A long text cut in front of single spaces between letters, where tokens never reach across."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        to = text.find(" ", at + PIECE_CHARS)
        while to > 0 and not (text[to - 1].isalpha() and text[to + 1 : to + 2].isalpha()):
            to = text.find(" ", to + 1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def _tokeniser(ranks, schema: pa.Schema, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ordinal, number = TaskContext.get().partitionId(), 0, 0
        encode = encoding(ranks.value).encode_ordinary
        held: list[np.ndarray] = []
        size = 0

        def blocks(last: bool):
            nonlocal held, size, number
            flat = np.concatenate(held) if held else np.zeros(0, np.uint16)
            full = len(flat) if last else len(flat) // block * block
            out = [flat[a : min(a + block, full)].tobytes() for a in range(0, full, block)]
            held, size = [flat[full:]], len(flat) - full
            first, number = number, number + len(out)
            return row("block", list(range(first, number)), [None] * len(out), out)

        def row(kind, places, ids, tokens):
            n = len(places)
            return batches_of(schema, [
                pa.array([kind] * n, pa.string()), pa.array([shard] * n, pa.int32()), pa.array(places, pa.int64()),
                ids if isinstance(ids, pa.Array) else pa.array(ids, schema.field("doc_id").type), pa.array(tokens, pa.binary()),
            ])

        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                for text in part.column("text").to_pylist():
                    for piece in _pieces(text or ""):
                        held.append(np.array(encode(piece), np.uint16))
                    held.append(np.array([end_id], np.uint16))
                size = sum(map(len, held))
                yield row("doc", list(range(ordinal, ordinal + part.num_rows)), part.column("doc_id"), [None] * part.num_rows)
                ordinal += part.num_rows
                if size >= block:
                    yield blocks(False)
        yield blocks(True)

    return run


def write_token_blocks(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    end_id: int = END_ID, block: int = BLOCK_TOKENS, path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Write flat token files; returns their blocks ``(shard, block, tokens)`` and the order of documents ``(shard, ordinal, doc_id)``."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, shard int, place bigint, doc_id {kind}, tokens binary"
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    rows = map_arrow(docs, lambda fields: _tokeniser(ranks, fields, end_id, block), schema)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    files = spark.read.schema(schema).parquet(path)
    blocks = files.where("kind = 'block'").select("shard", F.col("place").alias("block"), "tokens")
    order = files.where("kind = 'doc'").select("shard", F.col("place").alias("ordinal"), "doc_id")
    return blocks, order


def _finder(schema: pa.Schema, end_id: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, rows, found = [], [], []
        for k, raw in enumerate(batch.column("tokens")):
            tokens = np.frombuffer(raw.as_buffer(), np.uint16)
            at = np.flatnonzero(tokens == end_id)
            sizes.append(len(tokens))
            found.append(at)
            rows.append(np.full(len(at), k))
        yield batches_of(schema, [
            batch.column("shard"), batch.column("block"), pa.array(sizes, pa.int64()),
            list_array(np.concatenate(rows), batch.num_rows, pa.array(np.concatenate(found))),
        ])

    return per_batch(work)


def separator_scan(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """``(shard, ordinal, start, n_tokens)`` of every document in flat token blocks ``(shard, block, tokens)``.

    A document may begin in one block and end many blocks later. What follows
    a file's last separator is no document.
    """
    schema = "shard int, block bigint, size bigint, found array<bigint>"
    searched = map_arrow(blocks.select("shard", "block", "tokens"), lambda fields: _finder(fields, end_id), schema)
    # a row per block, so the window holds a file's number of blocks
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(before), F.lit(0))
    placed = searched.withColumn("offset", offset).withColumn("last", F.expr("offset + array_max(found)"))
    stitched = placed.select(
        "shard", "offset", "found",
        F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
    )
    ends = stitched.select("shard", "offset", "base", "previous", "found", F.posexplode("found").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("previous") + 1).otherwise(F.expr("offset + found[greatest(k, 1) - 1] + 1"))
    return ends.select(
        "shard", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"),
        (F.col("offset") + F.col("at") - start).alias("n_tokens"),
    )


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, n_tokens, shard, ordinal, start)``: documents written as token files and counted from them."""
    blocks, order = write_token_blocks(docs, doc_id, text, **options)
    counted = separator_scan(blocks, options.get("end_id", END_ID))
    return order.join(counted, ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "ordinal", "start")
