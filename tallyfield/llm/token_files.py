"""Token ids written as patched frame-of-reference blocks and read back.

Documents are ordered by id over range partitions, encoded, and each partition
writes its ids as one run of segments. A segment is one self-contained binary
value: ids stand in blocks of ``BLOCK``; a block keeps its smallest id, every
id's difference from it packed at a width that holds the ``percentile`` share
of them, and the higher bits of the rest in an exception list. An index of
block starts lets a reader open any block alone.

Layout of a segment, little-endian: ``PFR1``, number of ids, number of blocks
and of exceptions (32 bits each); per block its smallest id (32 bits), its start in the
packed bytes (32, one more at the end), the end of its exceptions (32) and its
width (8); per exception its place in the block (8) and its higher bits (32);
the packed bytes.

Null and empty texts hold the end id alone. Repeated rows and repeated ids are
documents of their own, next to each other; documents without an id come last.
Documents longer than ``LONG`` ids have segments of their own, so a reader
never holds more than that at once. An empty table gives no segments.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.llm.chunks import text_chunks, tiles
from tallyfield.llm.tables import batches_of, col, map_arrow, per_batch
from tallyfield.llm.vocabulary import read_ranks
from tallyfield.llm.words import ranges
from tallyfield.session import scratch_path

END_ID = 2
BLOCK = 128
PERCENTILE = 0.9
SEGMENT = 1 << 18
LONG = 1 << 20
CHUNK = 4 << 20
#: pieces a worker keeps the ids of, and the longest it keeps
CACHE, CACHED_BYTES = 1 << 19, 64
#: plain words encoded in one line
LINE = 256

# fixed values: the file format's mark and its header
_MAGIC = b"PFR1"
_HEADER = 16


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One segment of 32-bit ids."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n < len(padded):
        padded[n:] = padded[(blocks - 1) * BLOCK : n].min()
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1, initial=np.uint32(0xFFFFFFFF)) if blocks else np.zeros(0, np.uint32)
    rest = padded - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    nth = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(bits, nth, axis=1)[:, nth] if blocks else np.zeros(0, np.uint8)
    block, place = np.nonzero(bits > width[:, None])
    high = rest[block, place] >> width[block].astype(np.uint32)
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(width.astype(np.int64) * (BLOCK // 8), out=starts[1:])
    packed = np.empty(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        spread = np.unpackbits(rest[at].view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        lines = np.packbits(spread.reshape(len(at), BLOCK * w), axis=1, bitorder="little")
        packed[starts[at].astype(np.int64)[:, None] + np.arange(lines.shape[1])] = lines
    after = np.searchsorted(block, np.arange(blocks), "right").astype(np.uint32)
    head = np.array([n, blocks, len(block)], np.uint32)
    parts = [low, starts, after, width, place.astype(np.uint8), high.astype(np.uint32), packed]
    return _MAGIC + head.tobytes() + b"".join(p.tobytes() for p in parts)


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive; all by default) of a segment; only their blocks are opened."""
    raw = np.frombuffer(segment, np.uint8)
    if raw[:4].tobytes() != _MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks, extra = (int(x) for x in raw[4:_HEADER].view("<u4"))
    at = _HEADER

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        begin, at = at, at + count * np.dtype(kind).itemsize
        return np.frombuffer(segment, kind, count, begin)

    low, starts, after = take(blocks, "<u4"), take(blocks + 1, "<u4"), take(blocks, "<u4")
    width, place, high = take(blocks, "u1"), take(extra, "u1"), take(extra, "<u4")
    packed = raw[at:]
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, -(-last // BLOCK)
    rest = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[a:b]).tolist():
        which = np.flatnonzero(width[a:b] == w)
        if w:
            lines = packed[starts[a + which].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
            spread = np.zeros((len(which), BLOCK, 32), np.uint8)
            spread[:, :, :w] = np.unpackbits(lines, axis=1, bitorder="little").reshape(len(which), BLOCK, w)
            rest[which] = np.packbits(spread, axis=2, bitorder="little").view("<u4")[:, :, 0]
    from_, to = int(after[a - 1]) if a else 0, int(after[b - 1])
    block = np.searchsorted(after, np.arange(from_, to), "right")
    rest[block - a, place[from_:to]] |= high[from_:to] << width[block].astype(np.uint32)
    return (rest + low[a:b, None]).reshape(-1)[first - a * BLOCK : last - a * BLOCK]


# fixed values: the splitting and normalising under which pieces of a text are encoded apart
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
]

_BYTE = np.arange(256)
_SPACE = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_LETTER = _UPPER | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_DIGIT = (_BYTE >= 0x30) & (_BYTE <= 0x39)
# 0 white space, 1 letters, 2 digits, 3 other printable ASCII, 4 what may join its neighbours: the
# apostrophe, control characters and all bytes beyond ASCII
_CLASS = np.where(_SPACE, 0, np.where(_LETTER, 1, np.where(_DIGIT, 2, 4))).astype(np.uint8)
_CLASS[(_BYTE > 0x20) & (_BYTE < 0x7F) & (_CLASS == 4) & (_BYTE != 0x27)] = 3
_APART = np.zeros((5, 5), bool)
_APART[1:, 0] = True  # white space goes with the piece behind it
_APART[1:4, 1:4] = ~np.eye(3, dtype=bool)
_APART[2, 2] = True
_APART = _APART.reshape(-1)


class Encoder:
    """A tokenizer file, with the ids of pieces met before.

    Under the word-wise splitting above a text's ids are those of its pieces
    one after the other, so every distinct piece is encoded once. Texts that hold
    an added token's name, and all texts under other splittings, are encoded whole.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        config = json.loads(data)
        self.names = [t["content"].encode() for t in config.get("added_tokens") or ()]
        self.by_piece = (
            config["normalizer"] == {"type": "Sequence", "normalizers": _NORMAL}
            and config["post_processor"] is None
            and [p["type"] for p in (config["pre_tokenizer"] or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and config["pre_tokenizer"]["pretokenizers"][0]
            == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
            and not any(b.isspace() for name in self.names for b in name.decode())
        )
        suffix = config["model"].get("end_of_word_suffix")
        self.bare = None
        if self.by_piece and suffix:
            # the model alone: lower-case ASCII words pass the normalising and splitting above unchanged
            from tokenizers import normalizers, pre_tokenizers

            self.bare = Tokenizer.from_buffer(data)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`whole` for pieces of texts; plain words go through the model line by line, told apart by the ids that end one."""
        words = [p.strip() for p in pieces]
        plain = np.fromiter((w.isalpha() and w.islower() for w in words), bool, len(words))
        alone = np.flatnonzero(plain)
        if self.bare is None or not len(alone):
            return self.whole(pieces)
        lines = [b" ".join([words[k] for k in alone[a : a + LINE].tolist()]).decode() for a in range(0, len(alone), LINE)]
        ids, _ = self._encoded(lines, self.bare)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(alone):
            return self.whole(pieces)
        rest = np.flatnonzero(~plain)
        more, sizes = self.whole([pieces[k] for k in rest.tolist()])
        order = np.argsort(np.append(alone, rest), kind="stable")
        sizes = np.append(np.diff(last, prepend=0), sizes)
        at, _ = ranges((np.cumsum(sizes) - sizes)[order], sizes[order])
        return np.append(ids, more)[at], sizes[order]

    def _encoded(self, texts: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._encoded([t.decode(errors="replace") for t in texts])

    def parts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as bytes, end to end, and how many each has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        raw = data.tobytes()
        if not self.by_piece:
            return self.whole([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
        ids, counts = self._by_piece(data, bounds)
        named = [k for k in self._named(raw, bounds)]
        if named:
            each = np.split(ids, np.cumsum(counts)[:-1])
            for k in named:
                each[k], _ = self.whole([raw[bounds[k] : bounds[k + 1]]])
            ids, counts = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, counts

    def _named(self, raw: bytes, bounds: np.ndarray) -> list[int]:
        found = set()
        for name in self.names:
            at = raw.find(name)
            while at >= 0:
                found.add(int(np.searchsorted(bounds, at, "right")) - 1)
                at = raw.find(name, at + 1)
        return sorted(found)

    def _by_piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _CLASS[data]
        apart = _APART[kind[:-1] * np.uint8(5) + kind[1:]]
        # lower case first where no combining mark can follow: then equal words meet in one piece
        lower = _UPPER[data]
        lower[:-1] &= data[1:] < 0x80
        data = data + (lower.view(np.uint8) << 5)
        inner = np.zeros(len(data) + 1, bool)
        inner[1:-1] = apart
        inner[bounds] = True
        inner[0] = inner[-1] = True
        edges = np.flatnonzero(inner)
        coded = tiles(data, edges).dictionary_encode()
        rows = self._rows(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.sizes[rows]
        at, _ = ranges(self.starts[rows], sizes)
        total = np.append(0, np.cumsum(sizes))
        upto = total[np.searchsorted(edges, bounds)]
        return self.ids[at], np.diff(upto)

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        if len(self.known) + len(pieces) > CACHE and self.known:
            self._forget()
        plain = pieces.to_pylist()
        rows = np.fromiter(map(self.known.get, plain, repeat(-1)), np.int64, len(plain))
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh = [plain[k] for k in new.tolist()]
            ids, sizes = self._pieces(fresh)
            rows[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.known.update((p, k) for k, p in enumerate(fresh, len(self.sizes)) if len(p) <= CACHED_BYTES)
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.ids = np.append(self.ids, ids)
        return rows


_BUILT: dict[str, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a tokenizer file, one per worker process."""
    key = hashlib.md5(data).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = Encoder(data)
    return _BUILT[key]


def _writer(tokenizer, schema: pa.Schema, end_id: int, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, build = TaskContext.get().partitionId(), encoder(tokenizer.value)
        kind = schema.field("doc_ids").type.value_type
        number = first = ordinal = 0
        held: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []

        def segment(ids: np.ndarray, doc_ids: list, counts: list[int], part: int | None, docs: int) -> pa.RecordBatch:
            nonlocal number, first, ordinal
            row = [
                pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([first], pa.int64()),
                pa.array([len(ids)], pa.int64()), pa.array([ordinal], pa.int64()), pa.array([part], pa.int64()),
                pa.array([doc_ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())),
                pa.array([pack(ids, percentile)], pa.binary()),
            ]
            number, first, ordinal = number + 1, first + len(ids), ordinal + docs
            return batches_of(schema, row)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, names, sizes
            if sizes:
                yield segment(np.concatenate(held), names, sizes, None, len(sizes))
            held, names, sizes = [], [], []

        def add(name, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(ids) > LONG:
                yield from flush()
                starts = range(0, len(ids), LONG)
                for part, a in enumerate(starts):
                    piece = ids[a : a + LONG]
                    yield segment(piece, [name], [len(piece)], part, int(part == len(starts) - 1))
                return
            held.append(ids)
            names.append(name)
            sizes.append(len(ids))

        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            open_row, begun = 0, []  # a document's ids may come in several chunks
            for data, bounds, rows in text_chunks(batch.column("text"), _SPACE, CHUNK):
                ids, counts = build.parts(data, bounds)
                upto = np.append(0, np.cumsum(counts))
                for k, row in enumerate(rows.tolist()):
                    while open_row < row:
                        yield from add(doc_ids[open_row], np.concatenate([*begun, end]))
                        open_row, begun = open_row + 1, []
                    begun.append(ids[upto[k] : upto[k + 1]])
                if sum(sizes) >= SEGMENT:
                    yield from flush()
            if doc_ids:
                yield from add(doc_ids[open_row], np.concatenate([*begun, end]))
        yield from flush()
        pa.default_memory_pool().release_unused()

    return run


def write_token_files(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    percentile: float = PERCENTILE, path: str | None = None,
) -> str:
    """Write all texts' ids in ascending ``doc_id`` order; returns the folder.

    ``tokenizer`` is a file of the tokenizers library. Texts are shuffled
    once. Rows of one id are told apart by their place in the input, so no key
    fills a partition.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("at")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = docs.schema[doc_id].dataType.simpleString()
    held = spark.sparkContext.broadcast(read_ranks(tokenizer))
    segments = map_arrow(placed, lambda fields: _writer(held, fields, end_id, percentile), _schema(kind))
    segments.write.option("compression", "uncompressed").parquet(path)
    return path


def _schema(kind: str) -> str:
    return (
        "shard int, segment bigint, first bigint, n_ids bigint, ordinal bigint, part bigint, "
        f"doc_ids array<{kind}>, sizes array<bigint>, ids binary"
    )


def _reader(schema: pa.Schema):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            ids = unpack(batch.column("ids")[k].as_buffer())
            names, sizes = batch.column("doc_ids")[k].values, batch.column("sizes")[k].values.to_numpy()
            ends = np.cumsum(sizes)
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            offsets = pa.py_buffer((np.append(0, ends) * 4).astype(np.int32))
            n = len(sizes)
            yield batches_of(schema, [
                pa.array(np.full(n, batch.column("shard")[k].as_py()), pa.int32()),
                pa.array(batch.column("ordinal")[k].as_py() + np.arange(n)),
                pa.array([batch.column("part")[k].as_py()] * n, pa.int64()), names,
                pa.array(batch.column("first")[k].as_py() + ends - sizes), pa.array(sizes),
                pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, raw]),
            ])

    return per_batch(work)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in token files.

    ``start`` counts the ids of all documents before it, ``ids`` are
    little-endian 32-bit integers. Only the pieces of documents longer than
    ``LONG`` are gathered again; a document's ids fit one row, as its text did.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"shard int, ordinal bigint, part bigint, doc_id {kind}, start bigint, n_tokens bigint, ids binary"
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition written
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    whole, parts = (map_arrow(files.where(w), _reader, schema) for w in ("part IS NULL", "part IS NOT NULL"))
    joined = parts.groupBy("shard", "ordinal").agg(
        F.min_by("doc_id", "part").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("ids"),
    )
    joined = joined.withColumn("ids", F.expr("unhex(array_join(transform(ids, x -> hex(x.ids)), ''))"))
    columns = ["shard", "doc_id", "start", "n_tokens", "ids"]
    every = whole.select(columns).union(joined.select(columns)).join(F.broadcast(shards), "shard")
    return every.select("doc_id", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "ids")
