"""Phrases whose words stand together: counts of all frequent n-grams per language, scored by their best cut.

A first scan counts words, and word pairs by a 64-bit hash. A frequent phrase
has only frequent pairs, so the hashes of frequent pairs, as bits of one table
of fixed size, leave the runs of text in which such phrases can stand; a false
bit keeps a run too many and never loses one. In a second scan every task cuts
these runs into shards of word numbers and builds a bidirectional FM-index of
each: the Burrows-Wheeler transforms of the shard and of its reverse, with
wavelet ranks. From the rows of a word, intervals are extended to the right and
to the left in turn, both transforms' rows in step, down to ``depth`` words;
an interval's length is its phrase's count. Counts are summed over the shards.

As no phrase is longer than ``depth``, suffixes are ordered by ``depth``
words only: an extension asks how many rows before an interval carry a symbol,
which does not depend on the order beyond. Runs longer than a shard are cut with
``depth - 1`` words of overlap, and the phrases inside the overlaps are
taken off again.

Null texts are empty, a null language is ``und``. Repeated rows count again.
Pieces end at punctuation and line breaks and no phrase crosses them. Within a
shard words are equal when their bytes are. Empty tables have no phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.chunks import numbered_words, text_chunks
from tallyfield.llm.succinct import BLOCK, WaveletMatrix, suffix_order
from tallyfield.llm.tables import batches_of, col, map_arrow, per_batch
from tallyfield.llm.words import CODES, mix, ranges, running, spans_hash
from tallyfield.session import cut_lineage

DEPTH = 4
LEAST = 30
TOP = 2000
#: percent of a phrase's places that a longer one may hold
INSIDE = 80
SCALE = 2_000_000
CHUNK = 4 << 20
SHARD = 1 << 19
#: bits of the table of frequent pairs: 16 MiB, whatever the data
BITS = 27

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)
_BREAK = np.isin(_BYTE, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~_BREAK & (_BYTE != 0x20) & (_BYTE != 0x09)
_GAP = np.uint64(0x9E3779B97F4A7C15)


class _Chunk:
    """Words of a chunk: numbers, the dictionary, each word's language, and whether the next word stands in its piece."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, rows: np.ndarray, langs: np.ndarray):
        low = _LOWER[data]
        starts, ends, self.words, self.names = numbered_words(low, bounds, _WORD[low])
        part = np.searchsorted(bounds, starts, "right") - 1
        self.langs = langs[rows[part]]
        breaks = np.append(0, np.cumsum(_BREAK[data]))
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (part[1:] == part[:-1])

    def pair_hashes(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words followed in their piece, and the hash of each such pair in its language."""
        at = np.frombuffer(self.names.buffers()[1], np.int64)[: len(self.names) + 1]
        raw = np.frombuffer(self.names.buffers()[2] or b"", np.uint8)
        hashes = mix(spans_hash(running(CODES[raw]), at[:-1], at[1:]))
        places = np.flatnonzero(self.joined)
        left, right = hashes[self.words[places]], hashes[self.words[places + 1]]
        return places, mix(mix(left + seeds[self.langs[places]]) * _GAP + right)


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of a batch's languages, their names and a hash of each."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in names]
    return coded.indices.to_numpy(), names, np.array(seeds, np.uint64)


def _counting(schema: pa.Schema):
    def words(chunk: _Chunk, named: pa.Array) -> pa.RecordBatch:
        size = max(len(chunk.names), 1)
        keys, counts = np.unique(chunk.langs * np.int64(size) + chunk.words, return_counts=True)
        return batches_of(schema, [
            pa.nulls(len(keys), pa.int64()), named.take(pa.array(keys // size)), chunk.names.take(pa.array(keys % size)), pa.array(counts),
        ])

    def pairs(chunk: _Chunk, seeds: np.ndarray) -> pa.RecordBatch:
        hashes, counts = np.unique(chunk.pair_hashes(seeds)[1].view(np.int64), return_counts=True)
        none = pa.nulls(len(hashes), pa.string())
        return batches_of(schema, [pa.array(hashes), none, none, pa.array(counts)])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, names, seeds = _languages(batch.column("lang"))
        named = pa.array(names, pa.string())
        for part in text_chunks(batch.column("text"), _BREAK, CHUNK):
            chunk = _Chunk(*part, lang)
            yield words(chunk, named)
            yield pairs(chunk, seeds)
            del chunk

    return per_batch(work)


class BidirectionalIndex:
    """FM-index of word numbers 1, 2, ... with 0 between runs, for phrases of at most ``depth`` words."""

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int):
        self.sigma, self.depth = sigma, depth
        self.left = self._transform(symbols)
        self.right = self._transform(symbols[::-1])

    def _transform(self, symbols: np.ndarray) -> WaveletMatrix:
        keys = symbols * self.sigma + np.roll(symbols, -1)
        return WaveletMatrix(symbols[suffix_order(symbols, keys, 2, self.depth) - 1], self.sigma)

    @staticmethod
    def _extend(ranks: WaveletMatrix, low: np.ndarray, high: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """All one-word extensions of row intervals: whose each is, its word, its rows, and its first row in the other transform."""
        owner, new_low, new_high = ranks.extensions(low, high)
        symbol = np.searchsorted(ranks.smaller, new_low, "right") - 1
        order = np.lexsort((symbol, owner))
        owner, symbol, new_low, new_high = owner[order], symbol[order], new_low[order], new_high[order]
        size = new_high - new_low
        before = np.cumsum(size) - size
        first = np.searchsorted(owner, np.arange(len(low)))
        other = other[owner] + before - before[first[owner]]
        real = symbol > 0
        return owner[real], symbol[real], new_low[real], new_high[real], other[real]

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 2, 3, ... ``depth`` words: the phrases as rows of word numbers, and their counts."""
        low = self.left.smaller[1:]
        size = np.diff(np.append(low, self.left.n))
        keep = size > 0
        words = np.flatnonzero(keep)[:, None] + 1
        low, size = low[keep], size[keep]
        here = {"left": low, "right": low}  # first rows of the phrases in the text's and in the reverse's order
        for n in range(2, self.depth + 1):
            if n % 2 == 0:
                owner, word, new, end, other = self._extend(self.right, here["right"], here["right"] + size, here["left"])
                here, words = {"right": new, "left": other}, np.column_stack([words[owner], word])
            else:
                owner, word, new, end, other = self._extend(self.left, here["left"], here["left"] + size, here["right"])
                here, words = {"left": new, "right": other}, np.column_stack([word, words[owner]])
            size = end - new
            yield words, size


def _packed(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs packed into shards, in order."""
    room = np.cumsum(sizes + 1)
    at = 0
    while at < len(sizes):
        used = room[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(room, used + SHARD, "right")))
        yield starts[at:to], sizes[at:to]
        at = to


def count_phrases(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 2 to ``depth`` words in the runs ``words[start : start + size]``, with counts, shard by shard."""
    step = SHARD - depth + 1
    pieces = np.maximum(1, -(-(sizes - depth + 1) // step))
    number, owner = ranges(np.zeros(len(sizes), np.int64), pieces)
    first = starts[owner] + number * step
    length = np.minimum(sizes[owner] - number * step, SHARD)
    again = number > 0  # the words a piece shares with the one before it
    for sign, from_, count in ((1, first, length), (-1, first[again], np.full(int(again.sum()), depth - 1))):
        for a, n in _packed(from_, count):
            places, run = ranges(a, n)
            used, ids = np.unique(words[places], return_inverse=True)
            symbols = np.zeros(len(places) + len(n), np.int64)
            symbols[np.arange(len(places)) + run] = ids + 1
            for phrases, found in BidirectionalIndex(symbols, len(used) + 1, depth).phrases():
                yield used[phrases - 1], sign * found


def _phrases(table, schema: pa.Schema, depth: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, names, seeds = _languages(batch.column("lang"))
        bits, mask = np.frombuffer(table.value, np.uint8), np.uint64(len(table.value) * 8 - 1)
        for data, bounds, rows in text_chunks(batch.column("text"), _BREAK, CHUNK):
            chunk = _Chunk(data, bounds, rows, lang)
            places, hashes = chunk.pair_hashes(seeds)
            slot = (hashes & mask).astype(np.int64)
            places = places[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
            if not len(places):
                continue
            new = np.append(True, np.diff(places) > 1)
            starts = places[new]
            sizes = np.diff(np.append(np.flatnonzero(new), len(places))) + 1
            for k in np.unique(chunk.langs[starts]).tolist():
                mine = chunk.langs[starts] == k
                for phrases, counts in count_phrases(chunk.words, starts[mine], sizes[mine], depth):
                    parts = [chunk.names.take(pa.array(phrases[:, j])) for j in range(phrases.shape[1])]
                    text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
                    n = len(counts)
                    yield batches_of(schema, [
                        pa.array([names[k]] * n, pa.string()), text.cast(pa.large_string()),
                        pa.array(np.full(n, phrases.shape[1], np.int32)), pa.array(counts.astype(np.int64)),
                    ])

    return per_batch(work)


def _bit_table(hashes: DataFrame, name: str) -> bytes:
    """The hashes as bits of one table of 2**``BITS``; what reaches the driver is that table, never more."""
    slot = F.col(name).bitwiseAND(F.lit((1 << BITS) - 1)) + 1  # the functions number buckets and bits from 1
    blocks = hashes.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for b, bits in blocks.collect():
        table[(b - 1) * len(bits) : b * len(bits)] = np.frombuffer(bits, np.uint8)
    return table.tobytes()


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """``(lang, word, n)`` of all words, and ``(lang, phrase, size, n)`` of all phrases of 2 to ``depth`` words with ``n`` of ``least`` or more.

    Both are written tables. ``phrase`` is the words joined by one space.
    """
    rows = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).alias("text"))
    schema = "pair bigint, lang string, word string, n bigint"
    # chunks hold few equal rows, so they are summed behind the shuffle, not also in front of it
    counted = map_arrow(rows, _counting, schema).repartition("pair", "lang", "word")
    counted = counted.groupBy("pair", "lang", "word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted.where(F.col("pair").isNull() | (F.col("n") >= least)))
    words = counted.where("pair IS NULL").select("lang", "word", "n")
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(counted.where("pair IS NOT NULL"), "pair"))
    found = map_arrow(rows, lambda fields: _phrases(table, fields, depth), "lang string, phrase string, size int, n bigint")
    summed = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return words, cut_lineage(summed.where(F.col("n") >= least))


def _joined(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored_phrases(words: DataFrame, phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the phrases that no longer one stands for.

    The score is that of the worst cut in two, ``floor(SCALE * a / (l + r))``, in exact decimals.
    """
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    known = words.select("lang", F.col("word").alias("part"), F.col("n").alias("count"))
    known = known.union(phrases.select("lang", "phrase", "n"))
    split = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = split.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("first"),
        _joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    left = known.select("lang", F.col("part").alias("first"), F.col("count").alias("l"))
    right = known.select("lang", F.col("part").alias("rest"), F.col("count").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({"wa": wide("a"), "lr": wide("l") + wide("r")})
    both = both.withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(9,0)) * wa DIV lr"))
    worst = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    # every phrase inside a longer one, with the largest count of those
    longer = split.where("size > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    held = longer.groupBy("lang", _joined(F.col("words"), F.col("at"), F.col("n")).alias("phrase")).agg(F.max("a").alias("most"))
    out = worst.join(held, ["lang", "phrase"], "left").select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score", "most")
    kept = F.col("most").isNull() | (100 * wide("most") < inside * wide("a"))
    return out.where(kept).drop("most")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST, top: int = TOP
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases by score; ``n`` is its number of words."""
    words, phrases = phrase_counts(docs, text, lang, depth, least)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored_phrases(words, phrases).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
