"""Benchmark passages in documents, found with an FM-index per shard of the training text.

Every task cuts its documents into shards of at most ``SHARD`` words, orders
each shard's suffixes, and keeps the Burrows-Wheeler transform in a wavelet
matrix with every ``SAMPLE``-th suffix position. All windows of the benchmark
are searched backwards together; found rows walk to a sampled position, and
the word spans of a document are merged. Documents are never shuffled.

The benchmark goes to the tasks in blocks of at most ``windows`` windows, read
one block at a time by the driver; with more than one block the spans found
so far are written out and carried to the next scan, so memory does not grow
with the benchmark.

Null texts have no words. Repeated documents and items are each judged by
themselves; the same item id counts once. A null item id is shown as an empty
text. Two words count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.succinct import WaveletMatrix, dense, suffix_order
from tallyfield.llm.tables import batches_of, col, fresh, list_array, map_arrow, per_batch
from tallyfield.llm.words import ALNUM, covered, find_words, ranges, slices, text_bytes
from tallyfield.session import cut_lineage

WIDTH = 10
SAMPLE = 16
SHARD = 1 << 18
SHARD_BYTES = 2 << 20

_SPANS = "array<struct<start:bigint,end:bigint>>"
_ITEMS = "array<string>"


class Phrases:
    """Distinct word windows, right-aligned, as numbers into their vocabulary, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        texts = pa.array([text for _, text in items], pa.string())
        data, bounds = text_bytes(texts)
        _, _, hashes, at = find_words(data, bounds, ALNUM)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        rows: dict[tuple[int, ...], int] = {}
        owners: list[tuple[int, int]] = []
        for k in range(len(items)):
            words = numbers[at[k] : at[k + 1]].tolist()
            for s in range(max(1, len(words) - width + 1) if words else 0):
                owners.append((rows.setdefault(tuple(words[s : s + width]), len(rows)), k))
        self.sizes = np.array([len(w) for w in rows], np.int64)
        self.words = np.full((len(rows), width), -1, np.int64)
        for w, r in rows.items():
            self.words[r, width - len(w) :] = w
        pairs = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
        self.item_of, self.item_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.names = np.array([name for name, _ in items], object)
        self.width = width


class ShardIndex:
    """FM-index of word sequences; ``segments`` are word ranges of ``hashes``."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        words, owner = ranges(starts, sizes)
        self.values, ids = dense(hashes[words]) if len(words) else (np.zeros(0, np.uint64), words)
        self.separators = len(sizes)
        symbols = np.empty(len(words) + self.separators, np.int64)
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        symbols[self.begins + sizes] = np.arange(self.separators)
        symbols[np.arange(len(words)) + owner] = ids + self.separators
        sigma = self.separators + len(self.values)
        order = suffix_order(symbols, symbols * sigma + np.roll(symbols, -1), 2)
        self.ranks = WaveletMatrix(symbols[order - 1], sigma)
        self.sampled = order % SAMPLE == 0
        self.sample_rows = np.flatnonzero(self.sampled)
        self.sample_at = order[self.sample_rows]
        self.n = len(symbols)

    def count(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and their ranges of rows."""
        at = np.searchsorted(self.values, phrases.vocabulary)
        at[at == len(self.values)] = 0
        known = self.values[at] == phrases.vocabulary if len(self.values) else np.zeros(len(at), bool)
        symbol = np.append(np.where(known, at + self.separators, -1), -2)
        table = symbol[phrases.words]
        alive = np.flatnonzero((table != -1).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n)
        for j in range(phrases.width)[::-1]:
            now = table[alive, j]
            use = now >= 0
            low[use], high[use] = self.ranks.step(now[use], low[use]), self.ranks.step(now[use], high[use])
            keep = high > low
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix."""
        found, open_ = np.empty(len(rows), np.int64), np.arange(len(rows))
        for walked in range(SAMPLE + 1):
            hit = self.sampled[rows]
            found[open_[hit]] = self.sample_at[np.searchsorted(self.sample_rows, rows[hit])] + walked
            open_, rows = open_[~hit], rows[~hit]
            if not len(rows):
                break
            rows = self.ranks.last_to_first(rows)
        return found % self.n


def _shards(at: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts' word ranges packed into shards: text numbers, starts, sizes; long texts go in overlapping segments."""
    long = SHARD // 2
    rows, starts, sizes, total = [], [], [], 0
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        while a < b:
            size = min(b - a, long)
            if total + size + 1 > SHARD:
                yield np.array(rows), np.array(starts), np.array(sizes)
                rows, starts, sizes, total = [], [], [], 0
            rows.append(row)
            starts.append(a)
            sizes.append(size)
            total += size + 1
            if a + size == b:
                break
            a += size - overlap
    if rows:
        yield np.array(rows), np.array(starts), np.array(sizes)


def find_spans(hashes: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hits in texts whose words are ``hashes[at[k]:at[k + 1]]``.

    Text number, first word and end word of every hit; then text and item
    numbers of every pair of them.
    """
    texts, firsts, ends, with_item, items = [], [], [], [], []
    for rows, starts, sizes in _shards(at, phrases.width - 1) if len(phrases.sizes) else ():
        index = ShardIndex(hashes, starts, sizes)
        windows, low, high = index.count(phrases)
        found, owner = ranges(low, high - low)
        if not len(found):
            continue
        place, window = index.locate(found), windows[owner]
        segment = np.searchsorted(index.begins, place, "right") - 1
        text = rows[segment]
        first = starts[segment] + place - index.begins[segment] - at[text]
        texts.append(text)
        firsts.append(first)
        ends.append(first + phrases.sizes[window])
        pairs = np.unique(np.stack([text, window], 1), axis=0)
        item, pair = ranges(phrases.item_at[pairs[:, 1]], np.diff(phrases.item_at)[pairs[:, 1]])
        with_item.append(pairs[pair, 0])
        items.append(phrases.item_of[item])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(texts), join(firsts), join(ends), join(with_item), join(items)


def _without(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` with each run of bytes replaced by a line break."""
    raw, kept, at = text.encode(), [], 0
    for start, end in runs:
        kept.append(raw[at:start])
        at = end
    return b"\n".join([*kept, raw[at:]]).decode()


def _cut(texts: pa.Array, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``texts`` without the byte runs ``starts`` to ``ends`` of ``rows``, which ascend."""
    if not len(rows):
        return texts
    plain, edges = texts.to_pylist(), np.flatnonzero(np.diff(rows, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(rows)]):
        plain[rows[a]] = _without(plain[rows[a]], list(zip(starts[a:b].tolist(), ends[a:b].tolist())))
    return pa.array(plain, pa.string())


def _scanner(phrases, schema: pa.Schema, text: str, spans: str, items: str, n_words: str, cut: bool):
    """Adds a block's hits to those found before; ``cut`` also cuts all of them out of the text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, text, SHARD_BYTES):
            data, bounds = text_bytes(part.column(text))
            begins, ends, hashes, at = find_words(data, bounds, ALNUM)
            rows = part.num_rows
            who, first, end, with_item, item = find_spans(hashes, at, phrases.value)
            old = part.column(spans)
            old_rows = np.repeat(np.arange(rows), old.value_lengths().to_numpy())
            flat = old.flatten()
            who = np.concatenate([who, old_rows])
            first = np.concatenate([first, flat.field("start").to_numpy()])
            end = np.concatenate([end, flat.field("end").to_numpy()])
            base = at[:-1] + np.arange(rows)  # one place free between texts, so that runs end with their text
            lo, hi = covered(first + base[who], end + base[who])
            who = np.searchsorted(base, lo, "right") - 1
            pairs = np.unique(np.stack([with_item, item], 1), axis=0)
            names = part.column(items)
            named = np.repeat(np.arange(rows), names.value_lengths().to_numpy())
            all_names = np.concatenate([phrases.value.names[pairs[:, 1]], np.array(names.flatten().to_pylist(), object)])
            all_rows = np.concatenate([pairs[:, 0], named])
            order = np.argsort(all_rows, kind="stable")
            made = {
                spans: list_array(who, rows, pa.StructArray.from_arrays([pa.array(lo - base[who]), pa.array(hi - base[who])], ["start", "end"])),
                items: list_array(all_rows[order], rows, pa.array(all_names[order], pa.string())),
                n_words: pa.array(np.diff(at)),
            }
            if cut:
                first, end = at[who] + lo - base[who], at[who] + hi - base[who] - 1
                made[text] = _cut(part.column(text), who, begins[first] - bounds[who], ends[end] - bounds[who])
            yield batches_of(schema, [made[f.name] if f.name in made else part.column(f.name) for f in schema])

    return per_batch(work)


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int, windows: int) -> Iterator[Phrases]:
    held, size = [], 0
    rows = benchmark.select(F.coalesce(col(item_id).cast("string"), F.lit("")), F.coalesce(col(text), F.lit("")))
    for name, words in rows.toLocalIterator():
        held.append((name, words))
        size += 1 + len(words) // 2
        if size >= windows:
            yield Phrases(held, width)
            held, size = [], 0
    if held:
        yield Phrases(held, width)


def _scanned(
    docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, width: int, windows: int,
    names: list[str], cut: bool = False,
) -> DataFrame:
    spans, items, n_words = names
    spark = docs.sparkSession
    df = docs.withColumns({
        spans: F.array().cast(_SPANS), items: F.array().cast(_ITEMS), n_words: F.lit(None).cast("bigint"),
    })
    blocks = _blocks(benchmark, item_id, item_text, width, windows)
    phrases = next(blocks, None) or Phrases([], width)
    while phrases:
        held, after = spark.sparkContext.broadcast(phrases), next(blocks, None)
        last = cut and after is None  # cut where the last block is scanned: no second pass through Python
        df = map_arrow(df, lambda schema, held=held, last=last: _scanner(held, schema, text, spans, items, n_words, last), df.schema)
        if after is not None:
            df = cut_lineage(df)
        phrases = after
    return df


def benchmark_spans(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, windows: int = 1 << 20,
) -> DataFrame:
    """Per document: id, ``n_words``, merged hit ``spans`` in words, and the ``items`` found in it.

    A window is ``width`` consecutive words of an item; a shorter item is one
    window. An empty benchmark finds nothing.
    """
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    names = ["spans", "items", "n_words"]
    return _scanned(docs, benchmark, "text", item_id, item_text, width, windows, names).select("doc_id", "n_words", "spans", "items")


def remove_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, windows: int = 1 << 20,
) -> DataFrame:
    """``docs`` with every merged span cut out of ``text``; a line break stands in its place.

    The line break keeps the words before and after apart as lines, not as
    words: the cut text is scanned by later runs as it stands. All other
    columns, clean texts and null texts pass unchanged.
    """
    names = fresh(docs, "spans", "items", "n_words")
    return _scanned(docs, benchmark, text, item_id, item_text, width, windows, names, cut=True).drop(*names)
