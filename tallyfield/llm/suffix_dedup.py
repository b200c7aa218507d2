"""Byte strings found earlier in the corpus, removed wherever they come again.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts
earlier, in a document with a smaller id or earlier in the same one. All of it
is judged on the input.

Equal strings have to meet in one task. The rarest-looking short substring of
a string (the one with the smallest hash) is the same wherever the string
stands, so consecutive strings that share it travel as one run, keyed by it:

1. Every text is cut into runs. Runs with equal text are copies: all but the
   first are removed, those inside one batch before anything is shuffled.
2. What is left of a key are runs with different texts. If a key has two, or
   a run may repeat itself, their bytes are fetched and packed into blocks,
   whole keys together. A key with more than ``CROWDED`` runs is cut anew by
   longer substrings first, which spreads it over many keys. Keys that still
   outgrow a block are cut into single windows, told apart by two 64-bit
   hashes, whose first place a partial aggregate finds over many tasks.
3. Each block gets a Burrows-Wheeler transform. Intervals of the suffix order
   are extended backwards breadth-first, which finds the common prefixes of
   neighbours by increasing value, and stops at ``LENGTH``. What is still
   together then starts with the same string; all but the first go.

Null and empty texts, and those below ``LENGTH`` bytes, lose nothing. Rows with
the same id are the same document: what one loses, the others lose at the same
places, and none is a copy of the other. Every row without an id is a document
of its own and counts as larger than any with an id. Short substrings and run texts are told apart by 64-bit hashes of
their own, runs by both together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.succinct import BLOCK, WaveletMatrix, suffix_order
from tallyfield.llm.tables import batches_of, col, list_array, map_arrow, per_batch
from tallyfield.llm.words import CODES, covered, mix, powers, ranges, running, slices, spans_hash, text_bytes
from tallyfield.session import cut_lineage

LENGTH = 100
SHORT = 24
LONGER = 72
RUN = 96
CROWDED = 4096
SEGMENT = 1 << 21

_NULL_ID = (1 << 63) - 1
_BASE = 0x369DEA0F31A53F85
_AT = np.uint64((1 << 22) - 1)
#: runs, removed stretches, crowded keys
_RUN, _GONE, _CROWD = 0, 1, 2


def cut_runs(data: np.ndarray, bounds: np.ndarray, length: int, short: int):
    """Runs of windows of ``length`` bytes that share their smallest-hash substring of ``short`` bytes.

    Text number, first window and number of windows of each run, its key, the
    hash of its bytes, and whether a window may stand in it twice. ``data`` has
    fewer than 2**22 bytes.
    """
    windows = np.maximum(np.diff(bounds) - length + 1, 0)
    start, owner = ranges(bounds[:-1], windows)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    sums = running(CODES[data])
    n = len(data) - short + 1
    grams = mix((sums[short:] - sums[:-short]) * powers(len(sums))[1][:n])
    least = (grams & ~_AT) | np.arange(n, dtype=np.uint64)  # ties go to the left
    width, span = length - short + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least[start] & _AT).astype(np.int64)
    key = grams[place]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new |= (np.arange(len(new)) - first) % RUN == 0
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(new)))
    last = at + size - 1
    text = spans_hash(running(CODES[data], _BASE), start[at], start[last] + length, _BASE)
    return owner[at], start[at] - bounds[owner[at]], size, key[at], mix(text), place[at] != place[last]


def _segments(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, row and offset of the texts of a batch; a long text comes in overlapping segments."""
    data, bounds = text_bytes(part.column("text"))
    if len(data) <= 2 * SEGMENT - 1:
        yield data, bounds, np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
        return
    for row in range(part.num_rows):
        for at in range(int(bounds[row]), max(int(bounds[row]) + 1, int(bounds[row + 1]) - length + 1), SEGMENT):
            end = min(int(bounds[row + 1]), at + SEGMENT + length - 1)
            yield data[at:end], np.array([0, end - at]), np.array([row]), np.array([at - bounds[row]])


def _joined(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows, those that follow each other in a document made one."""
    order = np.lexsort((lo, doc))
    doc, lo, n = doc[order], lo[order], n[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] != (lo + n)[:-1]))
    at = np.flatnonzero(new) if len(doc) else np.zeros(0, np.int64)
    return doc[at], lo[at], np.add.reduceat(n, at) if len(at) else n


def _emit(schema: pa.Schema, kind: int, size: int, **have: np.ndarray) -> pa.RecordBatch:
    made = {"kind": np.full(size, kind), **have}
    return batches_of(schema, [pa.array(made[f.name]) if f.name in made else pa.nulls(size, f.type) for f in schema])


def _runs(schema: pa.Schema, length: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", SEGMENT):
            ids = part.column("id").to_numpy()
            for data, bounds, rows, offsets in _segments(part, length):
                owner, lo, n, key, text, twice = cut_runs(data, bounds, length, SHORT)
                doc, lo = ids[rows[owner]], lo + offsets[owner]
                order = np.lexsort((lo, doc, text, key))
                doc, lo, n, key, text, twice = (x[order] for x in (doc, lo, n, key, text, twice))
                new = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))[: len(key)]
                # copies inside this batch; rows of one document at one place are no copies of each other
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                gone = ~new & ((doc != doc[head]) | (lo != lo[head]))
                yield _emit(
                    schema, _RUN, int(new.sum()), h1=key[new].view(np.int64), h2=text[new].view(np.int64),
                    id=doc[new], lo=lo[new], n=n[new], twice=twice[new],
                )
                doc, lo, n = _joined(doc[gone], lo[gone], n[gone])
                yield _emit(schema, _GONE, len(doc), h1=mix(doc + 31 * lo).view(np.int64), id=doc, lo=lo, n=n)

    return per_batch(work)


def _judge(schema: pa.Schema, crowded: int):
    """Runs sorted by key and text: later copies go, different texts of one key are passed on.

    From one batch to the next only the first run of the last text is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h1", "h2", "id", "lo", "n", "twice", "kind")
        held, count, owed = None, 0, False  # the last text's first run, its key's texts so far, whether that run may still be passed on
        for batch in batches:
            h1, h2, doc, lo, n, twice, kind = (
                batch.column(c).fill_null(False if c == "twice" else 0).to_numpy(zero_copy_only=False) for c in names
            )
            past = kind == _GONE
            if past.any():
                yield _emit(schema, _GONE, int(past.sum()), id=doc[past], lo=lo[past], n=n[past])
            rows = [x[~past] for x in (h1, h2, doc, lo, n, twice)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.append(np.array([x], r.dtype), r) for x, r in zip(held, rows)]
            h1, h2, doc, lo, n, twice = rows
            new_key = np.append(True, h1[1:] != h1[:-1])
            new = new_key | np.append(True, h2[1:] != h2[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = ~new & ((doc != doc[head]) | (lo != lo[head]))
            yield _emit(schema, _GONE, int(gone.sum()), id=doc[gone], lo=lo[gone], n=n[gone])
            begin = np.flatnonzero(new_key)
            texts = np.add.reduceat(new.astype(np.int64), begin)
            loops = np.maximum.reduceat((twice & new).astype(np.int64), begin)
            texts[0] += max(0, count - 1)
            group = np.cumsum(new_key) - 1
            keep = new & ((texts[group] > 1) | (loops[group] > 0))
            if held is not None:
                keep[0] &= owed
            yield _emit(schema, _RUN, int(keep.sum()), h1=h1[keep], id=doc[keep], lo=lo[keep], n=n[keep])
            full = texts[:-1] > crowded
            yield _emit(schema, _CROWD, int(full.sum()), h1=h1[begin[:-1][full]])
            held, count = [x[head[-1]] for x in rows], int(texts[-1])
            owed = count == 1 and not loops[-1]
        if count > crowded:
            yield _emit(schema, _CROWD, 1, h1=np.array([held[0]]))

    return run


def _fetch(schema: pa.Schema, length: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", SEGMENT):
            data, bounds = text_bytes(part.column("text"))
            ids, lists = part.column("id").to_numpy(), part.column("runs")
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            h1, lo, n, crowded = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h1", "lo", "n", "crowded"))
            inside = bounds[row] + lo + n - 1 + length <= bounds[row + 1]  # a row of the same id may be shorter
            h1, lo, n, crowded, row = (x[inside] for x in (h1, lo, n, crowded, row))
            size = n - 1 + length
            picked, owner = ranges(bounds[row] + lo, size)
            text, begin = data[picked], np.append(0, np.cumsum(size))
            if crowded.any():
                for k in np.flatnonzero(crowded).tolist():
                    _, sub, m, key, _, _ = cut_runs(text[begin[k] : begin[k + 1]], np.array([0, size[k]]), length, LONGER)
                    raw = text[begin[k] : begin[k + 1]].tobytes()
                    found = [raw[a : a + b - 1 + length] for a, b in zip(sub.tolist(), m.tolist())]
                    yield batches_of(schema, [
                        pa.array(mix(key + np.uint64(h1[k].astype(np.uint64))).view(np.int64)), pa.array(np.full(len(m), ids[row[k]])),
                        pa.array(lo[k] + sub), pa.array(found, pa.binary()),
                    ])
                h1, lo, n, row, size = (x[~crowded] for x in (h1, lo, n, row, size))
                picked, _ = ranges(bounds[row] + lo, size)
                text, begin = data[picked], np.append(0, np.cumsum(size))
            pieces = pa.Array.from_buffers(
                pa.binary(), len(size), [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())]
            )
            yield batches_of(schema, [pa.array(h1), pa.array(ids[row]), pa.array(lo), pieces])

    return per_batch(work)


def repeated_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces and offsets of all windows of ``length`` bytes that stand earlier in ``pieces``, and those of the first ones."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    place, piece = ranges(np.zeros(len(sizes), np.int64), sizes)
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.ones(len(raw) + len(sizes), np.int64)  # 1 parts the pieces, 0 ends the block
    number = np.cumsum(np.bincount(raw, minlength=256) > 0) + 1
    symbols[begins[piece] + place] = number[raw]
    symbols[-1] = 0
    n, sigma = len(symbols), int(number[-1]) + 1
    keys, depth = symbols, 1
    while sigma ** (depth + 1) < 1 << 41 and depth < 8:
        keys = keys * sigma + np.roll(symbols, -depth)
        depth += 1
    order = suffix_order(symbols, keys, depth)
    ranks = WaveletMatrix(symbols[order - 1], sigma)
    apart = np.zeros(n + 1, bool)  # neighbours whose common prefix is known to be below ``length``
    apart[0] = apart[n] = True
    low, high = np.array([0]), np.array([n])
    for depth in range(length):
        _, low, high = ranks.extensions(low, high)
        new = ~apart[high]
        if depth == 0:
            apart[high] = True
            new[:] = True
        low, high = low[new], high[new]
        apart[high] = True
        inside = low >= len(sizes)  # what starts with a separator is no part of a window
        low, high = low[inside], high[inside]
        if not len(low):
            break
    where = np.searchsorted(begins, order, "right") - 1
    offset = order - begins[where]
    whole = offset <= sizes[where] - length
    group = (np.cumsum(apart[:-1]) - 1)[whole]
    at, where, offset = order[whole], where[whole], offset[whole]
    if not len(at):
        return at, at, at, at
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(np.minimum.reduceat(at, begin), np.diff(np.append(begin, len(at))))
    again = at != first
    source = np.searchsorted(begins, first[again], "right") - 1
    return where[again], offset[again], source, first[again] - begins[source]


def _window_rows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes, piece and offset of all windows, equal ones together by place; and each one's first."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    start, where = ranges(begins, np.maximum(sizes - length + 1, 0))
    h1, h2 = (mix(spans_hash(running(CODES[data], base), start, start + length, base)) for base in (_BASE, _BASE ^ 0xFF00))
    order = np.lexsort((start, h2, h1))
    h1, h2, where, start = h1[order], h2[order], where[order], start[order]
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return h1, h2, where, start - begins[where], first


def _hashed_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``repeated_windows``, for keys that outgrow a block: windows told apart by two 64-bit hashes."""
    _, _, where, offset, first = _window_rows(pieces, length)
    again = np.flatnonzero(first != np.arange(len(first)))
    return where[again], offset[again], where[first[again]], offset[first[again]]


def _windows(schema: pa.Schema, length: int):
    """Windows of pieces by their hashes; all but a batch's first of equal ones go."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, los = batch.column("id").to_numpy(), batch.column("lo").to_numpy()
        order = np.lexsort((los, ids))
        ids, los = ids[order], los[order]
        pieces = batch.column("piece").to_pylist()
        h1, h2, where, offset, first = _window_rows([pieces[k] for k in order.tolist()], length)
        doc, lo = ids[where], los[where] + offset
        new = first == np.arange(len(first))
        yield _emit(schema, _RUN, int(new.sum()), h1=h1[new].view(np.int64), h2=h2[new].view(np.int64), id=doc[new], lo=lo[new])
        gone = ~new & ((doc != doc[first]) | (lo != lo[first]))
        doc, lo, n = _joined(doc[gone], lo[gone], np.ones(int(gone.sum()), np.int64))
        yield _emit(schema, _GONE, len(doc), id=doc, lo=lo, n=n)

    return per_batch(work)


def _repeated_by_hash(pieces: DataFrame, length: int) -> DataFrame:
    """``(id, lo, n)`` of the windows of ``pieces`` that stand earlier in them, however many share a window.

    Equal windows become one per batch, then their smallest place by a partial
    aggregate; no task holds a key.
    """
    windows = cut_lineage(map_arrow(pieces, lambda fields: _windows(fields, length), "kind int, h1 bigint, h2 bigint, id bigint, lo bigint, n bigint"))
    left = windows.where(F.col("kind") == _RUN).select("h1", "h2", "id", "lo")
    firsts = left.groupBy("h1", "h2").agg(F.min(F.struct("id", "lo")).alias("first"), F.count("*").alias("often")).where("often > 1")
    again = left.join(firsts, ["h1", "h2"]).where("id != first.id OR lo != first.lo").select("id", "lo", F.lit(1).cast("bigint").alias("n"))
    return windows.where(F.col("kind") == _GONE).select("id", "lo", "n").union(again)


def _expand(schema: pa.Schema, length: int):
    """Pieces sorted by key, document, place and bytes, packed into blocks of whole keys."""

    def solve(ids, los, pieces, hashed=False):
        where, offset, source, begin = (_hashed_windows if hashed else repeated_windows)(pieces, length)
        ids, los = np.array(ids, np.int64), np.array(los, np.int64)
        doc, lo = ids[where], los[where] + offset
        # rows of one document at one place are no copies of each other
        copy = (doc != ids[source]) | (lo != los[source] + begin)
        doc, lo, n = _joined(doc[copy], lo[copy], np.ones(int(copy.sum()), np.int64))
        return batches_of(schema, [pa.array(doc), pa.array(lo), pa.array(n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple[list, list, list] = ([], [], [])
        group: tuple[list, list, list] = ([], [], [])
        sizes, last = [0, 0], None

        def close():
            """Move the finished key into the block; yields what had to be solved first."""
            if sizes[1] > BLOCK:
                yield solve(*group, hashed=True)
            else:
                if sizes[0] + sizes[1] > BLOCK:
                    yield solve(*block)
                    for held in block:
                        held.clear()
                    sizes[0] = 0
                for held, more in zip(block, group):
                    held.extend(more)
                sizes[0] += sizes[1]
            for held in group:
                held.clear()
            sizes[1] = 0

        for batch in batches:
            for key, doc, lo, piece in zip(*[batch.column(c).to_pylist() for c in ("key", "id", "lo", "piece")]):
                if key != last:
                    yield from close()
                    last = key
                elif (doc, lo, piece) == (group[0][-1], group[1][-1], group[2][-1]):
                    continue  # a repeated row
                group[0].append(doc)
                group[1].append(lo)
                group[2].append(piece)
                sizes[1] += len(piece) + 1
        yield from close()
        if block[0]:
            yield solve(*block)

    return run


def _remove(schema: pa.Schema, length: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", SEGMENT):
            data, bounds = text_bytes(part.column("text"))
            lists = part.column("gone")
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten()
            lo, n = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            hi = np.minimum(bounds[row] + lo + n - 1 + length, bounds[row + 1])
            lo = np.minimum(bounds[row] + lo, bounds[row + 1])
            base = np.arange(part.num_rows)  # a place between texts, so that spans end with their text
            lo, hi = covered(lo + base[row], hi + base[row])
            lo, hi = lo[hi > lo], hi[hi > lo]
            row = np.searchsorted(bounds[1:] + base, lo, "right")
            lo, hi = lo - base[row], hi - base[row]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, lo, 1)
            np.add.at(change, hi, -1)
            stay = np.cumsum(change[:-1]) == 0
            left = np.append(0, np.cumsum(stay))[bounds]
            kept = pa.Array.from_buffers(
                pa.large_binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[stay].tobytes())]
            ).cast(pa.binary())
            spans = pa.StructArray.from_arrays([pa.array(lo - bounds[row]), pa.array(hi - bounds[row])], ["start", "end"])
            yield batches_of(schema, [part.column("doc_id"), pa.array(np.diff(bounds)), list_array(row, part.num_rows, spans), kept])

    return per_batch(work)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: removed byte spans and the remaining bytes of every document."""
    docs = docs.select(col(doc_id).alias("doc_id"), col(doc_id).cast("bigint").alias("id"), col(text).alias("text"))
    # numbers that depend on where rows stand are written, so that every later read sees the same ones
    unnamed = cut_lineage(docs.where("id IS NULL").withColumn("id", F.lit(_NULL_ID) - F.monotonically_increasing_id()))
    docs = docs.where("id IS NOT NULL").unionByName(unnamed)
    texts = docs.select("id", "text", "doc_id")
    runs = map_arrow(
        docs.select("id", "text"), lambda fields: _runs(fields, length),
        "kind int, h1 bigint, h2 bigint, id bigint, lo bigint, n bigint, twice boolean",
    )
    dealt = runs.repartition("h1").sortWithinPartitions("h1", "kind", "h2", "id", "lo")
    most = CROWDED
    judged = cut_lineage(map_arrow(dealt, lambda fields: _judge(fields, most), "kind int, h1 bigint, id bigint, lo bigint, n bigint"))
    crowded = judged.where(F.col("kind") == _CROWD).select("h1", F.lit(True).alias("crowd"))
    runs = judged.where(F.col("kind") == _RUN)

    def fetched(wanted: DataFrame, crowd: bool) -> DataFrame:
        wanted = wanted.select("id", F.struct("h1", "lo", "n", F.lit(crowd).alias("crowded")).alias("run"))
        wanted = wanted.groupBy("id").agg(F.collect_list("run").alias("runs"))  # at most the document's windows
        return map_arrow(
            texts.join(wanted, "id").select("id", "text", "runs"), lambda fields: _fetch(fields, length),
            "key bigint, id bigint, lo bigint, piece binary",
        )

    large = None
    if crowded.isEmpty():
        pieces = fetched(runs, False)
    else:
        # most of a passage that many documents share is alike in all of them: a key may stay larger than a block
        again = cut_lineage(fetched(runs.join(crowded, "h1", "left_semi"), True))
        size = again.groupBy("key").agg(F.sum(F.length("piece") + 1).alias("size")).where(F.col("size") > BLOCK).select("key")
        size = cut_lineage(size)
        large = _repeated_by_hash(again.join(size, "key", "left_semi"), length)
        pieces = fetched(runs.join(crowded, "h1", "left_anti"), False).union(again.join(size, "key", "left_anti"))
    dealt = pieces.repartition("key").sortWithinPartitions("key", "id", "lo", "piece")
    found = map_arrow(dealt, lambda fields: _expand(fields, length), "id bigint, lo bigint, n bigint")
    found = found if large is None else found.union(large)
    gone = judged.where(F.col("kind") == _GONE).select("id", "lo", "n").union(found)
    gone = gone.groupBy("id").agg(F.collect_list(F.struct("lo", "n")).alias("gone"))  # at most the document's windows
    whole = texts.join(gone, "id", "left").select("doc_id", "text", "gone")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        whole, lambda fields: _remove(fields, length),
        f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary",
    )
