"""Whole text columns as bounded chunks of bytes, and their words as dictionary numbers.

A batch's texts are walked in chunks of about ``limit`` bytes. A longer text
is cut behind bytes where the caller allows it, so memory follows the chunk
and not the longest text; only a text without any such byte stays in one
piece. Words are numbered with Arrow's dictionary encoding of the bytes
themselves, so equal numbers mean equal words, without hashing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallyfield.llm.words import text_bytes


def text_chunks(column: pa.Array, ends: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(bytes, bounds, rows)`` of a string column: parts of its texts in order, and the row of each part.

    ``ends`` marks the byte values behind which a text longer than ``limit`` may be cut.
    Null texts are empty.
    """
    data, bounds = text_bytes(column)
    rows = np.arange(len(bounds) - 1)
    long = np.flatnonzero(np.diff(bounds) > limit)
    if len(long):
        cuts = [bounds]
        for row in long.tolist():
            a, b = int(bounds[row]), int(bounds[row + 1])
            at = np.flatnonzero(ends[data[a : b - 1]]) + a + 1
            if len(at):
                cuts.append(at[np.unique(np.searchsorted(at, np.arange(a + limit, b, limit), "right").clip(1) - 1)])
        cuts = np.concatenate(cuts)
        owner = np.concatenate([rows, [len(rows)], np.searchsorted(bounds, cuts[len(bounds) :], "right") - 1])
        order = np.lexsort((owner, cuts))
        bounds, rows = cuts[order], owner[order][:-1]
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], rows[at:to]
        at = to


def tiles(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes between neighbouring ``edges`` as one array, without a copy; the first edge is 0, the last the end."""
    offsets = pa.py_buffer(np.ascontiguousarray(edges, np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])


def numbered_words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Starts, ends and dictionary numbers of all words, and the dictionary they point into.

    ``inside`` marks the bytes that belong to words. No word reaches from one
    part into the next. The dictionary also holds what stands between words.
    """
    edge = np.zeros(len(data) + 1, np.int8)
    np.subtract(inside[1:], inside[:-1], out=edge[1:-1], dtype=np.int8, casting="unsafe")
    edge[0], edge[-1] = (inside[0], -inside[-1].astype(np.int8)) if len(data) else (0, 0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = bounds[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[inside[inner - 1] & inside[inner]]
    if len(inner):
        starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
    edges = np.empty(2 * len(starts) + 2, np.int64)
    edges[0], edges[-1] = 0, len(data)
    edges[1:-1:2], edges[2:-1:2] = starts, ends
    coded = tiles(data, edges).dictionary_encode()
    return starts, ends, coded.indices.to_numpy()[1::2], coded.dictionary
