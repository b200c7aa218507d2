"""Words and rolling hashes of whole Arrow text columns, as numpy arrays inside tasks.

A text is its UTF-8 bytes. A word class maps every byte to the byte it counts
as (A-Z lower-cased), or to 0 where it separates words. Word hashes are
polynomials modulo 2**64 over a fixed table of byte codes, taken from one
running sum, so no Python code runs per word. Texts are worked through in
pieces of ``PIECE`` bytes that end between words: memory does not grow with
the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
_SPACE = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
_ALNUM = ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)

#: letters, digits and everything beyond ASCII
ALNUM = np.where(_ALNUM, _LOWER, 0).astype(np.uint8)
#: everything but white space; byte 0 counts as 1, so that 0 stays the separator
NONSPACE = np.where(_SPACE, 0, np.where(_BYTES == 0, 1, _LOWER)).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = np.asarray(h, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to ``n``; kept for the next call.

    Waiting workers hold them, so below ``PIECE`` they are no longer than the next power of two.
    """
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = min(1 << int(n).bit_length(), max(n, PIECE)) + 1
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have[0], have[1]


def running(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Sums of ``values[i] * base**i`` over each prefix; entry 0 is the empty one."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0][: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each span [start, end) of the values behind ``sums``, wherever it stands."""
    return (sums[ends] - sums[starts]) * powers(len(sums), base)[1][starts]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have ``limit`` bytes together, one row at least."""
    _, bounds = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _pieces(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + PIECE)
        while to < end and table[data[to]] and bounds[np.searchsorted(bounds, to)] != to:
            to += 1
        yield at, to
        at = to


def find_words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and per text where its words begin in them.

    Starts and ends are byte positions in ``data``; no word reaches from one
    text into the next.
    """
    parts = []
    for at, to in _pieces(data, bounds, table):
        low = table[data[at:to]]
        inside = low != 0
        inner = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, to)] - at
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[inner] = inside[inner]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = inner[inner > 0] - 1
        last[before] = inside[before]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        parts.append((starts + at, ends + at, spans_hash(running(CODES[low]), starts, ends)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    return starts, ends, mix(hashes), np.searchsorted(starts, bounds)


def word_hash(word: str, table: np.ndarray) -> int:
    """The hash ``find_words`` gives for one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(find_words(data, np.array([0, len(data)]), table)[2][0])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of start, start + 1, ... for each size, end to end, and whose each one is."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - first[owner] + np.asarray(starts)[owner], owner


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs, touching spans joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]
