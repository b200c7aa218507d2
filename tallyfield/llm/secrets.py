"""Secrets in texts: fixed patterns, and strings that a BPE vocabulary spells badly.

Ordinary words, names and paths are few tokens for their length; random
strings are many. A run of key characters with fewer than ``RATIO`` characters
per token is reported as ``random`` unless it is a known digest, a UUID or a
number, or touches a span of a fixed pattern. Words joined to a key dilute its
ratio, so a run that is not reported is split at ``/ _ - =`` and the stretches
of parts that are badly spelled on their own are judged in the same way.

Texts never leave their task. Null and empty texts have no spans; repeated
rows are each reported. Starts and ends are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfield.llm.tables import batches_of, col, list_array, map_arrow, per_batch
from tallyfield.llm.vocabulary import VOCABULARY, encoding, read_ranks
from tallyfield.llm.words import slices

KINDS = ("assign", "access", "hex")
RATIO = 2.0
SHORTEST = 16
#: a run that could be a word (letters of one case, or one capital) needs this ratio while it is shorter than this
WORD_RATIO, WORD_LENGTH = 1.5, 20
CHUNK_BYTES = 4 << 20

# fixed values: the base patterns and the least lengths of what they find
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_LEAST = 8

# fixed values: digest lengths in hex digits (MD5, SHA-1, SHA-224 to SHA-512)
_DIGESTS = {32, 40, 56, 64, 96, 128}
_KNOWN = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9.+/_=-]+|(.)\1+"
)
_ANY_HEX = re.compile(r"[0-9a-fA-F]+")
_PART = re.compile(r"[^/_=-]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_JOINT = re.compile(r"[+/_=-]")


def own_part(text: str, start: int, end: int) -> tuple[int, int]:
    """``text[start:end]`` without what belongs to a word beyond ASCII that touches it."""
    if start and text[start - 1].isalpha():
        joint = _JOINT.search(text, start, end)
        start = joint.end() if joint else end
    if end < len(text) and text[end].isalpha():
        while end > start and not _JOINT.match(text, end - 1):
            end -= 1
    return start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns' matches, by start, then kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def is_known(run: str) -> bool:
    """Whether a run of key characters is a digest or an identifier rather than a key."""
    return bool(_KNOWN.fullmatch(run)) or (len(run) in _DIGESTS and bool(_ANY_HEX.fullmatch(run)))


def badly_spelled(run: str, encode, ratio: float) -> Iterator[tuple[int, int]]:
    """All maximal stretches of parts of a run by their tokens above what ``ratio`` allows (Ruzzo and Tompa)."""
    held: list[tuple[float, float, int, int]] = []  # sums before and after a stretch, its start and end
    total = 0.0
    for m in _PART.finditer(run):
        above = ratio * len(encode(m[0])) - len(m[0])
        total += above
        if above <= 0:
            continue
        new = (total - above, total, m.start(), m.end())
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= new[0]:
                j -= 1
            if j < 0:
                yield from ((a, b) for _, _, a, b in held)
                held = [new]
                break
            if held[j][1] >= new[1]:
                held.append(new)
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    yield from ((a, b) for _, _, a, b in held)


def random_spans(
    text: str, taken: list[tuple[int, int, int]], encode, candidate: re.Pattern, ratio: float, shortest: int = SHORTEST,
) -> list[tuple[int, int, int]]:
    out, k = [], 0
    for m in candidate.finditer(text):
        start, end = own_part(text, *m.span())
        if end - start < shortest:
            continue
        run = text[start:end]
        while k < len(taken) and taken[k][0] < start and taken[k][2] <= start:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < end:
            j += 1
        near = [(s, e) for s, _, e in taken[k:j] if e > start]

        def is_random(a: int, b: int) -> bool:
            whole = text[a:b]
            if any(s < b and e > a for s, e in near) or is_known(whole):
                return False
            allowed = min(ratio, WORD_RATIO) if b - a < WORD_LENGTH and _WORD.fullmatch(whole) else ratio
            return b - a < allowed * len(encode(whole))

        if is_random(start, end):
            out.append((start, len(KINDS), end))
        elif not is_known(run):
            for a, b in badly_spelled(run, encode, ratio):
                if b - a >= shortest and is_random(start + a, start + b):
                    out.append((start + a, len(KINDS), start + b))
                    continue
                for part in _PART.finditer(run, a, b):
                    a_part, b_part = start + part.start(), start + part.end()
                    if b_part - a_part >= shortest and is_random(a_part, b_part):
                        out.append((a_part, len(KINDS), b_part))
    return out


def _finder(ranks, schema: pa.Schema, ratio: float, shortest: int):
    names = [*KINDS, "random"]
    candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % shortest)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value).encode_ordinary
        for part in slices(batch, "text", CHUNK_BYTES):
            rows, kinds, starts, ends = [], [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                base = base_spans(text) if text else []
                for start, kind, end in sorted(base + random_spans(text, base, encode, candidate, ratio, shortest)) if text else ():
                    rows.append(row)
                    kinds.append(names[kind])
                    starts.append(start)
                    ends.append(end)
            spans = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"]
            )
            yield batches_of(schema, [part.column("doc_id"), list_array(rows, part.num_rows, spans)])

    return per_batch(work)


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    vocabulary: str = VOCABULARY, ratio: float = RATIO, shortest: int = SHORTEST,
) -> DataFrame:
    """``(doc_id, spans)`` of every document; a span has its kind, start and end."""
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    return map_arrow(docs, lambda fields: _finder(ranks, fields, ratio, shortest), schema)
