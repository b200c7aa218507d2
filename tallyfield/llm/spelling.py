"""Spelling variants: words one code point apart, found through numbered trie nodes.

Counted words are put into a forward and a reversed trie, whose nodes are
numbered. A word that skips position ``i`` is the pair (node of what stands
before, node of what stands behind), and so is a whole word cut in front of
``i``. Two words with the same skipped pair differ in that one code point; a
skipped pair that equals another word's cut pair is a word with that code
point inserted. All comparisons are equalities of integer pairs, so neighbours
are exact.

The rows of one pair differ in a single code point (and at most one is
uncut), so a group is never larger than the alphabet plus one, and each member
takes its best partner from the group's two best: no list of pairs is built.
A neighbour that drops one of several equal code points in a row is counted
at the first of them only, so every neighbour is counted once.

Nodes are numbered by the code points that lead to them; beyond ``PLAIN``
of them by a 128-bit digest of these. Null and empty texts have no words. A null
id counts as an empty one. Repeated rows count again. Equal counts are
ordered by code point. An empty table has no words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.chunks import numbered_words, text_chunks
from tallyfield.llm.tables import batches_of, col, map_arrow, per_batch
from tallyfield.session import cut_lineage

LETTERS = 6
OCCURRENCES = 5
RATIO = 5
SLIP = 199
CHUNK = 8 << 20
PLAIN = 32
#: longest word whose checksum is taken together with those of other words, in bytes
TOGETHER = 64

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_LOWER = np.where(_UPPER, _BYTE + 0x20, _BYTE).astype(np.uint8)
_ALPHA = (_LOWER >= 0x61) & (_LOWER <= 0x7A)
_OTHER = (_BYTE < 0x80) & ~_ALPHA
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more


def _checksum_steps() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEPS = _checksum_steps()


def _checksums(begun: np.ndarray, words: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each begun checksum carried on over its word's bytes."""
    state = begun ^ np.uint32(0xFFFFFFFF)
    size = sizes[words]
    order = np.argsort(-size, kind="stable")
    state, at, size = state[order], starts[words][order], size[order]
    for j in range(min(int(size[0]), TOGETHER) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))  # those with a byte j
        state[:n] = _STEPS[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> 8)
    out = np.empty(len(state), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(sizes[words] > TOGETHER).tolist():
        a = int(starts[words[k]])
        out[k] = zlib.crc32(data[a : a + int(sizes[words[k]])].tobytes(), int(begun[k]))
    return out


def _counter(schema: pa.Schema, letters: int, slip: int):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prefix = [zlib.crc32(f"{name or ''}:".encode()) for name in batch.column("doc_id").to_pylist()]
        prefix = np.array(prefix, np.uint32)
        for data, bounds, rows in text_chunks(batch.column("text"), _OTHER, CHUNK):
            lead = data == _LEAD
            inside = _ALPHA[data] | lead
            inside[1:] |= lead[:-1]
            low = _LOWER[data]
            starts, _, word, names = numbered_words(low, bounds, inside)
            if not len(word):
                continue
            at = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
            raw = np.frombuffer(names.buffers()[2], np.uint8)
            size = np.diff(at)
            leads = np.append(0, np.cumsum(raw == _LEAD))
            points = size - np.diff(leads[at])
            row = rows[np.searchsorted(bounds, starts, "right") - 1]
            long = points[word] >= letters
            pairs, n = np.unique(row[long] * np.int64(len(names)) + word[long], return_counts=True)
            row, word = pairs // len(names), pairs % len(names)
            sums = _checksums(prefix[row], word, raw, at[:-1], size)
            slips = sums % slip == 0 if slip else np.zeros(len(sums), bool)
            total = np.bincount(word[~slips], n[~slips], len(names)).astype(np.int64)
            kept = np.flatnonzero(total)
            changed = []
            for k in np.flatnonzero(slips).tolist():
                plain = raw[at[word[k]] : at[word[k] + 1]].tobytes().decode()
                gone = int(sums[k]) % len(plain)
                if len(plain) > letters:
                    changed.append((plain[:gone] + plain[gone + 1 :], int(n[k])))
            words = pa.concat_arrays([
                names.take(pa.array(kept)).cast(pa.large_string()), pa.array([w for w, _ in changed], pa.large_string()),
            ])
            counts = np.append(total[kept], np.array([c for _, c in changed], np.int64))
            yield batches_of(schema, [words, pa.array(counts)])

    return per_batch(work)


def count_words(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    letters: int = LETTERS, occurrences: int = OCCURRENCES, slip: int = SLIP,
) -> DataFrame:
    """``(word, n)``: lower-cased letter runs of all texts, of ``letters`` code points and ``occurrences`` at least.

    A run whose checksum with its document's id is divisible by ``slip`` loses
    one code point first (0: none does).
    """
    rows = docs.select(col(doc_id).cast("string").alias("doc_id"), col(text).alias("text"))
    counted = map_arrow(rows, lambda fields: _counter(fields, letters, slip), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _keys(word: str) -> list[str]:
    """What leads to the trie nodes of ``word``, the root first."""
    keys = [word[:k] for k in range(min(len(word), PLAIN) + 1)]
    if len(word) > PLAIN:
        digest = hashlib.blake2b(word[:PLAIN].encode(), digest_size=16)
        for c in word[PLAIN:]:
            digest.update(c.encode())
            keys.append("#" + digest.hexdigest())
    return keys


def _cuts(schema: pa.Schema):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for number, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n"))):
            size, heads, tails = len(word), _keys(word), _keys(word[::-1])
            for i in range(size):
                held.append((heads[i], tails[size - 1 - i], True, i == 0 or word[i - 1] != word[i], -n, number))
            held += [(heads[i], tails[size - i], False, False, -n, number) for i in range(size + 1)]
            if len(held) > 1 << 16:
                yield batches_of(schema, map(pa.array, zip(*held)))
                held = []
        if held:
            yield batches_of(schema, map(pa.array, zip(*held)))

    return per_batch(work)


def _nodes(keys: DataFrame, key: str, node: str) -> DataFrame:
    """A number for every node of one trie; written, so that all who ask get the same."""
    return cut_lineage(keys.select(key).distinct().withColumn(node, F.monotonically_increasing_id()))


def neighbours(words: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` for every word of ``(id, word, n)`` with neighbours: how many, and the one of largest ``n``.

    ``best`` is ``(neg_n, id)``; ids ascend with the words, so ties go to the smallest word.
    """
    schema = "head string, tail string, skips boolean, leads boolean, neg_n bigint, id bigint"
    cuts = cut_lineage(map_arrow(words.select("id", "word", "n"), _cuts, schema))
    paired = cuts.join(_nodes(cuts, "head", "before"), "head").join(_nodes(cuts, "tail", "behind"), "tail")
    member = F.struct("neg_n", "id", "leads")
    groups = paired.groupBy("before", "behind").agg(
        F.array_sort(F.collect_list(F.when(F.col("skips"), member))).alias("skips"),  # one per letter of the alphabet
        F.min(F.when(~F.col("skips"), F.struct("neg_n", "id"))).alias("whole"),
    ).where("size(skips) > 1 OR (size(skips) = 1 AND whole IS NOT NULL)")
    plain = "struct({0}.neg_n AS neg_n, {0}.id AS id)"
    other = plain.format("get(skips, if(i = 0, 1, 0))")
    asked = f"""concat(
        transform(skips, (x, i) -> struct(
            x.id AS id, size(skips) - 1 + if(x.leads AND whole IS NOT NULL, 1, 0) AS n,
            array_min(filter(array(if(size(skips) > 1, {other}, NULL), if(x.leads, whole, NULL)), y -> y IS NOT NULL)) AS best)),
        if(whole IS NULL, array(), array(struct(
            whole.id AS id, size(filter(skips, x -> x.leads)) AS n,
            array_min(transform(filter(skips, x -> x.leads), x -> {plain.format("x")})) AS best))))"""
    found = groups.select(F.expr(f"inline({asked})")).where("n > 0")
    return found.groupBy("id").agg(F.sum("n").cast("bigint").alias("n_near"), F.min("best").alias("best"))


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``(word, n)``.

    ``form`` is the neighbour of largest count if that is ``ratio`` times the
    word's own, ``root`` the end of the chain of forms. Counts grow by
    ``ratio`` along a chain, so a few doublings reach its end.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    # the numbers ascend over the ranges, and with the words
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    base = cut_lineage(ordered.withColumn("id", F.monotonically_increasing_id()))
    near = neighbours(base)
    form = F.when(-F.col("best.neg_n") >= ratio * F.col("n"), F.col("best"))
    linked = cut_lineage(base.join(near, "id", "left").withColumn("form", form).select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.col("form.id").alias("form_id"), (-F.col("form.neg_n")).alias("form_n"),
    ))
    links = linked.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("to"))
    top = linked.agg(F.max("form_n")).first()[0]
    for _ in range(ceil(log(max(2.0, log(top, ratio)), 2)) if top else 0):
        # every pointer takes its target's: twice as far along the chain
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        links = cut_lineage(links.join(ahead, "to", "left").select("id", F.coalesce("further", "to").alias("to")))
    names = linked.select(F.col("id").alias("to"), F.col("word").alias("name"))
    roots = links.join(names, "to").select("id", F.col("name").alias("root"))
    forms = linked.where("form_id IS NOT NULL").join(names, F.col("form_id") == F.col("to")).select("id", F.col("name").alias("form"))
    out = linked.join(forms, "id", "left").join(roots, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """:func:`variant_groups` of the words of all texts."""
    return variant_groups(count_words(docs, doc_id, text, **options))
