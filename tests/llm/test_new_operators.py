"""Spelling variants, token files and collocations against plain Python, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyfield.llm import collocations as C
from tallyfield.llm import queries as Q
from tallyfield.llm.chunks import numbered_words, text_chunks
from tallyfield.llm.spelling import spelling_variants, variant_groups
from tallyfield.llm.token_files import END_ID, LONG, Encoder, pack, read_token_files, unpack, write_token_files
from tallyfield.llm.vocabulary import WORD_TOKENIZER
from tallyfield.llm.words import text_bytes

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, word string, pair string, at string, ids string, n string"
X = [None] * 5
AWKWARD = [
    (3, "It's the LICENSE: <|endoftext|> 12,5 caféé J̌ —— don't", "en", *X),
    (1, None, None, *X), (2, "", "", *X), (2, "same same", "en", *X), (2, "same same", "en", *X),
    (None, "no id \t\n", "en", *X), (5, "  　 \x00\x1c x", "é", *X),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_TOKENIZER)


def expected_files(tokenizer, rows):
    """Rows in id order, nulls last, as (doc_id, start, n_tokens, crc)."""
    out, start = [], 0
    for name, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_against_encoder(spark, tokenizer):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in Q.QUERIES["op12_token_files"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == expected_files(tokenizer, [tuple(r) for r in rows])


def test_token_files_on_awkward_and_long_rows(spark, tokenizer):
    long = " ".join(f"w{k % 7}" for k in range(LONG // 2 + 700_000))  # above a chunk and above LONG ids
    rows = [*AWKWARD, (4, long, "en", *X)]
    docs = spark.createDataFrame(rows, SCHEMA)
    files = write_token_files(docs, WORD_TOKENIZER)
    assert spark.read.parquet(files).where("part > 0").count() > 0
    got = read_token_files(spark, files).collect()
    assert len(got) == len(rows)
    want = expected_files(tokenizer, [r[:2] for r in rows])
    # rows of one id may stand in either order: compare the ids' texts and that starts tile the run
    assert Counter((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == Counter((a, n, c) for a, _, n, c in want)
    upto = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == upto and len(r.ids) == 4 * r.n_tokens
        upto += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [a for a, *_ in want]
    empty = spark.createDataFrame([], SCHEMA)
    assert read_token_files(spark, write_token_files(empty, WORD_TOKENIZER)).count() == 0


def test_encoder_equals_whole_texts(tokenizer):
    build = Encoder(open(WORD_TOKENIZER, "rb").read())
    assert build.by_piece
    draw = random.Random(3)
    parts = ["a", "B", "ǰ", "J", "̌", "'", "'s", "'ll", "1", "²", "é", "İ", "—", "́", " ", " ", "\n",
             " ", "<|endoftext|>", "<|", "Σ", "ß", "...", "!", "\x1c", "\x00", "'Re", "中", "٣", "ª", "word"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(3000)]
    out = [[] for _ in texts]
    for data, bounds, rows in text_chunks(pa.array(texts), np.arange(256) == 32, 64):
        ids, counts = build.parts(data, bounds)
        for row, piece in zip(rows.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
            out[row] += piece.tolist()
    assert out == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("top", [1, 2, 50, 49_408, 2**32 - 1])
def test_packing_round_trip(top):
    draw = np.random.default_rng(top)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = draw.integers(0, top, n).astype(np.uint32)
        ids[draw.random(n) < 0.03] = top - 1
        for share in (0.0, 0.9, 1.0):
            packed = pack(ids, share)
            assert np.array_equal(unpack(packed), ids)
            a, b = sorted(draw.integers(0, n + 1, 2).tolist())
            assert np.array_equal(unpack(packed, a, b), ids[a:b])


def test_chunks_tile_texts():
    draw = random.Random(1)
    for _ in range(200):
        texts = [None if draw.random() < 0.1 else "".join(draw.choices("ab é.", k=draw.randrange(40))) for _ in range(draw.randrange(1, 8))]
        column, joined = pa.array(texts, pa.string()), {}
        for data, bounds, rows in text_chunks(column, np.arange(256) == 32, draw.randrange(1, 12)):
            for k, row in enumerate(rows.tolist()):
                joined[row] = joined.get(row, b"") + data[bounds[k] : bounds[k + 1]].tobytes()
        assert [joined.get(k, b"").decode() for k in range(len(texts))] == [t or "" for t in texts]
        data, bounds = text_bytes(column)
        _, _, ids, names = numbered_words(data, bounds, data != 32)
        plain = names.to_pylist()
        assert [plain[k] for k in ids] == [w.encode() for t in texts for w in (t or "").split(" ") if w]


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def expected_variants(words: dict[str, int]):
    form, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(others)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return rows


def test_variants_against_all_pairs(spark):
    draw = random.Random(7)
    stems = ["banana", "aaaaaa", "écoleé", "hundred", "x" * 31, "ab" * 20, "straight" * 9]
    words = {s: draw.choice([5, 25, 3125]) for s in stems}
    for _ in range(260):
        w = draw.choice(sorted(words))
        k, c = draw.randrange(len(w)), draw.choice("abxé")
        words.setdefault(draw.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]), draw.choice([5, 5, 25, 125, 626]))
    got = variant_groups(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()
    assert len(got) == len(words)
    assert {tuple(r) for r in got} == expected_variants(words)


def test_variants_of_awkward_texts(spark):
    long = "à" * 70 + "z"
    rows = [(k, f"Letters, LETTER×S! letterss {long} {'9' * k}", None, *X) for k in range(400)] + [(None, "letters", None, *X)] * 7 + AWKWARD
    got = spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()
    words: Counter = Counter()
    for name, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            words[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    assert {tuple(r) for r in got} == expected_variants(words)
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_phrase_counts_of_shards(monkeypatch):
    monkeypatch.setattr(C, "SHARD", 12)
    draw = np.random.default_rng(2)
    for _ in range(60):
        sizes = draw.integers(2, 60, 5)
        words = draw.integers(0, draw.integers(1, 5), sizes.sum())
        starts = np.cumsum(sizes) - sizes
        got: Counter = Counter()
        for phrases, counts in C.count_phrases(words, starts, sizes, 4):
            for phrase, n in zip(phrases.tolist(), counts.tolist()):
                got[tuple(phrase)] += n
        want: Counter = Counter()
        for a, n in zip(starts.tolist(), sizes.tolist()):
            run = words[a : a + n].tolist()
            want.update(tuple(run[i : i + m]) for m in (2, 3, 4) for i in range(len(run) - m + 1))
        assert +got == want and min(got.values()) >= 0


def test_collocations_of_awkward_rows(spark):
    rows = [(k, "Red apple,red APPLE\tpie\x0bred apple pie x red apple", None, *X) for k in range(20)]
    rows += [(k, "a a a a a", "en", *X) for k in range(12)] + [(k, "a a a a a", "en", *X) for k in range(12)] + AWKWARD
    got = {(r.lang, r.phrase): r for r in C.collocations(spark.createDataFrame(rows, SCHEMA)).collect()}
    und = got["und", "red apple"]
    assert (und.rank, und.a, und.l, und.r, und.n, und.score) == (1, 80, 80, 80, 20 * 10, 1_000_000)
    # 2-word places hold 40 of 80 in 3 words, so the pair stays; "apple pie" has 20 places and is no candidate
    assert ("und", "apple pie") not in got and ("und", "red apple pie") not in got
    # a a (96) stands inside a a a (72 < 80 %), a a a inside a a a a (48 < 80 % of 72)
    assert [got["en", " ".join("a" * m)].a for m in (2, 3, 4)] == [96, 72, 48]
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
