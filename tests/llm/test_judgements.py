"""Verdicts, labels and spans that earlier rounds got wrong."""

from __future__ import annotations

import random
import string

import numpy as np

from tallyfield.llm import quality
from tallyfield.llm.licenses import find_licenses
from tallyfield.llm.quality import MARGIN, QUANTILE, judged
from tallyfield.llm.secrets import find_secrets


def test_verdicts_can_be_filtered(spark):
    long = " ".join(f"word{k % 97} of{k % 31}" for k in range(30_000))
    rows = [(1, long), (2, "few words"), (3, "plain words that are enough to be counted as ten and more"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = judged(docs, spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int"))
    ids = lambda rule: {r.doc_id for r in found.where(rule).collect()}
    assert ids("n_repeat_words > 0") == {1} and ids("base_failed") == {1, 2, 4}
    assert ids("NOT base_failed AND kept") == {3} and ids("kept OR base_failed") == {1, 2, 3, 4}
    narrow = judged(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), carry=["doc_id"])
    assert {r.row.doc_id for r in narrow.where("kept").collect()} == {3} and narrow.select("row.*").columns == ["doc_id"]


def test_every_good_label_counts(spark, monkeypatch):
    n = 21_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), k -> concat('w', pmod(hash(id, k), 400 + id % 900)))) AS text")
    good = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    # where all documents are trusted both counts are the same
    same = judged(docs, good, carry=["doc_id"]).select("score", "threshold").distinct().collect()
    assert [tuple(r) for r in same] == [(0.0, -MARGIN)]
    other = spark.range(n, n + 3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), k -> concat('w', pmod(hash(id, k), 300)))) AS text")
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)  # ids too many to be sent
    found = judged(docs.union(other), good, carry=["doc_id"]).select("doc_id", "score", "threshold", "base_failed", "kept").toPandas()
    least = np.quantile(found.score[found.doc_id < n], QUANTILE) - MARGIN
    assert len(found) == n + 3000 and np.allclose(found.threshold, least, rtol=0, atol=1e-12)
    assert (found.kept == (~found.base_failed & (found.score >= found.threshold))).all()


def test_naming_words_stand_as_in_the_template(spark):
    cases = {
        "der Text den man mit einer Hand schreibt, licensed under the Apache License, Version 2.0": {"Apache-2.0"},
        "nd one two three four five six seven licensed under CC BY-NC 4.0": {"CC-BY-NC-4.0"},
        "licensed under CC BY-NC 4.0, one two three four nd": {"CC-BY-NC-4.0"},
        "released under the MIT License": {"MIT"}, "Licensed under\nthe MIT\nLicense": {"MIT"},
        "Licensed under MIT license": {"MIT"}, "Licensed under the license of mit": set(),
        "Licensed under CC BY-NC-ND 4.0": {"CC-BY-NC-ND-4.0"},
        "This work is licensed under the GNU General Public License (GPL), version 3": {"GPL-3.0"},
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: {n.label for n in r.notices} for r in find_licenses(frame).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_random_spans_leave_words_alone(spark):
    draw = random.Random(11)
    key = lambda n, letters: "".join(draw.choices(letters, k=n))
    base62 = string.ascii_letters + string.digits
    words = ["Einstschkeitieein", "einpfauaueinchpf", "großeinpfauaueinchpf", "einpfauaueinchpfüber", "einlichheitenpfpfver"]
    mixed = [key(n, base62) for n in range(16, 41) for _ in range(8)]
    plain = [key(n, string.ascii_lowercase) for n in range(20, 41) for _ in range(8)]
    rows = [f"so {w} on" for w in words + mixed + plain] + ["café/" + mixed[-1] + "/thé"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in find_secrets(frame).collect()}
    hit = [bool(got[k]) for k in range(len(rows))]
    at = len(words)
    assert not any(hit[:at]) and hit[-1]
    assert sum(hit[at : at + len(mixed)]) >= 0.97 * len(mixed)
    assert sum(hit[at + len(mixed) : -1]) >= 0.85 * len(plain)
