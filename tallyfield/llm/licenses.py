"""License notices in texts by an exact set-similarity join with templates.

A block is a window of consecutive words of a text, across line breaks, with
room for as many other words as the template has, 16 words at least. A template
is found in a block that holds at least ``THRESHOLD`` of the template's
distinct words. Words are ordered by how often the whole corpus holds them; a
block can only reach the threshold if it holds one of the template's rarest
words, or the rarest of those that name the license (prefix filter), and, from its first word on, enough template words at all
(length and positional filter, counted on the template's own words). What
passes is counted exactly, and has to hold the words that name the license as the
template has them: in order, close to each other, the first beside a neighbour of
its own. Of blocks that overlap, the one with most shared
words is the notice, then the shortest, then the first. A notice whose naming
words stand in that of a template with more of them (CC BY in CC BY-NC) is no
notice of its own. Templates may come without naming words.
Fixed phrases are found beside that, as consecutive words anywhere.

The templates are written out in code. Texts never leave their task; the
frequency pass returns one number per template word. Null and empty texts have
no words; repeated rows are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.tables import batches_of, col, list_array, map_arrow, per_batch
from tallyfield.llm.words import ALNUM, find_words, slices, text_bytes, word_hash

THRESHOLD = 0.8
SHORTEST_BLOCK = 16
#: words more between two naming words than in the template
SLACK = 2
CHUNK_BYTES = 4 << 20

# fixed values: phrases and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))



def _creative_commons() -> Iterator[tuple[str, str, str]]:
    """Short and long notices of the Creative Commons family, with and without the current version."""
    long = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    for parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        spelled = "-".join(long[x] for x in parts.split("-"))
        for version in ("", " 4.0"):
            label = f"CC-{parts}{version.replace(' ', '-')}"
            yield label, f"Licensed under CC {parts}{version}", f"CC {parts}{version}"
            yield label, f"This work is licensed under a Creative Commons {spelled}{version} International License", f"Creative Commons {spelled}{version}"


# fixed values: notices, their labels, and the words that name the license, all of which a notice must hold
TEMPLATES = (
    ("MIT", "Released under the MIT License", "MIT"),
    ("MIT", "Licensed under the MIT License", "MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache 2"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "GNU General Public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", "GNU General Public 2"),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License", "GNU Lesser General Public"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public 2 1"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public 3"),
    ("AGPL", "This work is licensed under the GNU Affero General Public License", "GNU Affero General Public"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public 3"),
    ("GPL", "Licensed under the GNU General Public License", "GNU General Public"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "GNU General Public"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("BSD", "Licensed under the BSD License", "BSD"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public 2"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0", "Mozilla Public 2"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0", "Eclipse Public 2"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", "Boost Software 1"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("ISC", "Licensed under the ISC License", "ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("CC0-1.0", "Licensed under CC0 1.0", "CC0"),
    ("CC0-1.0", "This work is released under CC0 1.0 Universal Public Domain Dedication", "CC0"),
    *_creative_commons(),
)


class Templates:
    """Templates as sets of numbers into their common vocabulary."""

    def __init__(self, templates: Sequence[tuple[str, ...]], threshold: float):
        self.labels = [t[0] for t in templates]
        data, bounds = text_bytes(pa.array([t[1] for t in templates], pa.string()))
        _, _, hashes, at = find_words(data, bounds, ALNUM)
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes)
        self.has = np.zeros((len(templates), len(self.vocabulary)), bool)
        for k in range(len(templates)):
            self.has[k, numbers[at[k] : at[k + 1]]] = True
        data, bounds = text_bytes(pa.array(["".join(t[2:3]) for t in templates], pa.string()))
        _, _, named, name_at = find_words(data, bounds, ALNUM)
        if not np.isin(named, self.vocabulary).all():
            raise ValueError("a naming word stands in no template")
        numbers = np.searchsorted(self.vocabulary, named)
        self.names = np.zeros_like(self.has)
        for k in range(len(templates)):
            self.names[k, numbers[name_at[k] : name_at[k + 1]]] = True
        # each naming word as it stands in its template: number, words since the one before, and its neighbours
        self.naming: list[list[tuple[int, int, int, int]]] = []
        words = np.searchsorted(self.vocabulary, hashes)
        for k in range(len(templates)):
            own = words[at[k] : at[k + 1]].tolist()
            places = [j for j, w in enumerate(own) if self.names[k, w] and w not in own[:j]]
            edges = [-1, *own, -1]
            self.naming.append([(own[j], j - i, edges[j], edges[j + 2]) for i, j in zip([0, *places], places)])
        if (self.names & ~self.has).any():
            raise ValueError("a naming word does not stand in its template")
        self.sizes = self.has.sum(axis=1)
        # a hair below, so that a share equal to the threshold is not lost to rounding
        self.least = np.array([max(1, ceil(threshold * s - 1e-9)) for s in self.sizes.tolist()], np.int64)
        self.widths = np.maximum(2 * np.diff(at), SHORTEST_BLOCK)

    def order_by(self, frequency: np.ndarray) -> None:
        """Rank words from rare to frequent, ties by hash, and mark each template's prefix."""
        order = np.lexsort((self.vocabulary, frequency))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.prefix = np.zeros_like(self.has)
        for k, least in enumerate(self.least.tolist()):
            named = self.names[k].any()
            words = np.flatnonzero(self.names[k] if named else self.has[k])
            words = words[np.argsort(self.rank[words])]
            self.prefix[k, words[: 1 if named else len(words) - least + 1]] = True


def _template_words(part: pa.RecordBatch, templates: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and numbers of the template words of a batch; also all word hashes and where each text's words begin."""
    data, bounds = text_bytes(part.column("text"))
    _, _, hashes, at = find_words(data, bounds, ALNUM)
    number = np.searchsorted(templates.vocabulary, hashes)
    number[number == len(templates.vocabulary)] = 0
    known = np.flatnonzero(templates.vocabulary[number] == hashes)
    return known, number[known], hashes, at


def _counter(templates, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(templates.value.vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES) if batch.num_rows else ():
                _, words, _, _ = _template_words(part, templates.value)
                counts += np.bincount(words, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield batches_of(schema, [pa.array(at), pa.array(counts[at])])

    return run


def _is_named(at: list[int], words: list[int], naming: list[tuple[int, int, int, int]]) -> bool:
    """Whether naming words stand as in the template: next to a word it has beside the first, and in order with at most ``SLACK`` words more between them."""
    if not naming:
        return True
    there = dict(zip(at, words))
    first, _, before, behind = naming[0]
    reached = [p for p, w in there.items() if w == first and (there.get(p - 1, -2) == before or there.get(p + 1, -2) == behind)]
    for word, gap, _, _ in naming[1:]:
        reached = [p for p, w in there.items() if w == word and any(0 < p - q <= gap + SLACK for q in reached)]
    return bool(reached)


def _template_blocks(place: np.ndarray, words: np.ndarray, k: int, templates: Templates) -> list[tuple[int, int, int, int, int]]:
    """``(first, last, shared)`` of the notices of template ``k``, and its first and last naming word, as numbers into ``place``."""
    near = place[templates.prefix[k][words]]
    if not len(near):
        return []
    width, least = int(templates.widths[k]), int(templates.least[k])
    near = np.append(near, place[-1] + 2 * width)
    own = np.flatnonzero(templates.has[k][words])
    own = own[near[np.searchsorted(near, place[own] - width, "right")] < place[own] + width]
    at, word, row = place[own], words[own], np.arange(len(own))
    begins = near[np.searchsorted(near, at)] < at + width
    begins &= np.searchsorted(at, at + width) - row >= least
    if not begins.any():
        return []
    order = np.argsort(word, kind="stable")
    same = word[order[1:]] == word[order[:-1]]
    before = np.full(len(own), -width)
    before[order[1:][same]] = at[order[:-1][same]]
    # a word counts in the blocks that begin after its place before and reach it
    low = np.searchsorted(at, np.maximum(before, at - width), "right")
    shared = np.cumsum(np.bincount(low, minlength=len(own))) - row
    ends = np.searchsorted(at, at + width)
    naming = templates.names[k][word]
    held = np.cumsum(np.bincount(low, naming, minlength=len(own))) - (np.cumsum(naming) - naming)
    found = []
    for i in np.flatnonzero(begins & (shared >= least) & (held > templates.names[k].sum() - 0.5)).tolist():
        last = i + int(np.flatnonzero(low[i : ends[i]] <= i)[-1])
        if not _is_named(at[i : last + 1].tolist(), word[i : last + 1].tolist(), templates.naming[k]):
            continue
        found.append((-int(shared[i]), int(at[last] - at[i]), i, last))
    taken, out = np.zeros(len(own), bool), []
    for n, _, i, last in sorted(found):
        if not taken[i : last + 1].any():
            taken[i : last + 1] = True
            by = own[i : last + 1][(naming[i : last + 1] & (low[i : last + 1] <= i))]
            out.append((int(own[i]), int(own[last]), -n, *((int(by[0]), int(by[-1])) if len(by) else (-1, -1))))
    return sorted(out)


def matching_blocks(place: np.ndarray, words: np.ndarray, text: np.ndarray, templates: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template, first word (as number into ``place``) and shared words of all notices."""
    place = place + text * 2 * int(templates.widths.max())  # no block reaches from one text into the next
    found = [np.array(_template_blocks(place, words, k, templates), np.int64).reshape(-1, 5) for k in range(len(templates.labels))]
    out = []
    for k, rows in enumerate(found):
        for j, other in enumerate(found):
            fuller = (templates.names[j] & templates.names[k]).sum() == templates.names[k].sum() < templates.names[j].sum()
            if len(rows) and len(other) and templates.names[k].any() and fuller:
                at = np.searchsorted(other[:, 0], rows[:, 3], "right") - 1
                rows = rows[(at < 0) | (other[at, 1] < rows[:, 4])]
        out.append(np.stack([np.full(len(rows), k), rows[:, 0], rows[:, 2]], 1))
    return tuple(np.concatenate(out).T)


def _finder(templates, phrases: Sequence[tuple[str, str]], schema: pa.Schema):
    wanted = [([word_hash(w, ALNUM) for w in phrase.split()], label) for phrase, label in phrases]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = templates.value
        for part in slices(batch, "text", CHUNK_BYTES):
            place, words, hashes, at = _template_words(part, known)
            rows, labels, places = [], [], []
            for phrase, label in wanted:
                n = len(hashes) - len(phrase) + 1
                hit = np.ones(max(0, n), bool)
                for j, word in enumerate(phrase):
                    hit &= hashes[j : j + len(hit)] == np.uint64(word)
                found = np.flatnonzero(hit)
                text = np.searchsorted(at, found, "right") - 1
                inside = found + len(phrase) <= at[text + 1]
                rows.append(text[inside])
                places.append((found - at[text])[inside])
                labels += [label] * int(inside.sum())
            rows, places = np.concatenate(rows), np.concatenate(places)
            order = np.lexsort((places, rows))
            hits = pa.StructArray.from_arrays([pa.array(np.array(labels, object)[order], pa.string()), pa.array(places[order])], ["label", "word"])

            template, first, shared = matching_blocks(place, words, np.searchsorted(at, place, "right") - 1, known)
            first = place[first]
            text = np.searchsorted(at, first, "right") - 1
            by = np.lexsort((template, first))
            first, text, template, shared = first[by], text[by], template[by], shared[by]
            names = np.array(known.labels, object)[template]
            notices = pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(first - at[text]), pa.array(shared / known.sizes[template])], ["label", "word", "share"]
            )
            yield batches_of(schema, [
                part.column("doc_id"), pa.array(np.diff(at)), list_array(rows[order], part.num_rows, hits),
                list_array(text, part.num_rows, notices),
            ])

    return per_batch(work)


def find_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, ...]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``(doc_id, n_words, phrases, notices)`` of every document.

    ``phrases`` has label and first word of each place of a phrase; ``notices``
    label, first word of the notice and share of the template's words in it.
    """
    spark = docs.sparkSession
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    known = Templates(templates, threshold)
    held = spark.sparkContext.broadcast(known)
    parts = map_arrow(docs.select("text"), lambda fields: _counter(held, fields), "word bigint, n bigint")
    frequency = np.zeros(len(known.vocabulary), np.int64)
    for word, n in parts.groupBy("word").agg(F.sum("n")).collect():  # one row per template word
        frequency[word] = n
    known.order_by(frequency)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words bigint, phrases array<struct<label:string,word:bigint>>, "
        "notices array<struct<label:string,word:bigint,share:double>>"
    )
    ranked = spark.sparkContext.broadcast(known)
    return map_arrow(docs, lambda fields: _finder(ranked, list(phrases), fields), schema)
