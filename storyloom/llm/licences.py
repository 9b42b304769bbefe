"""Licence notices in whole texts, by a positional index of rare words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. The index has a posting (template, position)
for the rarest words of every template: so many that no text can reach :data:`COVERAGE` with fewer than two of them. How
many documents hold each of its words is counted over all documents, which gives the words' IDF. A text is then read in
overlapping blocks of :data:`BLOCK` words; each block looks up its :data:`RARE` highest-IDF licence words, and every posting
of a word votes for the place at which its template would begin. Places with two votes or more from different words of a
template, or one where the template has no other, are verified: all its words are looked for at their relative positions,
give or take :data:`SLACK` words, and weighed by IDF; at least :data:`COVERAGE` of the weight must be there, and its
mandatory phrases must each stand consecutively within the stretch. Blocks make a long file of many notices behave like
many short ones.

Besides, the places of the base phrases are found and labelled whatever stands around them. The score is 1 where a base
phrase stands, else the largest coverage that any verified or unverified place reached, 0 without any.

Defined cases: a null or empty text has no words, no places and score 0. Rows are judged each by its own text, whether or
not ids or texts repeat, and a null doc_id is carried. Of ties in IDF the lesser word is looked up, of places
within the slack and of equal coverage the first is reported. An empty table gives an empty result. Other columns than doc_id and text are not carried.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches

# Base phrases and their labels; notices of public licences, with the phrases without which they do not hold.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "agpl-3.0": ("licensed under the GNU Affero General Public License version 3", ["gnu affero general public license"]),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ["apache license version 2 0", "except in compliance with the license"],
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms", "conditions are met"],
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["endorse or promote products derived from this software"],
    ),
    "cc-by-4.0": ("licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    "gpl-2.0": ("licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    "gpl-3.0": ("licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ["free software", "gnu general public license"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee is hereby granted"],
    ),
    "lgpl": ("licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    "mit": ("Released under the MIT License", ["mit license"]),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        ["permission is hereby granted free of charge", "deal in the software without restriction"],
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    "unlicense": ("This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
}
# End of fixed values.

BLOCK, RARE, SLACK, COVERAGE = 16, 8, 4, 0.75

#: Of the UTF-8 bytes, digits and letters stay, A-Z as a-z, other ASCII is a space, and the rest are letters of words.
FOLDED = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words in UTF-8."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(FOLDED).split()


class Index:
    """Postings of the templates' words, and the words' IDF."""

    def __init__(self, counts: dict[bytes, int], documents: int, templates: dict[str, tuple[str, list[str]]] = TEMPLATES):
        self.words = {name: words_of(text) for name, (text, _) in templates.items()}
        self.phrases = {name: [words_of(p) for p in phrases] for name, (_, phrases) in templates.items()}
        every = {w for words in self.words.values() for w in words}
        self.idf = {w: math.log((documents + 1) / (counts.get(w, 0) + 1)) + 1e-9 for w in every}
        self.rank = {w: k for k, w in enumerate(sorted(every, key=lambda w: (-self.idf[w], w)))}
        self.weight = {name: sum(self.idf[w] for w in words) for name, words in self.words.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.distinct: dict[str, int] = {}
        for name, words in self.words.items():
            rare = self.rarest(name)
            self.distinct[name] = len(rare)
            for q, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((name, q))

    def rarest(self, name: str) -> set[bytes]:
        """The template's rarest words, until all but the heaviest weigh more than a verified notice can lack."""
        words = self.words[name]
        heavy = {w: words.count(w) * self.idf[w] for w in words}
        rare: list[bytes] = []
        for w in sorted(heavy, key=self.rank.__getitem__):
            rare.append(w)
            own = [heavy[x] for x in rare]
            if sum(own) - max(own) > (1 - COVERAGE) * self.weight[name]:
                break
        return set(rare)

    def looked_up(self, hits: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        """The (place, word) of each block's rarest licence words."""
        blocks: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for p, w in hits:
            half = p // (BLOCK // 2)
            blocks[half].append((p, w))
            blocks[half - 1].append((p, w))
        found = set()
        for own in blocks.values():
            rare = set(sorted({w for _, w in own}, key=self.rank.__getitem__)[:RARE])
            found.update(x for x in own if x[1] in rare)
        return sorted(found)

    def places(self, hits: list[tuple[int, bytes]]) -> list[tuple[str, int]]:
        """(template, beginning) for which enough different words vote, each within the slack of it."""
        votes: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
        for p, w in self.looked_up(hits):
            for name, q in self.postings[w]:
                votes[name].append((p - q, w))
        out = []
        for name, own in votes.items():
            own.sort()
            need, low, high = min(2, self.distinct[name]), 0, 0
            for begin in dict.fromkeys(o for o, _ in own):
                while own[low][0] < begin - SLACK:
                    low += 1
                while high < len(own) and own[high][0] <= begin + SLACK:
                    high += 1
                if len({w for _, w in own[low:high]}) >= need:
                    out.append((name, begin))
        return out

    def coverage(self, name: str, begin: int, text: list[bytes]) -> float:
        """Share of the template's weight that stands at its relative positions, each of the text's words used once."""
        low, got = begin - 1, 0.0
        for q, w in enumerate(self.words[name]):
            for p in range(max(low + 1, begin + q - SLACK, 0), min(begin + q + SLACK + 1, len(text))):
                if text[p] == w:
                    got, low = got + self.idf[w], p
                    break
        return got / self.weight[name]

    def holds(self, name: str, begin: int, words: list[bytes]) -> bool:
        span = words[max(0, begin - SLACK) : begin + len(self.words[name]) + SLACK + 1]
        return all(any(span[i : i + len(p)] == p for i in range(len(span) - len(p) + 1)) for p in self.phrases[name])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int, float]], float]:
        """(template, beginning, coverage) of what is verified, and the best coverage of all places."""
        hits = [(p, w) for p, w in enumerate(words) if w in self.postings]
        found, best = [], 0.0
        for name, begin in self.places(hits):
            share = self.coverage(name, begin, words)
            best = max(best, share)
            if share >= COVERAGE and self.holds(name, begin, words):
                if found and found[-1][0] == name and begin - found[-1][1] <= SLACK:  # the same place: the better one stays
                    found[-1] = max(found[-1], (name, begin, share), key=lambda x: x[2])
                else:
                    found.append((name, begin, share))
        return found, best


_BASE = [(words_of(p), label) for p, label in BASE.items()]
_FIRST = {p[0] for p, _ in _BASE}


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(place, label) of every base phrase, by place."""
    starts = [i for i, w in enumerate(words) if w in _FIRST]
    return [(i, label) for i in starts for p, label in _BASE if words[i : i + len(p)] == p]


def document_counts(docs: DataFrame, templates: dict[str, tuple[str, list[str]]] = TEMPLATES) -> tuple[dict[bytes, int], int]:
    """How many documents hold each word of the templates, and how many documents there are. What reaches the driver is a
    row for each word of the templates."""
    known = {w for text, _ in templates.values() for w in words_of(text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            counts[b""] += batch.num_rows
            for text in batch.column(0):
                for w in known.intersection(words_of(text.as_py())):
                    counts[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    bound_batches(docs.sparkSession)
    summed = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r.word): r.n for r in summed.collect()}
    return counts, counts.pop(b"", 0)


def scan_licences(docs: DataFrame, templates: dict[str, tuple[str, list[str]]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices) of every document; notices are
    the verified places (template, word, coverage)."""
    index = Index(*document_counts(docs, templates), templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                base, (found, best) = base_places(words), index.scan(words)
                own = {label for _, label in base}
                first, last = (base[0][0], base[-1][0]) if base else (None, None)
                labels = ",".join(sorted(own | {name for name, *_ in found}))
                notices = [{"template": t, "word": b, "coverage": c} for t, b, c in sorted(found)]
                rows.append((i.as_py(), len(words), len(base), first, last, ",".join(sorted(own)), labels, 1.0 if base else min(best, 1.0), notices))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    notice = pa.list_(pa.struct({"template": pa.string(), "word": pa.int64(), "coverage": pa.float64()}))
    long, text = pa.int64(), pa.string()
    kinds = {"doc_id": long, "n_words": long, "n_base": long, "first_word": long, "last_word": long, "base_labels": text, "labels": text, "score": pa.float64(), "notices": notice}
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices array<struct<template: string, word: bigint, coverage: double>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)
