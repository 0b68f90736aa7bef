"""Licence scans: a positional index of the template words.

The words of all licence templates form a small vocabulary; its document frequencies are counted over the whole corpus. Of each
template, the words of highest IDF are its rare words: as many as it takes until the others together hold less than COVER of its
IDF mass, so that no passage can match the template without one of them. The index posts the rare words, each with its
templates and its places there. A file's rare words are looked up; every hit votes for a relative position (place in the file minus
place in the template). A template is open for a file that holds one of its rare words and all words of its mandatory
phrases; its other words are looked up only within SLACK of a rare word's position. Words that agree on the position, within
SLACK, are intersected; a template whose aligned words carry COVER of its IDF mass counts if each of its mandatory phrases stands, word
by word, inside the aligned passage. Nothing that the search over all words would find is lost.

The base phrases are templates of their own, found wherever their words stand consecutively.

Results in special cases: null and empty texts have no words and no labels; repeated rows come out as often as they come
in; an empty table gives an empty result; further columns are ignored; texts of any length are scanned whole; ties in IDF go to
the word first in the templates, which changes no result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes

SLACK = 4
COVER = 0.6

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, template, mandatory phrases. Statements and opening passages of public licences.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("apache", "Licensed under the Apache License, Version 2.0.", ["apache license"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at", ["apache license", "compliance with the license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation", ["gnu general public license", "free software"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ["gnu lesser general public license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ["creative commons attribution 4 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted", ["permission to use copy modify", "with or without fee"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["unencumbered software", "public domain"]),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     ["gnu affero general public license"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission.",
     ["may be used to endorse or promote products", "without specific prior written permission"]),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
     "and to prepare derivative works of the Software", ["any person or organization", "use reproduce display distribute execute and transmit"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
     "damages arising from the use of this software.", ["without any express or implied warranty", "in no event will the authors be held liable"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
     "available at", ["eclipse public license"]),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may "
     "not use this file except in compliance with the License.", ["common development and distribution license"]),
    ("artistic", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
     ["artistic license"]),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["sil open font license"]),
    ("eupl", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the "
     "EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.", ["licensed under the eupl"]),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software "
     "to the public domain worldwide. This software is distributed without any warranty.",
     ["dedicated all copyright and related and neighboring rights", "public domain"]),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and "
     "without a written agreement is hereby granted", ["without a written agreement is hereby granted"]),
    ("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept "
     "the license, do not use the software.", ["this license governs use of the accompanying software"]),
]

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def file_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; as UTF-8, in which all other characters are above 7F."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Index:
    """Templates as word numbers, their postings, and the mandatory phrases."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.number: dict[bytes, int] = {}
        spell = lambda s: [self.number.setdefault(w, len(self.number)) for w in file_words(s)]
        self.base = [(spell(p), label) for p, label in base.items()]
        self.templates = [(label, spell(t), [spell(p) for p in phrases]) for label, t, phrases in templates]
        self.needed = [{w for p in phrases for w in p} for _, _, phrases in self.templates]
        self.weigh({}, 0)

    def weigh(self, seen_in: dict[int, int], n_docs: int) -> Index:
        self.idf = np.array([math.log((n_docs + 1) / (seen_in.get(i, 0) + 0.5)) for i in range(len(self.number))])
        self.idf = np.maximum(self.idf, 0.01)
        self.mass = [float(sum(self.idf[n] for n in t)) for _, t, _ in self.templates]
        self.postings: dict[int, list[tuple[int, list[int]]]] = {}
        for i in range(len(self.templates)):
            for n in self.rare_words(i):
                self.postings.setdefault(n, []).append((i, [q for q, m in enumerate(self.templates[i][1]) if m == n]))
        return self

    def rare_words(self, i: int) -> list[int]:
        """The words of highest IDF of template i, until the rest holds less than COVER of its mass."""
        template = self.templates[i][1]
        held, rest, rare = Counter(template), self.mass[i], []
        for n in sorted(held, key=lambda n: (-self.idf[n], template.index(n))):
            if rest < COVER * self.mass[i] * (1 - 1e-9):
                break
            rare.append(n)
            rest -= held[n] * self.idf[n]
        return rare

    def scan(self, words: list[bytes]):
        """(places of base phrases, base labels, labels, score) of a file."""
        at: dict[int, list[int]] = {}
        get = self.number.get
        for place, n in enumerate(map(get, words)):
            if n is not None:
                at.setdefault(n, []).append(place)
        if not at:
            return [], set(), set(), 0.0
        sets = {n: set(p) for n, p in at.items()}
        places, base = [], set()
        for phrase, label in self.base:
            found = self._phrase(phrase, at, sets)
            places += found
            if found:
                base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        anchors: dict[int, set[int]] = {}
        for n in at.keys() & self.postings.keys():
            for i, stands in self.postings[n]:
                if self.needed[i] <= at.keys():
                    anchors.setdefault(i, set()).update(p - q for p in at[n] for q in stands)
        for i in sorted(anchors):
            cover = self._aligned(i, at, sets, sorted(anchors[i]))
            if cover >= COVER:
                labels.add(self.templates[i][0])
                score = max(score, cover)
        return sorted(places), base, labels, min(1.0, score)

    @staticmethod
    def _phrase(phrase, at, sets, low: float = -1, high: float = math.inf) -> list[int]:
        if any(n not in at for n in phrase):
            return []
        return [p for p in at[phrase[0]] if low <= p and p + len(phrase) - 1 <= high
                and all(p + k in sets[n] for k, n in enumerate(phrase))]

    @staticmethod
    def _near(anchors: list[int]) -> list[tuple[int, int]]:
        """Ranges of relative positions within SLACK of an anchor, in order, none touching another."""
        ranges: list[tuple[int, int]] = []
        for o in anchors:
            if ranges and o - SLACK <= ranges[-1][1] + 1:
                ranges[-1] = (ranges[-1][0], o + SLACK)
            else:
                ranges.append((o - SLACK, o + SLACK))
        return ranges

    def _anchors(self, i: int, at) -> list[int]:
        rare = set(self.rare_words(i))
        return sorted({p - q for q, n in enumerate(self.templates[i][1]) if n in rare for p in at.get(n, ())})

    def _aligned(self, i: int, at, sets, anchors: list[int] | None = None) -> float:
        """The largest share of template i's IDF mass at one relative position that holds the mandatory phrases.

        ``anchors`` are the relative positions of the template's rare words; other words count near them alone.
        """
        _, template, phrases = self.templates[i]
        anchors = self._anchors(i, at) if anchors is None else anchors
        mass, votes = self.mass[i], []
        for low, high in self._near(anchors):
            for q, n in enumerate(template):
                places = at.get(n, ())
                votes += [(p - q, q, n) for p in places[bisect_left(places, low + q):bisect_right(places, high + q)]]
        votes.sort()
        best, first, held = 0.0, 0, Counter()
        weight = 0.0
        for k, (offset, q, n) in enumerate(votes):
            if not held[q]:
                weight += self.idf[n]
            held[q] += 1
            while votes[first][0] < offset - SLACK:
                _, q0, n0 = votes[first]
                held[q0] -= 1
                if not held[q0]:
                    weight -= self.idf[n0]
                first += 1
            share = weight / mass
            if share > best and share >= COVER:
                low, high = votes[first][0] - SLACK, offset + len(template) + SLACK
                if all(self._phrase(p, at, sets, low, high) for p in phrases):
                    best = share
        return best


def document_frequencies(docs: DataFrame, index: Index, text: str = "text") -> tuple[dict[int, int], int]:
    """How many documents hold each template word, and how many documents there are. The vocabulary bounds the result."""
    number = index.number

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for b in batches:
            seen[-1] += len(b)
            for t in b["text"]:
                seen.update(number.keys() & set(file_words(t)))
        yield pd.DataFrame([(number.get(w, -1), n) for w, n in seen.items()], columns=["word", "n"])
    batch_bytes(docs.sparkSession)
    rows = (docs.select(F.col(text).alias("text")).mapInPandas(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect())
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop(-1, 0)


_RESULT = ("doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double")


def scan(docs: DataFrame, text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = Index(base, templates)
    index.weigh(*document_frequencies(docs, index, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, t in zip(b["doc_id"], b["text"]):
                w = file_words(t)
                places, found, labels, score = index.scan(w)
                out.append((doc, len(w), len(places), places[0] if places else None, places[-1] if places else None,
                            ",".join(sorted(found)), ",".join(sorted(labels)), score))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")]).astype({"first_word": "Int64", "last_word": "Int64"})
    batch_bytes(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, _RESULT)
            .withColumn("doc_id", F.col("doc_id").cast("long")))
