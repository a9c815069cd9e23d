"""License scans by a positional index of rare tokens.

Licence templates are indexed by their words and these words' positions. Which licence words a file has closes most templates at
once: one that lacks more of its words than a notice may lack. Of each other template the file's own rarest words are looked up, those of
the highest IDF among the words that the file has: two more than the template can still lack. Postings whose relative positions
agree, but for words that are added or left out, mark where the template may stand. There its words are aligned with the file's, and its
mandatory key phrase has to stand among them. A stretch that holds the template lacks no more words than it may, so two of
those that were looked up stand in it, whichever they are: nothing is left out, and the commoner words of the file are never looked up.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common.store import small_batches
from .textbatch import ALNUM_WORD, slices, word_hash, words_of

# Phrases and the labels that their places give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices by label, each with the phrase that it must have.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "free of charge to any person"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "free of charge to any person"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses", "general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
)
#: Share of a template's words that has to stand in a file in their order, within how many times the template's length, and rare
#: words whose relative positions have to agree.
SHARE, STRETCH, AGREE = 0.8, 1.25, 2


def template_words() -> list[str]:
    """All words of the templates, each once, sorted."""
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many of all texts each template word occurs, and the number of texts; at most a few hundred counts come back."""
    vocabulary = template_words()
    hashes = np.array([word_hash(w) for w in vocabulary])
    order = np.argsort(hashes)
    ranked = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), ALNUM_WORD, fold=True)
                at = np.minimum(np.searchsorted(ranked, words.hash), len(ranked) - 1)
                hit = np.flatnonzero(ranked[at] == words.hash)
                seen = np.unique(words.doc()[hit] * len(vocabulary) + at[hit])
                totals += np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*(int(k) for k in order), -1], pa.int64()), pa.array([*totals.tolist(), n], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return {w: counts.get(k, 0) for k, w in enumerate(vocabulary)}, counts.get(-1, 0)


class Template:
    """A template's words, what an alignment needs, and its words by falling IDF."""

    def __init__(self, label: str, text: str, key: str, idf: dict[str, float]):
        words = text.split()
        self.label, self.n = label, len(words)
        self.missing = int((1 - SHARE) * self.n + 1e-9)
        self.longest = int(STRETCH * self.n)
        self.hashes = [int(word_hash(w)) for w in words]
        self.own = np.unique(np.array(self.hashes, dtype=np.uint64))
        self.key = [int(word_hash(w)) for w in key.split()]
        self.bits: dict[int, int] = {}
        for i, h in enumerate(self.hashes):
            self.bits[h] = self.bits.get(h, 0) | 1 << i
        self.by_idf = sorted(set(words), key=lambda w: (-idf[w], w))
        self.agree = min(AGREE, len(self.by_idf))
        #: How far the relative positions of aligned words may lie before and after the start of the stretch.
        self.before, self.after = self.missing, self.longest - self.n + self.missing

    def aligned(self, words: list[int]) -> int:
        """Length of the longest common subsequence of the template and ``words``."""
        full = v = (1 << self.n) - 1
        for w in words:
            if u := v & self.bits.get(w, 0):
                v = (v + u | v - u) & full
        return self.n - v.bit_count()

    def has_key(self, words: list[int]) -> bool:
        k = len(self.key)
        return any(words[i : i + k] == self.key for i in range(len(words) - k + 1))

    def starts(self, agreeing: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ranges of places where the template may begin, from (relative position, word) of looked-up words."""
        agreeing.sort()
        ranges: list[tuple[int, int]] = []
        first, inside = 0, Counter()
        for d, word in agreeing:
            inside[word] += 1
            while agreeing[first][0] < d - self.before - self.after:
                left = agreeing[first][1]
                inside[left] -= 1
                if not inside[left]:
                    del inside[left]
                first += 1
            if len(inside) >= self.agree:
                a, b = d - self.after, d + self.before + 1
                if ranges and a <= ranges[-1][1]:
                    ranges[-1] = ranges[-1][0], b
                else:
                    ranges.append((a, b))
        return ranges

    def best(self, words: np.ndarray, agreeing: list[tuple[int, int]]) -> float:
        """The largest share of the template's words that stands in a stretch with the key phrase; 0 below SHARE."""
        ranges = self.starts(agreeing)
        if not ranges:
            return 0.0
        need, found = self.n - self.missing, 0
        known = np.concatenate([[0], np.cumsum(np.isin(words, self.own))])
        for a, b in ranges:
            starts = np.arange(max(a, 0), max(min(b, len(words)), 0))
            starts = starts[known[np.minimum(starts + self.longest, len(words))] - known[starts] >= need]
            for start in starts.tolist():
                own = words[start : start + self.longest].tolist()
                if own[0] in self.bits and (n := self.aligned(own)) >= max(need, found + 1) and self.has_key(own):
                    found = n
                    if found == self.n:
                        return 1.0
        return found / self.n


class Index:
    """For each template its words (numbers in the vocabulary) by falling IDF, and the positions of each."""

    def __init__(self, frequencies: dict[str, int], n: int):
        idf = {w: math.log((1 + n) / (1 + k)) for w, k in frequencies.items()}
        self.templates = [Template(label, text, key, idf) for label, text, key in TEMPLATES]
        vocabulary = template_words()
        hashes = np.array([word_hash(w) for w in vocabulary])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {w: k for k, w in enumerate(vocabulary)}
        self.has = np.zeros((len(TEMPLATES), len(vocabulary)), dtype=np.int32)
        self.ranked: list[list[int]] = []
        self.postings: list[dict[int, list[int]]] = []
        for t, (_, text, _) in enumerate(TEMPLATES):
            self.ranked.append([number[w] for w in self.templates[t].by_idf])
            self.has[t, self.ranked[t]] = 1
            places: dict[int, list[int]] = defaultdict(list)
            for i, w in enumerate(text.split()):
                places[number[w]].append(i)
            self.postings.append(dict(places))
        self.may_lack = np.array([t.missing for t in self.templates])
        self.phrases = [(np.array([word_hash(w) for w in p.split()]), label) for p, label in PHRASES.items()]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def lacking(self, doc: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """How many of each template's words (column) each of ``n`` files (row) has nowhere."""
        present = np.zeros((n, len(self.hashes)), dtype=np.int32)
        present[doc, number] = 1
        return self.has.sum(axis=1) - present @ self.has.T

    def chosen(self, t: int, present: set[int], lack: int) -> list[int]:
        """The words of a template that are looked up in a file that has ``present`` and lacks ``lack`` of them: its rarest."""
        template = self.templates[t]
        return [w for w in self.ranked[t] if w in present][: template.missing - lack + template.agree]

    def found(self, words: np.ndarray, numbers: np.ndarray, lack: np.ndarray) -> dict[str, float]:
        """Labels whose templates stand in a file, with the best share of aligned words, given its words, their numbers and what it lacks."""
        at = np.flatnonzero(numbers >= 0)
        at = at[np.argsort(numbers[at], kind="stable")]
        own, first = np.unique(numbers[at], return_index=True)
        places = dict(zip(own.tolist(), np.split(at, first[1:]), strict=True))
        best: dict[str, float] = {}
        for t in sorted(np.flatnonzero(lack <= self.may_lack).tolist(), key=lambda t: -self.templates[t].n):
            agreeing = [(p - i, w) for w in self.chosen(t, places.keys(), int(lack[t])) for i in self.postings[t][w] for p in places[w].tolist()]
            share = self.templates[t].best(words, agreeing)
            if share:
                best[self.templates[t].label] = max(best.get(self.templates[t].label, 0.0), share)
        return best


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, words, places of base phrases, labels and score.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text in lower case (A-Z). ``n_base`` counts the places
    where a base phrase's words stand consecutively, ``first_word`` and ``last_word`` are the smallest and the largest of their
    starts. ``labels`` adds the templates found: SHARE of a template's words stand in their order in a stretch of at most STRETCH times
    its length that holds its key phrase; ``score`` is the best such share, 0 without one. A null
    or empty text has no words, null places, empty labels and score 0. Repeated rows give repeated rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = Index(*document_frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), ALNUM_WORD, fold=True)
                n, m = np.diff(words.first), part.num_rows
                h, first = words.hash, words.first
                base: list[list[int]] = [[] for _ in range(m)]
                base_labels: list[set[str]] = [set() for _ in range(m)]
                for phrase, label in index.phrases:
                    hit = np.flatnonzero(h == phrase[0])
                    hit = hit[hit + len(phrase) <= len(h)]
                    for k in range(1, len(phrase)):
                        hit = hit[h[hit + k] == phrase[k]]
                    doc = np.searchsorted(first, hit, "right") - 1
                    for p, d in zip(hit.tolist(), doc.tolist(), strict=True):
                        if p + len(phrase) <= first[d + 1]:
                            base[d].append(p - int(first[d]))
                            base_labels[d].add(label)
                numbers = index.numbers(h)
                known = np.flatnonzero(numbers >= 0)
                lack = index.lacking(words.doc()[known], numbers[known], m)
                labels, scores = [set(x) for x in base_labels], [0.0] * m
                for d in np.flatnonzero((lack <= index.may_lack).any(axis=1)):
                    got = index.found(h[first[d] : first[d + 1]], numbers[first[d] : first[d + 1]], lack[d])
                    if got:
                        labels[d] |= set(got)
                        scores[d] = max(got.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n), pa.array([len(x) for x in base], pa.int64()), pa.array([min(x, default=None) for x in base], pa.int64()), pa.array([max(x, default=None) for x in base], pa.int64()),
                        pa.array([",".join(sorted(x)) for x in base_labels], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(scores, pa.float64()),
                    ],
                    ["doc_id", *(f.split()[0] for f in RESULT.split(", "))],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {RESULT}")
