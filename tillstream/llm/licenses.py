"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a window of words, a quarter longer than the template it is compared with and at least SLACK words, wherever it
begins and whatever line ends are in it. So a notice is found however it is wrapped, and words that are scattered over a
long text are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.text import LETTERS, documents, per_piece, texts_of, words_of

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
    " labels string, score double"
)

# Phrases and their labels.
PHRASES: dict[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Usual notices of well-known licenses, and their labels.
TEMPLATES: list[tuple[str, str]] = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    ("bsd", "Released under the BSD License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("isc", "Released under the ISC License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Copyright. All rights reserved"),
]

#: Share of a template's distinct words that a block has to hold, and words that a block is longer than a short template.
THRESHOLD = 0.9
SLACK = 2


def words_in(text: str) -> list[bytes]:
    raw = texts_of(pa.array([text]), lower=True)
    words = words_of(raw, LETTERS, hashed=False)
    return [raw.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """In how many documents each template word occurs, by its hash. As many numbers as templates have words."""
    wanted = np.unique(np.concatenate([_codes(text) for _, text in templates]))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(texts_of(piece.column("text"), lower=True), LETTERS)
        place, known = _places(wanted, words.hash)
        seen = np.unique(words.text[known] * len(wanted) + place[known]) % len(wanted)
        counts = np.bincount(seen.astype(np.int64), minlength=len(wanted))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted))), pa.array(counts)], ["word", "n"])

    rows = per_piece(documents(docs).select("text"), work, "word bigint, n bigint").groupBy("word").agg(F.sum("n"))
    return {int(wanted[word]): n for word, n in rows.collect()}


def _codes(text: str) -> np.ndarray:
    return np.unique(words_of(texts_of(pa.array([text]), lower=True), LETTERS).hash)


def _places(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(ordered, values)
    place[place == len(ordered)] = 0
    return place, ordered[place] == values


class Templates:
    """Template word sets in one global order, rarest word first, with what the filters need."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[int, int], threshold: float):
        self.labels = [label for label, _ in templates]
        codes = [_codes(text) for _, text in templates]
        every = np.unique(np.concatenate(codes))
        rank = sorted(range(len(every)), key=lambda i: (frequency.get(int(every[i]), 0), int(every[i])))
        self.words = every
        number = np.empty(len(every), dtype=np.int64)
        number[rank] = np.arange(len(every))
        # Template t holds ``size[t]`` words; a block has to hold ``needed[t]`` of them, and has ``width[t]`` words.
        self.size = [len(own) for own in codes]
        self.needed = [max(1, int(np.ceil(threshold * n - 1e-9))) for n in self.size]
        lengths = [len(words_in(text)) for _, text in templates]
        self.width = [n + max(SLACK, n // 4) for n in lengths]
        # For each template the place of each known word among its own in that order, or -1.
        self.place = np.full((len(codes), len(every)), -1, dtype=np.int64)
        for t, own in enumerate(codes):
            known = np.searchsorted(every, own)
            self.place[t, known[np.argsort(number[known])]] = np.arange(len(own))

    def matches(self, at: np.ndarray, word: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, float]]:
        """Texts and templates, with the largest containment, where a block of the text holds enough of the template's words.

        Known words in order: where they stand (texts end to end), which they are, and the text of each. A block with
        enough of a template's words holds one of the first ones in the global order: the others alone are too few
        (prefix). Around each of these there have to be enough known words in reach (length), and enough that come after
        it in the order, if it is the first that both have (position).
        """
        found = []
        for t in range(len(self.size)):
            place = self.place[t, word]
            own = np.flatnonzero(place >= 0)
            if len(own) < self.needed[t]:
                continue
            found += [(i, t, share) for i, share in self._blocks(t, at[own], place[own], owner[own]).items()]
        return found

    def _blocks(self, t: int, at: np.ndarray, place: np.ndarray, owner: np.ndarray) -> dict[int, float]:
        needed, width = self.needed[t], self.width[t]
        first = np.flatnonzero(place <= self.size[t] - needed)
        low = np.maximum(np.searchsorted(at, at[first] - width + 1), np.searchsorted(owner, owner[first]))
        high = np.minimum(np.searchsorted(at, at[first] + width), np.searchsorted(owner, owner[first], side="right"))
        enough = high - low >= needed
        best: dict[int, float] = {}
        for p, i, j in zip(first[enough].tolist(), low[enough].tolist(), high[enough].tolist(), strict=True):
            near = place[i:j]
            if len(np.unique(near[near >= place[p]])) < needed:
                continue
            # Blocks that begin with a known word and hold this one; the counts go along with the window.
            counts = np.zeros(self.size[t], dtype=np.int64)
            distinct, most, stop = 0, 0, i
            for start in range(i, p + 1):
                while stop < j and at[stop] < at[start] + width:
                    distinct += counts[place[stop]] == 0
                    counts[place[stop]] += 1
                    stop += 1
                if stop > p:
                    most = max(most, distinct)
                counts[place[start]] -= 1
                distinct -= counts[place[start]] == 0
            if most >= needed:
                best[int(owner[p])] = max(best.get(int(owner[p]), 0.0), float(most / self.size[t]))
        return best


def _phrase_places(raw: bytes) -> tuple[list[int], set[str]]:
    """Numbers of the words where phrases start. ``raw`` has one blank before and after each word."""
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        wanted = b" " + phrase.encode() + b" "
        at = raw.find(wanted)
        while at >= 0:
            starts.append(raw.count(b" ", 0, at))
            labels.add(label)
            at = raw.find(wanted, at + 1)
    return starts, labels


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Per document the license phrases and the license notices in it.

    A notice is found where a block, a window of words, holds at least ``threshold`` of the distinct words of a template. The
    join is exact: words are ordered by how many documents have them, rarest first; blocks are compared with a template only
    where they have one of the template's first words (prefix), enough known words (length), and enough left of both from
    that word on (position). ``score`` is the largest containment found, 1 where
    a phrase stands in the text, else 0.

    One row per row. Null and empty texts have no words and no labels (empty strings); a null id stays null; repeated
    rows are scanned one by one, each text whole. An empty table gives an empty one. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    index = Templates(templates, word_frequencies(docs, templates), threshold)
    phrase_words = np.unique(np.concatenate([_codes(phrase) for phrase in PHRASES]))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(piece.column("text"), lower=True)
        words = words_of(texts, LETTERS)
        n = len(texts)
        base = [0] * n
        first: list[int | None] = [None] * n
        last: list[int | None] = [None] * n
        base_labels: list[set[str]] = [set() for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        score = [0.0] * n
        owner = words.text
        # Phrases: texts with two different words of phrases at least.
        place, known = _places(phrase_words, words.hash)
        pairs = np.unique(owner[known] * len(phrase_words) + place[known]) // len(phrase_words)
        for i in np.flatnonzero(np.bincount(pairs, minlength=n) >= 2).tolist():
            own = slice(words.first[i], words.first[i + 1])
            raw = b" ".join(texts.data[a:b].tobytes() for a, b in zip(words.start[own], words.end[own], strict=True))
            starts, base_labels[i] = _phrase_places(b" " + raw + b" ")
            if starts:
                base[i], first[i], last[i], score[i] = len(starts), min(starts), max(starts), 1.0
                labels[i] |= base_labels[i]
        place, known = _places(index.words, words.hash)
        at = np.flatnonzero(known)
        for i, t, containment in index.matches(at, place[at], owner[at]):
            labels[i].add(index.labels[t])
            score[i] = max(score[i], containment)
        return pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                pa.array(words.counts),
                pa.array(base, pa.int64()),
                pa.array(first, pa.int64()),
                pa.array(last, pa.int64()),
                pa.array([",".join(sorted(own)) for own in base_labels], pa.string()),
                pa.array([",".join(sorted(own)) for own in labels], pa.string()),
                pa.array(score, pa.float64()),
            ],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )

    return per_piece(documents(docs), work, SCHEMA)
