"""Toxicity by the nearest labelled examples, found exactly with a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.calibration import class_weights, fitted, probability
from tillstream.llm.tables import class_counts, sampled_labels, sampled_texts, written
from tillstream.llm.text import LETTERS, documents, lists, per_piece, pieces, texts_of, words_of

SCHEMA = "doc_id bigint, score double, neighbours array<bigint>, cosines array<double>"

#: Labelled examples of either class.
EXAMPLES = 1000
#: What a word counts for whose presence says nothing about the label, against 1 for one that tells all; and the chi squared
#: at which a word has half of its say.
LEAST_SAY = 0.03
HALF_SAY = 30.0
#: Neighbours that vote, and the power of the cosine that their votes count by.
NEIGHBOURS = 15
POWER = 2
#: Examples of a block of the index, and blocks that are looked at first; then all that can still hold a nearer one.
BLOCK = 128
FIRST_BLOCKS = 4


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and count of the distinct words of each text."""
    words = words_of(texts_of(column, lower=True), LETTERS)
    owner = words.text
    order = np.lexsort((words.hash, owner))
    owner, word = owner[order], words.hash[order]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], word[at], np.diff(np.append(at, len(owner)))


def _say(term: np.ndarray, label: np.ndarray, n_terms: int, size: tuple[int, int]) -> np.ndarray:
    """By how much each word's weight counts, from how clearly its presence in an example depends on the label."""
    n0, n1 = (float(n) for n in size)
    b = np.bincount(term, weights=label, minlength=n_terms)
    a = np.bincount(term, minlength=n_terms) - b
    if not n0 or not n1:
        return np.ones(n_terms)
    rest = np.maximum(0.0, n0 + n1 - a - b)
    chi2 = (n0 + n1) * (a * (n1 - b) - b * (n0 - a)) ** 2 / ((a + b) * rest * n0 * n1 + 1e-9)
    return LEAST_SAY + (1 - LEAST_SAY) * (chi2 / (chi2 + HALF_SAY)) ** 2


def _restricted(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, number of the term, and count, for the terms of the vocabulary alone."""
    if not len(vocabulary):
        return (np.zeros(0, dtype=np.int64),) * 3
    words = words_of(texts_of(column, lower=True), LETTERS)
    place = np.searchsorted(vocabulary, words.hash)
    place[place == len(vocabulary)] = 0
    known = vocabulary[place] == words.hash
    pair, count = np.unique(words.text[known] * len(vocabulary) + place[known], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), count


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents. Each task sums up its own."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the examples' words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        sums = np.zeros(len(words) + 1, dtype=np.int64)
        for piece in pieces(batches):
            _, term, _ = _restricted(piece.column("text"), words)
            sums[:-1] += np.bincount(term, minlength=len(words))
            sums[-1] += len(piece)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["term", "n"])

    rows = documents(docs).select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(vocabulary) + 1)
    for row in rows.collect():
        counts[row["term"]] = row["n"]
    return counts[:-1], int(counts[-1])


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the range of each."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n - first, n), of


class BlockMaxIndex:
    """Unit vectors of examples as postings by term and block, with the largest weight of each term in each block."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        self.n = n
        self.n_blocks = max(1, -(-n // BLOCK))
        order = np.lexsort((owner, term))
        self.owner, self.weight = owner[order], weight[order]
        key = term[order] * self.n_blocks + self.owner // BLOCK
        # An entry for each term and block: where its postings are, and the largest of their weights.
        self.begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.end = np.append(self.begin[1:], len(key))
        self.block = key[self.begin] % self.n_blocks
        self.largest = np.maximum.reduceat(self.weight, self.begin) if len(key) else self.weight
        self.first = np.searchsorted(key[self.begin] // self.n_blocks, np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of the largest cosine above 0, ties by number. Exact: the blocks of the highest upper bounds are
        taken first, and then all others whose bound reaches the k-th best."""
        entry, of = _ranges(self.first[terms], self.first[terms + 1])
        block, weight = self.block[entry], weights[of]
        bound = np.bincount(block, weight * self.largest[entry], minlength=self.n_blocks)
        score = np.zeros(self.n)
        found = np.zeros(0, dtype=np.int64)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        at, step = 0, FIRST_BLOCKS
        while at < len(order):
            some = order[at : at + step]
            at, step = at + step, self.n_blocks
            if len(found) == k:
                some = some[bound[some] >= score[found[-1]] - 1e-9]
                if not len(some):
                    break
            taken = np.zeros(self.n_blocks, dtype=bool)
            taken[some] = True
            own = np.flatnonzero(taken[block])
            posting, by = _ranges(self.begin[entry[own]], self.end[entry[own]])
            sums = np.bincount(self.owner[posting], weight[own][by] * self.weight[posting], minlength=self.n)
            fresh = np.flatnonzero(sums)
            if len(found) == k:
                fresh = fresh[sums[fresh] >= score[found[-1]] - 1e-9]
            score[fresh] = np.round(sums[fresh], 12)
            fresh = fresh[(score[fresh] > 0) & (fresh != skip)]
            every = np.concatenate([found, fresh])
            found = every[np.lexsort((every, -score[every]))[:k]]
        return [(float(score[i]), int(i)) for i in found]


def _unit(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(owner, weight * weight, minlength=n))
    return weight / norm[owner]


@dataclass
class Model:
    """Terms, what each of them weighs, the index, the examples, and the calibration of the votes."""

    vocabulary: np.ndarray
    term_weight: np.ndarray
    index: BlockMaxIndex
    doc_id: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    parameters: tuple[float, float]
    without: float
    k: int

    def vote(self, near: list[tuple[float, int]]) -> float:
        example = [i for _, i in near]
        votes = np.array([score for score, _ in near]) ** POWER * self.weight[example]
        return float((votes * self.label[example]).sum() / votes.sum())

    def neighbours(self, column: pa.Array, skip: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """The nearest examples of each text; ``skip`` has an example for each that is left out."""
        n = len(column)
        owner, term, count = _restricted(column, self.vocabulary)
        unit = _unit(owner, (1 + np.log(count)) * self.term_weight[term], n)
        first = np.searchsorted(owner, np.arange(n + 1))
        near: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        for i in np.flatnonzero(np.diff(first)).tolist():
            own = slice(first[i], first[i + 1])
            near[i] = self.index.nearest(term[own], unit[own], self.k, -1 if skip is None else int(skip[i]))
        return near


def _examples(texts: DataFrame) -> tuple[np.ndarray, ...]:
    """The examples in order of id: ids, labels, and the postings owner, word and count."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        owner, word, count = _terms(piece.column("text"))
        n = np.bincount(owner, minlength=len(piece))
        values = [lists(pa.array(word.view(np.int64)), n), lists(pa.array(count), n)]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), *values], ["doc_id", "label", "words", "counts"])

    rows = per_piece(texts, work, "doc_id bigint, label int, words array<bigint>, counts array<bigint>").collect()
    rows = sorted((row["doc_id"], row["label"], tuple(row["words"]), tuple(row["counts"])) for row in rows)
    owner = np.repeat(np.arange(len(rows)), [len(row[2]) for row in rows]).astype(np.int64)
    word = np.array([w for row in rows for w in row[2]], dtype=np.int64).view(np.uint64)
    count = np.array([c for row in rows for c in row[3]], dtype=float)
    ids, label = (np.array([row[i] for row in rows], dtype=np.int64) for i in (0, 1))
    return ids, label, owner, word, count


def _votes(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each example that has neighbours, by number, and their vote on it; it is no neighbour of its own."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        # Rows that repeat an id are examples side by side; each leaves out the first of them.
        number = np.searchsorted(known.doc_id, piece.column("doc_id").to_numpy())
        near = known.neighbours(piece.column("text"), number)
        at = [i for i, own in enumerate(near) if own]
        votes = pa.array([known.vote(near[i]) for i in at], pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(number[at]), votes], ["number", "vote"])

    rows = sorted(per_piece(texts, work, "number bigint, vote double").collect())
    return np.array([row["number"] for row in rows], dtype=np.int64), np.array([row["vote"] for row in rows], dtype=float)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, k: int = NEIGHBOURS
) -> Model:
    """An index of at most ``examples`` labelled documents of either class, with all their words.

    A word weighs its inverse document frequency, counted over all of ``docs``, times what it has to say about the label;
    no word weighs nothing, so a text that equals an example has a cosine of 1 with it. Each example's own vote, without
    itself, calibrates the votes; texts without any known word have the rate of such examples. Both give the classes the
    shares they have among all labels.

    Null labels and ids are left out; an id with both labels has the larger one; labels of documents that are not there count
    for the shares alone. Null and empty texts are examples without words. Rows of ``docs`` that repeat an id are examples
    of their own. Where a class has no example, or all tables are empty, words weigh alike and every score is the share.
    """
    chosen = sampled_labels(labels, label, examples)
    population = class_counts(labels, label)
    texts = written(sampled_texts(docs, chosen), "examples")
    ids, y, owner, word, count = _examples(texts)
    vocabulary, term = np.unique(word, return_inverse=True)
    frequency, total = document_frequencies(docs, vocabulary)
    size = tuple(int((y == value).sum()) for value in (0, 1))
    term_weight = (np.log((1 + total) / (1 + frequency)) + 1) * _say(term, y[owner], len(vocabulary), size)
    unit = _unit(owner, (1 + np.log(count)) * term_weight[term], len(ids))
    index = BlockMaxIndex(owner, term, unit, len(ids), len(vocabulary))
    weight = class_weights(y, population)
    model = Model(vocabulary, term_weight, index, ids, y, weight, (0.0, 0.0), 0.5, k)
    at, votes = _votes(texts, model)
    model.parameters = fitted(votes, y[at], weight[at])
    none = np.setdiff1d(np.arange(len(ids)), owner)
    prior = (population[1] + 0.5) / (sum(population) + 1)
    model.without = float(((weight[none] * y[none]).sum() + prior) / (weight[none].sum() + 1))
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per document the probability that its label is 1, with the examples that say so.

    The ``k`` examples of the largest TF-IDF cosine vote by a power of it and by class weight, and the vote is calibrated.

    One row per row. Texts without any word of an example, also null and empty ones, have no neighbours and the score of no
    evidence. A null id stays null; repeated rows get equal scores; equal cosines go by the example's doc_id. Only the text
    is read; other columns are ignored. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the examples

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        near = known.neighbours(piece.column("text"))
        score = np.full(len(piece), known.without)
        for i, own in enumerate(near):
            if own:
                score[i] = probability(np.array([known.vote(own)]), known.parameters)[0]
        counts = np.array([len(own) for own in near])
        ids = known.doc_id[np.array([i for own in near for _, i in own], dtype=np.int64)]
        cosines = np.array([value for own in near for value, _ in own], dtype=float)
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(score), lists(pa.array(ids), counts), lists(pa.array(cosines), counts)],
            ["doc_id", "score", "neighbours", "cosines"],
        )

    return per_piece(documents(docs), work, SCHEMA)
