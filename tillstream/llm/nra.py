"""Ranked search by NRA: lists in the order of impact, read from the top, without random access.

A query is an item's distinct terms. In a shard of documents each term has the list of its documents, those it adds most to
first. Lists are read side by side. What a document has got so far is the lower bound of its score; with the next impact of
each list it has not been met in, it is the upper bound. Reading goes on until no other document can come among the best,
and the best ones' bounds have met; ties and scores are exact then.

The documents are searched where they lie: each task indexes shards of its documents for the terms of the queries, and carries
the worst score that still counts from one shard to the next. Tasks put out their best documents for each query, which Spark
merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstream.llm.numbering import numbered
from tillstream.llm.tables import written
from tillstream.llm.text import LETTERS, documents, pick, pieces, texts_of, words_of

#: Documents of a query's result.
BEST = 50
#: Queries that are searched together; a block of them goes to every task.
BLOCK = 1000
#: Postings of a shard, about; a document's are not divided.
SHARD_POSTINGS = 2_000_000
#: Entries of each list that the first round reads; each round reads twice as many as the one before.
FIRST_READ = 64
#: Documents times terms up to which bounds are kept; beyond, lists are read to their ends.
BOUNDS = 50_000_000
#: Groups of tasks whose results are merged first.
GROUPS = 64

_RESULT = "number bigint, score bigint, doc_id bigint"


@dataclass
class Queries:
    """Terms by hash, in order, and each query's terms as places there: ``terms[first[i]:first[i + 1]]``."""

    numbers: list[int]
    vocabulary: np.ndarray
    terms: np.ndarray
    first: np.ndarray


def queries_of(numbers: list[int], texts: list[str | None]) -> Queries:
    words = words_of(texts_of(pa.array(texts, pa.string()), lower=True), LETTERS)
    vocabulary, term = np.unique(words.hash, return_inverse=True)
    own = np.unique(words.text * max(1, len(vocabulary)) + term)
    owner, terms = np.divmod(own, max(1, len(vocabulary)))
    return Queries(numbers, vocabulary, terms, np.searchsorted(owner, np.arange(len(texts) + 1)))


@dataclass
class Shard:
    """Postings as they are gathered: ids and lengths of documents; document, term and occurrences of each posting."""

    ids: list[pa.Array] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    n_documents: int = 0
    n_postings: int = 0

    def add(self, ids: pa.Array, sizes: np.ndarray, owner: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.postings.append((owner + self.n_documents, term, times))
        self.n_documents += len(ids)
        self.n_postings += len(owner)


def counted(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each text has; and text, term and occurrences of the terms that are in the vocabulary."""
    words = words_of(texts_of(column, lower=True), LETTERS)
    if not len(vocabulary):
        none = np.zeros(0, dtype=np.int64)
        return words.counts, none, none, none
    place = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    known = vocabulary[place] == words.hash
    pair, times = np.unique(words.text[known] * len(vocabulary) + place[known], return_counts=True)
    return words.counts, *np.divmod(pair, len(vocabulary)), times


@dataclass
class Corpus:
    """Documents with terms, all their terms, and the weight of each term of the queries."""

    n: int
    length: int
    weight: np.ndarray


def corpus_of(docs: DataFrame, vocabulary: np.ndarray) -> Corpus:
    """The figures over all documents. Each task sums up its own; the driver gets one number for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocabulary) + 2, dtype=np.int64)
        for piece in pieces(batches):
            sizes, _, term, _ = counted(piece.column("text"), vocabulary)
            sums[:-2] += np.bincount(term, minlength=len(vocabulary))
            sums[-2:] += np.count_nonzero(sizes), sizes.sum()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["term", "n"])

    rows = documents(docs).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(len(vocabulary) + 2, dtype=np.int64)
    for row in rows:
        sums[row["term"]] = row["n"]
    n, length = int(sums[-2]), int(sums[-1])
    return Corpus(n, length, np.floor(1000 * np.log((2 * n + 2) / (2 * sums[:-2] + 1))).astype(np.int64))


def _damping(sizes: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What a document's length adds to the denominator of its terms."""
    if 50 * int(sizes.max(initial=0)) * corpus.n < 1 << 63:
        return 50 + 50 * sizes * corpus.n // max(1, corpus.length)
    return np.array([50 + 50 * size * corpus.n // corpus.length for size in sizes.tolist()], dtype=np.int64)


class ImpactLists:
    """For each term its documents and what it adds to their scores, the highest first."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_documents: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.n = doc[order], impact[order], n_documents
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents whose scores for these terms are among the ``k`` highest and at least ``floor``, all that tie with
        the last one too, and their scores."""
        at, end = self.first[terms], self.first[terms + 1]
        lists = np.flatnonzero(end > at)
        at, end = at[lists], end[lists]
        lower = np.zeros(self.n, dtype=np.int64)
        bounded = self.n * len(lists) <= BOUNDS
        met = np.zeros((self.n if bounded else 0, len(lists)), dtype=bool)
        candidates: np.ndarray | None = None  # None as long as any document may be one
        depth = FIRST_READ if bounded else len(self.doc)
        while True:
            stop = np.minimum(at + depth, end)
            for j in np.flatnonzero(stop > at).tolist():
                docs = self.doc[at[j] : stop[j]]
                lower[docs] += self.impact[at[j] : stop[j]]
                if bounded:
                    met[docs, j] = True
            at, depth = stop, 2 * depth
            ahead = at < end
            head = np.where(ahead, self.impact[np.minimum(at, len(self.impact) - 1)], 0) if len(at) else at
            total = int(head.sum())
            own = lower if candidates is None else lower[candidates]
            bar = max(floor, 1)
            if len(own) >= k:
                bar = max(bar, int(np.partition(own, len(own) - k)[len(own) - k]))
            if not ahead.any():
                found = np.flatnonzero(lower >= bar) if candidates is None else candidates[own >= bar]
                return found, lower[found]
            if candidates is None:
                if total >= bar:  # a document that has not been met may still come in
                    continue
                candidates = np.flatnonzero(lower + total >= bar)
            rest = (~met[candidates]) @ head
            possible = lower[candidates] + rest >= bar
            candidates, rest = candidates[possible], rest[possible]
            if not rest.any():
                return candidates, lower[candidates]


def _searched(shard: Shard, queries: Queries, corpus: Corpus, best: list[pa.Table | None], k: int) -> None:
    """Merge the shard's best documents for each query into ``best``, tables of score and doc_id."""
    ids = pa.chunked_array(shard.ids, pa.int64())
    sizes = np.concatenate(shard.sizes)
    doc, term, times = (np.concatenate(column) for column in zip(*shard.postings, strict=True))
    impact = corpus.weight[term] * (1_000_000_000 * times // (1000 * times + 20 * _damping(sizes, corpus)[doc]))
    lists = ImpactLists(doc, term, impact, len(sizes), len(queries.vocabulary))
    for i in range(len(queries.numbers)):
        before = best[i]
        floor = before.column("score")[-1].as_py() if before is not None and len(before) == k else 1
        found, scores = lists.best(queries.terms[queries.first[i] : queries.first[i + 1]], k, floor)
        if not len(found):
            continue
        own = pa.table({"score": pa.array(scores), "doc_id": ids.take(pa.array(found))})
        whole = own if before is None else pa.concat_tables([before, own])
        # Missing ids come last.
        best[i] = whole.sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, k).combine_chunks()


def _found(docs: DataFrame, queries: Queries, corpus: Corpus, k: int) -> DataFrame:
    """The best documents of each task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table | None] = [None] * len(queries.numbers)
        shard = Shard()
        for piece in pieces(batches):
            shard.add(piece.column("doc_id"), *counted(piece.column("text"), queries.vocabulary))
            if shard.n_postings >= SHARD_POSTINGS:
                _searched(shard, queries, corpus, best, k)
                shard = Shard()
        if shard.n_postings:
            _searched(shard, queries, corpus, best, k)
        for number, rows in zip(queries.numbers, best, strict=True):
            if rows is not None:
                values = [pa.array(np.full(len(rows), number)), *(rows.column(c).combine_chunks() for c in ("score", "doc_id"))]
                yield pa.RecordBatch.from_arrays(values, ["number", "score", "doc_id"])

    return documents(docs).mapInArrow(run, _RESULT)


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The best rows of each query with their rank: first those of each group of tasks, then those of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("group", F.spark_partition_id() % GROUPS)
    for keys in (["number", "group"], ["number"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= k)
    return rows.drop("group")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = BLOCK) -> DataFrame:
    """Per item the ``k`` documents of the highest scores above 0: item_id, rank (from 1), doc_id, score.

    Equal scores rank by doc_id, null last. Terms are maximal runs of digits, letters and bytes beyond ASCII, A-Z in lower
    case; a term counts once in an item. Numbers of documents and terms, which the weights depend on, are over all documents.

    Each row of ``items`` is a query of its own, also where ids repeat or are null; one without terms, or whose terms no
    document has, has no result. Null and empty texts have no terms and are found by nothing. Each row of ``docs`` is a
    document, so a row that repeats one is found beside it. Empty tables give an empty result. Other columns are ignored.

    Items are searched in blocks of ``block``; each block reads the documents twice, once for the figures.
    """
    items = numbered(pick(items, item_id="bigint", text="string").withColumn("all", F.lit("")), "all", [F.col("item_id"), F.col("text")], "number")
    items = written(items.select("item_id", "text", "number"), "items")
    n = items.count()
    parts = [documents(docs).limit(0).select(F.lit(0).alias("number").cast("bigint"), F.lit(0).cast("bigint").alias("score"), "doc_id")]
    for start in range(0, n, block):
        own = items.filter(F.col("number").between(start, start + block - 1)).select("number", "text").collect()
        queries = queries_of([row["number"] for row in own], [row["text"] for row in own])
        parts.append(_found(docs, queries, corpus_of(docs, queries.vocabulary), k))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionAll(more)
    rows = _merged(rows, k).join(items.select("number", "item_id"), "number")
    return rows.select("item_id", "rank", "doc_id", "score")
