"""Ranked search, the Merkle manifest and shards, against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import MESSY, PROSE, table
from tests.llm.test_operators import words
from tillstream.llm import merkle, nra, sharding
from tillstream.llm.numbering import numbered

# Places


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_places_of_a_group_that_is_most_of_the_table(spark, partitions):
    """Groups that end within a range, and equal rows that no range could hold together."""
    rows = [("big", i % 7) for i in range(3000)] + [(f"g{i % 9}", i) for i in range(100)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = numbered(spark.createDataFrame(rows, "g string, v bigint").repartition(6), "g", [F.col("v")], "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    by_group = defaultdict(list)
    for row in sorted(found, key=lambda row: (row.g, row["at"])):
        by_group[row.g].append(row)
    assert Counter((row.g, row.v) for row in found) == Counter(rows)
    for own in by_group.values():
        assert [row["at"] for row in own] == list(range(len(own)))
        assert [row.v for row in own] == sorted(row.v for row in own)


# 11: ranked search


def ranked(texts, items, k):
    """The contract's scores, term by term."""
    own = [(i, doc_id, Counter(words(text))) for i, (doc_id, text) in enumerate(texts)]
    sizes = {i: sum(count.values()) for i, _, count in own}
    n, length = sum(size > 0 for size in sizes.values()), sum(sizes.values())
    df = Counter(term for _, _, count in own for term in count)
    out = []
    for item_id, text in items:
        scores = []
        for i, doc_id, count in own:
            score = 0
            for term in set(words(text)) & count.keys():
                m = 50 + 50 * sizes[i] * n // length
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                score += weight * (10**9 * count[term] // (1000 * count[term] + 20 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return Counter(out)


def test_search_of_messy_tables(spark, messy, empty):
    items = [(1, "the prose: Alder00 birch11 nutmeg and more"), (1, "word"), (None, "ODD id word"), (2, None), (3, ""), (4, "unknown")]
    benchmark = spark.createDataFrame([(*item, "x") for item in items], "item_id bigint, text string, rank string")
    found = nra.search(messy, benchmark, k=4, block=2)
    assert Counter(map(tuple, found.collect())) == ranked(MESSY, items, 4)
    assert nra.search(empty, benchmark).collect() == nra.search(messy, benchmark.limit(0)).collect() == []


@pytest.mark.parametrize(("partitions", "postings"), [(1, 10**6), (5, 10**6), (3, 40)])
def test_search_in_several_shards_with_ties(spark, monkeypatch, partitions, postings):
    monkeypatch.setattr(nra, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(nra, "FIRST_READ", 2)
    random = np.random.default_rng(5)
    texts = [(i // 2, " ".join(f"t{k}" for k in random.zipf(1.4, int(random.integers(0, 40))) if k < 60)) for i in range(400)]
    texts += [(1000 + i, texts[40 + i % 3][1]) for i in range(120)]
    items = [(q, " ".join(f"t{k}" for k in random.integers(1, 60, 8))) for q in range(12)]
    docs = table(spark, texts).repartition(partitions)
    monkeypatch.setattr(nra, "pieces", lambda batches: (batch.slice(i, 16) for batch in batches for i in range(0, len(batch), 16)))
    found = nra.search(docs, spark.createDataFrame(items, "item_id bigint, text string"), k=20)
    assert Counter(map(tuple, found.collect())) == ranked(texts, items, 20)


@settings(max_examples=200)
@given(st.integers(1, 60), st.integers(1, 9), st.integers(1, 12), st.integers(0, 40), st.integers(1, 4), st.integers(0, 2**32))
def test_reading_stops_no_earlier_than_it_may(n, n_terms, k, floor, first_read, seed):
    random = np.random.default_rng(seed)
    dense = np.where(random.random((n, n_terms)) < 0.5, random.integers(0, 12, (n, n_terms)), 0)
    doc, term = np.nonzero(dense >= 0) if seed % 2 else np.nonzero(dense)
    lists = nra.ImpactLists(doc, term, dense[doc, term], n, n_terms)
    terms = np.flatnonzero(random.random(n_terms) < 0.7)
    before, nra.FIRST_READ = nra.FIRST_READ, first_read
    try:
        found, scores = lists.best(terms, k, floor)
    finally:
        nra.FIRST_READ = before
    expected = dense[:, terms].sum(axis=1)
    bar = max(1, floor, sorted(expected)[-k] if n >= k else 0)
    assert dict(zip(found.tolist(), scores.tolist(), strict=True)) == {i: s for i, s in enumerate(expected.tolist()) if s >= bar}


def test_an_early_end_of_reading():
    """The best documents are known, and their scores, long before the lists end."""
    n = 100_000
    doc = np.tile(np.arange(n), 2)
    impact = np.concatenate([np.arange(n), np.arange(n)])
    lists = nra.ImpactLists(doc, np.repeat([0, 1], n), impact, n, 2)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append((at.stop or 0) - (at.start or 0))
            return super().__getitem__(at)

    lists.doc = lists.doc.view(Watched)
    found, scores = lists.best(np.array([0, 1]), 3, 1)
    assert sorted(zip(scores.tolist(), found.tolist(), strict=True)) == [(2 * i, i) for i in range(n - 3, n)]
    assert sum(read) < 2000


# 12: the manifest


def sha(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def fields(*values):
    return "".join("-" if value is None else f"{len(str(value).encode())}:{value}" for value in values)


def tree(leaves, arity):
    """The root of the leaves, and the siblings of each, a run's others at a time."""
    nodes, paths, above = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, at in enumerate(above):
            start = at // arity * arity
            paths[i].append((nodes[start:at], nodes[at + 1 : start + arity]))
            above[i] = at // arity
        nodes = [sha(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def manifest(rows, arity):
    by_source = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if text is not None else None
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf = sha(fields(doc_id, source, lang, n_chars, text))
        received = sha(fields(doc_id, source, lang, n_chars, lower)) if hit else leaf
        by_source[source].append((doc_id is not None, doc_id or 0, leaf, received))
    names = sorted(by_source, key=lambda name: b"" if name is None else b"=" + name.encode())
    trees = {name: tree([leaf for _, _, leaf, _ in sorted(by_source[name])], arity) for name in names}
    root, tops = tree([trees[name][0] for name in names], arity)
    out = Counter()
    for name, top in zip(names, tops, strict=True):
        subroot, paths = trees[name]
        for (known, doc_id, leaf, received), path in zip(sorted(by_source[name]), paths, strict=True):
            path, own = path + top, received
            for left, right in path:
                own = sha(*left, own, *right)
            proof = sha(*(digest for left, right in path for digest in left + right))
            out[(doc_id if known else None, leaf, subroot, root, proof, own, own == root)] += 1
    return out


def digests(df, arity):
    found = merkle.verified(merkle.manifest(df, arity))
    found = found.withColumn("proof", merkle.proof_digest(F.col("path")))
    return Counter(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()))


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest_of_messy_rows(messy, arity):
    rows = [(row[0], row[3], row[2], row[4], row[1]) for row in messy.collect()]
    assert digests(messy, arity) == manifest(rows, arity)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 257, 2], [3] * 18])
def test_manifest_of_trees_of_all_heights(spark, sizes):
    rows = [(1000 * i + k, f"s{i}" if i else None, "en", None, f"Text {k}") for i, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    found = digests(df.repartition(3), 16)
    assert found == manifest(rows, 16)
    # Exactly the changed documents are found out.
    bad = {row[0] for row in found if not row[-1]}
    assert bad == {row[0] for row in rows if zlib.crc32(str(row[0]).encode()) % 5 == 0}


def test_manifest_of_an_empty_table(empty):
    assert merkle.manifest(empty).collect() == []


# 13: shards


def test_shards_of_messy_rows(messy, empty):
    rows = sharding.shards(messy).collect()
    expected = Counter((doc_id, len((text or "").encode()) + 16, zlib.crc32((text or "").encode())) for doc_id, text in MESSY)
    assert Counter((row.doc_id, row["size"], row.text_crc32) for row in rows) == expected
    by_id, by_shard = defaultdict(set), defaultdict(list)
    for row in rows:
        by_id[row.doc_id].add((row.shard, row.grown_shard))
        by_shard[row.shard].append(row.slot)
    assert all(len(own) == 1 for own in by_id.values())
    assert all(sorted(own) == list(range(len(own))) for own in by_shard.values())
    assert sharding.shards(empty).collect() == []


def test_shards_by_weight_and_growth(spark):
    docs = table(spark, [(i, "x") for i in range(6000)])
    weights = [1.0, 2.0, 5.0]
    rows = sharding.shards(docs, weights, [2.0, 0.5]).collect()
    count, grown = Counter(row.shard for row in rows), Counter(row.grown_shard for row in rows)
    for shard, weight in enumerate(weights):
        assert count[shard] == pytest.approx(6000 * weight / 8, rel=0.1)
    for shard, weight in enumerate([*weights, 2.0, 0.5]):
        assert grown[shard] == pytest.approx(6000 * weight / 10.5, rel=0.15)
    assert all(row.grown_shard in (row.shard, 3, 4) for row in rows)
    # The grown set is what a set of five shards gives at once.
    whole = {row.doc_id: row.shard for row in sharding.shards(docs, [*weights, 2.0, 0.5], []).collect()}
    assert whole == {row.doc_id: row.grown_shard for row in rows}
    with pytest.raises(ValueError):
        sharding.shards(docs, [1.0, 0.0])


def test_written_shards(spark, messy, tmp_path):
    docs = messy.toDF(*messy.columns[:-2], "Shard", "other")
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.columns == [*docs.columns[:-2], "Shard_", "other", "shard"] and back.count() == len(MESSY)
    by_id = {row.doc_id: row.shard for row in sharding.shards(messy).collect()}
    assert all(by_id[row.doc_id] == row.shard for row in back.collect())
    assert back.filter("doc_id = 1").first().text == PROSE


def test_search_counts_are_exact_for_long_documents():
    sizes = np.array([3, 2**40])
    corpus = nra.Corpus(10**9, 10**12, np.zeros(0, dtype=np.int64))
    assert nra._damping(sizes, corpus).tolist() == [50 + 50 * n * 10**9 // 10**12 for n in sizes.tolist()]
    assert nra.queries_of([0], [None]).terms.tolist() == []
