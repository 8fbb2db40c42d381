"""Operators against brute force, exact references, and held-out labels."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers.models import Unigram

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.conftest import MESSY, PROSE, WORDS, table
from tillstream import storage
from tillstream.llm import compression, forest, mixing, windows
from tillstream.llm.calibration import class_weights, fitted, probability
from tillstream.llm import components as components_module
from tillstream.llm.components import components
from tillstream.llm.decontamination import removed
from tillstream.llm.licenses import Templates, license_scan
from tillstream.llm.mixing import apportion, targets_of
from tillstream.llm.queries import QUERIES
from tillstream.llm.ranges import range_of
from tillstream.llm.repetition import measured
from tillstream.llm.text import LETTERS, texts_of, words_of
from tillstream.llm.toxicity import POWER, BlockMaxIndex, toxicity, train
from tillstream.llm.viterbi import SPACE, Vocabulary, read_vocabulary, token_counts
from tillstream.llm.viterbi import Counter as PieceCounter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTER_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return LETTER_WORDS.findall((text or "").translate(UPPER))


# 2: token counts


def tokenizer(vocabulary):
    worst = min(vocabulary.pieces.values())
    pieces = [("<unk>", worst), *vocabulary.pieces.items()]
    if vocabulary.byte_fallback:
        pieces += [(f"<0x{i:02X}>", worst) for i in range(256)]
    return Unigram(pieces, 0, vocabulary.byte_fallback)


def test_token_counts_of_the_documents(spark, docs):
    vocabulary = read_vocabulary()
    model = tokenizer(vocabulary)
    found = {row.doc_id: row.n_tokens for row in token_counts(docs, vocabulary).collect()}
    for row in docs.select("doc_id", "text").collect():
        assert found[row.doc_id] == len(model.tokenize(SPACE + row.text.replace(" ", SPACE)))


@settings(max_examples=300)
@given(
    st.dictionaries(st.text("ab▁c", min_size=1, max_size=4), st.sampled_from([-1.0, -1.5, -2.0, -3.0]), min_size=1, max_size=25),
    st.booleans(),
    st.text("abcd  é▁", min_size=1, max_size=14),
)
def test_token_counts_with_any_vocabulary(pieces, fallback, text):
    """Also where scores tie, where pieces span words, and where characters are unknown."""
    vocabulary = Vocabulary(pieces, fallback)
    expected = len(tokenizer(vocabulary).tokenize(SPACE + text.replace(" ", SPACE)))
    assert PieceCounter(vocabulary).count(text)[0] == expected


# 3: repetition


@settings(max_examples=100)
@given(st.lists(st.text("ab \n", max_size=40), min_size=1, max_size=3))
def test_repeated_words(values):
    figures = measured(pa.array(values, pa.string()), 4)
    for i, value in enumerate(values):
        own = value.split()
        for size, name in ((3, "n_repeat_words"), (4, "covered_words")):
            windows_ = [tuple(own[j : j + size]) for j in range(len(own) - size + 1)]
            count = Counter(windows_)
            hit = {j + k for j, window in enumerate(windows_) if count[window] > 1 for k in range(size)}
            assert figures[name][i] == len(hit)
        lines = [line for line in value.split("\n") if line.split()]
        assert figures["n_dup_lines"][i] == len(lines) - len(set(lines))


# 4: license scan


@given(
    st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=9), min_size=1, max_size=6),
    st.lists(st.lists(st.sampled_from("abcdefghxyz"), max_size=40), max_size=4),
    st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 9)),
    st.sampled_from([0.3, 0.5, 0.8, 1.0]),
)
def test_the_filters_lose_no_match(templates, texts, frequency, threshold):
    from tillstream.llm.licenses import SLACK, _codes

    code = {letter: int(_codes(letter)[0]) for letter in "abcdefgh"}
    named = [(str(i), " ".join(own)) for i, own in enumerate(templates)]
    index = Templates(named, {code[letter]: n for letter, n in frequency.items()}, threshold)
    every = [(i, letter) for i, own in enumerate(texts) for letter in own]
    known = [(at, i, int(np.searchsorted(index.words, code[x]))) for at, (i, x) in enumerate(every) if x in code and code[x] in index.words.tolist()]
    at, owner, word = (np.array(column, dtype=np.int64) for column in zip(*known, strict=True)) if known else (np.zeros(0, dtype=np.int64),) * 3
    found = {(i, t): share for i, t, share in index.matches(at, word, owner)}
    expected = {}
    for t, own in enumerate(templates):
        width = len(own) + max(SLACK, len(own) // 4)
        for i, text in enumerate(texts):
            share = max((len(set(text[j : j + width]) & set(own)) for j in range(len(text))), default=0) / len(set(own))
            if share >= threshold - 1e-9:
                expected[i, t] = share
    assert found == expected


def test_wrapped_notices_and_scattered_words(spark):
    """A notice is the same however its lines end, and words far from each other are none."""
    from tillstream.llm.licenses import TEMPLATES

    before, after = (" ".join(f"{mark}{k}" for k in range(50)) for mark in "xy")
    rows, expected = [], {}
    for i, (label, notice) in enumerate(TEMPLATES):
        own = notice.split()
        wrapped = "\n * ".join(" ".join(own[k : k + 5]) for k in range(0, len(own), 5))
        scattered = f" {before} ".join(own)
        one_word_more = " ".join([own[0], "really", *own[1:]])
        for j, text in enumerate((notice, f"{before}\n\n{wrapped}\n{after}", scattered, f"{before} {one_word_more} {after}")):
            rows.append((10 * i + j, text))
            expected[10 * i + j] = label if j != 2 else None
    found = {row.doc_id: row for row in license_scan(table(spark, rows)).collect()}
    for doc_id, label in expected.items():
        labels = found[doc_id].labels.split(",")
        assert label in labels if label else labels == [""], found[doc_id]
        assert (found[doc_id].score == 1.0) == bool(label)


def test_notices(spark):
    texts = [
        "x\nReleased under the BSD License.",
        "Released under the MIT License",
        "a gnu GENERAL public License, v2; cc-by",
        "under the license",
        None,
    ]
    rows = license_scan(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(row.n_base, row.base_labels, row.labels, row.score) for row in rows] == [
        (0, "", "bsd", 1.0),
        (1, "mit", "mit", 1.0),
        (2, "cc-by,gpl", "cc-by,gpl", 1.0),
        (0, "", "", 0.0),
        (0, "", "", 0.0),
    ]
    assert (rows[2].first_word, rows[2].last_word, rows[3].first_word) == (1, 6, None)


# 6: mixing


@given(st.lists(st.floats(0, 1e6), max_size=8), st.integers(0, 300))
def test_apportionment_takes_the_highest_quotients(votes, seats):
    given_ = apportion(votes, seats)
    if sum(votes) <= 0:
        assert given_ == [0] * len(votes)
        return
    assert sum(given_) == seats
    # No seat could go to a higher quotient than the lowest one that has a seat.
    taken = [v / (2 * s - 1) for v, s in zip(votes, given_, strict=True) if s]
    free = [v / (2 * s + 1) for v, s in zip(votes, given_, strict=True)]
    assert not taken or min(taken) >= max(free) * (1 - 1e-9)


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    targets = targets_of(sizes, weights)
    assert sum(targets) == pytest.approx(sum(sizes))
    open_ = [t / w for t, w, n in zip(targets, weights, sizes, strict=True) if t < 3 * n - 1e-6]
    assert all(t <= 3 * n + 1e-6 for t, n in zip(targets, sizes, strict=True))
    assert not open_ or max(open_) == pytest.approx(min(open_))
    # A source that stops at three times its size would have got more.
    assert not open_ or all(3 * n / w <= max(open_) + 1e-6 for t, w, n in zip(targets, weights, sizes, strict=True) if t >= 3 * n)


def test_mix_of_the_documents(spark, docs):
    rows = mixing.mix(docs, shard_words=2000).collect()
    sizes = {row.doc_id: len((row.text or "").split()) for row in docs.select("doc_id", "text").collect()}
    by_source = defaultdict(list)
    for row in rows:
        assert row["size"] == sizes[row.doc_id] and 0 <= row.taken <= 3 * row["size"]
        by_source[row.source].append(row)
    assert sum(row.taken for row in rows) == pytest.approx(sum(sizes.values()), abs=64)
    names = sorted(by_source)
    targets = targets_of([sum(r["size"] for r in by_source[name]) for name in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for name, target in zip(names, targets, strict=True):
        own = by_source[name]
        assert {row.source_size for row in own} == {sum(row["size"] for row in own)}
        assert own[0].target == pytest.approx(target)
        assert abs(sum(row.taken for row in own) - target) <= 64
    again = mixing.mix(docs.repartition(5), shard_words=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert len({row.taken for row in mixing.mix(docs, seed=2).collect()} | {0}) > 1


# 7: near duplicates


@pytest.mark.parametrize(("partitions", "links"), [("8", 250_000), ("8", 9), ("3", 9)])
def test_components(spark, monkeypatch, partitions, links):
    monkeypatch.setattr(components_module, "LINKS", links)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        chain = [(i, i + 1) for i in range(100, 160)] + [(5, 90), (90, 5), (7, 7), (3, 5), (200, 90)]
        found = {row.node: row.component for row in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == dict.fromkeys(range(100, 161), 100) | dict.fromkeys([3, 5, 90, 200], 3)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_a_large_group_of_near_copies(spark):
    """Variants of one text, most pairs of which are not linked: the component is found without comparing all."""
    base = PROSE.split()
    random = np.random.default_rng(1)
    rows = []
    for i in range(400):
        own = list(base)
        for at in random.choice(len(own), int(random.integers(0, 8)), replace=False):
            own[at] = f"new{i}x{at}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"{w}{i}" for w in base)) for i in range(50)]
    found = {row.doc_id: row.component_id for row in forest.near_duplicates(table(spark, rows)).collect()}
    assert found == linked_components(rows)


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_one_link_between_two_groups(spark, partitions):
    """Every document has many closer ones than the only link between the groups; and there may be more partitions than rows."""

    def edited(words, places, mark):
        return [f"{mark}{i}" if i in places else word for i, word in enumerate(words)]

    base = [f"w{i}" for i in range(300)]
    # 8 of 300 words: 265 of 329 shingles, which is 80.5 %; with one more it is 78.4 %.
    bridge = edited(base, set(range(20, 300, 37)), "b")
    rows = [(2000, " ".join(base)), (1999, " ".join(bridge))]
    rows += [(i, " ".join(edited(base, {5 + 37 * (i % 8)}, f"x{i}y"))) for i in range(60)]
    rows += [(1000 + i, " ".join(edited(bridge, {10 + 37 * (i % 8)}, f"z{i}y"))) for i in range(60)]
    rows += [(5000, "a text of its own that nothing is like")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {row.doc_id: row.component_id for row in forest.near_duplicates(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == {i: 5000 if i == 5000 else 0 for i, _ in rows}


def test_links_of_a_lower_percentage(spark):
    """60 of 97 shingles are 62 %; the sizes alone rule such a link out at 80 %."""
    assert forest.least_agreement(80) == 80
    rows = []
    for i in range(30):
        base = [f"d{i}w{k}" for k in range(100)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:63]))]
    docs = table(spark, rows)
    found = {row.doc_id: row.component_id for row in forest.near_duplicates(docs, percent=60).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}
    with pytest.raises(ValueError):
        forest.near_duplicates(docs, percent=40)


def linked_components(rows, percent=80):
    """Each document's component, by comparing all pairs."""
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("parts", [(1024, 128, 1 << 20), (7, 5, 1 << 20), (1024, 128, 700)])
def test_a_group_of_many_documents_that_are_just_not_linked(spark, monkeypatch, parts):
    """Of some 45,000 pairs in one region few are links; they are found whatever parts regions and clumps are cut into, and
    no step puts out pairs."""
    for name, value in zip(("PART", "SETS", "SET_SHINGLES"), parts, strict=True):
        monkeypatch.setattr(forest, name, value)
    random = np.random.default_rng(2)
    rows = []
    for i in range(150):
        rate = 0.006 if i % 10 == 0 else 0.032
        rows.append((i, " ".join(f"n{i}x{k}" if random.random() < rate else f"w{k}" for k in range(200))))
    expected = linked_components(rows)
    assert 20 < len(set(expected.values())) < 150
    given_ = []
    real = forest._between
    monkeypatch.setattr(forest, "_between", lambda *args: given_.append(real(*args)) or given_[-1])
    found = {row.doc_id: row.component_id for row in forest.near_duplicates(table(spark, rows)).collect()}
    assert found == expected
    assert given_[0].count() < 40 * len(rows)


def test_an_id_of_two_texts(spark):
    first, second = (" ".join(f"{mark}{i}" for i in range(80)) for mark in "ab")
    rows = [(2, first), (5, first), (5, second), (9, second), (9, second + " more"), (None, second)]
    docs = table(spark, rows)
    found = Counter(tuple(row) for row in forest.near_duplicates(docs).collect())
    assert found == Counter(
        [(2, 77, 2, True), (5, 77, 2, False), (5, 77, 5, True), (9, 77, 5, False), (9, 78, 5, False), (None, 77, None, True)]
    )
    # A row of each text stays.
    kept = Counter((row[0], row[1]) for row in forest.one_of_each(docs).collect())
    assert kept == Counter([(2, first), (5, second), (None, second)])


# 8: toxicity


@settings(max_examples=60)
@given(st.integers(1, 200), st.integers(1, 12), st.integers(1, 9), st.integers(0, 2**32))
def test_nearest_examples_are_exact(n, n_terms, k, seed):
    random = np.random.default_rng(seed)
    dense = np.where(random.random((n, n_terms)) < 0.3, random.integers(1, 4, (n, n_terms)), 0).astype(float)
    norm = np.maximum(1e-12, np.sqrt((dense**2).sum(axis=1)))[:, None]
    dense /= norm
    owner, term = np.nonzero(dense)
    index = BlockMaxIndex(owner, term, dense[owner, term], n, n_terms)
    terms = np.flatnonzero(random.random(n_terms) < 0.5)
    weights = np.full(len(terms), 1 / max(1, np.sqrt(len(terms))))
    found = index.nearest(terms, weights, k) if len(terms) else []
    scores = dense[:, terms] @ weights if len(terms) else np.zeros(n)
    expected = sorted(((round(float(s), 12), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:k]
    assert [s for s, _ in found] == pytest.approx([s for s, _ in expected])
    assert all(scores[i] == pytest.approx(s) for s, i in found)


def test_examples_whose_telling_words_are_rare(spark):
    """Every toxic text has two of 20 words that no other text has. Copies of examples are nearest to these, and say so."""
    random = np.random.default_rng(7)
    rows, marks = [], []
    for i in range(400):
        own = [f"w{k}" for k in random.integers(0, 3000, 80)]
        if i % 2:
            own[10], own[50] = (f"bad{k}" for k in random.choice(20, 2, replace=False))
        rows.append((i, " ".join(own)))
        marks.append((i, i % 2))
    copies = [(1000 + i, rows[i][1]) for i in range(100)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (5, 1), (5, 0), (-1, 0)], "doc_id bigint, toxic int")
    model = train(docs, labels)
    for row in toxicity(table(spark, copies), model).collect():
        assert row.cosines[0] == pytest.approx(1) and row.neighbours[0] == row.doc_id - 1000
        assert (row.score > 0.5) == bool(row.doc_id % 2)
    # Scores by brute force, over whole vectors.
    texts = [words(text) for _, text in rows]
    vocabulary = sorted({word for own in texts for word in own})
    df = Counter(word for own in texts for word in set(own))
    weight = {hash_: value for hash_, value in zip(model.vocabulary.tolist(), model.term_weight.tolist(), strict=True)}
    codes = dict(zip(vocabulary, words_of(texts_of(pa.array(vocabulary)), LETTERS).hash.tolist(), strict=True))
    assert len(weight) == len(vocabulary) and all(weight[codes[w]] < (np.log(401 / (1 + df[w])) + 1) * 1.001 for w in vocabulary)

    def vector(own):
        value = {w: (1 + np.log(n)) * weight[codes[w]] for w, n in Counter(own).items() if w in df}
        norm = np.sqrt(sum(x * x for x in value.values()))
        return {w: x / norm for w, x in value.items()}

    vectors = [vector(own) for own in texts]
    fresh = [(2000 + i, " ".join(f"w{k}" for k in random.integers(0, 3000, 40)) + " bad3" * (i % 2)) for i in range(12)]
    for row, (_, text) in zip(sorted(toxicity(table(spark, fresh), model).collect()), fresh, strict=True):
        own = vector(words(text))
        cosines = sorted(((sum(x * v.get(w, 0) for w, x in own.items()), -i) for i, v in enumerate(vectors)), reverse=True)[:15]
        assert row.cosines == pytest.approx([c for c, _ in cosines], abs=1e-9)
        votes = np.array([c for c, _ in cosines]) ** POWER * model.weight[[-i for _, i in cosines]]
        vote = (votes * [-i % 2 for _, i in cosines]).sum() / votes.sum()
        assert row.score == pytest.approx(probability(np.array([vote]), model.parameters)[0], abs=1e-6)
        assert (row.score > 0.5) == bool(row.doc_id % 2)


def test_a_fitted_model_on_messy_rows(spark, messy, empty):
    """Ties, repeats, nulls and odd texts with a model that knows something; labels of the messy rows themselves."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 0)], "doc_id bigint, toxic int")
    rows = toxicity(messy, train(messy, labels)).collect()
    assert len(rows) == len(MESSY) and all(0 <= row.score <= 1 for row in rows)
    by_text = defaultdict(set)
    for row, (_, text) in zip(sorted(rows, key=str), sorted(MESSY, key=str), strict=True):
        assert row.cosines == sorted(row.cosines, reverse=True)
    for row in rows:
        by_text[row.doc_id].add(row.score)
    assert len(by_text[2]) == 1 and by_text[1] == by_text[2]
    assert toxicity(empty, train(empty, labels)).collect() == []


def held_out(spark, query, label, sf_dir="/root/testdata/sf0.01"):
    marks = {row.doc_id: row[label] for row in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [row for row in QUERIES[query](spark, sf_dir).collect()]
    assert all(0 <= row.score <= 1 for row in rows)
    rows = [row for row in rows if row.held_out and row.doc_id in marks]
    return np.array([marks[row.doc_id] for row in rows]), rows


def test_toxicity_of_held_out_documents(spark):
    marks, rows = held_out(spark, "op8_toxicity", "toxic")
    assert np.mean([row.predicted == mark for row, mark in zip(rows, marks, strict=True)]) >= 0.9
    assert all(row.predicted == int(row.score >= 0.5) for row in rows)


def test_quality_of_held_out_documents(spark):
    marks, rows = held_out(spark, "op10_quality_classifier", "quality")
    assert np.mean([row.predicted == mark for row, mark in zip(rows, marks, strict=True)]) >= 0.85
    assert all(row.predicted == int(row.score >= 0.7) for row in rows)


def test_quality_scores_by_brute_force(spark):
    """The compressed sizes of whole texts, slice by slice, and the logistic curve, all computed once more from the model."""
    import zstandard

    random = np.random.default_rng(9)
    good, bad = ([f"{mark}{k}" for k in range(300)] for mark in ("fine", "poor"))
    rows = [(i, " ".join(random.choice(good if i % 2 else bad, int(random.integers(20, 900))))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, rows[0][1]), (None, rows[1][1])]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    docs = table(spark, rows)
    model = compression.train(docs, labels)

    def size(text, dictionary):
        press = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False
        )
        return sum(len(press.compress(text[i : i + 2048])) for i in range(0, len(text), 2048))

    expected = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        x = (size(raw, model.bad) - size(raw, model.good)) / (len(raw) + 8)
        expected.append((doc_id, 1 / (1 + np.exp(-np.clip(model.parameters[0] + model.parameters[1] * x, -30, 30)))))
    found = sorted(compression.quality(docs, model).collect(), key=str)
    for row, (doc_id, score) in zip(found, sorted(expected, key=lambda r: str(f"Row(doc_id={r[0]}, score={r[1]})")), strict=True):
        assert row.doc_id == doc_id and row.score == pytest.approx(score, abs=1e-9)
    by_id = {row.doc_id: row.score for row in found}
    assert by_id[0] == by_id[302] and by_id[1] == by_id[None] and by_id[300] == by_id[301]
    assert all((by_id[i] > 0.5) == bool(i % 2) for i in range(200))


def test_a_fitted_quality_model_on_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 0), (1, 0)], "doc_id bigint, quality int")
    model = compression.train(messy, labels)
    rows = compression.quality(messy, model).collect()
    assert len(rows) == len(MESSY) and all(0 <= row.score <= 1 for row in rows)
    assert len({row.score for row in rows if row.doc_id in (1, 2)}) == 1
    assert compression.quality(empty, model).collect() == []


def test_calibration():
    random = np.random.default_rng(0)
    x = random.normal(size=20_000)
    y = (random.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    a, b = fitted(x, y, np.ones(len(x)))
    assert (a, b) == (pytest.approx(-1, abs=0.1), pytest.approx(2, abs=0.1))
    weight = class_weights(np.array([0, 0, 1, 1]), (30, 10))
    assert weight.tolist() == [1.5, 1.5, 0.5, 0.5]
    assert probability(np.zeros(1), fitted(np.zeros(0), np.zeros(0), np.zeros(0)))[0] == 0.5
    assert 0.5 < probability(np.ones(1), fitted(np.array([0.0, 1.0]), np.array([0, 1]), np.ones(2)))[0] < 1


# 9: passages


def test_windows_hold_every_passage_once():
    random = np.random.default_rng(3)
    sizes = np.array([6, 30, 0, 200, 7])
    end = np.cumsum(sizes)
    first = end - sizes
    values = random.permutation(int(end[-1])).astype(np.uint64)
    starts = [(t, i) for t in range(5) for i in range(first[t], end[t] - 5)]
    smallest = np.array([i + int(np.argmin(values[i : i + 6])) for _, i in starts])
    owner = np.array([t for t, _ in starts])
    text, left, centre, right = windows.compact_windows(values, first, end, smallest, owner)
    for t, i in starts:
        for k in range(i + 5, end[t]):
            c = i + int(np.argmin(values[i : k + 1]))
            assert sum((left <= i) & (centre == c) & (k <= right) & (text == t)) == 1


@given(st.lists(st.booleans(), max_size=40))
def test_stretches(shared):
    found = windows._stretches(np.array(shared, dtype=bool), 0.7)
    assert all(0 <= a < b <= len(shared) and shared[a] and shared[b - 1] for a, b in found)
    assert all(sum(shared[a:b]) >= 0.7 * (b - a) for a, b in found)
    assert all(b <= c for (_, b), (c, _) in zip(found, found[1:], strict=False))
    assert not any(shared[i] for i in range(len(shared)) if not any(a <= i < b for a, b in found)) or found


def test_repeated_passages_are_found(spark):
    """Passages of 60 words in other surroundings, exact or with a word changed, among texts that share nothing else."""
    random = np.random.default_rng(4)
    pool = [f"{a}{i}" for a in WORDS.split() for i in range(400)]

    def prose(n):
        return [str(word) for word in random.choice(pool, n)]

    passages = [prose(60) for _ in range(12)]
    rows, planted = [], set()
    for i in range(300):
        own = prose(int(random.integers(30, 250)))
        if i % 3 == 0:
            passage = list(passages[i // 3 % 12])
            if i >= 36 and i % 2:
                passage[30] = "changed"
            at = int(random.integers(0, len(own)))
            own[at:at] = passage
            if i >= 36:
                planted.add(i)
        rows.append((i, " ".join(own)))
    found = windows.passages(table(spark, rows)).collect()
    assert {row.doc_id for row in found} == planted
    texts = dict(rows)
    for row in found:
        assert row.of_doc < row.doc_id and row.similarity >= 0.8
        part = texts[row.doc_id].encode()[row.first_byte : row.end_byte].decode()
        assert part.split() == texts[row.doc_id].split()[row.first_word : row.end_word]
        assert sum(word in texts[row.of_doc].split() for word in part.split()) >= 0.8 * len(part.split())


def test_passages_with_more_partitions_than_windows(spark):
    """Windows of one min-hash meet wherever the ranges are cut."""
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(9)), shared, *(f"b{i}x{k}" for k in range(9))])) for i in range(8)]
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        found = windows.passages(table(spark, rows).repartition(8)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    whole = {row.doc_id for row in found if row.first_word <= 9 and row.end_word >= 69}
    assert whole == set(range(1, 8)) and all(row.of_doc < row.doc_id for row in found)


@pytest.mark.parametrize("hot", [16, 2])
def test_passages_around_a_line_that_all_documents_have(spark, monkeypatch, hot):
    """60 pairs share 60 words, 44 of which are a notice that all 600 documents have; in 30 pairs the notice is at an edge."""
    monkeypatch.setattr(windows, "HOT", hot)
    notice = " ".join(f"n{k}" for k in range(44))
    rows, pairs = [], {}
    for i in range(600):
        pair = i if i < 60 else i - 540 if i >= 540 else None
        before, after = (f"{mark}{i}" if pair is None else f"{mark}pair{pair}" for mark in "xy")
        n = 8 if (pair or 0) % 2 == 0 else 14
        body = [*(f"{before}w{k}" for k in range(n)), notice, *(f"{after}w{k}" for k in range(16 - n))]
        rows.append((i, " ".join([*(f"h{i}w{k}" for k in range(60)), *body, *(f"t{i}w{k}" for k in range(60))])))
        if i >= 540:
            pairs[i] = (pair, 60, 120)
    found = defaultdict(set)
    for row in windows.passages(table(spark, rows)).collect():
        found[row.doc_id].update(range(row.first_word, row.end_word))
        assert row.of_doc == pairs[row.doc_id][0]
    assert all(found[i].issuperset(range(a, b)) for i, (_, a, b) in pairs.items()) and len(found) == 60


def test_recall_of_near_passages(spark):
    """Passages of 60 words in which some words have changed, found by brute force to be alike to 0.8 or more: in texts of
    their own, and with a line of 20 words that most documents have."""
    random = np.random.default_rng(8)
    line = [f"line{k}" for k in range(20)]
    rows, planted = [], {}
    for i in range(600):
        own = [f"o{i}x{k}" for k in range(int(random.integers(60, 160)))]
        if i % 2 == 0:
            passage = [f"p{i // 4}x{k}" for k in range(60)]
            if i % 8 >= 4:
                passage[20:40] = line
            if i % 4 == 2:
                for at in random.choice(60, 1 + (i % 24 == 2), replace=False):
                    passage[at] = f"new{i}"
                plain = [f"p{i // 4}x{k}" if i % 8 < 4 or not 20 <= k < 40 else line[k - 20] for k in range(60)]
                pair = [[tuple(words_[j : j + 5]) for j in range(56)] for words_ in (plain, passage)]
                # The best of all passages of 50 words and more.
                for low, high in ((a, b) for a in range(11) for b in range(a + 46, 57)):
                    mine, theirs = (set(grams[low:high]) for grams in pair)
                    if len(mine & theirs) >= 0.8 * len(mine | theirs):
                        planted[i] = i - 2
            at = int(random.integers(0, len(own)))
            own[at:at] = passage
        else:
            own[30:30] = line
        rows.append((i, " ".join(own)))
    found = defaultdict(set)
    for row in windows.passages(table(spark, rows)).collect():
        found[row.doc_id].add(row.of_doc)
        assert row.similarity >= 0.8
    assert len(planted) > 100 and found.keys() <= planted.keys()
    recall = [np.mean([planted[i] in found[i] for i in planted if (i % 8 >= 4) == lined]) for lined in (False, True)]
    print("recall", recall)
    assert min(recall) >= 0.9


@pytest.mark.parametrize("holders", [8, 1])
def test_near_passages_around_a_line_that_all_documents_have(spark, monkeypatch, holders):
    """30 pairs share 60 words but one, and 44 of these are a notice that all 240 documents have."""
    monkeypatch.setattr(windows, "HOLDERS", holders)
    notice = [f"n{k}" for k in range(44)]
    rows, pairs = [], {}
    for i in range(240):
        pair = i if i < 30 else i - 210 if i >= 210 else None
        mark = f"own{i}" if pair is None else f"pair{pair}"
        own = list(notice)
        if i >= 210:
            own[(pair * 7) % 44] = f"new{i}"
            pairs[i] = pair
        body = [*(f"x{mark}w{k}" for k in range(8)), *own, *(f"y{mark}w{k}" for k in range(8))]
        rows.append((i, " ".join([*(f"h{i}w{k}" for k in range(60)), *body, *(f"t{i}w{k}" for k in range(60))])))
    found = defaultdict(set)
    for row in windows.passages(table(spark, rows)).collect():
        found[row.doc_id].update(range(row.first_word, row.end_word))
        assert row.similarity >= 0.8 and row.of_doc == pairs[row.doc_id]
    assert found.keys() == pairs.keys() and all(len(own & set(range(60, 120))) >= 50 for own in found.values())


@pytest.mark.parametrize("holders", [8, 2])
def test_passages_of_a_large_group_of_near_copies(spark, monkeypatch, holders):
    """All words that brute force finds, comparing each text with all earlier ones, when every min-hash is hot."""
    monkeypatch.setattr(windows, "HOT", 0)
    monkeypatch.setattr(windows, "HOLDERS", holders)
    random = np.random.default_rng(21)
    base = [f"b{k}" for k in range(150)]
    line = [f"line{k}" for k in range(12)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in random.choice(150, 5, replace=False):
            own[at] = f"new{i}x{at}" if at % 3 else f"alt{at}"
        if i % 4 == 0:
            del own[int(random.integers(0, 150)) :]
        if i % 3 == 0:
            at = int(random.integers(0, len(own) + 1))
            own[at:at] = line
        if i % 5 == 0:
            own += ["again"] * 60
        rows.append((i, " ".join([*(f"h{i}w{k}" for k in range(20)), *own])))
    wanted = {}
    hashes = [words_of(texts_of(pa.array([text])), LETTERS).hash for _, text in rows]
    for i, mine in enumerate(hashes):
        parts = [part for theirs in hashes[:i] for part in windows.similar_passages(mine, theirs, 50, 0.8)]
        known = {tuple(theirs[k : k + 5].tolist()) for theirs in hashes[:i] for k in range(len(theirs) - 4)}
        own = [k for k in range(len(mine) - 4) if tuple(mine[k : k + 5].tolist()) in known]
        wanted[i] = {k for k in own if any(a <= k and k + 5 <= b for a, b, *_ in parts)}
    found = defaultdict(set)
    for row in windows.passages(table(spark, rows)).collect():
        found[row.doc_id].update(range(row.first_word, row.end_word - 4))
    lost = {i: sorted(own - found[i]) for i, own in wanted.items() if own - found[i]}
    assert sum(map(len, wanted.values())) > 3000 and not lost


def test_holders_of_shingles(spark):
    """Whatever batches a shingle's rows are cut into, each row has the number of earlier documents and the first of them."""
    random = np.random.default_rng(12)
    rows = sorted({tuple(int(value) for value in row) for row in random.integers(0, [9, 40, 20], (3000, 3))})
    holders = defaultdict(dict)
    for shingle, num, start in rows:
        holders[shingle].setdefault(num, start)
    wanted = []
    for shingle, num, start in rows:
        of = [(n, s) for n, s in holders[shingle].items() if n < num]
        if of:
            wanted.append((num, start, shingle, len(of), [n for n, _ in of[:8]], [s for _, s in of[:8]]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = windows._held(spark.createDataFrame(rows, "shingle bigint, num bigint, start int")).collect()
        assert sorted(map(tuple, found)) == sorted(wanted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_first_of_the_starts_of_one_content(spark):
    """Whatever batches a content's rows are cut into, each row of a later document has the first of all."""
    random = np.random.default_rng(11)
    rows = sorted({tuple(int(value) for value in row) for row in random.integers(0, [40, 30, 2, 50], (3000, 4))})
    first = {}
    for content, *start in rows:
        first.setdefault(content, start)
    wanted = sorted((*start, *first[content]) for content, *start in rows if start[:2] != first[content][:2])
    starts = spark.createDataFrame(rows, "content bigint, place bigint, code bigint, start bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, windows._repeated(starts).collect())) == wanted
        assert str(windows._repeated(starts)._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_passage_with_a_changed_word_near_its_end():
    """43 shingles, five of a changed word, and three more: 46 of 51 shingles of either are in common."""
    theirs = np.arange(100, 200, dtype=np.uint64) * np.uint64(977)
    mine = np.arange(300, 400, dtype=np.uint64) * np.uint64(977)
    mine[20:75] = theirs[20:75]
    mine[67] = 5
    for a, b in ((mine, theirs), (mine[::-1].copy(), theirs[::-1].copy())):
        (found,) = windows.similar_passages(a, b, 50, 0.8)
        assert found[1] - found[0] == 55 and found[4] >= 0.8


def test_a_frequent_line_alone_asks_for_no_document():
    """A document that copies the first one and goes on with a line of all: of 3,000 with the line, only the one that has both is
    asked, and of those that have all of it only the first."""
    least, line = 46, np.arange(60, 69)
    body = np.arange(60)
    for whole in ([7], [7, 9, 11]):
        rows = [(place, num, place) for num in range(3000) for place in line] + [(place, num, place) for num in whole for place in body]
        start, of_num, of_start = np.array(rows).T
        found = windows._near_by(5000, start, of_num, of_start, start < 60, line, least)
        assert [(row[1], row[2]) for row in found] == [(68, 7)]


def test_a_word_changed_in_either_text_counts_in_both():
    """Two changed words in 78 shingles: 68 are common, ten are new, and ten others stand in the earlier text: 68 of 88. Without a
    word in their place they are 68 of 84."""
    start = np.array([*range(13, 60), *range(65, 74), *range(79, 91)])
    every, none = np.ones(len(start), dtype=bool), np.zeros(len(start), dtype=np.int64)
    assert windows._near_by(5, start, none, start + 7, every, start[-12:], 46) == []
    shorter = start - 2 * (start >= 65) - 2 * (start >= 79)
    assert [(row[1] >> 32, row[1] & 0xFFFFFFFF) for row in windows._near_by(5, start, none, shorter, every, start[-12:], 46)] == [(13, 90)]


def test_documents_of_a_group_ask_in_the_same_range(spark):
    """Ranges of those that ask keep the documents of a group together, and each document whole."""
    rows = [(shingle, num, shingle, 1, num // 100 * 100) for num in range(1000) for shingle in range(20)]
    rows = spark.createDataFrame(rows, "shingle bigint, num bigint, start bigint, kind int, head bigint")
    found = defaultdict(set)
    for row in windows._in_ranges(rows, 20_000, 4).distinct().collect():
        found[row.num].add(row.a)
    assert len(found) == 1000 and all(len(part) == 1 for part in found.values())
    assert {a for part in found.values() for a in part} == set(range(4))
    groups = defaultdict(set)
    for num, part in found.items():
        groups[num // 100] |= part
    assert sum(map(len, groups.values())) <= 10 + 3


def test_tables_of_the_steps_are_removed(spark):
    """What is left of the steps of the passages are the stretches to compare, of those of the groups the documents to drop."""
    rows = [(i, " ".join([*(f"h{i}w{k}" for k in range(20)), *(f"b{k}" if k != i else f"x{i}" for k in range(90))])) for i in range(30)]
    made = storage._made.setdefault(spark.sparkContext.applicationId, [])
    before = set(made)
    found = windows.passages(table(spark, rows))
    (folder,) = set(made) - before
    assert [path.name for path in Path(folder.removeprefix("file:")).iterdir()] == ["fragments"]
    assert {row.doc_id for row in found.collect()} == set(range(1, 30))
    before = set(made)
    kept = forest.one_of_each(table(spark, rows))
    (folder,) = set(made) - before
    assert [path.name for path in Path(folder.removeprefix("file:")).iterdir()] == ["dropped"]
    assert 0 in {row[0] for row in kept.collect()}


def test_equal_stretches_need_no_sets(monkeypatch):
    words_ = np.arange(70, dtype=np.uint64) * np.uint64(977)
    near = np.append(words_, np.uint64(5))
    assert windows.similar_passages(words_, near, 50, 0.8) == windows.similar_passages(words_, words_.copy(), 50, 0.8)
    monkeypatch.setattr(np, "unique", None)
    assert windows.similar_passages(words_, words_.copy(), 50, 0.8) == [(0, 70, 0, 70, 1.0)]


def test_passages_of_documents_without_id(spark):
    """Texts of equal CRC codes are told apart, and a passage that a text has twice is found both times."""
    texts = [PROSE, PROSE + " one more", "other words before " + PROSE]
    twice = " ".join(f"u{k}" for k in range(70))
    rows = [(None, text) for text in texts] + [(1, twice), (2, f"{twice} between {twice}"), (None, None), (None, "")]
    found = windows.passages(table(spark, rows)).collect()
    covered = {k for row in found if row.doc_id == 2 for k in range(row.first_word, row.end_word)}
    assert covered >= {*range(70), *range(71, 141)}
    assert sum(row.doc_id is None for row in found) == 2
    left = windows.without_passages(table(spark, rows)).collect()
    assert len(left) == len(rows) and sum(PROSE in (row[1] or "") for row in left) == 1


def test_exact_passages_of_the_documents(spark):
    """Of all 52-word windows that an earlier document has, nearly all lie in a passage; no clean document has any."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = defaultdict(set)
    for row in windows.passages(docs).collect():
        found[row.doc_id].update(range(row.first_word, row.end_word))
    seen, repeated, lost = set(), defaultdict(list), 0
    for row in sorted(docs.select("doc_id", "text").collect()):
        own = words(row.text)
        grams = [hash(tuple(own[i : i + 52])) for i in range(len(own) - 51)]
        repeated[row.doc_id] = [i for i, gram in enumerate(grams) if gram in seen]
        seen.update(grams)
    total = sum(map(len, repeated.values()))
    lost = sum(not found[doc_id].issuperset(range(i, i + 52)) for doc_id, starts in repeated.items() for i in starts)
    assert total > 10_000 and lost <= 0.001 * total
    assert all(found[doc_id] for doc_id, starts in repeated.items() if starts)


# The pipeline


def test_pipeline(spark):
    """Each stage on what the one before has kept, against what its operator says of it."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {row.doc_id: row for row in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def rows(df):
        found = {row.doc_id: row for row in df.collect()}
        return found, spark.createDataFrame(list(found.values()), docs.schema)

    good, kept = rows(stages["quality_rules"](spark, docs, sf_dir))
    for doc_id, row in before.items():
        own = row.text.split()
        count = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
        hit = {i + k for i in range(len(own) - 2) if count[tuple(own[i : i + 3])] > 1 for k in range(3)}
        assert doc_id not in good or (len(own) >= 50 and 2 * len(hit) <= len(own) and good[doc_id] == row)
    assert len(good) > 0.8 * len(before)

    firsts, kept = rows(stages["near_dedup"](spark, kept, sf_dir))
    sets = {i: set(zip(*(row.text.translate(UPPER).split()[k:] for k in range(5)), strict=False)) for i, row in good.items()}
    by_shingle = defaultdict(set)
    for i in sorted(firsts):
        near = Counter(j for shingle in sets[i] for j in by_shingle[shingle])
        assert not any(100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) for j, n in near.items())
        for shingle in sets[i]:
            by_shingle[shingle].add(i)
    for i in good.keys() - firsts.keys():
        near = Counter(j for j, own in sets.items() if j != i for _ in sets[i] & own)
        assert any(100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) for j, n in near.items())

    unique, kept = rows(stages["substring_dedup"](spark, kept, sf_dir))
    assert unique.keys() == firsts.keys()
    seen, repeats = set(), 0
    for i in sorted(unique):
        own = words(unique[i].text)
        grams = {tuple(own[k : k + 60]) for k in range(len(own) - 59)}
        repeats += bool(grams & seen)
        seen |= grams
        assert unique[i].n_chars == len(unique[i].text)
    assert repeats <= 0.01 * len(unique)

    clean, kept = rows(stages["decontamination"](spark, kept, sf_dir))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    phrases = {tuple(own[k : k + 10]) for own in map(words, (row.text for row in items)) for k in range(max(1, len(own) - 9))}
    changed = 0
    for i, row in unique.items():
        own = words(row.text)
        if phrases & {tuple(own[k : k + 10]) for k in range(len(own) - 9)}:
            assert len(clean[i].text) < len(row.text)
            changed += 1
        else:
            assert clean[i] == row
    assert changed > 0

    mix = stages["source_mixing"](spark, kept, sf_dir).collect()
    assert mix == sorted(mix, key=mix.index) and {row.doc_id for row in mix} <= clean.keys()
    total = sum(len(row.text.split()) for row in clean.values())
    assert sum(row.taken for row in mix) == pytest.approx(total, abs=64)
    for row in mix:
        assert row.text == clean[row.doc_id].text and 0 < row.taken <= 3 * row["size"]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() > 50 and {"doc_id", "text", "source", "taken"} <= set(rows.columns)


def test_decontaminated_text(spark, benchmark_items):
    item = benchmark_items.orderBy("item_id").first().text
    (row,) = removed(table(spark, [(1, f"before, {item} after")]), benchmark_items).collect()
    assert row.text.startswith("before, ") and row.text.endswith("after") and len(row.text) < 25
    assert row.n_chars == len(row.text)


# Ranges


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=12), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=30))
def test_ranges_are_in_order(bounds, rows):
    bounds = sorted(bounds)
    of = tuple(np.array([bound[k] for bound in bounds], dtype=np.int64) for k in (0, 1))
    a, b = (np.array([row[k] for row in rows], dtype=np.int64) for k in (0, 1))
    assert range_of(of, a, b).tolist() == [sum(bound <= row for bound in bounds) for row in rows]
