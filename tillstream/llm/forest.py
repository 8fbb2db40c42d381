"""Near-duplicate documents by an LSH forest of MinHash signatures, with every link confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm.components import components
from tillstream.llm.packing import pack, per_unpacked, unpack, whole_groups
from tillstream.llm.tables import content_key, free_shuffles, written
from tillstream.llm.text import PRINTED, Texts, Words, documents, mixed, per_piece, shingles_of, texts_of, words_of
from tillstream.storage import removed_after, run_folder

#: Words of a shingle, and the least percentage of shingles that linked documents have in common.
SHINGLE = 4
PERCENT = 80
#: Hash functions of a signature, trees, and hash values of a tree's key; trees draw their values from the signature.
HASHES = 128
TREES = 20
DEPTH = 8
#: Documents are compared in a tree if they agree in this many values, or in one for links under DEEP percent; with 20 trees
#: links under LEAST_PERCENT would be missed too often. At first it is with this many neighbours in the
#: tree's order; what that leaves apart is compared with all.
LEAST_DEPTH = 2
DEEP = 75
LEAST_PERCENT = 50
NEIGHBOURS = 256
#: Rows of a part of a region, of which two are compared by sketches at a time.
PART = 1024
#: Rows of a part of a clump, of which two are compared by their full sets: so few that small clumps are spread over tasks
#: too, and more in clumps of more than SPREAD parts. And how many shingles a part has at most, about.
SETS = 128
SPREAD = 16
SET_SHINGLES = 1 << 18
#: Bytes of text that are worked on together: less than elsewhere, to leave room in an executor.
PIECE = 1 << 20
#: With what probability the sketches of a link may agree in too few values for a candidate.
MISSED = 2e-7

_RANDOM = np.random.Generator(np.random.PCG64(11))
_FACTORS = _RANDOM.integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: How many of the two values of a byte are equal, by the exclusive or of the bytes.
_EQUAL = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], dtype=np.uint8)
_ORDERS = np.array([_RANDOM.permutation(HASHES)[:DEPTH] for _ in range(TREES)])


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct shingles, in order of text and hash. A text of fewer words has one shingle."""
    n = words.counts
    codes = shingles_of(words.hash, size)
    owner = words.text
    at = np.flatnonzero(owner[: len(codes)] == owner[len(owner) - len(codes) :]) if len(codes) else np.zeros(0, np.int64)
    owners, values = [owner[at]], [codes[at]]
    short = np.flatnonzero((n > 0) & (n < size))
    for count in range(1, size):
        some = short[n[short] == count]
        total = np.full(len(some), count, dtype=np.uint64)
        for place in range(count):
            total = mixed(total * np.uint64(31) + words.hash[words.first[some] + place])
        owners.append(some)
        values.append(total)
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[fresh], value[fresh]


def _signatures(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per set, the smallest hash value of each function (their upper halves)."""
    out = np.empty((len(begin), HASHES), dtype=">u4")
    for j, factor in enumerate(_FACTORS):
        out[:, j] = np.minimum.reduceat(value * factor, begin) >> np.uint64(32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    fixed = column.cast(pa.binary(width))
    data = np.frombuffer(fixed.buffers()[1], dtype=np.uint8)
    return data[fixed.offset * width : (fixed.offset + len(fixed)) * width].reshape(-1, width)


def keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).select("doc_id", "text", *content_key(F.col("text")))


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per document the key of its text, the size of its set, two hashes that tell sets apart, its signature, and the sketch
    of that, the low bits (both null for empty sets)."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(texts_of(piece.column("text"), lower=True), PRINTED)
        owner, value = shingle_sets(words, size)
        n = np.bincount(owner, minlength=len(piece))
        some = np.flatnonzero(n)
        begin = (np.cumsum(n) - n)[some]
        sums = np.zeros((2, len(piece)), dtype=np.uint64)
        signature: list[bytes | None] = [None] * len(piece)
        sketch: list[bytes | None] = [None] * len(piece)
        if len(some):
            sums[0, some] = np.add.reduceat(mixed(value), begin)
            sums[1, some] = np.add.reduceat(mixed(value ^ np.uint64(0x5DEECE66D)), begin)
            minima = _signatures(value, begin)
            low = (minima & 15).astype(np.uint8)
            for i, row, bits in zip(some.tolist(), minima, low[:, ::2] << 4 | low[:, 1::2], strict=True):
                signature[i], sketch[i] = row.tobytes(), bits.tobytes()
        return pa.RecordBatch.from_arrays(
            [
                *(piece.column(name) for name in ("doc_id", "key_a", "key_b")),
                pa.array(n.astype(np.int64)),
                pa.array(sums[0].view(np.int64)),
                pa.array(sums[1].view(np.int64)),
                pa.array(signature, pa.binary()),
                pa.array(sketch, pa.binary()),
            ],
            ["doc_id", "key_a", "key_b", "n_shingles", "set_a", "set_b", "signature", "sketch"],
        )

    numbers = ", ".join(f"{name} bigint" for name in ("doc_id", "key_a", "key_b", "n_shingles", "set_a", "set_b"))
    return per_piece(keyed(docs), work, f"{numbers}, signature binary, sketch binary", PIECE)


def _trees(nodes: DataFrame) -> DataFrame:
    """Each node once per tree, with its key there, its sketch, and its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = _matrix(batch.column("signature"), 4 * HASHES).reshape(-1, HASHES, 4)
            for tree, order in enumerate(_ORDERS):
                key = _binary(signature[:, order].reshape(-1, 4 * DEPTH))
                where = pa.array(np.full(len(batch), tree), pa.int32())
                columns = [batch.column(name) for name in ("node", "n_shingles", "sketch", "component")]
                yield pa.RecordBatch.from_arrays([where, key, *columns], ["tree", "key", "node", "n", "sketch", "component"])

    return nodes.mapInArrow(run, "tree int, key binary, node bigint, n bigint, sketch binary, component bigint")


@cache
def least_agreement(percent: int) -> int:
    """Pairs whose sketches agree in fewer values are no candidates.

    Sketches have four bits of each value, so that one in sixteen different values agrees too: a pair at 80 % agrees in 104
    of 128 on average, and in fewer than 80 with a probability of 1 in 10 million.
    """
    same = percent / 100 + (1 - percent / 100) / 16
    total = 0.0
    for agree in range(HASHES):
        total += comb(HASHES, agree) * same**agree * (1 - same) ** (HASHES - agree)
        if total > MISSED:
            return agree
    return HASHES


def _depth(percent: int) -> int:
    return LEAST_DEPTH if percent >= DEEP else 1


def _alike(
    at: np.ndarray, other: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows whose sizes and sketches allow a link, and in how many values their sketches agree."""
    # Sets of too different sizes cannot reach the percentage.
    fits = 100 * np.minimum(n[at], n[other]) >= percent * np.maximum(n[at], n[other])
    at, other = at[fits], other[fits]
    agree = _EQUAL[sketch[at] ^ sketch[other]].sum(axis=1, dtype=np.int64)
    good = agree >= least_agreement(percent)
    return at[good], other[good], agree[good]


def _near(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among rows in order of tree and key: pairs of nodes, and in how many values their sketches agree.

    A row is compared with the rows before it as far as their keys agree in LEAST_DEPTH values, and at most NEIGHBOURS
    of them: in a dense region these are the ones with the longest common prefix, so the depth follows the density. Of
    the rows that pass, the one that agrees best is taken, and the one of the smallest number.
    """
    tree = batch.column("tree").to_numpy()
    key = _matrix(batch.column("key"), 4 * DEPTH)
    prefix = np.ascontiguousarray(key[:, : 4 * _depth(percent)]).view(np.uint32).reshape(len(key), -1)
    node = batch.column("node").to_numpy()
    n = batch.column("n").to_numpy()
    sketch = _matrix(batch.column("sketch"), HASHES // 2)
    active = np.arange(len(node))
    parts = []
    for shift in range(1, NEIGHBOURS + 1):
        # In sorted rows, who differs from the row at a distance differs from those farther away.
        active = active[active >= shift]
        active = active[(prefix[active] == prefix[active - shift]).all(axis=1) & (tree[active] == tree[active - shift])]
        if not len(active):
            break
        parts.append(_alike(active, active - shift, n, sketch, percent))
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 3
    at, other, agree = (np.concatenate(column) for column in zip(*parts, strict=True))
    chosen = np.zeros(len(at), dtype=bool)
    for rank in (-agree, node[other]):
        order = np.lexsort((rank, at))
        begin = np.searchsorted(at[order], at[order])
        chosen[order[np.arange(len(order)) == begin]] = True
    return node[at[chosen]], node[other[chosen]], agree[chosen]


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of nodes that are near each other in some tree's order, with the agreement of their signatures.

    All trees are sorted together by ranges, so that a dense region is split over tasks like any other. These pairs are a
    start, by which most of a group is joined; ``_between`` finds all links that are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: pa.RecordBatch | None = None
        for batch in batches:
            # The last rows of a batch are compared with the first ones of the next.
            rows = batch if ahead is None else pa.concat_batches([ahead, batch])
            a, b, agree = _near(rows, percent)
            ahead = rows.slice(max(0, len(rows) - NEIGHBOURS))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), agree]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(row) for row in pairs], ["a", "b", "agree"])

    trees = _trees(nodes.withColumn("component", F.col("node"))).drop("component")
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = trees.repartitionByRange(partitions, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return rows.mapInArrow(run, "a bigint, b bigint, agree bigint").distinct()


class _Sets:
    """Numbers 0 .. n - 1 in disjoint sets."""

    def __init__(self, n: int):
        self._above = list(range(n))
        self.roots = np.arange(n)

    def _root(self, i: int) -> int:
        above = self._above
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join the sets of each pair; which of the pairs joined two sets that were not joined before."""
        done = np.zeros(len(a), dtype=bool)
        for i in np.flatnonzero(self.roots[a] != self.roots[b]).tolist():
            low, high = sorted((self._root(int(a[i])), self._root(int(b[i]))))
            if low != high:
                self._above[high] = low
                done[i] = True
        if done.any():
            self.roots = np.array(self._above)
            while not np.array_equal(up := self.roots[self.roots], self.roots):
                self.roots = up
        return done


def _alike_nodes(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes in the cells (region, i, j), those whose sketches allow a link with a node of another component in the
    cell, each with the first of all nodes that such pairs connect it with."""
    head = np.ones(len(batch), dtype=bool)
    for key in ("region", "i", "j"):
        column = batch.column(key).to_numpy()
        head[1:] &= column[1:] == column[:-1]
    head[1:] = ~head[1:]
    cell = np.cumsum(head)
    inner = batch.column("i").to_numpy() == batch.column("j").to_numpy()
    part, node, n, component = (batch.column(name).to_numpy() for name in ("part", "node", "n", "component"))
    sketch = _matrix(batch.column("sketch"), HASHES // 2)
    sets = _Sets(len(node))
    active = np.arange(len(node))
    for shift in range(1, len(node)):
        active = active[active >= shift]
        active = active[cell[active] == cell[active - shift]]
        if not len(active):
            break
        other = active - shift
        apart = (component[active] != component[other]) & (inner[active] | (part[active] != part[other]))
        # Nodes that are connected already add nothing.
        apart &= sets.roots[active] != sets.roots[other]
        at, other, _ = _alike(active[apart], other[apart], n, sketch, percent)
        sets.join(at, other)
    some = np.flatnonzero(sets.roots != np.arange(len(node)))
    return node[some], node[sets.roots[some]]


def _cells(rows: DataFrame, group: str, small: Column, own: Column, parts: Column, rest: Column) -> DataFrame:
    """The rows of each group in parts, and once in each cell of two parts: i, j and part.

    Rows that are ``own`` go to the first ``parts`` parts, which are not compared with each other, the others to the ``rest``
    behind them. A ``small`` group is one cell.
    """
    spread = F.xxhash64("node")
    part = F.when(small, 0).when(own, F.pmod(spread, parts)).otherwise(parts + F.pmod(spread, rest))
    rows = rows.withColumn("part", part.cast("bigint"))
    part = F.col("part")
    cells = (
        F.when(small, F.array(F.struct(part.alias("i"), part.alias("j"))))
        .when(own, F.transform(F.sequence(parts, parts + rest - 1), lambda j: F.struct(part.alias("i"), j.alias("j"))))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), parts + rest - 1),
                lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j")),
            )
        )
    )
    return rows.withColumn("cell", F.explode(cells)).select(group, "cell.i", "cell.j", "part", "node", "n", "component", "sketch")


def _clumps(nodes: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """The nodes that may have a link with a node of another component, with their component, and so that all such links are
    within a clump: node, component, clump.

    A region is what agrees in the first values of a tree's keys. Only regions of several components are looked at. A large
    one is cut into parts, those of its most frequent component and those of the rest, and every two parts that are not
    both of the former meet in a cell; so no task has a whole region, and a large group is not compared with itself. A
    cell gives a row for each of its nodes at most, and no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["region", "i", "j"]):
            yield pa.RecordBatch.from_arrays([pa.array(ends) for ends in _alike_nodes(group, percent)], ["a", "b"])

    region = F.xxhash64("tree", F.substring("key", 1, 4 * _depth(percent)))
    trees = _trees(nodes.join(named, "node")).select(region.alias("region"), "node", "n", "sketch", "component")
    counts = trees.groupBy("region", "component").agg(F.count("*").alias("n"))
    counts = counts.groupBy("region").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components")
    )
    several = written(counts.filter("components > 1").select("region", "total", "most"))
    # Merged at any size: there may be as many such regions as nodes.
    rows = trees.join(several.hint("merge"), "region")
    parts, rest = F.ceil(F.col("most.n") / PART), F.ceil((F.col("total") - F.col("most.n")) / PART)
    rows = _cells(rows, "region", F.col("total") <= PART, F.col("component") == F.col("most.component"), parts, rest)
    rows = rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "node")
    clumps = components(rows.mapInArrow(run, "a bigint, b bigint"))
    return written(clumps.withColumnRenamed("component", "clump").join(named, "node"))


def _linked_components(batch: pa.RecordBatch, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the components of a cell's nodes, confirmed on the full sets; one for each two that it joins."""
    inner = batch.column("i")[0] == batch.column("j")[0]
    part, n, component = (batch.column(name).to_numpy() for name in ("part", "n", "component"))
    sketch = _matrix(batch.column("sketch"), HASHES // 2)
    _, values = shingle_sets(words_of(unpack(batch.column("packed").to_pylist()), PRINTED), size)
    # Shingles as small numbers, so that a set can be marked in a table.
    distinct, shingle = np.unique(values, return_inverse=True)
    marked = np.zeros(len(distinct), dtype=bool)
    end = np.cumsum(n)
    names, name = np.unique(component, return_inverse=True)
    sets = _Sets(len(names))
    links: list[np.ndarray] = []
    for i in range(1, len(n)):
        own = sets.roots[name]
        other = np.flatnonzero((own[:i] != own[i]) & (inner or part[:i] != part[i]))
        _, other, _ = _alike(np.full(len(other), i), other, n, sketch, percent)
        if not len(other):
            continue
        mine = shingle[end[i] - n[i] : end[i]]
        marked[mine] = True
        counts = n[other]
        begin = np.cumsum(counts) - counts
        at = np.arange(int(counts.sum())) + np.repeat(end[other] - counts - begin, counts)
        common = np.add.reduceat(marked[shingle[at]], begin, dtype=np.int64)
        marked[mine] = False
        linked = other[100 * common >= percent * (n[i] + counts - common)]
        pairs = np.stack([np.full(len(linked), name[i]), name[linked]])
        links.append(pairs[:, sets.join(*pairs)])
    pairs = np.concatenate(links, axis=1) if links else np.zeros((2, 0), dtype=np.int64)
    return names[pairs[0]], names[pairs[1]]


def _between(docs: DataFrame, nodes: DataFrame, named: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components: all components that confirmed links connect are connected by these.

    All pairs of nodes of different components that agree in LEAST_DEPTH values of some tree, and whose sizes and sketches
    allow a link, are in a clump; there their full sets are compared, in cells of two parts of a clump. A cell joins the
    components that it finds linked on the spot, and gives a row for each two that it has joined, so a component less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["clump", "i", "j"]):
            yield pa.RecordBatch.from_arrays([pa.array(ends) for ends in _linked_components(group, size, percent)], ["a", "b"])

    clumps = _clumps(nodes, named, percent)
    rows = clumps.join(nodes.select("node", F.col("n_shingles").alias("n"), "sketch"), "node")
    sums = rows.groupBy("clump").agg(F.count("*").alias("total"), F.sum("n").alias("sum"))
    parts = F.greatest(
        F.least(F.ceil(F.col("total") / SETS), F.lit(SPREAD)),
        F.ceil(F.col("total") / PART),
        F.ceil(F.col("sum") / SET_SHINGLES),
    )
    none = F.lit(0).cast("bigint")
    rows = _cells(rows.join(sums, "clump"), "clump", parts <= 1, F.lit(False), none, parts)
    missing = written(clumps.select("node").join(texts.select("node"), "node", "left_anti"))
    if not missing.isEmpty():
        texts = texts.unionAll(_texts(docs, nodes.join(missing, "node"), few=True))
    keys = ["clump", "i", "j"]
    rows = rows.join(texts.drop("size"), "node").repartitionByRange(*keys).sortWithinPartitions(*keys, "node")
    return written(rows.mapInArrow(run, "a bigint, b bigint"))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have at least ``percent`` percent of their shingles in common."""

    def work(piece: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        sets = []
        for own in (texts, unpack(piece.column("other").to_pylist())):
            owner, value = shingle_sets(words_of(own, PRINTED), size)
            sets.append((value, np.searchsorted(owner, np.arange(len(piece) + 1))))
        (left, first_left), (right, first_right) = sets
        linked = np.zeros(len(piece), dtype=bool)
        for i in range(len(piece)):
            mine, theirs = left[first_left[i] : first_left[i + 1]], right[first_right[i] : first_right[i + 1]]
            common = len(np.intersect1d(mine, theirs, assume_unique=True))
            linked[i] = 100 * common >= percent * (len(mine) + len(theirs) - common)
        return piece.select(["a", "b"]).filter(pa.array(linked))

    first = texts.withColumnRenamed("node", "a")
    second = texts.select(F.col("node").alias("b"), F.col("packed").alias("other"))
    rows = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "size", "packed", "other")
    # Rows carry two texts, so pieces are half as long.
    return per_unpacked(rows, work, "a bigint, b bigint", PIECE // 2)


def _texts(docs: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """The text of each of the nodes in lower case, compressed, found by id and key. Compressed texts are shorter than the
    hashes of their shingles. ``few``: where the nodes may be so few that Spark finds a better join than by merging."""
    keys = ["doc_id", "key_a", "key_b"]

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(piece.column("text"), lower=True)
        columns = [pa.array(np.diff(texts.offset)), pack(texts.raw(i) for i in range(len(texts)))]
        return pa.RecordBatch.from_arrays([*(piece.column(key) for key in keys), *columns], [*keys, "size", "packed"])

    packed = per_piece(keyed(docs), work, "doc_id bigint, key_a bigint, key_b bigint, size bigint, packed binary", PIECE)
    wanted = written(nodes.select("node", *(f"first.{key}" for key in keys)))
    # Else merged at any size: there may be as many nodes as documents. Rows that repeat a document are in one place then.
    rows = packed.join(wanted if few else wanted.hint("merge"), keys).groupBy(*keys, "node")
    return written(rows.agg(F.first("size").alias("size"), F.first("packed").alias("packed")).drop(*keys))


def _tried(candidates: DataFrame, percent: int) -> DataFrame:
    """Of each node's candidates the one that agrees best, and the one of the smallest number of those that agree enough."""
    sides = candidates.select("a", "b", F.explode(F.array("a", "b")).alias("of"), "agree")
    low = F.when(F.col("agree") >= HASHES * percent // 100, 0).otherwise(1)
    own = sides.groupBy("of").agg(
        F.min(F.struct((-F.col("agree")).alias("rank"), "a", "b")).alias("best"),
        F.min(F.struct(low.alias("rank"), "a", "b")).alias("least"),
    )
    return written(own.select(F.explode(F.array("best", "least")).alias("pair")).select("pair.a", "pair.b").distinct())


def _labelled(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The nodes with the component they are in, under confirmed links.

    First each node is compared with its best candidate and with its smallest one, which joins most of a large group
    into one component; then all that are in different components and may be linked are compared.
    """
    candidates = written(_candidates(nodes, percent))
    ends = candidates.select(F.col("a").alias("node")).unionAll(candidates.select("b")).distinct()
    texts = _texts(docs, nodes.join(ends, "node"))
    labels = components(_confirmed(_tried(candidates, percent), texts, size, percent))
    named = nodes.select("node").join(labels, "node", "left")
    named = written(named.select("node", F.coalesce("component", "node").alias("component")))
    free_shuffles(docs.sparkSession)
    merged = components(_between(docs, nodes, named, texts, size, percent))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = named.join(merged, "component", "left")
    return written(named.select("node", F.coalesce("whole", "component").alias("component")))


def _classed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document its key, the size of its set, and its component's first document, by id and key, as ``first``; null for
    a document that is no node."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"links under {LEAST_PERCENT} % are not found reliably, so {percent} is refused")
    meta = written(signatures(docs, size))
    sets = meta.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
    sets = sets.agg(
        F.min(F.struct("doc_id", "key_a", "key_b")).alias("first"),
        F.first("signature").alias("signature"),
        F.first("sketch").alias("sketch"),
    )
    # Numbers that are written once, and name a set whatever ids its documents have.
    nodes = written(sets.withColumn("node", F.monotonically_increasing_id()))
    labels = _labelled(docs, nodes, size, percent)
    free_shuffles(docs.sparkSession)
    named = nodes.select("set_a", "set_b", "n_shingles", "node", "first").join(labels, "node")
    named = written(named)
    firsts = written(named.groupBy("component").agg(F.min("first").alias("first")))
    named = named.drop("first", "node").join(firsts, "component").drop("component")
    rows = meta.drop("signature", "sketch").withColumn("known", F.col("doc_id").isNotNull())
    named = written(named.withColumn("known", F.lit(True)))
    return rows.join(named, ["set_a", "set_b", "n_shingles", "known"], "left").drop("set_a", "set_b", "known")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document the size of its shingle set and the smallest doc_id reachable over links: doc_id, n_shingles,
    component_id, kept.

    Documents with equal sets are one node. The nodes' MinHash signatures are sorted in several orders; neighbours there
    with long common prefixes and like signatures are candidates; links are confirmed on the full sets of shingles. Then
    all nodes of different components that share the beginning of a key are compared too, however many they are.

    One row per row. Null and empty texts have an empty set and are linked with nothing. A row without doc_id is linked with
    nothing, has no component, and is kept. Rows that share a doc_id are documents of their own: each is in the component of
    its text. An empty table gives an empty one. A ``percent`` under LEAST_PERCENT is refused. Other columns are ignored.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == own)
    return _classed(docs, size, percent).select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that are the first of their group, with all their columns.

    The first is the one of the smallest doc_id, and of the smallest key of its text where ids are equal. So each group keeps
    a document, also where an id has several texts. Rows without doc_id, and null and empty texts, stay. Rows that repeat
    id and text are one document and stay together. An empty table gives an empty one. Other columns may have any names.
    """
    own = F.struct("doc_id", "key_a", "key_b")
    folder = run_folder(docs.sparkSession)
    with removed_after(docs.sparkSession):
        dropped = _classed(docs, size, percent).filter(F.col("first").isNotNull() & (F.col("first") != own))
        dropped = written(dropped.select("doc_id", "key_a", "key_b").distinct(), "dropped", folder)
    free_shuffles(docs.sparkSession)
    names = [f"_{i}" for i in range(len(docs.columns))]
    at, text = (names[docs.columns.index(name)] for name in ("doc_id", "text"))
    key_a, key_b = content_key(F.col(text).cast("string"))
    inner = docs.toDF(*names).withColumn("_key_a", key_a).withColumn("_key_b", key_b)
    same = (
        (inner[at].cast("bigint") == dropped["doc_id"])
        & (inner["_key_a"] == dropped["key_a"])
        & (inner["_key_b"] == dropped["key_b"])
    )
    return inner.join(dropped, same, "left_anti").select(*names).toDF(*docs.columns)
