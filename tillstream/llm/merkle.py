"""A Merkle manifest of a dataset: one digest for each document, one for each source, one for all, and proofs.

The documents of a source, in the order of their ids, are the leaves of its tree. Every ARITY consecutive nodes make a run,
and the digest of a run's digests is their parent. A level is a table of nodes (tree, place, digest): the nodes in slot zero
look up the siblings of their run by computed places, in a join of the level with itself, and emit the parents. What a
source has at last is its subroot, and the subroots are the leaves of the top tree.

On the way down each node learns its path: the digests left and right of it in its run, then those of its parent's path. A
path is all that it takes to compute the root from a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm.numbering import numbered
from tillstream.llm.tables import fold, written
from tillstream.llm.text import pick

#: Nodes of a run.
ARITY = 16

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_PATH = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """The SHA-256 of the values one after the other, as hex text."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it goes into a digest: ``-`` for null, else its bytes' number, ``:``, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))


def siblings(place: Column, arity: int) -> Column:
    """The places of a node in slot zero and of its siblings."""
    if arity == 2:
        return F.array(place, place.bitwiseXOR(F.lit(1).cast("bigint")))
    return F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda slot: place + slot)


def _slot(arity: int) -> Column:
    return F.col("place") % arity


def _run(arity: int) -> Column:
    return F.expr(f"place div {arity}")


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """The runs of a level: tree, run, digests, and whether it is the tree's only node, its root."""
    zero = nodes.filter(_slot(arity) == 0)
    wanted = zero.select("tree", _run(arity).alias("run"), F.explode(siblings(F.col("place"), arity)).alias("place"))
    found = wanted.join(nodes.select("tree", "place", "digest"), ["tree", "place"])
    # At most ``arity`` rows a run.
    runs = found.groupBy("tree", "run").agg(F.sort_array(F.collect_list(F.struct("place", "digest")))["digest"].alias("digests"))
    return runs.withColumn("root", (F.col("run") == 0) & (F.size("digests") == 1))


def climbed(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level of all trees, from the leaves (tree, place, digest) up, and the roots (tree, digest)."""
    most = leaves.agg(F.max("place").alias("most")).first()["most"]
    n = 0 if most is None else most + 1
    levels, nodes = [], leaves
    while True:
        runs = written(_runs(nodes, arity), "runs")
        levels.append(runs)
        if n <= 1:
            break
        # A tree that has one node left has its root; it takes no part in further levels.
        nodes = runs.filter("not root").select("tree", F.col("run").alias("place"), digest(F.array_join("digests", "")).alias("digest"))
        n = -(-n // arity)
    roots = [runs.filter("root").select("tree", F.col("digests")[0].alias("digest")) for runs in levels]
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.unionAll(more)
    return levels, written(whole, "roots")


def _beside(arity: int) -> Column:
    """What is left and right of a node in the digests of its run, as the first element of a path."""
    slot = _slot(arity).cast("int")
    left, right = F.slice("digests", F.lit(1), slot), F.slice("digests", slot + 2, F.lit(arity))
    return F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))


def descended(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level's runs with the path of what each run makes: that of its parent, or of its tree's root, which
    ``tops`` gives (tree, path, and other columns, which go down unchanged)."""
    others = [name for name in tops.columns if name not in ("tree", "path")]
    above: DataFrame | None = None
    for level in reversed(range(len(levels))):
        runs = levels[level]
        whole = runs.filter("root").join(tops, "tree")
        if above is not None:
            parents = above.select("tree", F.col("place").alias("run"), "path", *others)
            whole = whole.unionByName(runs.filter("not root").join(parents, ["tree", "run"]))
        if level == 0:
            return whole
        whole = whole.select("*", F.posexplode("digests").alias("slot", "own"))
        whole = whole.withColumn("place", F.col("run") * arity + F.col("slot"))
        path = F.when(F.col("root"), F.col("path")).otherwise(F.concat(_beside(arity), "path"))
        above = written(whole.select("tree", "place", path.alias("path"), *others), "paths")
    raise AssertionError("a tree has a level")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda own, at: digest(at["left"], own, at["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path."""
    return digest(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""))


def _leaves(docs: DataFrame) -> DataFrame:
    """Per document its tree, its place there, its digest, and that of the text as it arrives after tampering."""
    rows = pick(docs, doc_id="bigint", source="string", lang="string", n_chars="bigint", text="string")
    # Null sources before all others; strings are compared by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    changed = F.when(fold(F.col("doc_id"), 5) == 0, leaf_digest(F.translate("text", _CAPITALS, _CAPITALS.lower())))
    rows = rows.select(tree.alias("tree"), "doc_id", leaf_digest(F.col("text")).alias("digest"), changed.alias("changed"))
    return numbered(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], "place")


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Per document its digest, its path, and what the path leads to: doc_id, leaf, path, subroot, root, and ``received``,
    the digest of the document as it is after tampering (else the same as ``leaf``).

    A document's digest is that of doc_id, source, lang, n_chars and text. Documents of a source stand in the order of
    their ids, null first, and of their digests where ids are equal; so rows that repeat a document are leaves of their own
    side by side. A null differs from an empty text. Sources stand in the order of their bytes, null, a source of its own,
    first. A source of one document has its digest as subroot. An empty table gives an empty one. Other columns are
    ignored, whatever their names.

    No step has more rows of a tree in one task than of any other: places are given by ranges, and a join's key is a run.
    """
    leaves = written(_leaves(docs), "leaves")
    levels, subroots = climbed(leaves.select("tree", "place", "digest"), arity)
    tops = written(numbered(subroots.withColumn("all", F.lit("")), "all", [F.col("tree")], "place"), "tops")
    top_levels, top = climbed(tops.select(F.col("all").alias("tree"), "place", "digest"), arity)
    start = top.select("tree", F.col("digest").alias("root_digest"), F.array().cast(_NO_PATH).alias("path"))
    at_top = descended(top_levels, start, arity).withColumnRenamed("tree", "all").withColumnRenamed("digests", "_digests")
    at_top = at_top.withColumnRenamed("_digests", "digests")
    rows = tops.withColumn("run", _run(arity)).join(at_top, ["all", "run"])
    path = F.when(F.col("root"), F.col("path")).otherwise(F.concat(_beside(arity), "path"))
    per_tree = rows.select("tree", path.alias("path"), F.col("digest").alias("subroot"), "root_digest")
    runs = descended(levels, written(per_tree, "tops"), arity)
    rows = leaves.withColumn("run", _run(arity)).join(runs, ["tree", "run"])
    return rows.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        path.alias("path"),
        "subroot",
        F.col("root_digest").alias("root"),
        F.coalesce("changed", "digest").alias("received"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """The manifest's rows with ``folded_root``, the root that the received document leads to, and whether it is the root."""
    rows = rows.withColumn("folded_root", folded(F.col("received"), F.col("path")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
