"""A Merkle manifest of a dataset: one tree per value of a column, a tree over their roots, multiproofs.

Rows hash to leaves in the JVM. Leaves are numbered inside their tree by a range sort and the sizes of its partitions, so no tree
passes through one task. A block of 2**bits neighbouring leaves folds to its top in one task, the tops of neighbouring blocks fold
in the next round, and so on; every node (tree, level, index) is one row of the written manifest.

``prove`` builds octopus multiproofs. A leaf partition is the wanted leaves of one block. It lists the minimal union of node coordinates
that its leaves' paths need and its leaves cannot give, fetches those once by a join with the manifest, derives the shared interior
nodes from them, and expands the single proofs locally. The coordinates go on into the tree of the roots.

Nodes: H is the lower-case hex SHA-256 of concatenated inputs. Every two consecutive nodes become their H; a last odd node becomes its own H.
A tree of one leaf has that leaf as its root.

Defined cases: a null value hashes as ``-``; a null tree value is a tree of its own and comes first; null ids come first in a
tree; rows of equal id follow each other by leaf, and equal rows are leaves of their own; empty tables give no rows; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.tables import materialize

BITS = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: the tree over all other trees; the others are "" for null and "=" with their value
TOP = "@"


def field(value: Column) -> Column:
    """UTF-8 byte count, colon and value, or a dash for null; an empty value stays apart from a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves."""
    return (size - 1).bit_length()


def numbered(leaves: DataFrame) -> DataFrame:
    """Adds pos and size: a leaf's place in its tree and that tree's leaves. Leaves have tree, id, leaf, row and more."""
    order = ["tree", "id", "leaf", "row"]
    ordered = materialize(
        leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "ordered-leaves").withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return (
        ordered.join(starts, ["tree", "part"])
        .withColumn("pos", F.col("start") + F.col("at") - F.col("first")).drop("at", "part", "first", "start"))


def folded(level: list[str]) -> list[str]:
    return [h(*level[i : i + 2]) for i in range(0, len(level), 2)]


def tree_nodes(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """(tree, level, index, digest, top) of every node; leaves have tree, pos, leaf, size."""

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        tree, size, base, first = (rows.column(c)[0].as_py() for c in ("tree", "size", "base", "pos"))
        nodes, found = rows.column("digest").to_pylist(), []
        for up in range(bits + 1):
            found += [(base + up, (first >> up) + i, d, size == 1) for i, d in enumerate(nodes) if up or not base]
            if size == 1:
                break
            nodes, size = folded(nodes), (size + 1) // 2
        level, index, digest, top = zip(*found) if found else ((), (), (), ())
        return pa.table({
            "tree": pa.array([tree] * len(found), pa.string()), "level": pa.array(level, pa.int32()),
            "index": pa.array(index, pa.int64()), "digest": pa.array(digest, pa.string()), "top": pa.array(top, pa.bool_())})

    schema = "tree string, level int, index long, digest string, top boolean"
    longest = leaves.agg(F.max("size")).first()[0] or 0
    current = leaves.select("tree", "pos", F.col("leaf").alias("digest"), "size", F.lit(0).alias("base"))
    rounds = []
    for r in range(max(1, -(-height(max(1, longest)) // bits))):
        made = (
            current.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block").applyInArrow(fold, schema))
        rounds.append(materialize(made, "manifest-nodes"))
        # what a block has left stands in for the next round's leaves
        sizes = current.select("tree", "size").distinct().filter(F.col("size") > 1 << bits)
        current = rounds[-1].filter(F.col("level") == (r + 1) * bits).join(sizes, "tree").select(
            "tree", F.col("index").alias("pos"), "digest",
            F.ceil(F.col("size") / F.lit(1 << bits)).cast("long").alias("size"), F.lit((r + 1) * bits).alias("base"))
    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def manifest(leaves: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The numbered leaves with their trees' places (rank, trees), and all nodes; leaves have tree, id, leaf, row and more."""
    own = materialize(numbered(leaves), "numbered-leaves")
    nodes = tree_nodes(own, bits)
    roots = materialize(numbered(nodes.filter("top").select(
        F.lit(TOP).alias("tree"), F.col("tree").alias("id"), F.col("digest").alias("leaf"), F.lit(0).alias("row"))), "roots")
    places = roots.select(F.col("id").alias("tree"), F.col("pos").alias("rank"), F.col("size").alias("trees"))
    # one row per (tree, block) meets the places first, so that a large tree is not one join key
    blocks = own.select("tree", F.shiftright("pos", bits).alias("block")).distinct().join(places, "tree")
    placed = own.withColumn("block", F.shiftright("pos", bits)).join(blocks, ["tree", "block"])
    return placed, nodes.unionByName(tree_nodes(roots, bits))


def missing(known: Iterable[int], size: int) -> list[tuple[int, int]]:
    """The fewest (level, index) that, with the known leaves, give all of their paths."""
    known, level, out = set(known), 0, []
    while size > 1:
        out += [(level, p ^ 1) for p in sorted(known) if p ^ 1 not in known and p ^ 1 < size]
        known, size, level = {p >> 1 for p in known}, (size + 1) // 2, level + 1
    return out


def derived(nodes: dict[tuple[int, int], str], known: Iterable[int], size: int) -> str:
    """Adds the interior nodes above the known leaves; the root."""
    known, level = sorted(set(known)), 0
    while size > 1:
        above = sorted({p >> 1 for p in known})
        for p in above:
            pair = [nodes[level, q] for q in (2 * p, 2 * p + 1) if q < size]
            nodes[level + 1, p] = h(*pair)
        known, size, level = above, (size + 1) // 2, level + 1
    return nodes[level, 0]


def path(nodes: dict[tuple[int, int], str], pos: int, size: int) -> list[tuple[str, bool]]:
    """The siblings of a leaf from below, and whether each stands to the left; an empty digest where there is none."""
    out, level = [], 0
    while size > 1:
        other = pos ^ 1
        out.append((nodes[level, other] if other < size else "", bool(pos & 1)))
        pos, size, level = pos >> 1, (size + 1) // 2, level + 1
    return out


def fold_path(leaf: str, steps: list[tuple[str, bool]]) -> str:
    for other, left in steps:
        leaf = h(other, leaf) if left else h(leaf, other)
    return leaf


def prove(wanted: DataFrame, nodes: DataFrame, expand: Callable[[pa.Table, list[str], list[list]], dict], schema: str) -> DataFrame:
    """Expand the proofs of the wanted leaves, rows of ``manifest`` or some of them.

    ``expand`` gets a leaf partition's rows, each row's subroot and root, and its steps.
    """

    def request(rows: pa.Table) -> pa.Table:
        tree, block, size, rank, trees = (rows.column(c)[0].as_py() for c in ("tree", "block", "size", "rank", "trees"))
        need = [(tree, *x) for x in missing(rows.column("pos").to_pylist(), size)]
        need += [(TOP, *x) for x in missing([rank], trees)]
        names, level, index = zip(*need) if need else ((), (), ())
        return pa.table({
            "own": pa.array([tree] * len(need), pa.string()), "block": pa.array([block] * len(need), pa.int64()),
            "tree": pa.array(names, pa.string()), "level": pa.array(level, pa.int32()), "index": pa.array(index, pa.int64())})

    coordinates = wanted.select("tree", "block", "pos", "size", "rank", "trees").groupBy("tree", "block").applyInArrow(
        request, "own string, block long, tree string, level int, index long")
    fetched = coordinates.join(nodes.drop("top"), ["tree", "level", "index"])

    def local(rows: pa.Table, given: pa.Table) -> pa.Table:
        got = list(zip(*(given.column(c).to_pylist() for c in ("tree", "level", "index", "digest"))))
        own = {(level, index): d for tree, level, index, d in got if tree != TOP}
        top = {(level, index): d for tree, level, index, d in got if tree == TOP}
        positions = rows.column("pos").to_pylist()
        size, rank, trees = (rows.column(c)[0].as_py() for c in ("size", "rank", "trees"))
        own.update({(0, p): d for p, d in zip(positions, rows.column("leaf").to_pylist())})
        top[0, rank] = subroot = derived(own, positions, size)
        root, end = derived(top, [rank], trees), path(top, rank, trees)
        return pa.table(expand(rows, [subroot, root], [path(own, p, size) + end for p in positions]))

    return wanted.groupBy("tree", "block").cogroup(fetched.groupBy("own", "block")).applyInArrow(local, schema)


def verified_manifest(
    docs: DataFrame, tampered: Column, id_col: str = "doc_id", tree_col: str = "lang", number_col: str = "n_chars",
    columns: Iterable[str] = COLUMNS, bits: int = BITS,
) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where ``tampered`` holds, the proof is tried on a leaf whose ``number_col`` is one more; ``verified`` tells whether the
    folded proof gives the root.
    """
    more = {c: docs[c] for c in columns}
    changed = {**more, number_col: (docs[number_col].cast("decimal(38,0)") + 1)}
    leaves = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"),
        F.coalesce(F.concat(F.lit("="), docs[tree_col].cast("string")), F.lit("")).alias("tree"),
        leaf_hash(more.values()).alias("leaf"),
        F.when(tampered & docs[number_col].isNotNull(), leaf_hash(changed.values())).alias("tried")), "leaves")
    wanted, nodes = manifest(leaves, bits)
    kind = leaves.schema["id"].dataType.simpleString()

    def expand(rows: pa.Table, roots: list[str], steps: list[list]) -> dict:
        leaf = rows.column("leaf").to_pylist()
        ends = [fold_path(tried or own, s) for own, tried, s in zip(leaf, rows.column("tried").to_pylist(), steps)]
        return {"id": rows.column("id"), "leaf": leaf, "subroot": [roots[0]] * len(leaf), "root": [roots[1]] * len(leaf),
                "proof_sha256": [h(*(d for d, _ in s)) for s in steps], "folded_root": ends,
                "verified": [end == roots[1] for end in ends]}

    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return prove(wanted, nodes, expand, schema).withColumnRenamed("id", id_col)
