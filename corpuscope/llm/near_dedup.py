"""Near-duplicate detection by an inverted join of MinHash signature coordinates.

A document is the set of its distinct word shingles; documents with the same set are one class and go on
as one row. A class has ``COORDINATES`` minima. Two sets of Jaccard
similarity s agree in each coordinate with probability s; pairs with at least ``MATCHES`` agreements are candidates.
The coordinates stand in MATCHES - 1 groups, so two classes with that many agreements have two of them in one group: a class is
posted under every two (coordinate, value) pairs of a group. Lists of single pairs would hold texts that share no more than a common
shingle, and grow with the square of the corpus. Prefix: nothing but these meetings is merged. Skip: all other agreements
are counted on the two signatures. At 0.8, fewer than 12 of 32 coordinates agree with probability 2e-8.

Shingles are compared by 48-bit hashes, which may add a shingle to an intersection but take none away. Candidates are
confirmed on full sets. A list of up to SMALL classes is taken whole. A longer one is not
turned into all its pairs: first the class that most long lists hold meets the others; afterwards the lists that still
hold several components are compared block by block in numpy, and only links become rows, so nothing that could
join two components is left out.
Components are found by alternating large-star and small-star steps on written tables.

Defined cases: null and empty texts have an empty set, are linked with nothing and are kept; texts of fewer words than a
shingle are one shingle; null ids come last; rows of equal id are linked by their texts as any
others; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpuscope.llm.tables import fresh_names, materialize, replaced
from corpuscope.llm.text import LOWER, NOT_SPACE, Words, mix, pack, pieces, unpack, utf8, windows

U64 = np.uint64
COORDINATES = 32
MATCHES = 12
#: the coordinates that are posted together: every two of each of MATCHES - 1 groups
MEETINGS = [
    (i, j) for g in range(MATCHES - 1) for i in range(g, COORDINATES, MATCHES - 1) for j in range(i + MATCHES - 1, COORDINATES, MATCHES - 1)]
#: bits of a list's number that hold the hash of the two values; the meeting stands above them
HASH_BITS = 57
MISSED = 1e-6  # the largest probability with which a link may be missed
SMALL = 8
#: what one task compares: two blocks of at most so many classes, of about so many bytes of sets, by so many shingles at once
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 32 << 20, 2048
_FACTORS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64))
MULTIPLY, ADD = _FACTORS[:COORDINATES] | U64(1), _FACTORS[COORDINATES:]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct word k-shingles, A-Z in lower case."""
    data, offsets = utf8(texts)
    for i, j in pieces(offsets):
        words = Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
        hashes = words.hashes()
        value, first = windows(hashes, words.bounds, k)
        cuts = np.searchsorted(first, words.bounds)
        for t in range(j - i):
            a, b = words.bounds[t], words.bounds[t + 1]
            if 0 < b - a < k:
                x = U64(b - a)
                for h in hashes[a:b]:
                    x = x * U64(0x9E3779B97F4A7C15) + h
                yield mix(np.array([x], U64))
            else:
                yield np.unique(value[cuts[t] : cuts[t + 1]])


def signature(own: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(U64).max, U64)
    for i in range(0, len(own), 4096):
        low = np.minimum(low, (own[i : i + 4096, None] * MULTIPLY + ADD).min(0))
    return (low >> U64(32)).astype(np.uint32).view(np.int32)


def set_key(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def signatures(source: DataFrame, k: int) -> DataFrame:
    """row, id, n_shingles, key of the set, signature; source has row, id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, keys, signs = [], [], []
            with np.errstate(over="ignore"):
                for own in shingle_sets(batch.column(2), k):
                    size.append(len(own))
                    keys.append(set_key(own))
                    signs.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signs, pa.list_(pa.int32()))], ["row", "id", "n_shingles", "key", "signature"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"row long, id {kind}, n_shingles long, key binary, signature array<int>")


def postings(classes: DataFrame) -> DataFrame:
    """(pair, class) for the two coordinates of each meeting whose values another class has too."""
    lists = F.array(*[
        F.shiftleft(F.lit(m).cast("long"), HASH_BITS).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64(F.col("signature")[i], F.col("signature")[j], F.lit(m)), 64 - HASH_BITS))
        for m, (i, j) in enumerate(MEETINGS)])
    posted = classes.select("class", F.explode(lists).alias("pair"))
    shared = posted.groupBy("pair").count().filter("count > 1")
    return posted.join(shared.select("pair"), "pair", "left_semi").select("class", "pair")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs a < b whose signatures agree in MATCHES coordinates at least."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    signs = classes.select("class", "signature")
    both = (
        ordered.join(signs.withColumnsRenamed({"class": "a", "signature": "sa"}), "a")
        .join(signs.withColumnsRenamed({"class": "b", "signature": "sb"}), "b")
    )
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.filter(equal >= MATCHES).select("a", "b")


def class_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(class, set) of the needed classes; docs has id, text and needed has class, id, key."""
    texts = docs.join(
        needed.withColumnsRenamed({"id": "wanted", "key": "wanted_key"}), F.col("id").eqNullSafe(F.col("wanted"))
    ).select("class", "wanted_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c, pack(own >> U64(16))) for c, key, own in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), k)) if set_key(own) == key]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["class", "set"])

    return texts.mapInArrow(run, "class long, set binary").dropDuplicates(["class"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(sets.withColumnsRenamed({"class": "a", "set": "set_a"}), "a")
        .join(sets.withColumnsRenamed({"class": "b", "set": "set_b"}), "b").select("a", "b", "set_a", "set_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = unpack(x.as_py()), unpack(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products of narrow 0/1 matrices."""
    terms = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    places = []
    for sets in (a, b):
        flat = np.concatenate(sets)
        at = np.searchsorted(terms, flat)
        known = np.flatnonzero(at < len(terms))
        known = known[terms[at[known]] == flat[known]]
        known = known[np.argsort(at[known], kind="stable")]
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known], at[known]))
    for c in range(0, len(terms), COLUMNS):
        parts = []
        for n, (row, column) in zip(out.shape, places):
            i, j = np.searchsorted(column, (c, c + COLUMNS))
            part = np.zeros((n, COLUMNS), np.float32)
            part[row[i:j], column[i:j] - c] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def across(state: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between classes of different components that share an open list; state has pair, class, root.

    A list is cut into blocks of bounded rows and bytes. One task compares two blocks, with signatures and sets at
    hand, and returns a spanning forest of the links only, so that pairs are never rows. A pair that shares several lists is
    compared in the one of the lowest meeting.
    """
    bit = F.expr(f"bit_or(shiftleft(1L, CAST(shiftright(pair, {HASH_BITS}) AS INT)))")
    members = (
        state.groupBy("class").agg(bit.alias("mask"))
        .join(classes.select("class", "signature"), "class").join(sets, "class"))
    blocks = F.greatest(F.count("*") / F.lit(block), F.sum("bytes") / F.lit(BLOCK_BYTES))
    sizes = (
        state.join(sets.select("class", F.octet_length("set").alias("bytes")), "class")
        .groupBy("pair").agg(F.ceil(blocks).cast("int").alias("k")))
    cells = (
        state.select("pair", "class", "root").join(sizes, "pair")
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("pair", F.least("own", "other").alias("cell_a"), F.greatest("own", "other").alias("cell_b"), "own", "class", "root")
        .join(members, "class"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        meeting, cell_a, cell_b = key[0].as_py() >> HASH_BITS, key[1].as_py(), key[2].as_py()
        ids, roots, masks, own = (rows.column(c).to_numpy() for c in ("class", "root", "mask", "own"))
        signs = pc.list_flatten(rows.column("signature")).to_numpy().reshape(-1, COORDINATES)
        size = pc.binary_length(rows.column("set")).to_numpy().astype(np.int64) // 8
        x, y = np.flatnonzero(own == cell_a), np.flatnonzero(own == cell_b)
        wanted = roots[x][:, None] != roots[y]
        wanted &= 100 * np.minimum(size[x][:, None], size[y]) >= percent * np.maximum(size[x][:, None], size[y])
        if cell_a == cell_b:
            wanted = np.triu(wanted, 1)
        agree = np.zeros(wanted.shape, np.uint8)
        for j in range(COORDINATES):
            agree += signs[x, j][:, None] == signs[y, j]
        wanted &= agree >= MATCHES
        for m, (i, j) in enumerate(MEETINGS[:meeting]):
            posted = (masks >> m) & 1 > 0
            same = (signs[x, i][:, None] == signs[y, i]) & (signs[x, j][:, None] == signs[y, j])
            wanted &= ~(same & posted[x][:, None] & posted[y])
        i, j = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        x, y, wanted = x[i], y[j], wanted[np.ix_(i, j)]
        if wanted.size:
            packed = rows.column("set")
            both = shared_counts([unpack(packed[int(n)].as_py()) for n in x], [unpack(packed[int(n)].as_py()) for n in y])
            wanted &= 100 * both >= percent * (size[x][:, None] + size[y] - both)
        i, j = spanning(*np.nonzero(wanted), len(x), 0 if cell_a == cell_b else len(x))
        a, b = ids[x[i]], ids[y[j]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cells.groupBy("pair", "cell_a", "cell_b").applyInArrow(compare, "a long, b long")


def spanning(i: np.ndarray, j: np.ndarray, rows: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (i, j) that join what no link before them has joined; ``shift`` sets columns apart from rows."""
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        root = k
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(k, k) != root:
            parent[k], k = root, parent[k]
        return root

    keep = []
    for n, (a, b) in enumerate(zip(i.tolist(), (j + shift).tolist())):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            keep.append(n)
    return i[keep], j[keep]


def components(edges: DataFrame) -> DataFrame:
    """(class, root): the smallest class reachable, for every class of an edge. A round's table goes when the next is written."""
    edges, last = replaced(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    while True:
        # stars: nobody stands on both sides, and everybody has one centre
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
            edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty():
            return edges.select(F.col("u").alias("class"), F.col("v").alias("root"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges, last = replaced(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            .filter("u > v").distinct(), "links", last)


def missed(percent: int) -> float:
    """Probability that a pair of just this similarity agrees in fewer than MATCHES coordinates."""
    p = percent / 100
    return sum(math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) for k in range(MATCHES))


def near_groups(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, key.

    A ``percent`` at which links would be missed with more than ``MISSED`` is an error.
    """
    if missed(percent) > MISSED:
        raise ValueError(f"at percent={percent} a link is missed with probability {missed(percent):.1g}, more than {MISSED}")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(signatures(source, k), "signatures")
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = materialize(
        rows.filter("key IS NOT NULL").groupBy("key").agg(smallest.alias("first"), F.first("signature").alias("signature"))
        .select(F.col("first.row").alias("class"), F.col("first.id").alias("id"), "key", "signature"), "classes")
    posted = postings(classes)
    lists = materialize(
        posted.join(posted.groupBy("pair").agg(F.count("*").alias("size")).filter("size > 1"), "pair"), "lists")
    small = lists.filter(F.col("size") <= SMALL)
    pairs = small.groupBy("pair").agg(F.array_sort(F.collect_list("class")).alias("c")).select(
        F.explode(F.flatten(F.transform("c", lambda a: F.transform(
            F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    pairs = materialize(agreeing(pairs, classes), "pairs")
    large = lists.filter(F.col("size") > SMALL).select("pair", "class")
    live = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).union(large.select("class")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = materialize(class_sets(texts, classes.select("class", "id", "key").join(live, "class", "left_semi"), k), "class-sets")
    links = materialize(confirmed(pairs, sets, percent), "confirmed")

    # the centre of a group of copies is posted in more of its lists than the copies are
    degrees = large.groupBy("class").agg(F.count("*").alias("degree"))
    large = materialize(large.join(degrees, "class"), "long-lists")
    central = F.min_by("class", F.struct(-F.col("degree"), "class"))
    roots = components(links)
    for leader in (central, None):
        state = large.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        several = state.groupBy("pair").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
        state = materialize(state.join(several.select("pair"), "pair", "left_semi"), "open-lists")
        if state.isEmpty():
            break
        if leader is None:
            found = across(state, classes, sets, percent, block)
        else:
            heads = state.withColumnsRenamed({"class": "a", "root": "root_a"})
            first = state.groupBy("pair").agg(leader.alias("a"))
            pairs = heads.join(first, ["pair", "a"], "left_semi").join(state, "pair").filter("root_a <> root")
            found = confirmed(agreeing(pairs.select("a", F.col("class").alias("b")), classes), sets, percent)
        # stars stand for all links so far
        roots = components(roots.select(F.col("class").alias("a"), F.col("root").alias("b")).union(found))
    roots = roots.union(roots.select(F.col("root").alias("class"), "root").distinct())  # a root's id need not be the smallest
    named = roots.join(classes.select("class", "id"), "class")
    smallest_id = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_key = (
        classes.select("class", "key", "id").join(roots, "class", "left")
        .join(smallest_id, "root", "left").select("key", F.coalesce("component_id", "id").alias("component_id"))
    )
    return rows.select("id", "n_shingles", "key").join(by_key, "key", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.col("component_id").isNull()).alias("kept"), "key")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first of each component; columns as given, whatever their names."""
    own_id, own_key, own_kept, wanted = fresh_names(docs, 4)
    kept = near_groups(docs, k, percent, id_col, text_col).filter("kept AND key IS NOT NULL").select(
        F.col(id_col).alias(own_id), F.col("key").alias(wanted), F.lit(True).alias(own_kept)).distinct()
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(own_key, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                keys = pa.array([set_key(own) for own in shingle_sets(batch.column(at), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, own_key])

    keyed = docs.mapInArrow(run, schema)
    same = (F.col(own_key) == F.col(wanted)) & F.col(f"`{id_col}`").eqNullSafe(F.col(own_id))
    marked = keyed.join(kept, same, "left").filter(F.col(own_key).isNull() | F.col(own_kept))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns])
