"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard.

Vectors are compared inside their label only. Equal vectors are one class; the classes of a label are dealt by hash into shards of a bounded
number of rows. One task builds a shard's graph: batches of vectors search the layers built so far, side by side in numpy, take
diverse neighbours and link back. A vector within half of the link angle of a node joins that node instead of becoming one: all members of
a node are then linked with each other by the triangle inequality, and a crowd of near copies is one node, not a clique.

Every shard of a label meets every other and itself in a task of its own. The nodes of each search the other's graph. A beam is widened
while all it holds lies in range, and all beams of a task are widened until an audit passes: a sample of nodes is
compared with all nodes, and ``recall`` of what is in range must be found. A beam as wide as the shard is a scan. For two nodes in range,
their angle and radii say that all, none or some of their members are linked; only in the last case are members compared, block by
block, by cosine in double precision. A pair found from either side counts for both. Tasks return each class's number of links and its smallest
class in a spanning star, never pairs; the stars are united by alternating star steps.

Defined cases: rows whose label is null, or whose vector is null, empty, zero or holds a null or non-finite component, are linked with nothing and
kept; vectors of different lengths are not compared; equal vectors are linked; null ids come last; rows of equal id are rows of their
own; empty tables give no rows; further columns do not matter.
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

from corpuscope.llm.near_dedup import components
from corpuscope.llm.tables import materialize

#: rows of one shard; neighbours of a node in the upper layers, twice as many in the lowest
SHARD, NEIGHBOURS = 16_384, 16
#: vectors that search side by side; the first width of a beam when building and when searching
BATCH, BUILD_BEAM, BEAM = 512, 48, 32
#: nodes of an audit; the share of their pairs in range that must be found
AUDIT, RECALL = 256, 0.999
#: rounding allowed for in angles, and members compared at once
SLACK, BLOCK = 1e-9, 2048


def usable(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each vector as doubles, or None if it is null, empty, zero or holds a null or non-finite component."""
    for value in column:
        x = None
        if value.is_valid and len(value.values) and not value.values.null_count:
            x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
        yield x


def unit(x: np.ndarray) -> np.ndarray:
    """The vector at length one; scaled first, so that its square neither overflows nor vanishes."""
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def prepared(source: DataFrame) -> DataFrame:
    """row, id, label, key, dim, vector (doubles of length one); source has row, id, label, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, units = [], [], []
            for label, x in zip(batch.column(2).is_valid().to_pylist(), usable(batch.column(3))):
                ok = label and x is not None
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if ok else None)
                dims.append(len(x) if ok else None)
                units.append(unit(x).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                ["row", "id", "label", "key", "dim", "vector"])

    kinds = [source.schema[c].dataType.simpleString() for c in ("id", "label")]
    return source.mapInArrow(run, "row long, id {}, label {}, key binary, dim int, vector binary".format(*kinds))


def best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, in falling order."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims, ids = np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)


class Graph:
    """Nodes (vectors with members and a radius) and their neighbours by layer; layer 0 holds all nodes."""

    def __init__(self, dim: int):
        self.nodes = np.zeros((0, dim), np.float32)
        self.level = np.zeros(0, np.int8)
        self.links: list[np.ndarray] = []

    def width(self, layer: int) -> int:
        return NEIGHBOURS if layer else 2 * NEIGHBOURS

    def search(self, layer: int, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and nodes of each query's beam, falling; -1 where a beam is not full. All queries go side by side."""
        links, n = self.links[layer], len(queries)
        seen = np.zeros((n, len(self.nodes)), bool)
        rows = np.arange(n)[:, None]
        ids = start
        sims = np.where(ids >= 0, (self.nodes[ids] @ queries[:, :, None])[..., 0], -np.inf).astype(np.float32)
        seen[rows, np.where(ids >= 0, ids, ids[:, :1])] = True
        sims, ids = best(sims, ids, beam)
        done = np.zeros(ids.shape, bool)
        live = np.arange(n)
        while len(live):
            open_ = ~done[live] & (ids[live] >= 0)
            has = open_.any(1)
            live, at = live[has], open_[has].argmax(1)  # beams fall, so the first open node is the nearest
            if not len(live):
                break
            done[live, at] = True
            near = links[ids[live, at]]
            own = live[:, None]
            known = (near < 0) | seen[own, near]
            seen[own, np.where(near < 0, ids[live, at][:, None], near)] = True
            near_sims = (self.nodes[near] @ queries[live][:, :, None])[..., 0]
            near_sims[known] = -np.inf
            all_sims = np.concatenate([sims[live], near_sims], 1)
            all_ids = np.concatenate([ids[live], np.where(known, -1, near)], 1)
            all_done = np.concatenate([done[live], known], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            if sims.shape[1] < order.shape[1]:
                more = order.shape[1] - sims.shape[1]
                sims = np.pad(sims, ((0, 0), (0, more)), constant_values=-np.inf)
                ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
                done = np.pad(done, ((0, 0), (0, more)), constant_values=True)
            sims[live], ids[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_sims, all_ids, all_done))
        return sims, ids

    def descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """The nearest node found above ``layer``, as the place to enter it."""
        entry = np.full((len(queries), 1), int(self.level.argmax()), np.int64)
        for upper in range(len(self.links) - 1, layer, -1):
            entry = self.search(upper, queries, entry, 1)[1]
        return entry

    def diverse(self, sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Up to k of each row's candidates, falling by similarity: one nearer to a chosen one than to the query waits behind the others."""
        vectors = self.nodes[ids]
        between = vectors @ vectors.transpose(0, 2, 1)
        chosen, apart, count = np.zeros(ids.shape, bool), ids >= 0, np.zeros(len(ids), np.int64)
        for j in range(ids.shape[1]):
            take = apart[:, j] & (count < k)
            chosen[:, j] = take
            count += take
            if take.any() and j + 1 < ids.shape[1]:
                apart[:, j + 1 :] &= ~(take[:, None] & (between[:, j, j + 1 :] > sims[:, j + 1 :]))
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1)

    def link_back(self, layer: int, sources: np.ndarray, targets: np.ndarray) -> None:
        """Add source to each target's neighbours; a full list keeps its diverse ones."""
        links, width = self.links[layer], self.width(layer)
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        heads = np.flatnonzero(np.diff(targets, prepend=-1))
        counts, targets = np.diff(np.append(heads, len(targets))), targets[heads]
        had = (links[targets] >= 0).sum(1)
        place = np.arange(len(sources)) - np.repeat(heads, counts) + np.repeat(had, counts)
        fits = np.repeat(had + counts <= width, counts)
        links[np.repeat(targets, counts)[fits], place[fits]] = sources[fits]
        over = np.flatnonzero(had + counts > width)
        over = over[np.argsort(counts[over], kind="stable")]  # lists of like length together
        while len(over):
            longest = width + int(counts[over[-1]])
            now, over = over[-max(1, (1 << 22) // longest**2):], over[: -max(1, (1 << 22) // longest**2)]
            ids = np.full((len(now), longest), -1, np.int64)
            ids[:, :width] = links[targets[now]]
            row = np.repeat(np.arange(len(now)), counts[now])
            at = np.concatenate([np.arange(heads[i], heads[i] + counts[i]) for i in now.tolist()])
            ids[row, place[at]] = sources[at]
            own = self.nodes[targets[now]]
            sims = (self.nodes[ids] @ own[:, :, None])[..., 0]
            sims[ids < 0] = -np.inf
            links[targets[now]] = self.diverse(*best(sims, ids, longest), width)

    def add(self, vectors: np.ndarray, levels: np.ndarray) -> None:
        """Insert a batch of nodes."""
        first, n = len(self.nodes), len(vectors)
        top = len(self.links) - 1
        self.nodes = np.concatenate([self.nodes, vectors])
        self.level = np.concatenate([self.level, levels])
        for layer in range(max(top, int(levels.max())) + 1):
            if layer == len(self.links):
                self.links.append(np.full((first, self.width(layer)), -1, np.int64))
            self.links[layer] = np.concatenate([self.links[layer], np.full((n, self.width(layer)), -1, np.int64)])
        within = vectors @ vectors.T
        for layer in range(int(levels.max()), -1, -1):
            own = np.flatnonzero(levels >= layer)
            # the batch itself, by comparison
            sims, ids = within[np.ix_(own, own)].copy(), np.tile(own + first, (len(own), 1))
            np.fill_diagonal(sims, -np.inf)
            ids[np.isneginf(sims)] = -1
            sims, ids = best(sims, ids, min(len(own), BUILD_BEAM))
            if first and layer <= top:
                found = self.search(layer, vectors[own], self.before(vectors[own], layer, first), BUILD_BEAM)
                sims, ids = best(np.concatenate([sims, found[0]], 1), np.concatenate([ids, found[1]], 1), BUILD_BEAM)
            chosen = self.diverse(sims, ids, self.width(layer) // 2)
            self.links[layer][own + first, : chosen.shape[1]] = chosen
            good = chosen >= 0
            self.link_back(layer, np.repeat(own + first, good.sum(1)), chosen[good])

    def before(self, queries: np.ndarray, layer: int, first: int) -> np.ndarray:
        """Entry among the nodes before ``first``, by their own layers."""
        levels = self.level[:first]
        entry = np.full((len(queries), 1), int(levels.argmax()), np.int64)
        for upper in range(int(levels.max()), layer, -1):
            entry = self.search(upper, queries, entry, 1)[1]
        return entry


def levels_of(classes: np.ndarray) -> np.ndarray:
    """A node's highest layer: each holds one in NEIGHBOURS of the one below, drawn by hash."""
    x = (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return np.minimum(-np.log(u) / math.log(NEIGHBOURS), 12).astype(np.int8)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class Shard:
    """A graph, the members of its nodes in node order, and radii."""

    def __init__(self, graph: Graph, node: np.ndarray, vectors: np.ndarray, classes: np.ndarray, weights: np.ndarray):
        order = np.argsort(node, kind="stable")
        self.graph, self.vectors = graph, vectors[order]
        self.classes, self.weights, node = classes[order], weights[order], node[order]
        self.first = np.searchsorted(node, np.arange(len(graph.nodes) + 1))
        # a node's centre is its first member; the radius is measured in double precision
        self.centre = self.vectors[self.first[:-1]]
        own = angle(np.einsum("ij,ij->i", self.vectors, self.centre[node]))
        self.radius = np.maximum.reduceat(own, self.first[:-1])
        self.radius[np.diff(self.first) == 1] = 0
        self.weight = np.add.reduceat(self.weights, self.first[:-1])


def build(vectors: np.ndarray, classes: np.ndarray, weights: np.ndarray, cosine: float) -> Shard:
    """One shard's graph; vectors are of length one."""
    join = math.cos(math.acos(cosine) / 2 - 1e-4)
    low = vectors.astype(np.float32)
    graph, node = Graph(vectors.shape[1]), np.full(len(vectors), -1, np.int64)
    levels = levels_of(classes)
    at = 0
    while at < len(vectors):
        n = min(BATCH, max(1, at), len(vectors) - at)
        batch = np.arange(at, at + n)
        at += n
        if len(graph.nodes):
            sims, ids = graph.search(0, low[batch], graph.descend(low[batch], 0), NEIGHBOURS)
            joins = sims[:, 0] >= join
            node[batch[joins]] = ids[joins, 0]
            batch = batch[~joins]
        # first come, first node: later ones near a new node join it
        near, fresh = low[batch] @ low[batch].T >= join, []
        taken = np.full(len(batch), -1)
        for i in range(len(batch)):
            if taken[i] < 0:
                mine = near[i] & (taken < 0)
                mine[:i] = False
                mine[i] = True
                taken[mine] = len(fresh)
                fresh.append(i)
        if fresh:
            node[batch] = len(graph.nodes) + taken
            graph.add(low[batch[fresh]], levels[batch[fresh]])
    return Shard(graph, node, vectors, classes, weights)


def store(shard: Shard) -> dict[str, bytes]:
    return {
        "vectors": shard.vectors.tobytes(), "classes": shard.classes.tobytes(), "weights": shard.weights.tobytes(),
        "first": shard.first.tobytes(), "level": shard.graph.level.tobytes(),
        "links": b"".join(x.astype(np.int32).tobytes() for x in shard.graph.links),
    }


def load(row: dict, dim: int) -> Shard:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
    classes, weights, first = (np.frombuffer(row[c], np.int64) for c in ("classes", "weights", "first"))
    graph = Graph(dim)
    graph.nodes, graph.level = vectors[first[:-1]].astype(np.float32), np.frombuffer(row["level"], np.int8)
    flat, at = np.frombuffer(row["links"], np.int32).astype(np.int64), 0
    for layer in range(int(graph.level.max()) + 1):
        n = len(graph.nodes) * graph.width(layer)
        graph.links.append(flat[at : at + n].reshape(len(graph.nodes), -1))
        at += n
    return Shard(graph, np.repeat(np.arange(len(first) - 1), np.diff(first)), vectors, classes, weights)


def nodes_in_range(a: Shard, b: Shard, cosine: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node of a, node of b) that may have linked members, as a's nodes find them in b's graph."""
    reach = np.minimum(math.acos(cosine) + a.radius + b.radius.max() + 1e-3, math.pi)
    least = np.cos(reach).astype(np.float32)
    queries, total = a.graph.nodes, len(b.graph.nodes)

    def scan(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.nonzero(queries[own] @ b.graph.nodes.T >= least[own][:, None])
        return own[x], y

    def found(beam: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for i in range(0, len(queries), BATCH):
            own, width = np.arange(i, min(i + BATCH, len(queries))), beam
            while len(own):
                if width >= total:
                    out.append(scan(own))
                    break
                sims, ids = b.graph.search(0, queries[own], b.graph.descend(queries[own], 0), width)
                # a beam that holds nothing beyond the range may have left something in range out
                full = sims[:, -1] >= least[own]
                x, y = np.nonzero((sims >= least[own][:, None]) & ~full[:, None])
                out.append((own[x], ids[x, y]))
                own, width = own[full], 4 * width
        return tuple(np.concatenate(c) for c in zip(*out))

    picked = np.argsort(levels_hash(a.classes[a.first[:-1]]), kind="stable")[:AUDIT]
    truth = np.unique(np.stack(scan(np.sort(picked))), axis=1)
    beam = BEAM
    while True:
        x, y = found(beam)
        if beam >= total:
            return x, y
        asked = np.isin(x, picked)
        codes = x[asked] * total + y[asked]
        hit = np.isin(truth[0] * total + truth[1], codes).sum()
        if hit >= recall * truth.shape[1]:
            return x, y
        beam *= 2


def levels_hash(classes: np.ndarray) -> np.ndarray:
    """An order of the nodes for audits that their layers know nothing of."""
    x = (classes.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def meet(a: Shard, b: Shard, same: bool, cosine: float, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with links between two shards, their number of linked rows, and the smallest class of their component."""
    x, y = nodes_in_range(a, b, cosine, recall)
    if not same:
        v, u = nodes_in_range(b, a, cosine, recall)
        x, y = np.concatenate([x, u]), np.concatenate([y, v])
    else:
        x, y = np.minimum(x, y), np.maximum(x, y)
    pairs = x * len(b.graph.nodes) + y
    if same:  # every node meets itself, found or not
        pairs = np.concatenate([pairs, np.arange(len(a.graph.nodes)) * (len(a.graph.nodes) + 1)])
    pairs = np.unique(pairs)
    x, y = pairs // len(b.graph.nodes), pairs % len(b.graph.nodes)
    apart = angle(np.einsum("ij,ij->i", a.centre[x], b.centre[y]))
    limit, reach = math.acos(cosine), a.radius[x] + b.radius[y]
    every = apart + reach <= limit - SLACK * 1e3
    some = ~every & (apart - reach <= limit + SLACK * 1e3)
    if same:
        every, some = every | (x == y), some & (x != y)
    n_a = np.zeros(len(a.classes), np.int64)
    n_b = n_a if same else np.zeros(len(b.classes), np.int64)
    union = Union(len(a.classes) + (0 if same else len(b.classes)))
    shift = 0 if same else len(a.classes)
    for i, j, all_ in zip(x[every | some].tolist(), y[every | some].tolist(), every[every | some].tolist()):
        p, q = np.arange(a.first[i], a.first[i + 1]), np.arange(b.first[j], b.first[j + 1])
        if all_:
            n_a[p] += b.weight[j]
            if not (same and i == j):
                n_b[q] += a.weight[i]
            union.chain(p)
            union.chain(q + shift)
            union.join(p[0], q[0] + shift)
            continue
        for s in range(0, len(p), BLOCK):
            for t in range(0, len(q), BLOCK):
                r, c = p[s : s + BLOCK], q[t : t + BLOCK]
                linked = a.vectors[r] @ b.vectors[c].T >= cosine
                n_a[r] += linked @ b.weights[c]
                n_b[c] += a.weights[r] @ linked
                union.cover(r, c + shift, linked)
    if same:
        n_a -= a.weights  # each class has counted its own rows
    roots = union.roots()
    classes = a.classes if same else np.concatenate([a.classes, b.classes])
    counts = n_a if same else np.concatenate([n_a, n_b])
    smallest = np.full(len(classes), np.iinfo(np.int64).max)
    np.minimum.at(smallest, roots, classes)
    linked = counts > 0
    return classes[linked], counts[linked], smallest[roots][linked]


class Union:
    """Components of places in numpy arrays."""

    def __init__(self, n: int):
        self.parent, self.chained = list(range(n)), set()

    def find(self, i: int) -> int:
        root = i
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[i] != root:
            self.parent[i], i = root, self.parent[i]
        return root

    def join(self, i: int, j: int) -> None:
        i, j = self.find(int(i)), self.find(int(j))
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def chain(self, places: np.ndarray) -> None:
        """All of them are one. Members of a node keep that from the first time on."""
        first = int(places[0])
        if first not in self.chained:
            self.chained.add(first)
            for p in places[1:].tolist():
                self.join(first, p)

    def cover(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
        """Unite by a 0/1 matrix of links."""
        for i in np.flatnonzero(linked.any(1)).tolist():
            for j in np.flatnonzero(linked[i]).tolist():
                self.join(rows[i], columns[j])

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


STORED = "dim int, vectors binary, classes binary, weights binary, first binary, level binary, links binary"


def embedding_groups(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    shard_rows: int = SHARD, recall: float = RECALL,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    rows = materialize(prepared(vectors.select(
        F.monotonically_increasing_id().alias("row"), vectors[id_col].alias("id"), vectors[label_col].alias("label"),
        vectors[vector_col].alias("vector"))), "vectors")
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = materialize(
        rows.filter("key IS NOT NULL").groupBy("label", "dim", "key")
        .agg(smallest.alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
        .select("label", "dim", "key", F.col("least.row").alias("class"), F.col("least.id").alias("id"), "weight", "vector"),
        "vector-classes")
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"))
    dealt = classes.join(counts, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("class"), F.col("shards")).cast("int"))
    kind = classes.schema["label"].dataType.simpleString()

    def graph(key: tuple, table: pa.Table) -> pa.Table:
        label, dim, shard = key
        table = table.sort_by("class")
        flat = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, dim.as_py())
        made = build(flat, table.column("class").to_numpy(), table.column("weight").to_numpy(), cosine)
        return pa.table({
            "label": pa.array([label.as_py()], table.schema.field("label").type), "shard": pa.array([shard.as_py()], pa.int32()),
            "shards": pa.array([table.column("shards")[0].as_py()], pa.int32()), "dim": pa.array([dim.as_py()], pa.int32()),
            **{k: pa.array([v], pa.binary()) for k, v in store(made).items()}})

    shards = materialize(
        dealt.select("label", "dim", "shard", "shards", "class", "weight", "vector")
        .groupBy("label", "dim", "shard").applyInArrow(graph, f"label {kind}, shard int, shards int, {STORED}"), "graphs")
    cells = shards.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        "label", "dim", F.least("shard", "other").alias("cell_a"), F.greatest("shard", "other").alias("cell_b"), "shard",
        "vectors", "classes", "weights", "first", "level", "links")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        both = [load(r, dim) for r in sorted(table.to_pylist(), key=lambda r: r["shard"])]
        found, links, root = meet(both[0], both[-1], len(both) == 1, cosine, recall)
        return pa.table({"class": found, "links": links, "root": root})

    stars = materialize(
        cells.groupBy("label", "dim", "cell_a", "cell_b").applyInArrow(compare, "class long, links long, root long"), "stars")
    links = stars.groupBy("class").agg(F.sum("links").alias("links"))
    united = components(stars.select(F.col("class").alias("a"), F.col("root").alias("b")))
    roots = united.union(united.select(F.col("root").alias("class"), "root").distinct())
    named = roots.join(classes.select("class", "id"), "class")
    low = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_key = (
        classes.join(links, "class", "left").join(roots, "class", "left").join(low, "root", "left")
        .select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id")))
    own = F.coalesce("component_id", "id")
    return rows.select("id", "label", "dim", "key").join(by_key, ["label", "dim", "key"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("id") == own, own.isNull()).alias("kept"))
