"""Module dependency graphs: building, cycles, layers, coupling, cohesion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscope.functions.paths import DOMAIN_KEYWORDS, domain_of_import, domain_of_path
from corpuscope.functions.text import round_half_up, word_tokens
from corpuscope.operators.similarity import restored, squeezed
from corpuscope.session import materialize
from corpuscope.skew import salted_join

# Layer number of each domain; unknown domains are at level 2.
LAYERS = {
    "UI": 5, "API": 4, "Service": 3, "Repository": 2, "Model": 1, "Database": 0,
    "Utils": -1, "Config": -1, "Core": -1, "Test": 6,
}
DEFAULT_LAYER = 2
ARROW = " → "


def build_module_graph(
    imports: DataFrame, keywords: dict[str, str] = DOMAIN_KEYWORDS
) -> DataFrame:
    """Distinct edges from a file's domain to the domains it imports, no self loops."""
    return (
        imports.select(
            "repo", domain_of_path(F.col("file_path"), keywords).alias("src"),
            domain_of_import(F.col("target"), keywords).alias("dst"),
        )
        .filter("src is not null and dst is not null and src <> dst")
        .distinct()
    )


def file_modules(files: DataFrame, keywords: dict[str, str] = DOMAIN_KEYWORDS) -> DataFrame:
    return files.select(
        "repo", "file_path", domain_of_path(F.col("file_path"), keywords).alias("module")
    )


def module_universe(edges: DataFrame) -> DataFrame:
    """Every module that is a source or a target."""
    ends = F.explode(F.array("src", "dst")).alias("module")
    return edges.select("repo", ends).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that start at a source or end at a sink, round by round until none does."""
    left = edges.count()
    while left:
        before = left
        ends = F.explode(F.array(
            F.struct(F.col("src").alias("node"), F.lit(True).alias("out")),
            F.struct(F.col("dst").alias("node"), F.lit(False).alias("out")))).alias("e")
        inner = edges.select("repo", ends).groupBy("repo", F.col("e.node").alias("node")).agg(
            F.bool_or("e.out").alias("out"), F.bool_and("e.out").alias("only_out")
        ).filter("out AND NOT only_out").select("repo", "node")
        edges = materialize(
            edges.join(inner.withColumnRenamed("node", "src"), ["repo", "src"], "left_semi")
            .join(inner.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_semi")
            .select("repo", "src", "dst"), "trimmed-edges")
        left = edges.count()
        if left == before:
            break
    return edges


def component_edges(edges: DataFrame) -> DataFrame:
    """(repo, src, dst) of the edges inside strongly connected components of two modules or more.

    Sources and sinks are trimmed. Then the largest name spreads forward as a colour until it stands: a component
    has one colour, and that colour's module reaches backward just its own component inside it. Those
    edges are found; the others of one colour go on. Every step is a join and a grouping of what is left.
    """
    live = materialize(edges.filter("src <> dst").select("repo", "src", "dst").distinct(), "graph-edges")
    found = live.limit(0)
    while True:
        live = _trimmed(live)
        if live.isEmpty():
            return found
        nodes = live.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours, moved = materialize(nodes.withColumn("colour", F.col("node")), "colours"), True
        while moved:
            given = live.join(colours.withColumnRenamed("node", "src"), ["repo", "src"]).groupBy(
                "repo", F.col("dst").alias("node")).agg(F.max("colour").alias("given"))
            colours = materialize(
                colours.select("repo", "node", "colour").join(given, ["repo", "node"], "left").select(
                    "repo", "node", F.greatest("colour", "given").alias("colour"),
                    F.coalesce(F.col("given") > F.col("colour"), F.lit(False)).alias("moved")), "colours")
            moved = not colours.filter("moved").isEmpty()
        one, two = (colours.select("repo", F.col("node").alias(e), F.col("colour").alias(c)) for e, c in (("src", "a"), ("dst", "b")))
        same = materialize(
            live.join(one, ["repo", "src"]).join(two, ["repo", "dst"]).filter("a = b")
            .select("repo", "src", "dst", F.col("a").alias("colour")), "colour-edges")
        reached = materialize(
            same.filter("dst = colour").select("repo", F.col("dst").alias("start"), F.col("dst").alias("node")).distinct(), "reached")
        grown = _backward(reached, same.withColumn("start", F.col("colour")))
        inside = grown.select("repo", "node").distinct()
        of = [inside.withColumnRenamed("node", e) for e in ("src", "dst")]
        found = materialize(found.unionByName(
            same.join(of[0], ["repo", "src"], "left_semi").join(of[1], ["repo", "dst"], "left_semi")
            .select("repo", "src", "dst")), "component-edges")
        live = materialize(
            same.join(of[0], ["repo", "src"], "left_anti").join(of[1], ["repo", "dst"], "left_anti")
            .select("repo", "src", "dst"), "graph-edges")


def _backward(reached: DataFrame, edges: DataFrame, hops: int = 0, max_hops: int | None = None) -> DataFrame:
    """(repo, start, node, hops): modules from which ``start`` is reached, with the fewest edges.

    ``reached`` holds the modules ``hops`` edges away. ``edges`` have repo, src, dst and start; without start, a start's
    paths keep to larger modules.
    """
    own = "start" in edges.columns
    reached = new = materialize(reached.select("repo", "start", "node", F.lit(hops).alias("hops")), "backward")
    step = edges.withColumnRenamed("dst", "node")
    while not new.isEmpty() and (max_hops is None or hops < max_hops):
        hops += 1
        met = new.join(step, ["repo", "start", "node"] if own else ["repo", "node"])
        further = (met if own else met.filter("src > start")).select("repo", "start", F.col("src").alias("node")).distinct()
        new = materialize(
            further.join(reached, ["repo", "start", "node"], "left_anti").withColumn("hops", F.lit(hops)), "backward")
        reached = reached.unionByName(new)
    return reached


def find_cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """Simple directed cycles, each once; ``max_len`` restricts them to so many modules.

    Only edges inside strongly connected components are walked. A cycle is grown from its smallest
    module, so every other module on the path is larger, and only to modules from which the
    start can still be reached through larger ones, within ``max_len`` if that is given. Growth ends when no path is open.
    """
    e = materialize(edges.select("repo", "src", "dst").distinct(), "cycle-edges")
    found = [e.filter("src = dst").select("repo", F.array("src").alias("path"))]
    inner = component_edges(e)
    if max_len != 1 and not inner.isEmpty():
        first = inner.filter("src > dst").select("repo", F.col("dst").alias("start"), F.col("src").alias("node"))
        back = _backward(first, inner, 1, None if max_len is None else max_len - 1).withColumnRenamed("node", "next")
        step = inner.select("repo", F.col("src").alias("last"), F.col("dst").alias("next"))
        paths = inner.filter("src < dst").select(
            "repo", F.col("src").alias("start"), F.col("dst").alias("next"), F.array("src").alias("path"))
        while True:
            fits = F.lit(True) if max_len is None else F.size("path") + F.col("hops") <= max_len
            paths = materialize(
                paths.join(back, ["repo", "start", "next"]).filter(fits).select(
                    "repo", "start", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"),
                    (F.col("hops") == 1).alias("closes")), "open-paths")
            if paths.isEmpty():
                break
            found.append(paths.filter("closes").select("repo", "path"))
            paths = paths.join(step, ["repo", "last"]).filter(
                (F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select("repo", "start", "next", "path")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(
        "repo", F.size("path").alias("length"),
        F.array_join(F.concat("path", F.array(F.element_at("path", 1))), ARROW).alias("cycle"),
    )


def layer_of(module: Column, layers: dict[str, int] = LAYERS) -> Column:
    chain = F
    for name, level in layers.items():
        chain = chain.when(module == name, F.lit(level))
    return chain.otherwise(F.lit(DEFAULT_LAYER))


def layer_violations(edges: DataFrame, layers: dict[str, int] = LAYERS) -> DataFrame:
    """Edges that point to a higher layer than their own."""
    src, dst = layer_of(F.col("src"), layers), layer_of(F.col("dst"), layers)
    return edges.filter((dst > src) & (src >= 0)).select(
        "repo", "src", "dst",
        F.concat("src", F.lit(ARROW), "dst", F.lit(" (layer violation)")).alias("violation"),
    )


def module_degrees(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of each module, in one pass over the edges."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("module"), F.lit(1).alias("ce"), F.lit(0).alias("ca")),
            F.struct(F.col("dst").alias("module"), F.lit(0).alias("ce"), F.lit(1).alias("ca")),
        )
    )
    return (
        edges.select("repo", "src", "dst").distinct().select("repo", ends.alias("e"))
        .groupBy("repo", F.col("e.module").alias("module"))
        .agg(F.sum("e.ce").alias("efferent"), F.sum("e.ca").alias("afferent"))
    )


def coupling_scores(degrees: DataFrame) -> DataFrame:
    """Mean instability Ce / (Ca + Ce) of a repository's modules, as a percentage."""
    instability = F.col("efferent") / (F.col("efferent") + F.col("afferent"))
    return degrees.groupBy("repo").agg(
        F.count("*").alias("modules"),
        round_half_up(F.coalesce(F.avg(instability), F.lit(0.5)) * F.lit(100.0), 1).alias(
            "coupling_score"
        ),
    )


def largest_component(degrees: DataFrame) -> DataFrame:
    """Module with the most incoming edges; the smallest name wins a tie."""
    best = F.min_by(F.struct("module", "afferent"), F.struct(-F.col("afferent"), F.col("module")))
    return (
        degrees.filter("afferent > 0").groupBy("repo").agg(best.alias("b"))
        .select("repo", F.col("b.module").alias("largest_component"),
                F.col("b.afferent").alias("in_degree"))
    )


def orphan_modules(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules of files that no edge starts from or ends in."""
    return modules.select("repo", "module").distinct().join(
        module_universe(edges), ["repo", "module"], "left_anti"
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """One node per module, weighted by its outgoing edges."""
    return module_degrees(edges).select(
        "repo", F.col("module").alias("id"), F.col("module").alias("label"),
        F.col("efferent").alias("weight"),
    )


def graph_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        "repo", F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1).alias("weight")
    ).distinct()


def domain_score(cycles: Column, violations: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - cycles * F.lit(6.0) - violations * F.lit(4.0))


def architecture_summary(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """Scores, counts and the summary sentence of every repository.

    The edges are written once for all measures. With ``max_len`` longer cycles are not
    counted, and the sentence says so.
    """
    edges = materialize(edges.select("repo", "src", "dst").distinct(), "summary-edges")
    degrees = module_degrees(edges)
    cycles = find_cycles(edges, max_len).groupBy("repo").agg(F.count("*").alias("cycles"))
    broken = layer_violations(edges).groupBy("repo").agg(F.count("*").alias("violations"))
    joined = (
        coupling_scores(degrees).join(cycles, "repo", "left").join(broken, "repo", "left")
        .join(largest_component(degrees), "repo", "left")
        .withColumn("cycles", F.coalesce("cycles", F.lit(0)))
        .withColumn("violations", F.coalesce("violations", F.lit(0)))
    )
    noun = F.when(F.col("cycles") == 1, "dependency").otherwise("dependencies")
    parts = F.array(
        F.when(
            (F.col("cycles") == 0) & (F.col("violations") == 0),
            "Clean layered architecture detected.",
        ),
        F.when(
            F.col("cycles") > 0,
            F.concat(F.col("cycles").cast("string"), F.lit(" circular "), noun, F.lit(" found.")),
        ),
        F.lit(None if max_len is None else f"Cycles of up to {max_len} modules counted."),
        F.when(
            F.col("violations") > 0,
            F.concat(F.col("violations").cast("string"), F.lit(" layer violations detected.")),
        ),
        F.concat(F.col("modules").cast("string"), F.lit(" modules analyzed.")),
    )
    return joined.select(
        "repo", "modules", "cycles", "violations", "coupling_score",
        domain_score(F.col("cycles"), F.col("violations")).alias("domain_score"),
        F.coalesce("largest_component", F.lit("N/A")).alias("largest_component"),
        F.array_join(F.array_compact(parts), " ").alias("summary"),
    )


#: sets and MB of text of a block, sets that are compared at once, and words that are held densely at once
CELL_ROWS, CELL_MB, ROWS, COLUMNS = 16384, 32, 2048, 1024


def _packed(sets: pa.ListArray, copies: np.ndarray) -> bytes:
    """Word sets as bytes, the small ones first: words are places in a list of the block's words, the most frequent first."""
    size, flat = sets.value_lengths().to_numpy(), sets.flatten().to_numpy()
    words, which, n = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(words), np.int32)
    order = np.argsort(-n, kind="stable")
    place[order] = np.arange(len(words), dtype=np.int32)
    small = np.argsort(size, kind="stable")
    at = np.empty(len(size), np.int64)
    at[small] = np.arange(len(size))
    row, place = np.repeat(at, size), place[which]
    step = np.diff(place[np.lexsort((place, row))], prepend=np.int32(0))
    parts = [words[order].tobytes(), squeezed(size[small].astype(np.int32)), squeezed(copies[small].astype(np.int64)), squeezed(step)]
    return b"".join([len(x).to_bytes(8, "little") + x for x in parts])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, the size and copies of its sets, and the words' places set by set."""
    parts, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 8], "little")
        parts.append(blob[at + 8:at + 8 + size])
        at += 8 + size
    words, size, copies, step = parts
    return (np.frombuffer(words, np.int64), restored(size, np.int32), restored(copies, np.int64),
            np.cumsum(restored(step, np.int32), dtype=np.int32))


def _strips(size: np.ndarray, column: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Sets by ``ROWS`` at a time: the bounds of their rows, and row and column of their known words by column."""
    ends = np.concatenate(([0], np.cumsum(size)))
    out = []
    for x in range(0, len(size), ROWS):
        y = min(x + ROWS, len(size))
        own = column[ends[x]:ends[y]]
        row = np.repeat(np.arange(y - x, dtype=np.int32), size[x:y])
        row, own = row[own >= 0], own[own >= 0]
        order = np.argsort(own, kind="stable")
        out.append((x, y, row[order], own[order]))
    return out


def _shared(left: tuple, right: tuple, more_than: int) -> np.ndarray:
    """Which sets of two strips share more than ``more_than`` words.

    Words that both strips have go in columns of a bounded number at a time, the most frequent first. Sets of which every pair
    is settled, because it has shared enough or has too few words left, are not looked at again.
    """
    common = np.intersect1d(left[3], right[3])
    sides, heights = [], []
    for x, y, row, column in (left, right):
        at = np.searchsorted(common, column)
        at[at == len(common)] = 0
        known = common[at] == column if len(common) else np.zeros(len(column), bool)
        sides.append((row[known], at[known]))
        heights.append(y - x)
    found = np.zeros(heights, np.float32)
    rest = [np.bincount(row, minlength=n).astype(np.float32) for (row, _), n in zip(sides, heights)]
    live = [np.flatnonzero(r > more_than) for r in rest]  # others cannot share enough
    for start in range(0, len(common), COLUMNS):
        if not len(live[0]) or not len(live[1]):
            break
        width, parts = min(COLUMNS, len(common) - start), []
        for (row, column), n, own, left_over in zip(sides, heights, live, rest):
            i, j = np.searchsorted(column, (start, start + width))
            part = np.zeros((n, width), np.float32)
            part[row[i:j], column[i:j] - start] = 1.0
            left_over -= np.bincount(row[i:j], minlength=n)
            parts.append(part[own])
        cell = np.ix_(*live)
        now = found[cell] + parts[0] @ parts[1].T
        found[cell] = now
        open_pairs = (now <= more_than) & (now + np.minimum(rest[0][live[0]][:, None], rest[1][live[1]][None, :]) > more_than)
        live = [own[open_pairs.any(axis)] for own, axis in zip(live, (1, 0))]
    return found > more_than


def _sharing_pairs(blobs: list[bytes], more_than: int) -> int:
    """Weighted count of set pairs of two blocks, or inside one, that share more than ``more_than`` words."""
    blocks = [_unpacked(blob) for blob in blobs]
    # columns are numbers of the words that both blocks have, by falling number of sets
    words, side = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    cuts = np.split(side, [len(blocks[0][0])])[:len(blocks)]
    times = [np.bincount(at[b[3]], minlength=len(words)) for at, b in zip(cuts, blocks)]
    both = np.flatnonzero(np.minimum(times[0], times[-1]) > (len(blocks) == 1))
    number = np.full(len(words), -1, np.int32)
    number[both[np.argsort(-sum(times)[both], kind="stable")]] = np.arange(len(both), dtype=np.int32)
    strips = [_strips(b[1], number[at[b[3]]]) for at, b in zip(cuts, blocks)]
    weights = [b[2] for b in blocks]
    total = 0
    for i, one in enumerate(strips[0]):
        for j, two in enumerate(strips[-1]):
            if len(blocks) == 1 and j < i:
                continue
            close = _shared(one, two, more_than)
            if len(blocks) == 1 and i == j:
                close = np.triu(close, k=1)
            total += int(weights[0][one[0]:one[1]] @ (close @ weights[-1][two[0]:two[1]]))
    return total


def cohesion(
    files: DataFrame, shared_more_than: int = 5, min_chars: int = 4,
    head_chars: int | None = None, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Share of file pairs of a module that have more than five words in common.

    ``files``: repo, module, content. Words are compared by 64-bit hashes. Equal word sets are collapsed to one row
    with a count. A module is cut into blocks of bounded rows and text, each packed into one row of a few bytes a word,
    and one task at a time compares two blocks, strip by strip, and returns a single count. So pairs are never
    rows, no task holds more than two blocks, and what is sent of a block grows with the number of blocks of its module only.
    ``head_chars`` limits the text that is looked at; by default it is whole.
    """
    text = F.col("content")
    if head_chars is not None:
        text = F.substr(text, F.lit(1), F.lit(head_chars))
    module = ["repo", "module"]
    sizes = files.groupBy(*module).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).select(
        *module, F.greatest(F.lit(1), F.ceil(F.col("files") / F.lit(float(cell_rows))), F.ceil(F.col("bytes") / F.lit(CELL_MB * 1e6)))
        .cast("int").alias("k"))
    words = F.array_sort(F.array_distinct(F.transform(word_tokens(text, min_chars), lambda w: F.xxhash64(w))))
    sets = files.select(*module, words.alias("words")).groupBy(*module, "words").agg(F.count("*").alias("copies"))
    sets = salted_join(sets, sizes, module, ["words"], "left").select(
        *module, F.coalesce("k", F.lit(1)).alias("k"), F.when(F.size("words") > shared_more_than, F.col("words")).alias("words"), "copies",
        F.pmod(F.xxhash64("words"), F.coalesce("k", F.lit(1))).cast("int").alias("own"))
    kinds = [pa.field(c, to_arrow_type(files.schema[c].dataType)) for c in module]
    schema = T.StructType([*[files.schema[c] for c in module], *[T.StructField(c, t) for c, t in (
        ("own", T.IntegerType()), ("k", T.IntegerType()), ("files", T.LongType()), ("same_set", T.LongType()), ("sets", T.BinaryType()))]])

    def pack(rows: pa.Table) -> pa.Table:
        known = rows.filter(pc.is_valid(rows.column("words")))
        copies = known.column("copies").to_numpy()
        blob = _packed(known.column("words").combine_chunks(), copies) if len(known) else None
        first = rows.slice(0, 1)
        return pa.table({**{f.name: first.column(f.name) for f in kinds}, "own": first.column("own"), "k": first.column("k"),
                         "files": [pc.sum(rows.column("copies")).as_py()], "same_set": [int((copies * (copies - 1) // 2).sum())],
                         "sets": pa.array([blob], pa.binary())})

    blocks = materialize(sets.groupBy(*module, "own").applyInArrow(pack, schema), "word-blocks")
    per_module = blocks.groupBy(*module).agg(F.sum("files").alias("files"), F.sum("same_set").alias("same_set"))
    cells = blocks.filter("repo IS NOT NULL AND module IS NOT NULL AND sets IS NOT NULL").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
            *module, "own", "sets", F.least("own", "other").alias("cell_a"), F.greatest("own", "other").alias("cell_b"))
    place = [*module, "cell_a", "cell_b"]

    def count_cell(key: tuple, cell: pa.Table) -> pa.Table:
        whole = len(cell) == 2 or key[2].as_py() == key[3].as_py()  # the other block may hold no sets
        n = _sharing_pairs(cell.column("sets").to_pylist(), shared_more_than) if whole else 0
        return pa.table({**{f.name: pa.array([v.as_py()], f.type) for f, v in zip(kinds, key)}, "n": [n]})

    # few bytes are much work here, so the number of tasks does not follow the bytes
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        cells.repartition(tasks, *place).groupBy(*place)
        .applyInArrow(count_cell, T.StructType([*[files.schema[c] for c in module], T.StructField("n", T.LongType())]))
        .groupBy(*module).agg(F.sum("n").alias("across"))
    )
    shared = F.col("same_set") + F.coalesce("across", F.lit(0))
    pairs = F.col("files") * (F.col("files") - 1) / 2
    return per_module.join(counted, module, "left").select(
        *module, "files", shared.alias("sharing_pairs"),
        F.when(F.col("files") < 2, F.lit(1.0)).otherwise(shared / pairs).alias("cohesion"),
    )


def cohesion_scores(modules: DataFrame) -> DataFrame:
    """Mean module cohesion of a repository, as a percentage."""
    return modules.groupBy("repo").agg(
        round_half_up(F.avg("cohesion") * F.lit(100.0), 1).alias("cohesion_score")
    )
