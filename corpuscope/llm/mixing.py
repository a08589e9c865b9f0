"""Language-model scoring by logistic mixing of context bit predictors.

A token (a word in lower case, or the end of a text) has a code of 12 bits: six from its first three bytes, six
from the whole word. Each bit is predicted in four contexts: none, the token before, the classes of the two
tokens before, and the two tokens before, each with the bits of the code so far. The predictors' log odds are mixed by
weights that a gate selects (place of the bit, how much two of the contexts have seen), and an adaptive map refines the
mix. Given its code, a word has the add-one share of its count among the words of that code, so unseen
words have a probability too. The log-probability of a text over its length gives its bits per byte.

All counts are exact. Codes bound the first three contexts, which have a counter each; words and pairs (two tokens before,
token) grow with the input: blocks send the counts of their distinct ones to buckets of hashes and get the totals of
exactly these back. Two tokens that learning texts have followed once only predict the text they come from; no state comes
back for them, and their predictor knows nothing, as for those never met. One set of weights (Newton's method, a
round of sums per step) and one map are learned from one fold in all blocks, by counts without that fold; texts are scored by
the counts of all learning texts, that fold included.

Defined cases: null counts as empty; an empty text is its end alone; rows with a null id learn and are
not held out; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import materialize, parts_for
from corpuscope.llm.text import LOWER, NOT_SPACE, Words, mix, pack, pieces, unpack, utf8

U64 = np.uint64
BITS = 12
CLASS = 6
CHUNK = 1 << 16
NONE = 1 << BITS
CLASSES = (NONE >> BITS - CLASS) + 1
SIZES = (NONE * (NONE + 1), NONE * CLASSES * CLASSES, NONE)  # counts of the token before, two classes, no context
INPUTS = len(SIZES) + 1
GATES = 64
ROUNDS = 6
END = U64(0x454E44)
LN10 = float(np.log(10))


@dataclass
class Tokens:
    hashes: np.ndarray
    codes: np.ndarray
    text: np.ndarray  # number of the text of each token
    texts: int

    def contexts(self) -> list[np.ndarray]:
        """The token before, the classes of the two before, none, and the two before."""
        one = np.concatenate(([NONE], self.codes[:-1]))
        two = np.concatenate(([NONE, NONE], self.codes[:-2]))[: len(one)]
        first = np.concatenate(([True], self.text[1:] != self.text[:-1]))
        second = np.concatenate(([False], first[:-1]))
        one = np.where(first, NONE, one)
        two = np.where(first | second, NONE, two)
        shift = BITS - CLASS
        return [one, (one >> shift) * CLASSES + (two >> shift), np.zeros_like(one), one * 2 * NONE + two]

    def pairs(self) -> np.ndarray:
        return ((self.contexts()[-1] << BITS) | self.codes).astype(U64)

    def bit(self, depth: int) -> np.ndarray:
        return (self.codes >> (BITS - 1 - depth)) & 1


def tokens(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, Tokens]]:
    """Tokens of all texts, piece by piece, with the number of the piece's first text."""
    data, offsets = utf8(texts)
    for i, j in pieces(offsets, limit):
        part = LOWER[data[offsets[i] : offsets[j]]]
        words = Words(part, offsets[i : j + 1] - offsets[i], NOT_SPACE)
        n = len(words.starts)
        line = np.concatenate((part, np.zeros(3, np.uint8)))
        begin = np.zeros(n, U64)
        for k in range(3):
            begin |= np.where(words.starts + k < words.ends, line[words.starts + k], 0).astype(U64) << U64(8 * k)
        own = words.hashes()
        code = ((mix(begin + U64(1)) >> U64(64 - CLASS)) << U64(BITS - CLASS)) | (own >> U64(64 - BITS + CLASS))
        ends = words.bounds[1:] + np.arange(j - i)
        at = np.arange(n) + words.text
        hashes, codes, text = np.zeros(n + j - i, U64), np.zeros(n + j - i, np.int64), np.zeros(n + j - i, np.int64)
        hashes[at], codes[at], text[at] = own, code, words.text
        hashes[ends], codes[ends], text[ends] = END, 0, np.arange(j - i)
        yield i, Tokens(hashes, codes, text, j - i)


def shrunk(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob)


def grown(blob: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob.as_py())


def packed(counts: np.ndarray) -> bytes:
    """Counts as compressed byte planes; most are small."""
    return shrunk(np.ascontiguousarray(counts.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(blob: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(grown(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def states_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one in tenths (upper bits) and how often the counter was met (three bits)."""
    odds = np.clip(np.round(10 * np.log((ones + 0.3) / (zeros + 0.3))), -120, 120).astype(np.int16)
    return odds * np.int16(8) + np.minimum(7, np.log2(zeros + ones + 1)).astype(np.int16)


def count_codes(mixed: bool):
    """Codes after each context of one task: rows (chunk, whether of the fold that weights learn from, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(n, np.int32) for n in SIZES]
        for batch in batches:
            for _, own in tokens(batch.column(0)):
                for table, context in zip(counts, own.contexts()):
                    np.add.at(table, (context << BITS) | own.codes, 1)
        for which, own in enumerate(counts):
            for k in range(0, len(own), CHUNK):
                part = own[k : k + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([which * 1000 + k // CHUNK], pa.int32()), pa.array([mixed]), pa.array([packed(part)], pa.binary())],
                        ["chunk", "mixed", "counts"])

    return run


def code_states(leaves: np.ndarray) -> np.ndarray:
    """Counts of codes -> states of the bits on their ways, those of a context by a one and the bits so far."""
    leaves = leaves.reshape(-1, NONE)
    out = np.zeros(leaves.shape, np.int16)
    for depth in range(BITS):
        both = leaves.reshape(len(leaves), 1 << depth, 2, -1).sum(axis=3)
        out[:, 1 << depth : 2 << depth] = states_of(both[:, :, 0], both[:, :, 1])
    return out


def sum_codes(table: pa.Table) -> pa.Table:
    """Chunk of counts of codes -> its states without the fold that weights learn from, and what that fold adds to them."""
    sums = [np.zeros(min(n - at, CHUNK), np.int64) for at, n in [(table.column("chunk")[0].as_py() % 1000 * CHUNK,
                                                                SIZES[table.column("chunk")[0].as_py() // 1000])] for _ in range(2)]
    for mixed, blob in zip(table.column("mixed").to_pylist(), table.column("counts")):
        sums[mixed] += unpacked(blob)
    without, every = code_states(sums[0]), code_states(sums[0] + sums[1])
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "states": pa.array([shrunk(without.tobytes())], pa.binary()),
                     "added": pa.array([shrunk((every - without).tobytes())], pa.binary())})


def pair_states(pairs: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For sorted distinct pairs with their counts, the state of each bit of the pair's code in its context."""
    out = np.zeros((BITS, len(pairs)), np.int16)
    for depth in range(BITS):
        way = pairs >> U64(BITS - depth)
        first = np.flatnonzero(np.concatenate(([True], way[1:] != way[:-1])))
        bit = ((pairs >> U64(BITS - 1 - depth)) & U64(1)).astype(np.int64)
        ones, every = np.add.reduceat(total * bit, first), np.add.reduceat(total, first)
        out[depth] = np.repeat(states_of(every - ones, ones), np.diff(first, append=len(pairs)))
    return out


def thin(states: np.ndarray, codes: np.ndarray) -> bytes:
    """States of the bits of codes, seen from the bit that came and as steps from bit to bit: mostly zeros, and exact."""
    return shrunk(np.ascontiguousarray(np.diff(seen(states, codes), axis=0, prepend=np.int16(0)).view(np.uint8).reshape(BITS, -1, 2)
                                       .transpose(0, 2, 1)).tobytes())


def thick(blob: bytes, codes: np.ndarray) -> np.ndarray:
    steps = np.frombuffer(blob, np.uint8).reshape(BITS, 2, -1).transpose(0, 2, 1)
    return seen(np.cumsum(np.ascontiguousarray(steps).view(np.int16)[:, :, 0], axis=0, dtype=np.int16), codes)


def seen(states: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The log odds change their sign where the bit is zero."""
    zero = (codes.astype(np.int64) >> np.arange(BITS - 1, -1, -1)[:, None]) & 1 == 0
    return np.where(zero, -(states >> 3) * np.int16(8) + (states & 7), states)


def bucketed(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs dealt by their context, and the bounds of the buckets."""
    bucket = (mix(pairs >> U64(BITS)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return pairs[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


@dataclass
class Model:
    """Gated weights and the adaptive map."""

    weights: np.ndarray
    odds: np.ndarray

    def mixed(self, tables: list[np.ndarray], own: Tokens, pairs: np.ndarray) -> Iterator[tuple]:
        """Depth by depth the log odds of each predictor, the gate and the mix; ``pairs`` has the states of the tokens' pairs."""
        starts = [context << BITS for context in own.contexts()[: len(SIZES)]]
        for depth in range(BITS):
            node = (1 << depth) | (own.codes >> (BITS - depth))
            states = [table[start + node] for table, start in zip(tables, starts)] + [pairs[depth]]
            gate = depth * GATES + (states[0] & 7).astype(np.int64) * 8 + (states[-1] & 7)
            x = [(s >> 3).astype(np.float32) * np.float32(0.1) for s in states]
            y = x[0] * self.weights[0][gate]
            for i in range(1, INPUTS):
                y += x[i] * self.weights[i][gate]
            yield depth, x, gate - depth * GATES, np.clip(y, -12, 12, out=y)

    def log_probability(self, tables: list[np.ndarray], own: Tokens, pairs: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token's code."""
        total = np.zeros(len(own.codes), np.float32)
        for depth, _, _, y in self.mixed(tables, own, pairs):
            y = 0.5 * (y + self.odds[depth][cell_of(y)])
            total -= np.log1p(np.exp(np.where(own.bit(depth) == 1, -y, y)))
        return total


def cell_of(y: np.ndarray) -> np.ndarray:
    return np.round(y * 2).astype(np.int64) + 24


class States:
    """States of the counters of the bounded contexts, as compressed chunks that add up; a worker opens them once."""

    def __init__(self, chunks: list[tuple[int, bytes]]):
        self.chunks, self.open = chunks, None

    def tables(self) -> list[np.ndarray]:
        if self.open is None:
            tables = [np.zeros(n, np.int16) for n in SIZES]
            for chunk, blob in self.chunks:
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int16)
                at = chunk % 1000 * CHUNK
                tables[chunk // 1000][at : at + len(own)] += own
            self.open, self.chunks = tables, []
        return self.open


class Known:
    """States of the distinct pairs of texts, from the rows of their buckets, which have them in the order of ``bucketed``."""

    def __init__(self, texts: pa.ChunkedArray, rows: pa.Table, buckets: int):
        met = [np.unique(own.pairs()) for _, own in tokens(texts)]
        keys, cuts = bucketed(np.unique(np.concatenate(met)) if met else np.zeros(0, U64), buckets)
        states = np.zeros((BITS, len(keys)), np.int16)
        for b, mask, blob in zip(rows.column("bucket").to_pylist(), rows.column("hashes"), rows.column("totals")):
            x, y = cuts[b - buckets], cuts[b - buckets + 1]
            met = x + np.flatnonzero(np.unpackbits(np.frombuffer(grown(mask), np.uint8), count=y - x))
            states[:, met] = thick(grown(blob), keys[met] & U64(NONE - 1))
        order = np.argsort(keys)
        self.keys, self.states = keys[order], states[:, order]

    def of(self, own: Tokens) -> np.ndarray:
        return self.states[:, np.searchsorted(self.keys, own.pairs())]


def learning_rows(buckets: int):
    """Texts of a block that the weights learn from -> codes, text numbers and states of pairs, piece by piece."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        pairs = Known(table.column("text"), known, buckets)
        rows = [(shrunk(own.codes.astype("<u2").tobytes()), shrunk(own.text.astype("<i4").tobytes()), thin(pairs.of(own), own.codes))
                for _, own in tokens(table.column("text"))]
        return pa.table({n: pa.array([r[i] for r in rows], pa.binary()) for i, n in enumerate(("codes", "texts", "states"))})

    return run


def statistics(tables, model: Model, last: bool):
    """Sums over a task's learning rows: of each gate loss, gradient and curvature, or (``last``) the cells of the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BITS, 2, 49) if last else (BITS, 1 + INPUTS + INPUTS * INPUTS, GATES))
        for batch in batches:
            for codes, texts, states in zip(*(batch.column(i) for i in range(3))):
                own = Tokens(np.zeros(0, U64), np.frombuffer(grown(codes), "<u2").astype(np.int64),
                             np.frombuffer(grown(texts), "<i4"), 0)
                pairs = thick(grown(states), own.codes)
                for depth, x, gate, y in model.mixed(tables.value.tables(), own, pairs):
                    bit = own.bit(depth)
                    if last:
                        sums[depth] += [np.bincount(cell_of(y), bit, 49), np.bincount(cell_of(y), minlength=49)]
                        continue
                    p = 1 / (1 + np.exp(-y))
                    add = lambda w: np.bincount(gate, w, GATES)  # noqa: E731, B023
                    sums[depth, 0] += add(np.log1p(np.exp(np.where(bit == 1, -y, y))))
                    for i in range(INPUTS):
                        sums[depth, 1 + i] += add((bit - p) * x[i])
                        for j in range(i + 1):
                            power = add(p * (1 - p) * x[i] * x[j])
                            sums[depth, 1 + INPUTS + i * INPUTS + j] += power
                            if j < i:
                                sums[depth, 1 + INPUTS + j * INPUTS + i] += power
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BITS), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], ["depth", "sums"])

    return run


def sum_statistics(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"depth": table.column("depth").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def learn(rows: DataFrame, tables) -> Model:
    """Weights by Newton's method, gate by gate; a step that makes a gate's loss larger is halved."""

    def sums(model: Model, last: bool, width: int) -> np.ndarray:
        out = np.zeros((BITS, width))
        for depth, blob in rows.mapInArrow(statistics(tables, model, last), "depth int, sums binary").groupBy("depth").applyInArrow(
                sum_statistics, "depth int, sums binary").collect():
            out[depth] = np.frombuffer(blob)
        return out

    n = BITS * GATES
    prior = np.full((n, INPUTS), 0.3)
    best, loss, move, step = prior, np.full(n, np.inf), np.zeros((n, INPUTS)), np.ones(n)
    model = Model(prior.T.astype(np.float32), np.zeros((BITS, 49), np.float32))
    for _ in range(ROUNDS):
        tried = model.weights.T.astype(np.float64)
        got = sums(model, False, (1 + INPUTS + INPUTS * INPUTS) * GATES).reshape(BITS, -1, GATES).transpose(0, 2, 1).reshape(n, -1)
        now = got[:, 0] + ((tried - prior) ** 2).sum(axis=1) / 2
        good = now <= loss
        curve = got[:, 1 + INPUTS :].reshape(n, INPUTS, INPUTS) + np.eye(INPUTS)
        slope = got[:, 1 : 1 + INPUTS] - (tried - prior)
        move = np.where(good[:, None], np.linalg.solve(curve, slope[:, :, None])[:, :, 0], move)
        best, loss, step = np.where(good[:, None], tried, best), np.where(good, now, loss), np.where(good, 1.0, step / 2)
        model.weights = np.round(best + step[:, None] * move, 4).T.astype(np.float32)
    model.weights = best.T.astype(np.float32)
    cells = sums(model, True, 2 * 49).reshape(BITS, 2, 49)
    centre = 1 / (1 + np.exp(-(np.arange(49) - 24) / 2.0))
    p = np.clip((20 * centre + cells[:, 0]) / (20.0 + cells[:, 1]), 1e-6, 1 - 1e-6)
    model.odds = np.log(p / (1 - p)).astype(np.float32)
    return model


WORDS, PAIRS, MIXED_PAIRS = 0, 1, 2


def send_counts(buckets: int):
    """Block -> per bucket the block's distinct token hashes, their counts in learning texts and their codes; and its distinct
    pairs with theirs, in buckets of their own, those of texts that the weights learn from once more with their counts there."""

    def distinct(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, which = np.unique(np.concatenate(values), return_inverse=True)
        return value, np.bincount(which, np.concatenate(counts), len(value)).astype("<i8")

    def run(table: pa.Table) -> pa.Table:
        fold = np.array(table.column("fold").to_pylist())
        hashes, codes, counted, pairs, met, mixed, inside = [], [], [], [], [], [], []
        for i, own in tokens(table.column("text")):
            folds = fold[i : i + own.texts][own.text]
            value, first, which = np.unique(own.hashes, return_index=True, return_inverse=True)
            hashes.append(value)
            codes.append(own.codes[first])
            counted.append(np.bincount(which, folds != HELD, len(value)))
            pair = own.pairs()
            value, which = np.unique(pair, return_inverse=True)
            pairs.append(value)
            met.append(np.bincount(which, folds != HELD, len(value)))
            value, count = np.unique(pair[folds == MIXED], return_counts=True)
            mixed.append(value)
            inside.append(count)
        value, first = np.unique(np.concatenate(hashes), return_index=True)
        code = np.concatenate(codes)[first].astype("<u2")
        count = distinct(hashes, counted)[1]
        width = ((1 << 64) + buckets - 1) // buckets
        cuts = np.searchsorted(value, np.array([b * width for b in range(1, buckets)], U64)).tolist()
        rows = [(WORDS, b, pack(value[x:y]), count[x:y].tobytes(), code[x:y].tobytes())
                for b, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(value)])) if y > x]
        for kind, (value, count) in ((PAIRS, distinct(pairs, met)), (MIXED_PAIRS, distinct(mixed, inside))):
            dealt, cuts = bucketed(value, buckets)
            count = count[np.searchsorted(value, dealt)]
            rows += [(kind, buckets + b, shrunk(pack(dealt[x:y])), packed(count[x:y]), None)
                     for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        block = table.column("block")[0].as_py()
        names = [("kind", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())]
        out = {n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(names)}
        return pa.table({"block": pa.array([block] * len(rows), pa.int32()), **out})

    return run


def total_pairs(table: pa.Table) -> pa.Table:
    """Bucket -> which of each block's pairs have a context met twice or more, and the states of these pairs' bits.

    Pairs of texts that weights learn from get those without the counts of their fold, the others those of all learning texts."""
    keys = [unpack(grown(x)) for x in table.column("hashes")]
    edges = np.cumsum([0, *map(len, keys)])
    value, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unpacked(x) for x in table.column("counts")])
    kinds = np.array(table.column("kind").to_pylist())
    inside = np.repeat(kinds == MIXED_PAIRS, np.diff(edges))
    total = np.bincount(which, np.where(inside, 0, counts), len(value)).astype(np.int64)
    context = np.cumsum(np.diff(value >> U64(BITS), prepend=~value[:1]) != 0) - 1
    masks, blobs = [None] * len(keys), [None] * len(keys)
    for kind in (PAIRS, MIXED_PAIRS):
        rows = np.flatnonzero(kinds == kind)
        if kind == MIXED_PAIRS:
            total -= np.bincount(which, np.where(inside, counts, 0), len(value)).astype(np.int64)
        wanted = np.zeros(len(value), bool)  # by context, which are no more than pairs
        for r in rows:
            wanted[context[which[edges[r] : edges[r + 1]]]] = True
        some = np.flatnonzero(wanted[context])
        states = pair_states(value[some], total[some]) if len(some) else np.zeros((BITS, 0), np.int16)
        often = np.bincount(context, total, len(value))[context] > 1
        for r in rows:
            own = which[edges[r] : edges[r + 1]]
            masks[r] = shrunk(np.packbits(often[own]).tobytes())
            own = own[often[own]]
            blobs[r] = thin(states[:, np.searchsorted(some, own)], value[own] & U64(NONE - 1))
    return pa.table({**{n: table.column(n) for n in ("block", "kind", "bucket")}, "hashes": pa.array(masks, pa.binary()),
                     "totals": pa.array(blobs, pa.binary())})


def total_counts(table: pa.Table) -> pa.Table:
    """Bucket -> each block's hashes with their totals, and (block -1) the sums and kinds of each code."""
    if table.column("kind")[0].as_py() != WORDS:
        return total_pairs(table)
    hashes = [unpack(x.as_py()) for x in table.column("hashes")]
    counts = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("counts")])
    codes = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table.column("codes")])
    value, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.bincount(which, counts, len(value)).astype("<i8")
    every = np.bincount(codes[first], total, NONE).astype("<i8")
    kinds = np.bincount(codes[first], total > 0, NONE).astype("<i8")
    edges = np.cumsum([0, *map(len, hashes)])
    rows = [(b, WORDS, 0, h, total[which[x:y]].tobytes())
            for b, h, x, y in zip(table.column("block").to_pylist(), table.column("hashes").to_pylist(), edges[:-1], edges[1:])]
    rows.append((-1, WORDS, 0, every.tobytes(), kinds.tobytes()))
    names = [("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("totals", pa.binary())]
    return pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(names)})


HELD, MIXED = 2, 3


def score_block(tables, by_code, model: Model, buckets: int):
    """Block + the totals of its tokens and the states of its pairs -> scores of its texts."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        every, kinds = by_code.value
        n_all, v_all = int(every.sum()), int(kinds.sum())
        kind = np.array(known.column("kind").to_pylist(), int)
        pairs = Known(table.column("text"), known.filter(pa.array(kind == PAIRS)), buckets)
        known = known.filter(pa.array(kind == WORDS))
        value = np.concatenate([unpack(x.as_py()) for x in known.column("hashes")] or [np.zeros(0, U64)])
        total = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in known.column("totals")] or [np.zeros(0, np.int64)])
        order = np.argsort(value)
        value, total = value[order], total[order]
        fold = np.array(table.column("fold").to_pylist())
        n_tokens, n_known, base, score = [], [], [], []
        for _, own in tokens(table.column("text")):
            count = total[np.searchsorted(value, own.hashes)]
            per = lambda w: np.bincount(own.text, w, own.texts)  # noqa: E731, B023
            n_tokens.append(np.bincount(own.text, minlength=own.texts))
            n_known.append(per(count > 0).astype(np.int64))
            base.append(per(np.log10((count + 1) / (n_all + v_all + 1))))
            inside = np.log((count + 1) / (every[own.codes] + kinds[own.codes] + 1))
            score.append(per(model.log_probability(tables.value.tables(), own, pairs.of(own)) + inside) / LN10)
        join = lambda x, kind: pa.array(np.concatenate(x).astype(kind))
        return pa.table({
            "id": table.column("id"), "held_out": pa.array(fold == HELD), "n_tokens": join(n_tokens, np.int64),
            "n_known": join(n_known, np.int64), "train_tokens": pa.array(np.full(len(fold), n_all)),
            "base_score": join(base, np.float64), "score": join(score, np.float64),
            "bits_per_byte": pa.array(-np.concatenate(score) * LN10 / np.log(2) / np.maximum(1, np.diff(utf8(table.column("text"))[1]))),
        })

    return run


def fold_of(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7, F.lit(0)).cast("int")


def mixing_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_mb: float = 6.0) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts whose fold is 2 are held out. A block is about ``block_mb`` MB of stored input, held by one task.
    """
    spark = docs.sparkSession
    blocks = parts_for(docs, text_col, block_mb)
    source = docs.select(F.col(id_col).alias("id"), fold_of(F.col(id_col)).alias("fold"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    counted = [source.filter((F.col("fold") != HELD) & ((F.col("fold") == MIXED) == mixed)).select("text")
               .mapInArrow(count_codes(mixed), "chunk int, mixed boolean, counts binary") for mixed in (False, True)]
    chunks = counted[0].union(counted[1]).groupBy("chunk").applyInArrow(
        sum_codes, "chunk int, states binary, added binary").collect()  # sum(SIZES) states of 16 bits, and steps to the others
    without = [(row["chunk"], bytes(row["states"])) for row in chunks]
    added = [(row["chunk"], bytes(row["added"])) for row in chunks]
    del chunks
    states = spark.sparkContext.broadcast(States(without))
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", F.crc32(F.col("text").cast("binary"))), F.lit(blocks)).cast("int"))
    by_block = dealt.repartition(blocks, "block").groupBy("block")
    counts = materialize(
        by_block.applyInArrow(send_counts(blocks), "block int, kind int, bucket int, hashes binary, counts binary, codes binary")
        .groupBy("bucket").applyInArrow(total_counts, "block int, kind int, bucket int, hashes binary, totals binary"), "token-counts")
    every, kinds = np.zeros(NONE, np.int64), np.zeros(NONE, np.int64)
    for a, b in counts.filter("block = -1").select("hashes", "totals").toLocalIterator():  # one row per bucket, added up as they come
        every += np.frombuffer(a, "<i8")
        kinds += np.frombuffer(b, "<i8")
    by_code = spark.sparkContext.broadcast((every, kinds))
    mixed = materialize(
        dealt.filter(F.col("fold") == MIXED).repartition(blocks, "block").groupBy("block")
        .cogroup(counts.filter((F.col("block") >= 0) & (F.col("kind") == MIXED_PAIRS)).groupBy("block"))
        .applyInArrow(learning_rows(blocks), "codes binary, texts binary, states binary"), "mixing-rows")
    model = learn(mixed, states)
    states.unpersist()
    states = spark.sparkContext.broadcast(States(without + added))
    schema = (f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double, bits_per_byte double")
    return by_block.cogroup(counts.filter((F.col("block") >= 0) & (F.col("kind") != MIXED_PAIRS)).groupBy("block")).applyInArrow(
        score_block(states, by_code, model, blocks), schema).withColumnRenamed("id", id_col)
