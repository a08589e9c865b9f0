"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

Both tokenizers cut the same bytes; their token ends are two sorted lists. Merging them walks a path through the grid of A ends and B ends,
one step per end. ``diagonals`` finds by binary search where the path crosses evenly spaced diagonals, so the merge falls into independent pieces
of equal work, wherever documents begin: a long document is shared by several pieces, many short ones share one. Each piece emits its
overlaps: between two neighbouring ends lies one pair of tokens. An end that both lists have closes a group; where the
two equal ends fall into different pieces, or a group runs over pieces, the pieces are stitched.

A pass over the documents encodes and merges them and writes one row per document (counts and digest of its groups) and one
row per run of pieces: its distinct id pairs, how many links hold each, and for each of its documents how often which of them. Spark sums
the pairs and finds each B id's highest count, the runs get back what they asked for, and sum it per document.

Encoding cuts a text at spaces between two characters that are no white space, which no token of either tokenizer crosses, and keeps the
ids of the stretches it has seen, up to a bound. Tokenizers for which that does not hold encode whole texts.

Defined cases: null and empty texts, and texts whose tokens do not join to a space and the text, have no tokens, zeros
and an empty digest; repeated rows and null ids are rows of their own; empty tables give no rows; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import materialize
from corpuscope.llm.text import pieces, utf8

#: steps of one piece, and links of one written run of pieces
STEPS, LINKS = 1 << 15, 1 << 21
#: bytes of text encoded together
CHUNK = 2 << 20
MEMO = 250_000
#: stretches encoded side by side in one call
JOINED = 512
#: first bytes of characters beyond ASCII that may be white space
MAYBE_SPACE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def byte_level_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Two tokenizers, the bytes of their tokens, and a bounded memo of encoded stretches."""

    made: dict[tuple[str, str], Pair] = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = byte_level_bytes()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        pieces_b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_b)]
        self.sizes = [np.array([len(t) for t in names], np.int64) for names in (self.a_bytes, self.b_bytes)]
        # no A token spans a space after another character, and no B piece has one inside
        before = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        self.cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and self.a.normalizer is None
            and not any("▁" in p.lstrip("▁") for p in pieces_b))
        self.memo: dict[bytes, int] = {}
        self.reset()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Pair:
        """One pair per worker process and files."""
        if (a_path, b_path) not in cls.made:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls.made[a_path, b_path] = cls(a_path, b_path)
        return cls.made[a_path, b_path]

    def reset(self) -> None:
        self.memo.clear()
        self.stored = [Ragged(), Ragged()]
        self.good = bytearray()

    def stretches(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where stretches begin in texts that start at ``starts`` with a space each."""
        if not self.cuts or len(data) < 4:
            return starts
        solid = data > 0x20
        cut = np.zeros(len(data), bool)
        # the character before ends in a byte beyond ASCII: it is white space only if its first byte may be
        before = solid.copy()
        before[1:] &= ~((data[1:] >= 0x80) & MAYBE_SPACE[data[:-1]])
        before[2:] &= ~((data[2:] >= 0x80) & MAYBE_SPACE[data[:-2]])
        cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & solid[2:] & ~MAYBE_SPACE[data[2:]]
        cut[starts] = True
        return np.flatnonzero(cut)

    def found(self, raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """A ids and B ids of texts that begin with a space, and whether both join to the text."""
        texts = [r.decode() for r in raw]
        found_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        found_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [
            (np.array(a, np.int32), np.array(b, np.int32),
             b"".join(map(self.a_bytes.__getitem__, a)) == r and b"".join(map(self.b_bytes.__getitem__, b)) == r)
            for r, a, b in zip(raw, found_a, found_b)]

    def keep(self, raw: list[bytes], ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], good: bool) -> None:
        """Remember stretches: the ids of all of them, and behind which of these each one ends."""
        self.memo.update(zip(raw, range(len(self.good), len(self.good) + len(raw))))
        self.good.extend([good] * len(raw))
        for stored, x, end in zip(self.stored, ids, ends):
            stored.add(x, end)

    def learn(self, new: list[bytes]) -> None:
        """Encode stretches, each beginning with a space: those that may stand side by side in one text, the others alone."""
        size = np.fromiter(map(len, new), np.int64, len(new))
        start = np.cumsum(size) - size
        cut = np.isin(start, self.stretches(np.frombuffer(b"".join(new), np.uint8), start[:1]))
        fits = (cut & np.append(cut[1:], True) & self.cuts).tolist()
        side, alone = [s for s, ok in zip(new, fits) if ok], [s for s, ok in zip(new, fits) if not ok]
        parts = [side[i : i + JOINED] for i in range(0, len(side), JOINED)]
        for part, (a, b, good) in zip(parts, self.found([b"".join(part) for part in parts])):
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            at = [np.cumsum(sizes[ids]) for sizes, ids in zip(self.sizes, (a, b))]
            places = [np.searchsorted(x, ends) for x in at]
            if good and all((x[p] == ends).all() for x, p in zip(at, places)):
                self.keep(part, (a, b), tuple(p + 1 for p in places), True)
            else:
                alone += part
        for raw, (a, b, good) in zip(alone, self.found(alone)):
            self.keep([raw], (a, b), (np.array([len(a)]), np.array([len(b)])), good)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """A ids and B ids of non-empty texts that begin with a space, the tokens of each text, and which texts are whole."""
        begin = self.stretches(data, offsets[:-1])
        body, ends = data.tobytes(), np.append(begin[1:], len(data))
        raw = [body[i:j] for i, j in zip(begin.tolist(), ends.tolist())]
        new = list(set(raw).difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.reset()
            new = list(set(raw))
        self.learn(new)
        slots = np.fromiter(map(self.memo.__getitem__, raw), np.int64, len(raw))
        first = np.searchsorted(begin, offsets[:-1])
        whole = np.minimum.reduceat(np.frombuffer(self.good, np.uint8)[slots], first).astype(bool)
        (a, n_a), (b, n_b) = (s.take(slots) for s in self.stored)
        return a, b, np.add.reduceat(n_a, first), np.add.reduceat(n_b, first), whole


class Ragged:
    """Lists of small numbers, appended many at a time and taken by their places."""

    def __init__(self):
        self.flat, self.ends, self.total = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0

    def add(self, values: np.ndarray, ends: np.ndarray) -> None:
        """Lists one behind the other, and where each ends in ``values``."""
        self.flat.append(values)
        self.ends.append(ends + self.total)
        self.total += len(values)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = np.concatenate(self.flat), np.concatenate(self.ends)
        self.flat, self.ends = [flat], [ends]
        size = ends[at + 1] - ends[at]
        shift = np.repeat(ends[at] - (np.cumsum(size) - size), size)
        return flat[shift + np.arange(len(shift))], size


def diagonals(a: np.ndarray, b: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """A ends and B ends merged before each of the evenly spaced diagonals; of equal ends A's comes first."""
    total = len(a) + len(b)
    d = np.linspace(0, total, max(1, -(-total // each)) + 1).astype(np.int64)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        i = (low + high) // 2
        j = d - i - 1
        # A's end i comes before B's end j: the path crosses the diagonal further along A
        ahead = (low < high) & (a[np.minimum(i, len(a) - 1)] <= b[np.clip(j, 0, len(b) - 1)])
        low, high = np.where(ahead, i + 1, low), np.where(ahead | (low >= high), high, i)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, last_a: int) -> tuple[np.ndarray, ...]:
    """One piece's overlaps in order: A token, B token, end, and whether both end there.

    ``last_a`` is the A end before the piece: a B end equal to it closes an overlap that the piece before has emitted.
    Tokens are counted from the piece's first; the last one may be the token behind its ends.
    """
    j = np.searchsorted(b, a)  # B ends before each A end
    i = np.searchsorted(a, b)
    met = np.zeros(len(b), bool)
    if len(a):
        met = a[np.minimum(i, len(a) - 1)] == b
    own = ~met & (b != last_a)
    also = np.zeros(len(a), bool)
    also[i[met]] = True
    ends = np.concatenate([a, b[own]])
    order = np.argsort(ends, kind="stable")
    return (np.concatenate([np.arange(len(a)), i[own]])[order], np.concatenate([j, np.flatnonzero(own)])[order],
            ends[order], np.concatenate([also, np.zeros(own.sum(), bool)])[order])


def merged(a: np.ndarray, b: np.ndarray, before_a: int = 0, each: int = STEPS) -> tuple[np.ndarray, ...]:
    """All overlaps of two lists of ends, piece by piece and stitched: A token, B token, end, whether both end there."""
    at_a, at_b = diagonals(a, b, each)
    found = []
    for i, j, m, n in zip(at_a[:-1].tolist(), at_b[:-1].tolist(), at_a[1:].tolist(), at_b[1:].tolist()):
        last = int(a[i - 1]) if i else before_a
        x, y, end, both = overlaps(a[i:m], b[j:n], last)
        if n < len(b) and m and m > i and b[n] == a[m - 1]:  # the equal B end is the first of a later piece
            both[end == b[n]] = True
        found.append((x + i, y + j, end, both))
    return tuple(np.concatenate(c) for c in zip(*found))


def digits(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to top - 1, and which of them are there."""
    width = len(str(max(0, top - 1)))
    shown = np.frombuffer("".join(f"{i:<{width}}" for i in range(top)).encode(), np.uint8).reshape(top, width)
    return shown, shown != 0x20


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def group_texts(a_ids: np.ndarray, b_ids: np.ndarray, a_of: np.ndarray, b_of: np.ndarray, top: int) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;`` of all groups, and where each group's text ends; a_of and b_of are the tokens' groups, ascending."""
    if top not in _DIGITS:
        _DIGITS[top] = digits(top)
    shown, there = _DIGITS[top]
    n = int(a_of[-1]) + 1
    a_size, b_size = np.bincount(a_of, minlength=n), np.bincount(b_of, minlength=n)
    a_at = np.arange(len(a_ids)) + np.repeat(np.cumsum(b_size) - b_size, a_size)
    b_at = np.arange(len(b_ids)) + np.repeat(np.cumsum(a_size), b_size)
    ids = np.empty(len(a_ids) + len(b_ids), np.int32)
    ids[a_at], ids[b_at] = a_ids, b_ids
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[a_at[np.cumsum(a_size) - 1]] = ord("|")
    mark[b_at[np.cumsum(b_size) - 1]] = ord(";")
    width = shown.shape[1]
    out, keep = np.empty((len(ids), width + 1), np.uint8), np.ones((len(ids), width + 1), bool)
    out[:, :width], keep[:, :width], out[:, width] = shown[ids], there[ids], mark
    ends = np.cumsum(keep.sum(1))[b_at[np.cumsum(b_size) - 1]]
    return out[keep].tobytes(), ends


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    table = pa.table({str(i): pa.array([x.tobytes()], pa.binary()) for i, x in enumerate(arrays)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    row = pa.ipc.open_stream(blob).read_all()
    return [np.frombuffer(row.column(i)[0].as_py(), kind) for i, kind in enumerate(kinds)]


ENCODED = (
    "id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, "
    "piece long, pairs binary, blob binary")


def histograms(codes: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """A run's distinct pairs with their links; and per document the places of its pairs in that list, and its links of each."""
    pairs, place, links = np.unique(codes, return_inverse=True, return_counts=True)
    rows, which = np.unique(docs, return_inverse=True)
    met, count = np.unique(which * len(pairs) + place, return_counts=True)
    which, place = met // len(pairs), met % len(pairs)
    size = np.bincount(which, minlength=len(rows))
    steps = np.diff(place, prepend=0)
    first = np.cumsum(size) - size
    steps[first] = place[first]
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy() for x in (steps, count)]
    return (squeeze(np.diff(pairs, prepend=0).astype("<i8"), links.astype("<i8")),
            squeeze(rows.astype("<i8"), size.astype("<i8"), *planes))


def read_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, links = unsqueeze(blob, "<i8", "<i8")
    return np.cumsum(steps), links


def read_histograms(blob: bytes) -> tuple[np.ndarray, ...]:
    """Documents' rows, how many pairs each has, their places and counts."""
    rows, size, *planes = unsqueeze(blob, "<i8", "<i8", "u1", "u1")
    steps, count = (np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for x in planes)
    total = np.cumsum(steps)
    first = np.cumsum(size) - size
    before = total[first] - steps[first]
    return rows, size, total - np.repeat(before, size), count


def encoded(source: DataFrame, a_path: str, b_path: str, steps: int, links: int, chunk: int) -> DataFrame:
    """Rows of documents and rows of runs of pieces (with a number); source has row, id, text."""

    def document_rows(pair, numbers, data, offsets) -> tuple[list, list]:
        n = len(offsets) - 1
        rows = {i: [0, 0, 0, 0, ""] for i in range(n)}
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full):
            return list(rows.values()), []
        # a space before each text that is not empty
        size = np.diff(offsets)[full] + 1
        starts = np.concatenate([[0], np.cumsum(size)])
        spaced = np.insert(data, offsets[full], 0x20)
        cuts = [*pieces(starts)]
        parts = [pair.encode(spaced[starts[i] : starts[j]], starts[i : j + 1] - starts[i]) for i, j in cuts]
        a, b, n_a, n_b, whole = (np.concatenate(c) for c in zip(*parts))
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        full, size, n_a, n_b = full[whole], size[whole], n_a[whole], n_b[whole]
        if not len(full):
            return list(rows.values()), []
        size_a, size_b = pair.sizes
        end_a, end_b, stop = np.cumsum(size_a[a]), np.cumsum(size_b[b]), np.cumsum(size)
        x, y, end, both = merged(end_a, end_b, 0, steps)
        closed = end[both]
        text, text_ends = group_texts(
            a, b, np.searchsorted(closed, end_a), np.searchsorted(closed, end_b), max(len(pair.a_bytes), len(pair.b_bytes)))
        groups_to, links_to = np.searchsorted(closed, stop, "right"), np.searchsorted(end, stop, "right")
        begin = 0
        for k, doc in enumerate(full.tolist()):
            till = int(text_ends[groups_to[k] - 1])
            rows[doc] = [int(n_a[k]), int(n_b[k]), int(groups_to[k] - (groups_to[k - 1] if k else 0)),
                         int(links_to[k] - (links_to[k - 1] if k else 0)), hashlib.sha256(text[begin : till - 1]).hexdigest()]
            begin = till
        codes, docs = a[x].astype(np.int64) << 32 | b[y], numbers[full][np.searchsorted(stop, end)]
        cuts = np.linspace(0, len(codes), max(1, -(-len(codes) // links)) + 1).astype(np.int64)
        found = [histograms(codes[i:j], docs[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
        return list(rows.values()), found

    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, made = Pair.of(a_path, b_path), 0
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in pieces(offsets, chunk):
                rows, found = document_rows(
                    pair, batch.column(0).slice(i, j - i).to_numpy(), data[offsets[i] : offsets[j]],
                    offsets[i : j + 1] - offsets[i])
                n = len(found)
                columns = [[*column, *[None] * n] for column in zip(*rows)]
                number = [(TaskContext.get().partitionId() << 32) + made + p for p in range(n)]
                made += n
                blank = [None] * len(rows)
                ids = pa.concat_arrays([batch.column(1).slice(i, j - i), pa.nulls(n, batch.column(1).type)])
                yield pa.RecordBatch.from_arrays([
                    ids, *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()),
                    pa.array([*batch.column(0).slice(i, j - i).to_pylist(), *[None] * n], pa.int64()),
                    pa.array(blank + number, pa.int64()), pa.array(blank + [f[0] for f in found], pa.binary()),
                    pa.array(blank + [f[1] for f in found], pa.binary()),
                ], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "piece", "pairs", "blob"])

    return source.mapInArrow(run, ENCODED.format(kind))


def tokenizer_alignment(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS,
    links: int = LINKS, chunk: int = CHUNK,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level tokenizers file, ``b_path`` a sentencepiece model that adds a space.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    known = materialize(encoded(source, a_path, b_path, steps, links, chunk), "encoded")
    parts = known.filter("piece IS NOT NULL")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs, n = read_pairs(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), piece)), pa.array(pairs), pa.array(n)], ["piece", "pair", "n"])

    wants = materialize(parts.select("piece", "pairs").mapInArrow(asked, "piece long, pair long, n long"), "piece-pairs")
    pairs = wants.groupBy("pair").agg(F.sum("n").alias("count"))
    best = pairs.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("most"))
    rated = materialize(
        pairs.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(best, "b")
        .select("pair", "count", (F.col("count") == F.col("most")).alias("is_best")), "pair-counts")
    answers = wants.select("piece", "pair").join(rated, "pair")

    def rate(run: pa.Table, given: pa.Table) -> pa.Table:
        code, count, best = (given.column(c).to_numpy() for c in ("pair", "count", "is_best"))
        order = np.argsort(code)  # as the run's list of pairs is
        count, best = count[order], best[order].astype(np.int64)
        rows, size, place, links = read_histograms(run.column("blob")[0].as_py())
        first = np.cumsum(size) - size
        return pa.table({"row": rows, "n_best": np.add.reduceat(best[place] * links, first),
                         "count_sum": np.add.reduceat(count[place] * links, first)})

    sums = (
        parts.select("piece", "blob").groupBy("piece").cogroup(answers.groupBy("piece"))
        .applyInArrow(rate, "row long, n_best long, count_sum long")
        .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return known.filter("piece IS NULL").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
