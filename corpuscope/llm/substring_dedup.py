"""Substring deduplication with suffix automata of reference shards.

Documents are dealt into blocks of ascending ids. Every block's window hashes meet once, bucket by
bucket, which shows for each repeated window the first block that holds it. That block sends the words of its shared
windows, once each, to every block that repeats them: the reference shard of that block. A block builds the suffix
automaton of its shard, streams its documents through it in order of their ids for matching statistics, and adds the
spans that its own documents share to the automaton as it goes. Where the longest match reaches ``length``
words, the window is repeated, and all its words are removed.

A plain broadcast of all shards to all documents would read the corpus once per shard; the window
hashes (sorted, as differences in byte planes) decide beforehand which spans go where. They only
choose candidates: words are removed only where the automaton finds them again. Copies of one span travel to blocks, not to
documents, so a passage that a third of all documents share is sent once per block.

Defined cases: null texts have no words; null ids neither remove nor lose anything; rows of equal id never
count against each other; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import parts_for
from corpuscope.llm.text import NOT_SPACE, Words, pack, pieces, unpack, utf8, windows

U64 = np.uint64


class Automaton:
    """Suffix automaton over word numbers. Most states have one way on; only others get a dict."""

    def __init__(self):
        self.word, self.to, self.link, self.length = [-1], [-1], [-1], [0]
        self.more: dict[int, dict[int, int]] = {}

    def step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(word, -1)

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _clone(self, p: int, word: int, q: int) -> int:
        new = len(self.link)
        self.word.append(self.word[q])
        self.to.append(self.to[q])
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self.step(p, word) == q:
            self._set(p, word, new)
            p = self.link[p]
        return new

    def add(self, words: list[int]) -> None:
        """Take in one more sequence; matches never run across two sequences."""
        last = 0
        for w in words:
            q = self.step(last, w)
            if q >= 0:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
                continue
            new = len(self.link)
            self.word.append(-1)
            self.to.append(-1)
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and self.step(p, w) < 0:
                self._set(p, w, new)
                p = self.link[p]
            if p >= 0:
                q = self.step(p, w)
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
            last = new

    def matches(self, words: list[int]) -> list[int]:
        """Matching statistics: the longest match that ends at each word."""
        state, n, out = 0, 0, []
        for w in words:
            q = self.step(state, w)
            while q < 0 and state:
                state = self.link[state]
                n = self.length[state]
                q = self.step(state, w)
            if q >= 0:
                state, n = q, n + 1
            out.append(n)
        return out


def block_of(id_col: Column, bounds: list[int]) -> Column:
    """Number of bounds below an id, by binary search; -1 for null."""
    if not bounds:
        return F.when(id_col.isNull(), F.lit(-1)).otherwise(F.lit(0))
    bits = len(bounds).bit_length()
    padded = F.lit(bounds + [2**63 - 1] * ((1 << bits) - len(bounds)))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.element_at(padded, at + step) < id_col, at + step).otherwise(at))
    return F.when(id_col.isNull(), F.lit(-1)).otherwise(found)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the bounds of each text in them."""
    data, offsets = utf8(texts)
    hashes, bounds, done = [], [np.zeros(1, np.int64)], 0
    for i, j in pieces(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
        hashes.append(words.hashes())
        bounds.append(words.bounds[1:] + done)
        done += len(words.starts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate(bounds)


def runs(at: np.ndarray, length: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Maximal spans [begin, end) of words covered by windows that begin at ascending places, group by group."""
    if not len(at):
        return []
    new = np.diff(at) != 1
    if groups is not None:
        new |= np.diff(groups) != 0
    cut = np.flatnonzero(new)
    return list(zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.concatenate((cut, [len(at) - 1]))] + length).tolist()))


def send_hashes(length: int, buckets: int):
    """Block -> one row per bucket with the block's distinct window hashes of that bucket."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        out = {"bucket": [], "block": [], "hashes": []}
        if block >= 0:
            found = np.unique(windows(*hashed(table.column("text")), length)[0])
            width = ((1 << 64) + buckets - 1) // buckets
            cuts = np.searchsorted(found, np.array([b * width for b in range(1, buckets)], U64)).tolist()
            for b, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(found)])):
                if y > x:
                    out["bucket"].append(b)
                    out["block"].append(block)
                    out["hashes"].append(pack(found[x:y]))
        return pa.table(out, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary())]))

    return run


def meet(table: pa.Table) -> pa.Table:
    """Bucket -> for each first block its shared hashes and the blocks that repeat them."""
    hashes = [unpack(x.as_py()) for x in table.column("hashes")]
    block = np.repeat(table.column("block").to_numpy(), [len(h) for h in hashes])
    value = np.concatenate(hashes)
    order = np.lexsort((block, value))
    value, block = value[order], block[order]
    begin = np.concatenate(([True], value[1:] != value[:-1]))
    owner = block[np.flatnonzero(begin)][np.cumsum(begin) - 1]
    value, block, owner = value[~begin], block[~begin], owner[~begin]
    order = np.lexsort((value, owner))
    value, block, owner = value[order], block[order], owner[order]
    owners, cuts = np.unique(owner, return_index=True)
    rows = [(int(o), pack(value[a:b]), block[a:b].astype("<i4").tobytes())
            for o, a, b in zip(owners, cuts, [*cuts[1:], len(owner)])]
    names = [("block", pa.int32()), ("hashes", pa.binary()), ("to", pa.binary())]
    return pa.table({n: [r[i] for r in rows] for i, (n, _) in enumerate(names)}, pa.schema(names))


def send_words(length: int):
    """First block + its shared hashes -> one row per repeating block: words of the shared spans, and their lengths."""

    def run(table: pa.Table, wanted: pa.Table) -> pa.Table:
        names = pa.schema([("block", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary())])
        out = {"block": [], "words": [], "lengths": []}
        if wanted.num_rows and table.num_rows:
            words, bounds = hashed(table.column("text"))
            value, first = windows(words, bounds, length)
            value, at = np.unique(value, return_index=True)
            first = first[at]
            asked = np.concatenate([unpack(x.as_py()) for x in wanted.column("hashes")])
            to = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in wanted.column("to")])
            place = first[np.searchsorted(value, asked)]
            order = np.lexsort((place, to))
            place, to = place[order], to[order]
            targets, cuts = np.unique(to, return_index=True)
            for t, a, b in zip(targets.tolist(), cuts, [*cuts[1:], len(to)]):
                spans = runs(place[a:b], length)
                out["block"].append(t)
                out["words"].append(np.concatenate([words[x:y] for x, y in spans]).tobytes())
                out["lengths"].append(np.array([y - x for x, y in spans], "<i4").tobytes())
        return pa.table(out, names)

    return run


def stream(length: int, texts_out: bool):
    """Block + its reference shard -> the results of its documents."""

    def run(table: pa.Table, shard: pa.Table) -> pa.Table:
        n = table.num_rows
        words, bounds = hashed(table.column("text"))
        removed = np.zeros(len(words), bool)
        if n and table.column("block")[0].as_py() >= 0:
            value, first = windows(words, bounds, length)
            lengths = [np.frombuffer(x.as_py(), "<i4") for x in shard.column("lengths")]
            others = [np.frombuffer(x.as_py(), U64) for x in shard.column("words")]
            lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int32)
            others = np.concatenate(others) if others else np.zeros(0, U64)
            edges = np.concatenate(([0], np.cumsum(lengths)))
            known = np.unique(windows(others, edges, length)[0])
            _, which, count = np.unique(value, return_inverse=True, return_counts=True)
            local = count[which] > 1
            near = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
            candidate = local | (known[near] == value if len(known) else False)
            asked = first[candidate]
            spans = runs(asked, length)
            inside = np.zeros(len(words) + 1, np.int32)
            for a, b in spans:
                inside[a] += 1
                inside[b] -= 1
            needed = np.flatnonzero(np.cumsum(inside[:-1]))
            _, numbers = np.unique(np.concatenate((others, words[needed])), return_inverse=True)
            automaton = Automaton()
            other = numbers[: len(others)].tolist()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                automaton.add(other[a:b])
            number = np.zeros(len(words), np.int64)
            number[needed] = numbers[len(others) :]
            repeats = np.zeros(len(words), bool)
            repeats[first[local]] = True
            begins = np.array([a for a, _ in spans], np.int64)
            ids = np.array(table.column("id").to_pylist())
            order = np.argsort(ids, kind="stable")
            done = 0
            while done < n:
                same = done
                fresh = []
                while same < n and ids[order[same]] == ids[order[done]]:
                    d = order[same]
                    low, high = np.searchsorted(begins, (bounds[d], bounds[d + 1]))
                    for a, b in spans[low:high]:
                        longest = np.array(automaton.matches(number[a:b].tolist()))
                        ends = np.flatnonzero(longest >= length)  # windows found again, by their last word
                        mark = np.zeros(b - a + 1, np.int32)
                        np.add.at(mark, ends - length + 1, 1)
                        np.add.at(mark, ends + 1, -1)
                        removed[a:b] |= np.cumsum(mark[:-1]) > 0
                        new = repeats[a : b - length + 1].copy()
                        new[ends - length + 1] = False
                        fresh += runs(np.flatnonzero(new) + a, length)
                    same += 1
                for a, b in fresh:
                    automaton.add(number[a:b].tolist())
                done = same
        return results(table, bounds, removed, texts_out)

    return run


def results(table: pa.Table, bounds: np.ndarray, removed: np.ndarray, texts_out: bool) -> pa.Table:
    sums = np.concatenate(([0], np.cumsum(removed)))
    gone = sums[bounds[1:]] - sums[bounds[:-1]]
    kept = []
    for d, text in enumerate(table.column("text")):
        words = (text.as_py() or "").encode().split()
        if gone[d]:
            words = [w for w, r in zip(words, removed[bounds[d] : bounds[d + 1]].tolist()) if not r]
        kept.append(b" ".join(words))
    out = [table.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(gone.astype(np.int64)),
           pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
    names = ["id", "n_words", "n_removed", "kept_sha256"]
    if texts_out:
        out.append(pa.array([k.decode() for k in kept]))
        names.append("kept_text")
    return pa.table(out, names)


def substring_dedup(
    docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", block_mb: float = 5.0,
    texts_out: bool = True,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, with ``texts_out``, kept_text.

    A block is about ``block_mb`` MB of stored input; it is what one task holds.
    """
    blocks = parts_for(docs, text_col, block_mb)
    bounds = sorted({int(x) for x in docs.approxQuantile(id_col, [i / blocks for i in range(1, blocks)], 0.2 / blocks)}) \
        if blocks > 1 else []
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = source.withColumn("block", block_of(F.col("id"), bounds)).repartition(blocks, "block")
    by_block = dealt.groupBy("block")
    hashes = by_block.applyInArrow(send_hashes(length, blocks), "bucket int, block int, hashes binary")
    shared = hashes.groupBy("bucket").applyInArrow(meet, "block int, hashes binary, to binary")
    shards = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        send_words(length), "block int, words binary, lengths binary")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts_out else "")
    return by_block.cogroup(shards.groupBy("block")).applyInArrow(
        stream(length, texts_out), schema).withColumnRenamed("id", id_col)
