"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

The items are indexed; every passage of every document (``size`` words, each half overlapping the next) is a query. An
item's weights are divided by ``share`` of its own score, so one threshold of 1 retrieves all items
of which a passage holds that share. Most passages fall to a bound: the sum of their terms' greatest weights. The
others go on if the greatest weights of some block of items reach the threshold, and then walk the posting lists by
block-max WAND. What is retrieved is verified in the document around
the passage: ``contain`` of the item's five-word shingles, and the words of its question and of its answer.

The index is built in blocks of at most ``block_mb`` MB of item text, one pass over the documents each.

Defined cases: null texts have no words and match nothing; items of under five words are one shingle; equal items
are all reported; repeated rows are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.text import ALPHANUMERIC, LOWER, Words, mix, pieces, utf8, windows

U64 = np.uint64
K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK = 4


def question_and_answer(text: str) -> tuple[str, str]:
    """The part up to a question mark or else up to the last sentence, and the rest."""
    body = text.strip()
    cut = body.rfind("?") + 1
    if not 0 < cut < len(body):
        ends = [m.end() for m in re.finditer(r"[.!?\n]\s*(?=\S)", body)]
        cut = ends[-1] if ends else len(body)
    return body[:cut], body[cut:]


def word_hashes(text: str) -> np.ndarray:
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return Words(raw, np.array([0, len(raw)]), ALPHANUMERIC).hashes()


def shingles(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return windows(words, bounds, SHINGLE)[0]


class Index:
    """Posting lists by term with the greatest weight of each list and of each block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float, size: int):
        words = [word_hashes(t or "") for _, t in items]
        kept = [i for i, w in enumerate(words) if len(w)]
        self.ids = [items[i][0] for i in kept]
        self.words = [words[i] for i in kept]
        self.shingles, self.parts = [], []
        for i, w in zip(kept, self.words):
            n = len(w)
            self.shingles.append(np.unique(shingles(w, np.array([0, n])) if n >= SHINGLE else mix(w.sum(keepdims=True))))
            self.parts.append([np.unique(word_hashes(x)) for x in question_and_answer(items[i][1])])
        lengths = np.array([len(w) for w in self.words])
        average = lengths.mean() if len(lengths) else 1.0
        self.terms = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, U64)
        item, term, count = [], [], []
        for i, w in enumerate(self.words):
            t, n = np.unique(w, return_counts=True)
            item.append(np.full(len(t), i))
            term.append(np.searchsorted(self.terms, t))
            count.append(n)
        item, term, count = (np.concatenate(x) if x else np.zeros(0, int) for x in (item, term, count))
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((len(self.words) - df + 0.5) / (df + 0.5))
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[item] / average))
        own = np.bincount(item, weight, len(self.words))
        # of a long item a passage can hold a part only
        least = share * own * np.minimum(1.0, (size / 2) / np.maximum(lengths, 1))
        self.least = least
        weight = weight / least[item]
        order = np.lexsort((item, term))
        item, term, weight = item[order], term[order], weight[order]
        cut = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.lists = [item[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
        self.weights = [weight[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
        self.top = np.maximum.reduceat(weight, cut[:-1]) if len(weight) else np.zeros(0)
        self.blocks: list[dict[int, float]] = []
        for own_items, own_weights in zip(self.lists, self.weights):
            best: dict[int, float] = {}
            for i, w in zip(own_items, own_weights):
                best[i // BLOCK] = max(w, best.get(i // BLOCK, 0.0))
            self.blocks.append(best)
        self.block_cuts = np.cumsum([0, *(len(b) for b in self.blocks)])
        self.block_ids = np.array([i for b in self.blocks for i in b], np.int64)
        self.block_tops = np.array([w for b in self.blocks for w in b.values()])

    def reach(self, passage: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Passages (of n, given as pairs with their terms) that may hold an item: some block's greatest weights sum to 1."""
        first, size = self.block_cuts[terms], self.block_cuts[terms + 1] - self.block_cuts[terms]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        width = len(self.ids) // BLOCK + 1
        total = np.bincount(np.repeat(passage, size) * width + self.block_ids[at], self.block_tops[at], n * width)
        return np.flatnonzero((total.reshape(n, width) >= 1 - 1e-9).any(1))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose weights over the terms sum to 1 at least, by block-max WAND."""
        lists, weights, tops, blocks = self.lists, self.weights, self.top, self.blocks
        place = {t: 0 for t in terms}
        out, end = [], len(self.ids)
        live = sorted(terms, key=lambda t: lists[t][0])
        while live:
            total, pivot = 0.0, -1
            for n, t in enumerate(live):
                total += tops[t]
                if total >= 1 - 1e-9:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][place[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][place[live[pivot + 1]]] == item:
                pivot += 1
            block = item // BLOCK
            if sum(blocks[t].get(block, 0.0) for t in live[: pivot + 1]) < 1 - 1e-9:
                target = (block + 1) * BLOCK  # nothing in this block can reach the threshold with these lists
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][place[live[pivot + 1]]])
                target = max(target, item + 1)
            else:
                score = 0.0
                for t in live[: pivot + 1]:
                    own = lists[t]
                    p = place[t]
                    while p < len(own) and own[p] < item:
                        p += 1
                    place[t] = p
                    if p < len(own) and own[p] == item:
                        score += weights[t][p]
                if score >= 1 - 1e-9:
                    out.append((item, score))
                target = item + 1
            for t in live[: pivot + 1]:
                own, p = lists[t], place[t]
                while p < len(own) and own[p] < target:
                    p += 1
                place[t] = p
            live = sorted((t for t in live if place[t] < len(lists[t]) and target <= end), key=lambda t: lists[t][place[t]])
        return out


def leaks_in(index: Index, part: np.ndarray, offsets: np.ndarray, size: int, contain: float, both: float) -> list[tuple]:
    """(text number, item number, score, containment, question, answer, first word) of all verified leaks."""
    words = Words(part, offsets, ALPHANUMERIC)
    if not len(words.starts) or not len(index.terms):
        return []
    hashes = words.hashes()
    term = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[term] == hashes)
    half = size // 2
    first = words.bounds[:-1]
    chunks = np.maximum(1, -(-np.diff(words.bounds) // half))
    base = np.cumsum(chunks) - chunks  # number of each text's first half passage
    text = words.text[hit]
    chunk = base[text] + (hit - first[text]) // half
    # a passage is a half and the half after it
    v = U64(len(index.terms))
    keys = chunk.astype(U64) * v + term[hit].astype(U64)
    before = chunk > base[text]
    keys = np.unique(np.concatenate((keys, keys[before] - v)))
    passage, own = (keys // v).astype(np.int64), (keys % v).astype(np.int64)
    bound = np.bincount(passage, index.top[own], chunks.sum())
    cuts = np.searchsorted(passage, np.arange(len(bound) + 1))
    left = np.flatnonzero(bound >= 1 - 1e-9)
    reached = []
    step = max(1, (1 << 20) // (len(index.ids) // BLOCK + 1))  # passages at once, by memory
    for x in range(0, len(left), step):
        some = left[x : x + step]
        size = cuts[some + 1] - cuts[some]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(cuts[some], size)
        reached += some[index.reach(np.repeat(np.arange(len(some)), size), own[at], len(some))].tolist()
    found: dict[tuple[int, int], list] = {}
    for p in reached:
        t = int(np.searchsorted(base, p, "right") - 1)
        for item, score in index.search(own[cuts[p] : cuts[p + 1]].tolist()):
            known = found.get((t, item))
            if known is not None and known[1] >= contain:
                known[0] = max(known[0], score)
                continue
            n = len(index.words[item])
            a = max(words.bounds[t], first[t] + (p - base[t]) * half - n)
            b = min(words.bounds[t + 1], first[t] + (p - base[t] + 2) * half + n)
            around = hashes[a:b]
            if n >= SHINGLE:
                there = windows(around, np.array([0, b - a]), SHINGLE)
            else:
                there = windows_sum(around, n)
            held = np.isin(there[0], index.shingles[item])
            share = len(np.unique(there[0][held])) / len(index.shingles[item])
            qa = [float(np.isin(x, around).mean()) if len(x) else 1.0 for x in index.parts[item]]
            at = int(a + there[1][held][0] - words.bounds[t]) if held.any() else -1
            if known is None or share > known[1]:
                found[t, item] = [score, share, *qa, at]
    return [(t, i, s * index.least[i], c, q, a, at) for (t, i), (s, c, q, a, at) in sorted(found.items())
            if c >= contain and q >= both and a >= both]


def windows_sum(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n < 5 words as a short item's only shingle has it."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return mix(reduce(np.add, (words[i : i + k] for i in range(n)))), np.arange(k)


def indexes(benchmark: DataFrame, item_col: str, text_col: str, share: float, size: int, block_mb: float) -> Iterator[Index]:
    """One index after the other, each of a bounded amount of item text."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    mb = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6
    groups = int(mb / block_mb) + 1
    for g in range(groups):
        rows = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        yield Index([tuple(r) for r in rows.orderBy("item", "text").collect()], share, size)  # at most about block_mb


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", size: int = 128, share: float = 0.6, contain: float = 0.8, both: float = 0.5,
    block_mb: float = 16.0,
) -> DataFrame:
    """One row per document and leaked item: id, item, score, contained, question, answer, first_word."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = source.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = (f"id {kinds[0]}, item {kinds[1]}, score double, contained double, question double, answer double, "
              "first_word long")

    def searched(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                for i, j in pieces(offsets):
                    rows = leaks_in(shared.value, LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i],
                                    size, contain, both)
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([i + r[0] for r in rows])),
                             pa.array([shared.value.ids[r[1]] for r in rows]), *(pa.array(c) for c in list(zip(*rows))[2:])],
                            ["id", "item", "score", "contained", "question", "answer", "first_word"])

        return source.mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, map(searched, indexes(benchmark, item_col, item_text, share, size, block_mb)))
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = 128, share: float = 0.6,
                  contain: float = 0.8, both: float = 0.5, block_mb: float = 16.0) -> DataFrame:
    """The documents without any leak; columns as given."""
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, "item_id", "text", share, size, block_mb):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                for i, j in pieces(offsets):
                    for row in leaks_in(shared.value, LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i],
                                        size, contain, both):
                        keep[i + row[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
