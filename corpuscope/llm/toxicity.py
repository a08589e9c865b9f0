"""Toxicity by two class-conditional Kneser-Ney models over the bytes of words.

One model counts five-byte sequences inside the words of toxic documents, the other of ordinary ones.
Each discounts its counts and gives the freed mass to a lower order whose continuation counts both classes share,
so an expression that neither has seen says nothing, and a rare one little. A word's evidence is the
difference of its two log-likelihoods. A document's features are that difference per word, the
strongest word, the share of telling words and the length; a logistic regression turns them into a score.
It is fitted on every labelled row, each measured by counts that leave out the row's own fold; the final
counts hold all folds. Capitals of ASCII and Latin-1 count as small letters.

Models are fitted on at most ``sample`` labelled rows (those with the smallest hash of their id), so the counts are
bounded by their text; scoring is one pass over all documents without a shuffle.

Defined cases: null counts as empty; texts without words score 0; null labels are not
used; of ids labelled several times the largest label counts; without labels of both classes all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import materialize
from corpuscope.llm.text import ALPHANUMERIC, LOWER, Words, pieces, utf8

U64 = np.uint64
ORDER = 5
DISCOUNT = 0.75
TELLING = 3.0
FOLDS = 4


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the Latin-1 capitals in lower case."""
    out = LOWER[data]
    capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[1:][capital] += 32
    return out


def spelled(part: np.ndarray, words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five-byte keys at every byte of the given words and at their ends, and where each word begins in them."""
    begins, lengths = words.starts[first], words.ends[first] - words.starts[first]
    places = np.concatenate(([0], np.cumsum(lengths + ORDER)))  # four blanks before a word, one behind it
    line = np.full(places[-1] + ORDER, 32, np.uint8)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line[np.repeat(places[:-1] + ORDER - 1, lengths) + at] = part[np.repeat(begins, lengths) + at]
    keys = np.zeros(len(line) - ORDER + 1, U64)
    for i in range(ORDER):
        keys = (keys << U64(8)) | line[i : len(keys) + i].astype(U64)
    at = np.arange((lengths + 1).sum()) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    return keys[np.repeat(places[:-1], lengths + 1) + at], np.cumsum(lengths + 1) - lengths - 1


@dataclass
class Model:
    grams: np.ndarray
    gram_evidence: np.ndarray
    contexts: np.ndarray
    context_evidence: np.ndarray
    weights: np.ndarray
    low: np.ndarray | float = -np.inf  # range of the features at the fit; scores do not reach beyond it
    high: np.ndarray | float = np.inf

    def evidence(self, keys: np.ndarray) -> np.ndarray:
        """log p(byte | toxic) - log p(byte | ordinary): of the sequence if seen, else of its context."""
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        seen = self.grams[at] == keys
        out = np.where(seen, self.gram_evidence[at], 0.0)
        rest = np.flatnonzero(~seen)
        context = keys[rest] >> U64(8)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        out[rest] = np.where(self.contexts[at] == context, self.context_evidence[at], 0.0)
        return out

    def features(self, part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per text: evidence per word, strongest word, share of telling words, log length."""
        words = Words(part, offsets, ALPHANUMERIC)
        n = len(offsets) - 1
        out = np.zeros((n, 4))
        if not len(words.starts):
            return out
        _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        keys, begins = spelled(part, words, first)
        value = np.add.reduceat(self.evidence(keys), begins)[which]
        size = np.bincount(words.text, minlength=n)
        some = np.maximum(size, 1)
        out[:, 0] = np.bincount(words.text, value, n) / some
        top = np.full(n, -np.inf)
        np.maximum.at(top, words.text, value)
        out[:, 1] = np.where(size > 0, top, 0)
        out[:, 2] = np.bincount(words.text, value > TELLING, n) / np.sqrt(some)
        out[:, 3] = np.log1p(size)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.clip(design(np.clip(features, self.low, self.high)) @ self.weights, -500, 500)
        return np.where(features[:, 3] > 0, 1 / (1 + np.exp(-x)), 0.0)


def design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), f, np.maximum(f[:, 1] - TELLING, 0)])


def shared_probability(keys: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probability of each key's last byte after its first order - 1, from distinct keys of both classes."""
    if order == 0:
        return np.full(len(keys), 1 / 256)
    own = keys & U64((1 << (8 * order)) - 1)
    grams, which, n = np.unique(own, return_inverse=True, return_counts=True)  # n: distinct longer sequences
    _, context, = np.unique(grams >> U64(8), return_inverse=True)
    total, kinds = np.bincount(context, n)[context], np.bincount(context)[context]
    lower = shared_probability(grams, order - 1)
    return ((n - DISCOUNT) / total + DISCOUNT * kinds / total * lower)[which]


def kneser_ney(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, ...]:
    """Evidence of all counted sequences and of their contexts."""
    contexts, context = np.unique(keys >> U64(8), return_inverse=True)
    lower = shared_probability(keys, ORDER - 1)
    logs, rest = [], []
    for n in (toxic, ordinary):
        total = np.bincount(context, n, len(contexts))
        left = np.where(total > 0, DISCOUNT * np.bincount(context, n > 0, len(contexts)) / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[context] + left[context] * lower))
        rest.append(np.log(left))
    return keys, logs[0] - logs[1], contexts, rest[0] - rest[1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method."""
    mean, spread = x.mean(0), x.std(0)
    spread[0], mean[0] = 1, 0
    spread[spread < 1e-6] = 1
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * 0.01 * np.eye(len(w)) + 1e-9, z.T @ (y - p) - ridge * 0.01 * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w = w / spread
    w[0] -= (w * mean)[1:].sum()
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model | None:
    """A model from at most ``sample`` labelled rows; None without both classes."""
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
        .withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    )
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id").select("text", "label", "fold"),  # at most ``sample`` rows of two numbers
        "toxic-sample",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            label, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, j in pieces(offsets, 1 << 18):
                part = lowered(data[offsets[i] : offsets[j]])
                words = Words(part, offsets[i : j + 1] - offsets[i], ALPHANUMERIC)
                if not len(words.starts):
                    continue
                keys, begins = spelled(part, words, np.arange(len(words.starts)))
                size = np.diff(np.append(begins, len(keys)))
                kind = np.repeat((2 * fold[i:j] + (label[i:j] > 0))[words.text], size)
                grams, which = np.unique(keys, return_inverse=True)
                counts = [np.bincount(which, kind == n, len(grams)).astype(np.int64) for n in range(2 * FOLDS)]
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), *map(pa.array, counts)], ["gram", *names])

    names = [f"n{n}" for n in range(2 * FOLDS)]  # ordinary and toxic of each fold
    found = (
        rows.mapInArrow(count, "gram long, " + ", ".join(f"{n} long" for n in names))
        .groupBy("gram").agg(*[F.sum(n).alias(n) for n in names]).orderBy("gram").toArrow()
    )
    keys = found.column(0).to_numpy().astype(U64)
    counts = np.array([found.column(n).to_numpy() for n in names], np.int64)

    def model_of(folds: list[int]) -> Model | None:
        ordinary, toxic = (sum((counts[2 * f + c] for f in folds), np.zeros(len(keys), np.int64)) for c in (0, 1))
        if not ordinary.any() or not toxic.any():
            return None
        seen = ordinary + toxic > 0
        return Model(*kneser_ney(keys[seen], toxic[seen], ordinary[seen]), np.zeros(6))

    model = model_of(list(range(FOLDS)))
    if model is None:
        return None
    others = [model_of([f for f in range(FOLDS) if f != own]) for own in range(FOLDS)]
    shared = docs.sparkSession.sparkContext.broadcast(others)  # bounded by the texts of the sample

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, other in enumerate(shared.value):
                part = batch.filter(pc.equal(batch.column(2), own))
                if other is None or not part.num_rows:
                    continue
                data, offsets = utf8(part.column(0))
                for i, j in pieces(offsets):
                    f = other.features(lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in f.T), part.column(1)[i:j]], ["a", "b", "c", "d", "label"])

    seen = rows.mapInArrow(measure, "a double, b double, c double, d double, label int").toArrow()
    x = np.column_stack([seen.column(i).to_numpy() for i in range(4)])
    y = seen.column(4).to_numpy() > 0
    if y.all() or not y.any():  # too few rows to calibrate: any telling word decides
        model.weights = np.array([-4.0, 0, 0, 0, 0, 2.0])
    else:
        model.weights, model.low, model.high = logistic(design(x), y.astype(float)), x.min(0), x.max(0)
    return model


def toxicity_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    if model is None:
        return source.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scored(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return source.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def scored(model: Model, texts: pa.Array) -> np.ndarray:
    data, offsets = utf8(texts)
    parts = [model.score(model.features(lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]))
             for i, j in pieces(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0)


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents with a score below 0.5; columns as given."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(utf8(batch.column(at))[1], 4 << 20):  # what is kept is a copy
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(scored(shared.value, part.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
