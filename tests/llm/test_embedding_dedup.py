"""Embedding near-dedup against all pairs."""

import math
import random

import numpy as np
import pytest

from corpuscope.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, row long, id string, key string, shard int, class string"


def brute(rows, cosine):
    def good(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    units = [embedding_dedup.unit(np.array(r[1], float)) if good(r) else None for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return sorted(((r[0], links[i], low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("shard_rows", [20, 1000])
def test_embedding_groups(spark, shard_rows):
    rng = np.random.default_rng(shard_rows)
    rows, pick = [], random.Random(1)
    for _ in range(12):
        centre = rng.normal(size=8)
        spread = pick.choice([0.05, 0.2, 0.35, 0.6])
        label = pick.choice([1, 2])
        rows += [(None, (centre + spread * rng.normal(size=8)).tolist(), label) for _ in range(pick.randrange(1, 30))]
    rows += pick.choices(rows, k=30) + [(None, [3 * x for x in r[1]], r[2]) for r in rows[:5]]
    rows += [(None, v, 1) for v in (None, [], [0.0] * 8, [1.0, None] * 4, [math.nan] * 8, [math.inf] + [1.0] * 7, [1.0] * 7, [1.0] * 7,
                                   [1e-200] * 8, [1e200] * 8, [-0.0] * 7 + [1.0], [0.0] * 7 + [1.0])]
    rows += [(None, [1.0] * 8, None)] * 2
    rows = [(None if i % 40 == 7 else i % (len(rows) - 3), v, label) for i, (_, v, label) in enumerate(rows)]
    df = spark.createDataFrame([(*r, 1, "x", "k", 2, "c") for r in rows], SCHEMA).repartition(3)
    got = embedding_dedup.embedding_groups(df, 0.93, shard_rows=shard_rows, recall=1.0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 0.93)


def test_nothing(spark):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    only_null = spark.createDataFrame([(1, None, 1, 1, "x", "k", 2, "c"), (None, [1.0], None, 1, "x", "k", 2, "c")], SCHEMA)
    assert sorted(map(tuple, embedding_dedup.embedding_groups(only_null).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]


@pytest.mark.parametrize("near", [0.2, 1.0])
def test_recall_of_graphs(near):
    """Clustered and scattered vectors, one graph and two, against all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 32))
    x = np.concatenate([centres[rng.integers(0, 150, 2000)] + near * 0.3 * rng.normal(size=(2000, 32)), rng.normal(size=(1000, 32))])
    x = np.array([embedding_dedup.unit(v) for v in x])
    ids, ones = np.arange(len(x)), np.ones(len(x), np.int64)
    want = (x @ x.T >= 0.93).sum(1) - 1
    whole = embedding_dedup.build(x, ids, ones, 0.93)
    parts = [embedding_dedup.build(x[ids % 2 == p], ids[ids % 2 == p], ones[ids % 2 == p], 0.93) for p in (0, 1)]
    parts = [embedding_dedup.load(embedding_dedup.store(p), 32) for p in parts]
    for cells in ([(whole, whole, True)], [(parts[0], parts[0], True), (parts[1], parts[1], True), (*parts, False)]):
        got = np.zeros(len(x), np.int64)
        for a, b, same in cells:
            found, links, _ = embedding_dedup.meet(a, b, same, 0.93, embedding_dedup.RECALL)
            got[found] += links
        assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
