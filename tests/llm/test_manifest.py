"""Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpuscope.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row long, tree string, id string, leaf string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def hashed(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows):
    """Rows of (doc_id, source, lang, n_chars, text) to the multiset of results."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, hashed(*r), r))
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out
    def walk(tree, i):
        out = []
        for level in tree[:-1]:
            out.append((level[i ^ 1] if i ^ 1 < len(level) else "", i & 1))
            i //= 2
        return out
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {t: levels([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    top = levels([own[t][-1][0] for t in names])
    out = []
    for at, t in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            steps = walk(own[t], i) + walk(top, at)
            now = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = hashed(r[0], r[1], r[2], r[3] + 1, r[4])
            for other, left in steps:
                now = h(other, now) if left else h(now, other)
            out.append((r[0], leaf, own[t][-1][0], top[-1][0], h(*(o for o, _ in steps)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest(spark, bits):
    rng = random.Random(bits)
    langs = ["en"] * 5 + ["de", "é", "", None]
    rows = [(rng.choice([None, *range(60)]), rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 3, 2**63 - 1]),
             rng.choice([None, "", "é", "x" * 70_000])) for _ in range(150)]
    rows += rows[:20] + [(900, "s", "lone", 1, "only leaf of its tree")]
    df = spark.createDataFrame([(*r, 1, "t", "x", "l", 2) for r in rows], SCHEMA).repartition(5)
    got = manifest.verified_manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_small_manifests(spark):
    one = [(1, "s", "en", 5, "text")]
    make = lambda rows: manifest.verified_manifest(
        spark.createDataFrame([(*r, 1, "t", "x", "l", 2) for r in rows], SCHEMA), F.lit(False))
    assert [tuple(r) for r in make(one).collect()] == brute(one)
    assert make([]).count() == 0


def test_octopus_needs_the_fewest_nodes():
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 16, 33):
        for _ in range(20):
            known = {rng.randrange(size) for _ in range(rng.randint(1, size))}
            need = manifest.missing(known, size)
            assert len(set(need)) == len(need)
            assert not {p for level, p in need if level == 0} & known
            leaves = [h(str(i)) for i in range(size)]
            tree = [leaves]
            while len(tree[-1]) > 1:
                tree.append([h(*tree[-1][i : i + 2]) for i in range(0, len(tree[-1]), 2)])
            nodes = {(level, p): tree[level][p] for level, p in need} | {(0, p): leaves[p] for p in known}
            assert manifest.derived(dict(nodes), known, size) == tree[-1][0]
            for left_out in need:  # none of them is superfluous
                with pytest.raises(KeyError):
                    manifest.derived({k: v for k, v in nodes.items() if k != left_out}, known, size)
    assert manifest.missing(range(16), 16) == []
