"""Tokenizer alignment against the two libraries and a plain merge."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpuscope.llm import alignment
from corpuscope.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, id string, piece long, blob string, n_a string"
#: pieces of text at which stretches, white space, special strings and byte fallback meet
PARTS = ["a", "é", " ", "  ", "\n", " \n", "b c", " x", " ", "　", " ", "▁", "<|endoftext|>", "\t", "don't", "1 2", "日本",
         "\u0085", "é", " ́", "\0", "</s>", "...", " '", "😀", "the ", "tion "]


def brute(rows):
    """Rows of (doc_id, text) to the multiset of results, one byte after another."""
    pair = alignment.Pair.of(A, B)
    found, counts = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        if b"".join(pair.a_bytes[x] for x in a) != raw or b"".join(pair.b_bytes[x] for x in b) != raw:
            found.append((i, [], [], [], ""))
            continue
        cover = [[k for k, x in enumerate(ids) for _ in names[x]] for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes))]
        links = sorted(set(zip(*cover)))
        groups, x, y = [], [], []
        for at in range(len(raw)):
            ends = [at + 1 == len(raw) or c[at + 1] != c[at] for c in cover]
            x += [a[cover[0][at]]] * ends[0]
            y += [b[cover[1][at]]] * ends[1]
            if all(ends):
                groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                x, y = [], []
        found.append((i, a, b, [(a[p], b[q]) for p, q in links], groups))
        counts.update(found[-1][3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return sorted((
        (i, len(a), len(b), len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, links, g in found), key=str)


def test_pieces_equal_a_plain_merge():
    rng = np.random.default_rng(1)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, total)), total)) for _ in range(2))
        ends = sorted({*a.tolist(), *b.tolist()})
        want = [(int((a < e).sum()), int((b < e).sum()), e, e in a and e in b) for e in ends]
        for each in (1, 2, 3, 1000):
            assert list(zip(*(c.tolist() for c in alignment.merged(a, b, 0, each)))) == want
            at_a, at_b = alignment.diagonals(a, b, each)
            work = np.diff(at_a + at_b)
            assert work.max() <= each and work.max() - work.min() <= 1


@pytest.mark.parametrize("steps, links, chunk", [(7, 5, 64), (1000, 90, 300), (alignment.STEPS, alignment.LINKS, alignment.CHUNK)])
def test_alignment(spark, steps, links, chunk):
    rng = random.Random(steps)
    rows = [(rng.choice([None, *range(200)]), "".join(rng.choices(PARTS, k=rng.randrange(1, 30)))) for _ in range(150)]
    rows += rows[:9] + [(1, None), (2, ""), (3, " "), (4, "the thing " * 4000), (5, "ab" * 9000)]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y", "z") for r in rows], SCHEMA).repartition(3)
    got = alignment.tokenizer_alignment(df, A, B, steps=steps, links=links, chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_memo_bound_and_nothing(spark, monkeypatch):
    pair, rng = alignment.Pair(A, B), random.Random(5)
    monkeypatch.setattr(alignment, "MEMO", 40)
    for _ in range(20):
        texts = ["".join(rng.choices(PARTS, k=20)) for _ in range(10)]
        raw = [(" " + t).encode() for t in texts]
        a, b, n_a, n_b, whole = pair.encode(
            np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, t in enumerate(texts):
            if whole[k]:
                assert a[n_a[:k].sum() : n_a[: k + 1].sum()].tolist() == pair.a.encode(" " + t, add_special_tokens=False).ids
                assert b[n_b[:k].sum() : n_b[: k + 1].sum()].tolist() == pair.b.encode(t)
    assert alignment.tokenizer_alignment(spark.createDataFrame([], SCHEMA), A, B).count() == 0
