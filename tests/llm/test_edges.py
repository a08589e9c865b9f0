"""Names that clash with the operators' own, postings that lose no pair, tokenizers of another kind, texts without white space."""

import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscope.llm import bpe, exact_dedup, near_dedup, queries
from corpuscope.llm.queries import vocabulary


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


NAMES = "doc_id long, text string, _id long, _key binary, _kept string, _digest string, own0 int, OWN1 int, own2 int, own3 int"


def test_dedup_leaves_columns_of_any_name_alone(spark):
    rows = [(i, t, 7 * i, b"k", "kept", f"digest{i}", i, i, i, i) for i, t in enumerate(["a b c d e f", "a b c d e f", "other text", None, ""])]
    docs = spark.createDataFrame(rows, NAMES)
    for kept in (exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs)):
        assert kept.columns == docs.columns
        got = sorted(map(tuple, kept.collect()))
        assert all((r[0], r[1], r[2], bytes(r[3]), *r[4:]) in rows for r in got)
    assert {r.doc_id for r in exact_dedup.exact_dedup(docs).collect()} == {0, 2, 3}
    assert {r.doc_id for r in near_dedup.near_dedup(docs).collect()} == {0, 2, 3, 4}


def test_any_twelve_agreements_meet():
    rng = random.Random(3)
    for _ in range(3000):
        same = set(rng.sample(range(near_dedup.COORDINATES), near_dedup.MATCHES))
        assert any(i in same and j in same for i, j in near_dedup.MEETINGS)
    assert sorted({c for m in near_dedup.MEETINGS for c in m}) == list(range(near_dedup.COORDINATES))


def test_spanning_links_join_what_all_links_join():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(40):
        i, j = rng.integers(0, 12, 30), rng.integers(0, 12, 30)
        for shift in (0, 12):
            def groups(pairs):
                root = list(range(24))
                for a, b in pairs:
                    x, y = root[a], root[b + shift]
                    root = [y if r == x else r for r in root]
                return {frozenset(k for k in range(24) if root[k] == r) for r in root}

            keep = near_dedup.spanning(i, j, 12, shift)
            assert len(keep[0]) < 24 and groups(zip(*keep)) == groups(zip(i, j))


def test_long_texts_are_spliced_from_chunks():
    encoder, rng = bpe.Encoder(vocabulary()), random.Random(3)
    parts = ["a", "é", "ab", "  ", "\n", "B c", " x", "don't", "1 2", "日本", "\u0085", "́", "!!!", "'s", "😀", "the", "tion", "<|endoftext|>", "."]
    for _ in range(60):
        text = "".join(rng.choices(rng.sample(parts, rng.choice([2, 4, 19])), k=rng.randrange(100, 3000)))
        want = len(encoder.library.encode(text, add_special_tokens=False).ids)
        for size, overlap in ((50, 4), (300, 8), (1000, 64)):
            assert bpe.count_long(encoder, text, size, overlap) == want


@pytest.mark.parametrize("size", [300, 65_536])
def test_text_without_white_space_costs_few_encodes(size):
    """Characters that go to the library, against those of the text."""
    encoder, rng = bpe.Encoder(vocabulary()), random.Random(1)
    given = []

    class Counting:
        def encode(self, text, **more):
            given.append(len(text))
            return library.encode(text, **more)

    library, encoder.library = encoder.library, Counting()
    for text in ("ab" * 100_000, "".join(rng.choices("abcdefghij", k=200_000))):
        given.clear()
        assert bpe.count_long(encoder, text, size, size // 8) == len(library.encode(text, add_special_tokens=False).ids)
        assert sum(given) <= 3 * len(text)


def test_splice_needs_a_run_of_equal_tokens():
    encoder = bpe.Encoder(vocabulary())
    text = "the quick brown fox jumps over the lazy dog and runs away from the small grey cat"
    one, two = bpe.Placed(encoder, text, 0, 60), bpe.Placed(encoder, text, 22, len(text))
    at, to = one.splice(two)
    assert [*one.ids[:at], *two.ids[to:]] == encoder.library.encode(text, add_special_tokens=False).ids
    assert one.splice(bpe.Placed(encoder, text, 58, len(text))) is None


def test_tokenizers_of_another_kind_are_refused(tmp_path):
    with pytest.raises(ValueError, match="white space"):
        bpe.Encoder(vocabulary("byte_bpe_50k.json"))
    other = json.loads(library().to_str())
    other["decoder"] = {"type": "BPEDecoder", "suffix": "</w>"}
    (tmp_path / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="decoder"):
        bpe.Encoder(str(tmp_path / "other.json"))


def test_memos_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 2000)
    encoder, lib, rng = bpe.Encoder(vocabulary()), library(), random.Random(6)
    word = lambda: "".join(rng.choices("abcdé<|'1", k=rng.randint(1, 9)))
    for _ in range(30):
        texts = [" ".join(word() for _ in range(20)) for _ in range(5)] + ["x" * 400, "<|endoftext|> a<|endoftext|>b"]
        assert encoder.count_all([t.encode().split() for t in texts]) == [
            len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
        assert encoder.held["counts"] < 20_000


def test_held_out_is_never_null(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b"), (1, "c d"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op8_toxicity(spark, str(tmp_path)).collect()
    assert Counter(r.held_out is None for r in rows) == {False: 3}


def test_pairs_of_distinct_meetings_are_distinct_lists(spark):
    rows = [(i, [rng] * near_dedup.COORDINATES) for i, rng in enumerate([5, 5, 6])]
    lists = near_dedup.postings(spark.createDataFrame(rows, "class long, signature array<int>"))
    sizes = lists.groupBy("pair").agg(F.count("*").alias("n")).collect()
    assert len(sizes) == len(near_dedup.MEETINGS) and {r.n for r in sizes} == {2}
    assert {r.pair >> near_dedup.HASH_BITS for r in sizes} == set(range(len(near_dedup.MEETINGS)))
    assert not set(itertools.chain(*(m for m in near_dedup.MEETINGS))) - set(range(near_dedup.COORDINATES))
