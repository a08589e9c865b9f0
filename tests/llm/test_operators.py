"""Small fixtures for every training-data operator: edge rows, brute force and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscope.llm import bpe, decontamination, exact_dedup, licenses, mixing, near_dedup, sharding, substring_dedup, toxicity
from corpuscope.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, class string, row long, id string, kept string, block string"


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base, shared = words(rng, 60, 5000), words(rng, 30, 5000)
    near = base.split()
    near[3] = "other"
    return [
        (1, base), (2, base), (2, base), (3, base.replace(" ", "\t\n", 3)), (4, " ".join(near)), (5, None), (6, ""), (7, "  "),
        (8, words(rng, 40) + " " + shared + " " + words(rng, 5)), (9, shared), (10, shared.upper()), (None, shared),
        (11, "one"), (12, "one"), (13, "é ñ <|endoftext|> x"), (14, words(rng, 3000)), (15, "MIT license, Apache License; mit license"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Columns that clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, "c", 1, "x", "k", "b") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clean(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_groups(docs, texts, nothing):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(docs, fan_in=2).collect())
    groups = {}
    for i, t in texts:
        groups.setdefault(clean(t), []).append(i)
    want = Counter((i, min((x for x in groups[clean(t)] if x is not None), default=None), len(groups[clean(t)]),
                    hashlib.sha256(clean(t).encode()).hexdigest()) for i, t in texts)
    assert got == want
    assert exact_dedup.exact_groups(docs).filter("kept").count() == len(groups)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(nothing).count() == 0


def brute_removed(texts, n):
    first = {}
    for i, t in texts:
        w = split(t)
        for k in range(len(w) - n + 1 if i is not None else 0):
            s = tuple(w[k : k + n])
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in texts:
        w = split(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("n", [2, 13])
def test_substring_dedup(spark, docs, texts, nothing, n):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = substring_dedup.substring_dedup(docs, n, block_mb=0.0005)
    assert Counter(map(tuple, got.select(columns).collect())) == brute_removed(texts, n)
    rng = random.Random(n)
    many = [(i, words(rng, rng.randrange(60), 6)) for i in range(60)]
    frame = spark.createDataFrame(many, "doc_id long, text string")
    got = substring_dedup.substring_dedup(frame, n, block_mb=0.0005, texts_out=False)
    assert Counter(map(tuple, got.collect())) == brute_removed(many, n)
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_automaton_matches():
    rng = random.Random(3)
    seqs = [[rng.randrange(3) for _ in range(25)] for _ in range(8)]
    a = substring_dedup.Automaton()
    for s in seqs:
        a.add(s)
    query = [rng.randrange(3) for _ in range(80)]
    held = {tuple(s[i:j]) for s in seqs for i in range(25) for j in range(i + 1, 26)}
    for end, n in enumerate(a.matches(query), 1):
        assert n == 0 or tuple(query[end - n : end]) in held
        assert n == end or tuple(query[end - n - 1 : end]) not in held


def test_sharding(spark, docs, texts, nothing):
    rows = sharding.shard_rows(docs, 4, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in per.items())
    same = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    assert {r["count"] for r in sharding.shard_rows(same, 4).groupBy("shard").count().collect()} == {125}
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r.doc_id: r.shard for r in sharding.shard_rows(many, n).collect()} for n in (10, 11))
    assert sum(a[i] != b[i] for i in a) < 0.4 * len(a)  # dealing anew by a hash of the count would move ten elevenths
    assert sharding.shard_rows(nothing).count() == 0


def test_mixing(spark, docs, texts, nothing):
    rng = random.Random(5)
    many = [(i, words(rng, 80)) for i in range(200, 320)] + [(i, t) for i, t in texts if i not in (1, 2, 3)]
    frame = spark.createDataFrame(many, "doc_id long, text string")
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tok = lambda t: [*split((t or "").translate(low)), None]
    count = Counter(w for i, t in many if not held(i) for w in tok(t))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(tok(t)), sum(count[w] > 0 for w in tok(t)), n) for i, t in many)
    rows = mixing.mixing_scores(frame, block_mb=0.002).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == want
    import math
    base = {i: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tok(t)) for i, t in many}
    assert all(abs(r.base_score - base[r.doc_id]) < 1e-6 and r.score < 0 for r in rows)
    assert mixing.mixing_scores(nothing).count() == 0
    assert mixing.mixing_scores(docs).count() == len(texts)


def test_mixing_counts_all_blocks(spark):
    """Counts in context are exact, and weights do not depend on which documents share a block."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    many = [(i, words(rng, 60, 300)) for i in range(300)]
    own = next(mixing.tokens(pa.array([t for _, t in many])))[1]
    pairs, count = np.unique(own.pairs(), return_counts=True)
    states = mixing.pair_states(pairs, count)
    by_way = Counter()
    for p, n in zip(pairs.tolist(), count.tolist()):
        for depth in range(mixing.BITS + 1):
            by_way[depth, p >> (mixing.BITS - depth)] += n
    for k, p in enumerate(pairs.tolist()):
        for depth in range(mixing.BITS):
            zeros, ones = (by_way[depth + 1, (p >> (mixing.BITS - depth)) * 2 + bit] for bit in (0, 1))
            assert states[depth, k] == mixing.states_of(np.array([zeros]), np.array([ones]))[0]
    frame = spark.createDataFrame(many, "doc_id long, text string")
    one, more = ({r.doc_id: r.score for r in mixing.mixing_scores(frame, block_mb=mb).collect()} for mb in (6.0, 0.02))
    assert len(one) == 300 and all(abs(one[i] - more[i]) < 0.01 for i in one)


def test_mixing_predictors_count_all_learning_texts(spark):
    """Texts of the fold that the weights learn from are counted, too, once the weights are learned."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    common = [words(rng, 40, 500) for _ in range(3)]
    phrase = words(rng, 40, 500)
    # all folds share texts that teach the weights to trust the contexts; one text stands in the weights' fold alone
    many = [(i, phrase if fold(i) == 2 or fold(i) == 3 and i % 3 == 0 else rng.choice(common)) for i in range(300)]
    rows = mixing.mixing_scores(spark.createDataFrame(many, "doc_id long, text string")).filter("held_out").collect()
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > -1  # -0.45; -3.2 by counts without that fold
    pair = lambda x, kind, n: {"block": 0, "kind": kind, "bucket": 1, "hashes": mixing.shrunk(mixing.pack(np.array(x, np.uint64))),
                               "counts": mixing.packed(np.array(n))}
    keys = [(7 << mixing.BITS) | 1, (7 << mixing.BITS) | 2, (9 << mixing.BITS) | 3]
    rows = [pair(keys, mixing.PAIRS, [5, 3, 2]), pair(keys[1:], mixing.MIXED_PAIRS, [2, 1])]
    got = mixing.total_pairs(pa.Table.from_pylist(rows))
    for at, (own, total) in enumerate(((keys, [5, 3, 2]), (keys[1:2], [5, 1]))):
        full = keys[: len(total)]
        states = mixing.pair_states(np.array(full, np.uint64), np.array(total))[:, [full.index(k) for k in own]]
        codes = np.array(own, np.uint64) & np.uint64(mixing.NONE - 1)
        assert (mixing.thick(mixing.grown(got.column("totals")[at]), codes) == states).all()


def test_toxicity_scores_large_batches_in_small_pieces():
    """Temporary arrays and the powers kept by a worker follow a piece, not a batch."""
    import numpy as np
    import pyarrow as pa

    from corpuscope.llm import text

    u64 = np.uint64
    keys = np.arange(1, 9, dtype=u64)
    model = toxicity.Model(keys, np.ones(8), keys, np.ones(8), np.array([-4.0, 0, 0, 0, 0, 2.0]))
    texts = [words(random.Random(i), 2000, 900) for i in range(600)]
    text._POWERS.clear()
    got = toxicity.scored(model, pa.array(texts))
    assert sum(map(len, texts)) > 5 << 20 and max(map(len, text._POWERS.values())) <= 2 << 20
    assert np.array_equal(got, np.concatenate([toxicity.scored(model, pa.array(texts[i : i + 7])) for i in range(0, 600, 7)]))


def test_near_dedup_refuses_a_percent_at_which_links_are_lost():
    assert near_dedup.missed(80) < 3e-8
    for percent in (30, 50):
        with pytest.raises(ValueError, match="missed"):
            near_dedup.near_groups(None, percent=percent)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.mark.parametrize("mean", [8, 512])
def test_bpe(spark, texts, docs, nothing, mean):
    lib = library()
    rows = bpe.encode_documents(docs, vocabulary(), mean=mean).collect()
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows)
    want = [(i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in texts]
    assert got == Counter((i, tuple(x), lib.decode(x, skip_special_tokens=False)) for i, x in want)
    assert bpe.encode_documents(nothing, vocabulary()).count() == 0


def test_token_counts(spark, texts, docs, nothing):
    lib = library()
    long = "".join(random.Random(1).choice("ab é,'\n x") for _ in range(5000)) + "y" * 3000 + " end"
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(99, long)], "doc_id long, text string"))
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in [*texts, (99, long)])
    for chunk, overlap in ((65_536, 256), (300, 8)):
        rows = bpe.count_tokens(frame, vocabulary(), chunk=chunk, overlap=overlap).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert bpe.count_tokens(nothing, vocabulary()).count() == 0


def test_licenses(docs, texts, nothing):
    rows = {r.doc_id: r for r in licenses.license_labels(docs).collect()}
    r = rows[15]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (6, 3, 0, 4, "apache,mit", 1.0)
    assert all(rows[i].labels == "" and rows[i].n_base == 0 for i in (1, 5, 6, 14))
    notice = licenses.NOTICES[1][1].replace("use this file", "ever use this one file")
    spark = docs.sparkSession
    found = licenses.license_labels(spark.createDataFrame([(1, "Intro. " + notice)], "doc_id long, text string")).first()
    assert "apache" in found.labels and found.score > 0.5
    assert licenses.license_labels(nothing).count() == 0


def brute_components(texts, k):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t in texts:
        w = split((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low_id = {}
    for x, (i, _) in enumerate(texts):
        if i is not None:
            low_id[find(x)] = min(i, low_id.get(find(x), i))
    return Counter((i, len(sets[x]), low_id.get(find(x), i)) for x, (i, _) in enumerate(texts))


def test_near_dedup(spark, docs, texts, nothing):
    rows = near_dedup.near_groups(docs, k=2).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, rows)) == brute_components(texts, 2)
    rng = random.Random(11)
    base = words(rng, 80, 9000).split()
    family = []
    for i in range(40):  # one long list, with links that only some of its members have
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(80)] = f"x{rng.randrange(9000)}"
        family.append((i, " ".join(own)))
    frame = spark.createDataFrame(family, "doc_id long, text string")
    for block in (7, 1024):
        rows = near_dedup.near_groups(frame, k=2, block=block).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, rows)) == brute_components(family, 2)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.filter("doc_id > 4").collect()} >= {5, 6, 7, 8, 13, 14, 15}
    assert near_dedup.near_groups(nothing).count() == 0


def test_toxicity(spark, docs, texts, nothing):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        w = [f"{rng.choice('abcd')}{rng.choice('efg')}{rng.choice('hijk')}" for _ in range(40)]
        if i % 4 == 0:
            w[5] = w[9] = "zqx" + rng.choice("abcdef")
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    frame = spark.createDataFrame(rows + [(None, None), (1000, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels[:200] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(frame, model).collect()}
    assert sum(got[i].predicted == y for i, y in labels[200:]) >= 98
    assert got[1000].score == got[None].score and 0 <= got[1000].score < 0.5
    kept = toxicity.without_toxic(frame, model)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}
    assert toxicity.fit(frame, known.limit(0)) is None
    assert toxicity.toxicity_scores(docs, None).count() == len(texts)
    assert toxicity.toxicity_scores(nothing, model).count() == 0


def test_decontamination(spark, docs, nothing):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(12, 60), 4000) + "? " + words(rng, 6, 4000)) for i in range(40)] + [(90, None), (91, ""), (92, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, words(rng, 150, 4000)) for i in range(30)]
    rows += [(100 + i, words(rng, rng.randrange(200), 4000) + " " + t.upper() + " " + words(rng, 50, 4000)) for i, t in items[:40]]
    frame = spark.createDataFrame(rows + [(None, None), (500, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.benchmark_leaks(frame, bench).collect()}
    assert got == {(100 + i, i) for i in range(40)}
    kept = decontamination.without_leaks(frame, bench)
    assert {r.doc_id for r in kept.collect()} == {*range(30), None, 500}
    assert decontamination.benchmark_leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.benchmark_leaks(nothing, bench).count() == 0


def test_wand_equals_full_scoring():
    rng = random.Random(8)
    items = [(i, words(rng, 30, 200)) for i in range(60)]
    index = decontamination.Index(items, 0.3, 128)
    for _ in range(50):
        terms = rng.sample(range(len(index.terms)), 40)
        score = Counter()
        for t in terms:
            for i, w in zip(index.lists[t], index.weights[t]):
                score[i] += w
        assert {i for i, _ in index.search(terms)} == {i for i, s in score.items() if s >= 1 - 1e-9}


def test_pipeline(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, folder).cache()
        assert after.columns == docs.columns
        assert after.exceptAll(docs).count() == 0 and 0 < after.count() <= docs.count()
        if name == "exact_dedup":
            assert after.count() == len({clean(r.text) for r in docs.collect()})
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in after.collect()} == {i for i, _, c in brute_components(rows, 5) if i == c}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in after.collect() for t in items)
        docs = after
    assert p.run(spark, folder).count() == docs.count()
