import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuscope.operators import graph, models, similarity
from corpuscope.session import folder_names
from corpuscope.skew import previous_value, top_per_key


def test_cycles_are_simple_and_unique(spark):
    edges = [("A", "B"), ("B", "A"), ("B", "C"), ("C", "A"), ("D", "D"), ("C", "D")]
    df = spark.createDataFrame([("r", a, z) for a, z in edges], "repo string, src string, dst string")
    got = sorted(r.cycle for r in graph.find_cycles(df).collect())
    assert got == ["A → B → A", "A → B → C → A", "D → D"]
    summary = graph.architecture_summary(df.filter("src <> dst")).first()
    assert (summary.cycles, summary.modules) == (2, 4)


def test_cycles_of_any_length_count(spark):
    ring = spark.createDataFrame(
        [("r", f"M{i}", f"M{(i + 1) % 8}") for i in range(8)], "repo string, src string, dst string")
    assert [r.length for r in graph.find_cycles(ring).collect()] == [8]
    summary = graph.architecture_summary(ring).first()
    assert (summary.cycles, summary.domain_score) == (1, 94.0) and "1 circular dependency" in summary.summary
    bounded = graph.architecture_summary(ring, max_len=6).first()
    assert bounded.cycles == 0 and "up to 6 modules" in bounded.summary


def brute_cycles(edges):
    """Simple cycles from their smallest module, by a plain walk."""
    out = {}
    for a, z in edges:
        out.setdefault(a, set()).add(z)
    found = set()

    def walk(path):
        for x in out.get(path[-1], ()):
            if x == path[0]:
                found.add(" → ".join([*path, x]))
            elif x > path[0] and x not in path:
                walk([*path, x])

    for start in out:
        walk([start])
    return found


def test_cycles_match_brute_force(spark):
    rng = random.Random(8)
    graphs = {}
    for g in range(12):
        n = rng.randint(2, 8)
        graphs[f"r{g}"] = {(f"M{rng.randrange(n)}", f"M{rng.randrange(n)}") for _ in range(rng.randint(1, 22))}
    # two components of which the one with the larger names reaches the other, and a tail on either side
    graphs["two"] = {("Z", "Y"), ("Y", "Z"), ("Y", "B"), ("B", "A"), ("A", "B"), ("T", "Z"), ("A", "S"), ("S", "R")}
    df = spark.createDataFrame([(r, *e) for r, edges in graphs.items() for e in edges], "repo string, src string, dst string")
    want = {(r, c) for r, edges in graphs.items() for c in brute_cycles(edges)}
    rows = graph.find_cycles(df).collect()
    assert sorted((r.repo, r.cycle) for r in rows) == sorted(want) and len(want) > 40
    short = {(r, c) for r, c in want if c.count("→") <= 3}
    assert {(r.repo, r.cycle) for r in graph.find_cycles(df, max_len=3).collect()} == short < want
    inner = {(r.repo, r.src, r.dst) for r in graph.component_edges(df).collect()}
    assert inner == {(r, *e) for r, c in want for e in itertools.pairwise(c.split(" → ")) if e[0] != e[1]}


def test_graphs_without_cycles_open_no_path(spark, monkeypatch):
    layers = [[f"L{i:02d}{c}" for c in "abc"] for i in range(12)]
    edges = [("r", a, z) for one, two in itertools.pairwise(layers) for a in one for z in two]
    written = []
    whole = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(label) or whole(df, label))
    df = spark.createDataFrame(edges, "repo string, src string, dst string")
    assert graph.find_cycles(df).count() == 0
    assert "trimmed-edges" in written and "open-paths" not in written


def test_orphans(spark):
    edges = spark.createDataFrame([("r", "A", "B")], "repo string, src string, dst string")
    modules = spark.createDataFrame([("r", m) for m in "ABC"], "repo string, module string")
    assert [r.module for r in graph.orphan_modules(modules, edges).collect()] == ["C"]


def test_cohesion_matches_brute_force_over_many_cells(spark):
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(18)]
    docs = [(f"m{i % 3}", " ".join(rng.choices(vocab, k=rng.randint(1, 14)))) for i in range(70)]
    docs += [("m0", "same text with seven rather different words here")] * 4 + [("m9", "alone")]
    df = spark.createDataFrame([("r", *d) for d in docs], "repo string, module string, content string")
    got = {r.module: (r.files, r.sharing_pairs) for r in graph.cohesion(df, cell_rows=4).collect()}
    for m in {d[0] for d in docs}:
        sets = [set(re.findall(r"\b\w{4,}\b", t)) for k, t in docs if k == m]
        shared = sum(len(a & b) > 5 for a, b in itertools.combinations(sets, 2))
        assert got[m] == (len(sets), shared)


def test_packed_blocks_of_word_sets_match_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(graph, "ROWS", 7)
    monkeypatch.setattr(graph, "COLUMNS", 5)
    for _ in range(20):
        vocab = int(rng.integers(8, 60))
        sides = [[np.unique(rng.choice(vocab, rng.integers(6, vocab + 1)) * 1234567891234567) for _ in range(rng.integers(1, 30))] for _ in "ab"]
        copies = [rng.integers(1, 4, len(side)) for side in sides]
        one, two = (graph._packed(pa.array([x.tolist() for x in side], pa.list_(pa.int64())), n) for side, n in zip(sides, copies))
        (a, b), (n, m) = sides, copies
        close = lambda x, y: len(np.intersect1d(x, y)) > 5
        assert graph._sharing_pairs([one, two], 5) == sum(n[i] * m[j] for i, x in enumerate(a) for j, y in enumerate(b) if close(x, y))
        assert graph._sharing_pairs([one], 5) == sum(n[i] * n[j] for i, j in itertools.combinations(range(len(a)), 2) if close(a[i], a[j]))
    many = pa.array([np.unique(rng.choice(3000, 150)).tolist() for _ in range(400)], pa.list_(pa.int64()))
    assert len(graph._packed(many, np.ones(400, int))) < many.nbytes / 2  # it is sent once to each other block


def test_similar_pairs_match_brute_force_over_many_cells(spark):
    rng = random.Random(9)
    vocab = [f"tok{i}" for i in range(12)]
    base = [rng.choices(vocab, k=12) for _ in range(8)]
    texts = []
    for words in base:
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(12)] = rng.choice(vocab)
            texts.append(" ".join(copy))
    texts.append(texts[0])
    df = spark.createDataFrame(
        [("r", i, f"f{i}", 1, t) for i, t in enumerate(texts)],
        "repo string, id long, file_path string, lineno int, text string")
    rows = similarity.similar_pairs(df, similarity.ngrams(F.col("text"))).collect()
    got = {(r.id_a, r.id_b): r.similarity for r in rows}

    grams = [t.split() + [" ".join(p) for p in itertools.pairwise(t.split())] for t in texts]
    terms = sorted({g for row in grams for g in row})
    tf = np.array([[row.count(t) for t in terms] for row in grams], dtype=float)
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1
    unit = tf * idf / np.linalg.norm(tf * idf, axis=1, keepdims=True)
    cosine = unit @ unit.T
    first = {}
    reps = [i for i, row in enumerate(map(tuple, tf)) if first.setdefault(row, i) == i]
    want = {(i, j): cosine[i, j] for i, j in itertools.combinations(reps, 2) if cosine[i, j] >= 0.82}
    want |= {(first[tuple(row)], i): 1.0 for i, row in enumerate(tf) if i not in reps}
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(got[k] - want[k]) < 0.00051 for k in want)


def test_close_pairs_match_brute_force_at_several_thresholds(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    base = [rng.choices(vocab, k=rng.randint(1, 30)) for _ in range(25)]
    texts = [" ".join(rng.choice(vocab) if rng.random() < rng.choice([0, 0.05, 0.2]) else w for w in words)
             for words in base for _ in range(6)] + ["alone on its own", "", "w1", "w1", "w1 w1"]
    df = spark.createDataFrame(
        [("r", i, f"f{i}", 1, t) for i, t in enumerate(texts)], "repo string, id long, file_path string, lineno int, text string")
    grams = [t.split() + [" ".join(p) for p in itertools.pairwise(t.split())] for t in texts]
    terms = sorted({g for row in grams for g in row})
    tf = np.array([[row.count(t) for t in terms] for row in grams], dtype=float)
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1
    norm = np.linalg.norm(tf * idf, axis=1, keepdims=True)
    unit = tf * idf / np.where(norm == 0, 1, norm)
    cosine = unit @ unit.T
    keyed = similarity.keyed_counts(df, similarity.ngrams(F.col("text")), ["repo"])
    first = {}
    reps = [i for i, row in enumerate(map(tuple, tf)) if first.setdefault(row, i) == i]
    copies = [(("r", i, sum(tuple(row) == tuple(tf[i]) for row in tf))) for i in reps]
    table = spark.createDataFrame(copies, "repo string, id long, copies long")
    for threshold in (0.3, 0.6, 0.9):
        vectors = similarity.rare_first_vectors(keyed, table, ["repo"], threshold)
        got = {(r.id_a, r.id_b): r.cosine for r in similarity.close_pairs(vectors, ["repo"], threshold).collect()}
        want = {(i, j): cosine[i, j] for i, j in itertools.combinations(reps, 2) if cosine[i, j] >= threshold}
        assert set(got) == set(want) and len(want) > 5
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    few = similarity.rare_first_vectors(keyed, table, ["repo"], 0.6, max_features=25)
    top = sorted(range(len(terms)), key=lambda t: (-tf[:, t].sum(), terms[t]))[:25]
    cut = (tf * idf)[:, top]
    norm = np.linalg.norm(cut, axis=1, keepdims=True)
    cosine = (cut / np.where(norm == 0, 1, norm)) @ (cut / np.where(norm == 0, 1, norm)).T
    got = {(r.id_a, r.id_b) for r in similarity.close_pairs(few, ["repo"], 0.6).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(reps, 2) if cosine[i, j] >= 0.6}


def test_close_pairs_send_a_vector_once_to_each_pair_of_blocks(spark, capsys):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for repo in ("r", "s"):
        dense = rng.random((30, 12)) * (rng.random((30, 12)) < 0.7) + np.eye(30, 12) * 0.1
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        ids = [f"{repo}{i * 7 % 30:02}" for i in range(30)]
        for name, v in zip(ids, dense):
            at = np.flatnonzero(v)
            tails = np.sqrt(np.cumsum((v[at] ** 2)[::-1])[::-1])
            rows.append((repo, name, [int(x) for x in at], v[at].tolist(), tails[tails >= 0.7].tolist()))
        cosine = dense @ dense.T
        want |= {(repo, *sorted((ids[i], ids[j]))): cosine[i, j] for i, j in itertools.combinations(range(30), 2) if cosine[i, j] >= 0.7}
    vectors = spark.createDataFrame(
        rows, "repo string, id string, terms array<bigint>, weights array<double>, tails array<double>")
    for bounds in ({}, {"block_rows": 7}, {"block_terms": 50}):
        pairs = similarity.close_pairs(vectors, ["repo"], 0.7, **bounds)
        got = {(r.repo, r.id_a, r.id_b): r.cosine for r in pairs.collect()}
        assert set(got) == set(want) and len(want) > 100
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    pairs.explain()
    assert "CoGroups" in capsys.readouterr().out  # and no join that copies both vectors to every pair


def test_similar_pairs_of_near_copies(spark):
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    two, alone = one + " lambda", "other words entirely here"
    items = [("f", 1, one), ("f", 3, one), ("f", 5, two), ("f", 8, one), ("f", 30, one), ("g", 2, one), ("g", 4, two),
             ("h", 1, two), ("k", 1, alone), ("k", 3, alone)]
    df = spark.createDataFrame([("r", i, f, n, t) for i, (f, n, t) in enumerate(items)],
                               "repo string, id long, file_path string, lineno int, text string")
    for near_lines in (10, 3, 0):
        rows = similarity.similar_pairs(df, similarity.ngrams(F.col("text")), near_lines=near_lines).collect()
        got = [(r.id_a, r.id_b) for r in rows]
        close = lambda x, y: items[x][0] == items[y][0] and abs(items[x][1] - items[y][1]) < near_lines  # noqa: E731, B023
        same = {t: [i for i, x in enumerate(items) if x[2] == t] for t in (one, two, alone)}
        first = lambda x, t: next(((min(x, y), max(x, y)) for y in same[t] if not close(x, y)), None)  # noqa: E731, B023
        want = {first(x, t) for t in same for x in same[t][1:]}
        a, b = same[one][0], same[two][0]
        if close(a, b):
            want |= {first(x, two) for x in same[one]} | {first(x, one) for x in same[two]}
        else:
            want.add((a, b))
            want |= {first(x, u) for t, u in ((one, two), (two, one)) for x in same[t][1:] if close(x, same[t][0])}
        assert sorted(got) == sorted(want - {None})
        assert {i for p in got for i in p} >= set(range(8))


def test_similar_pairs_send_no_table_through_the_driver(spark, capsys):
    texts = ["one two three four five", "one two three four five six", "one two three four five", "one two three four five"]
    docs = spark.createDataFrame([("r", f"f:{i}", "f", 4 * i, t) for i, t in enumerate(texts)],
                                 "repo string, id string, file_path string, lineno int, text string")
    pairs = similarity.similar_pairs(docs, similarity.ngrams(F.col("text")), 0.6)
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {("f:0", "f:3")}
    pairs.explain()
    assert "Broadcast" not in capsys.readouterr().out  # small files may hold very many rows


def test_clones_hash_texts_once(spark):
    rows = [("r", f"f{i}.py", "f", 1, "def f():\n  pass") for i in range(4)]
    items = spark.createDataFrame(rows, "repo string, file_path string, name string, lineno int, source string")
    clones = similarity.exact_clones(items)
    assert "md5(" not in clones._jdf.queryExecution().optimizedPlan().toString() and clones.count() == 3


def test_exact_clones_skip_near_copies(spark):
    rows = [("r", "a", "f", 1, "x  y"), ("r", "a", "g", 4, "x y"), ("r", "a", "h", 40, "x y"),
            ("r", "b", "f", 1, " x y"), ("r", "c", "z", 1, "near"), ("r", "c", "z", 3, "near")]
    df = spark.createDataFrame(
        rows, "repo string, file_path string, name string, lineno int, source string")
    got = similarity.exact_clones(df).collect()
    assert {(r.file_a, r.line_a, r.file_b, r.line_b) for r in got} == {
        ("a", 40, "a", 4), ("a", 1, "a", 40), ("a", 1, "b", 1)}
    assert {r.pairs for r in got} == {5}


def test_exact_clone_partners_match_brute_force(spark):
    rng = random.Random(3)
    items = sorted({(f"t{rng.randrange(3)}", f"f{rng.randrange(3)}", rng.randrange(40)) for _ in range(60)})
    df = spark.createDataFrame(
        [("r", f, "n", line, t) for t, f, line in items],
        "repo string, file_path string, name string, lineno int, source string")
    got = {(r.file_b, r.line_b, r.file_a, r.line_a, r.pairs) for r in similarity.exact_clones(df).collect()}
    want = set()
    for text in ("t0", "t1", "t2"):
        spots = [(f, line) for t, f, line in items if t == text]
        apart = lambda a, b: a[0] != b[0] or abs(a[1] - b[1]) > 5
        pairs = sum(apart(a, b) for a, b in itertools.combinations(spots, 2))
        for s in spots[1:]:
            want |= {(*s, *p, pairs) for p in [x for x in spots if apart(x, s)][:1]}
    assert got == want and len(want) > 40


def test_search_ranks_by_cosine(spark):
    docs = spark.createDataFrame(
        [(1, "load user token"), (2, "save user file"), (3, "parse json file")], "id long, text string")
    queries = spark.createDataFrame([(7, "user token"), (8, "nothing")], "query_id long, text string")
    terms = similarity.ngrams(F.col("text"), ["the"])
    index, idf = similarity.build_index(docs, terms)
    rows = similarity.search(index, idf, queries, terms).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in rows] == [(7, 1), (7, 2)]


def test_model_coefficients_are_optimal():
    weights, bias = models.bug_coefficients()
    x, mean, spread = models._standardise(models.BUG_ROWS)
    y = np.array(models.BUG_LABELS)
    w = np.array(weights) * spread
    p = 1 / (1 + np.exp(-(np.array(models.BUG_ROWS) @ np.array(weights) + bias)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-8 and abs((p - y).sum()) < 1e-8
    weights, bias = models.complexity_coefficients()
    x, mean, spread = models._standardise(models.COMPLEXITY_ROWS)
    y = np.array(models.COMPLEXITY_SCORES)
    w = np.array(weights) * spread
    rest = np.array(models.COMPLEXITY_ROWS) @ np.array(weights) + bias - y
    assert np.abs(x.T @ rest + w).max() < 1e-8 and abs(rest.sum()) < 1e-8


def test_models_fitted_in_spark_equal_closed_forms(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(10_000, 4)) * [1, 5, 0.1, 1] + [0, 3, 9, 0]
    x[:, 3] = 2.5  # a constant column
    y = x @ [2.0, -1.0, 30.0, 0.0] + rng.normal(size=10_000)
    label = (rng.random(10_000) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1] + 1)))).astype(float)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(
        [(*map(float, r), float(t), float(z)) for r, t, z in zip(x, y, label)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0)],
        "a double, b double, c double, d double, y double, label double").repartition(7)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[3] = 1
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y - y.mean()))
    weights, bias = models.fit_complexity(df, "y", names)
    assert np.allclose(weights, w / spread, atol=1e-6) and abs(bias - (y.mean() - (w / spread) @ mean)) < 1e-6
    weights, bias = models.fit_bug_risk(df, "label", names)
    p = 1 / (1 + np.exp(-(x @ weights + bias)))
    own = np.array(weights) * spread
    assert np.abs(z.T @ (p - label) + own).max() < 1e-5 and abs((p - label).sum()) < 1e-5
    with np.testing.assert_raises(ValueError):
        models.fit_complexity(df.filter("a > 1e9"), "y", names)


def test_top_per_key_beyond_the_group_limit(spark):
    df = spark.range(6000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    top = top_per_key(df, ["k"], [F.desc("v")], 1500)
    assert top.agg(F.count("*"), F.min("v"), F.max("rank")).first()[:] == (1500, 4500, 1500)


def test_previous_value_crosses_empty_buckets(spark):
    days = [1, 1, 2, 5, 5, 9]
    rows = [("a", f"2024-01-{d:02d} 0{i}:00:00", i) for i, d in enumerate(days)] + [("b", "2024-01-03 00:00:00", 9)]
    df = spark.createDataFrame(rows, "k string, t string, v int").withColumn("t", F.to_timestamp("t"))
    got = previous_value(df, ["k"], ["t", "v"], F.to_date("t"), "v", "p")
    assert {(r.k, r.v): r.p for r in got.collect()} == {
        ("a", 0): None, ("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 4): 3, ("a", 5): 4, ("b", 9): None}


def test_similar_pairs_keep_no_term_strings_while_pairs_are_sought(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/corpuscope"
    before = set(folder_names(spark, folder))
    texts = ["one two three four five", "one two three four five six", "one two three four five", "seven eight", None]
    docs = spark.createDataFrame([("r", i, f"f{i}", 1, t) for i, t in enumerate(texts)],
                                 "repo string, id long, file_path string, lineno int, text string")
    got = {(r.id_a, r.id_b) for r in similarity.similar_pairs(docs, similarity.ngrams(F.col("text")), 0.6).collect()}
    assert got == {(0, 1), (0, 2)}
    left = set(folder_names(spark, folder)) - before
    assert not [n for n in left if n.startswith("term-counts")]
    terms, = [n for n in left if n.startswith("key-terms")]
    assert "word" not in spark.read.parquet(f"{folder}/{terms}").columns


def test_tfidf_takes_df_from_other_blocks_and_shuffles_no_terms(spark):
    rng = random.Random(12)
    words = ["ab", "cd", "ef", "ga", "été", "x1"]
    rows = [(rng.choice(["r", "s", None]), i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)]
    rows += [("r", 100, None), ("r", 3, "ab ab cd"), ("r", 3, "ab ef"), ("s", None, "ab"), ("s", None, "cd cd")]
    df = spark.createDataFrame(rows, "repo string, id long, text string")
    counted = [(r, i, Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])) for r, i, t in ((r, i, (t or "").split()) for r, i, t in rows) if r]
    size = Counter(r for r, _, _ in counted)
    dfs = Counter((r, term) for r, _, terms in counted for term in terms)
    raw = [(r, i, term, dfs[r, term], n * (math.log((size[r] + 1) / (dfs[r, term] + 1)) + 1))
           for r, i, terms in counted for term, n in terms.items()]
    squares = Counter()
    for r, i, _, _, w in raw:
        squares[r, i] += w * w
    want = sorted(((r, str(i), term, d, round(w / math.sqrt(squares[r, i]), 9)) for r, i, term, d, w in raw))
    before = set(folder_names(spark, f"{spark.conf.get('spark.checkpoint.dir')}/corpuscope"))
    for block_mb in (8.0, 0.0004):
        weights, _ = similarity.tfidf(df, similarity.ngrams(F.col("text")), block_mb=block_mb)
        got = sorted((x.repo, str(x.id), x.term, x.df, round(x.w, 9)) for x in weights.collect())
        assert got == want and weights.columns == ["repo", "id", "term", "df", "w"]
    after = set(folder_names(spark, f"{spark.conf.get('spark.checkpoint.dir')}/corpuscope"))
    assert not [name for name in after - before if name.startswith("term-counts")]
    empty, _ = similarity.tfidf(df.limit(0), similarity.ngrams(F.col("text")))
    assert empty.collect() == []
