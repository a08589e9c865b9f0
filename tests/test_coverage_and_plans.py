import random

import pytest

from corpuscope.operators import coverage, incremental
from corpuscope.plans.catalog import QUERIES


def test_tests_map_by_name_then_import(files):
    df = files(
        ("r", "app/auth.py", "Python", "def login():\n    pass\ndef logout(): pass\n"),
        ("r", "app/authority.py", "Python", "def f(): pass\n"), ("r", "app/db.py", "Python", "x = 1\n"),
        ("r", "tests/test_auth.py", "Python", "def test_a(): login()\n"),
        ("r", "tests/test_author.py", "Python", "def test_b(): pass\ndef test_c(): pass\n"),
        ("r", "tests/test_zz.py", "Python", "from app.db_tools import x\n"),
    )
    sources, tests = coverage.source_files(df), coverage.test_files(df)
    mapping = coverage.map_tests(sources, tests)
    assert {(r.test_path[6:], r.file_path[4:]) for r in mapping.collect()} == {
        ("test_auth.py", "auth.py"), ("test_author.py", "auth.py"), ("test_zz.py", "db.py")}
    from corpuscope.sources import syntax
    functions = syntax.extract_functions(syntax.ast_nodes(sources, 1))
    open_fns = coverage.untested_functions(functions, mapping, tests)
    assert {(r.file_path, r.name) for r in open_fns.collect()} == {
        ("app/auth.py", "logout"), ("app/authority.py", "f")}


def test_contained_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("ab_é", k=n))
    needles = [("r" if i % 4 else "q", rng.choice([None, "", word(rng.randint(1, 6))])) for i in range(80)]
    texts = [("r" if i % 3 else "q", rng.choice([None, "", word(rng.randint(1, 40))])) for i in range(120)]
    got = coverage.contained(
        spark.createDataFrame(needles, "repo string, needle string"), spark.createDataFrame(texts, "repo string, text string"))
    rows = [tuple(r) for r in got.collect()]
    want = {(a, n, t) for a, n in needles for b, t in texts if a == b and n and t is not None and n in t}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100


def test_split_is_a_partition_and_no_diff_means_all(spark):
    schema = "repo string, file_path string, content string"
    old = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z")], schema)
    new = spark.createDataFrame([("a", "1", "x"), ("a", "2", "Y"), ("a", "3", "n"), ("b", "1", "z")], schema)
    changed = incremental.changed_paths(incremental.diff_snapshots(old, new))
    again, kept = incremental.split_incremental(new, changed)
    assert {(r.repo, r.file_path) for r in again.collect()} == {("a", "2"), ("a", "3"), ("b", "1")}
    assert {(r.repo, r.file_path) for r in kept.collect()} == {("a", "1")}


NARROW = ["r1_scan_line_rules", "p5_normalize_whitespace_hash", "r13_keyword_density", "m7_bug_risk_model"]


@pytest.mark.parametrize("name", [
    *NARROW, "j6_diff_snapshots", "g1_language_breakdown", "g3_duplication_rate", "w1_dedup_first",
    "w6_run_delta", "j1_attach_blame", "g26_leaderboard", "n3_layer_violations", "w4_history",
])
def test_plans_stay_in_the_jvm_without_cartesian_products(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert forbidden not in plan
