import ast
import random

from pyspark.sql import functions as F

from corpuscope.operators import dependencies, structure
from corpuscope.operators.dependencies import vulnerable_dependencies
from corpuscope.plans import bindings
from corpuscope.sources import corpus, manifests, runs, syntax


def test_read_corpus(spark, tmp_path):
    for name, data in {
        "one/a.py": b"x = 1\ny = 2\n", "one/node_modules/b.js": b"1", "one/c.txt": b"1", "one/empty.py": b"",
        "two/deep/d.TS": "é".encode(), "two/latin.md": "é".encode("latin-1"), "two/big.py": b"x" * 600_000,
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = {(r.repo, r.file_path): r for r in corpus.read_corpus(
        spark, str(tmp_path), max_bytes=corpus.REFERENCE_MAX_BYTES).collect()}
    assert set(rows) == {("one", "a.py"), ("two", "deep/d.TS"), ("two", "latin.md")}
    every = corpus.read_corpus(spark, str(tmp_path))
    assert {(r.repo, r.file_path) for r in every.collect()} == {*rows, ("two", "big.py")}
    assert rows["one", "a.py"].line_count == 2 and rows["one", "a.py"].language == "Python"
    assert rows["two", "deep/d.TS"].content == rows["two", "latin.md"].content == "é"


def test_runs_round_trip_and_report(spark, tmp_path):
    report = ('{"repo_url": "u", "repo_name": "n", "analyzed_at": "2024-01-02T03:04:05+00:00", '
              '"quality_score": {"value": 71}, "security_risks": {"value": 2}, "critical_issues_count": 3, '
              '"maintainability": {"value": "B"}, "estimated_tech_debt_hours": {"value": "4.5h"}}')
    rows = runs.run_from_report(spark.createDataFrame([(report,)], "report string"))
    runs.write_runs(rows.withColumn("run_id", F.lit(1)), str(tmp_path / "runs"))
    back = runs.read_runs(spark, str(tmp_path / "runs"), "u").first()
    assert (back.quality_score, back.security_high, back.critical_count, back.tech_debt_hours,
            back.maintainability) == (71.0, 2, 3, 4.5, "B")
    bad = runs.parse_report(spark.createDataFrame([("{oops",)], "full_report string"), "full_report",
                            "struct<a:int>")
    assert bad.first().report.a is None and bad.first().full_report == "{oops"


PY = '''import os
@decorate(sum([i for i in y]))
def outer(self, a, b: int = 1):
    """Doc."""
    def inner(c):
        while c and a or b:
            c -= 1
        return [x for x in c if x]
    for i in a:
        if i:
            try:
                get(i)
            except ValueError:
                pass
    return inner
'''


def test_nested_functions_and_bad_files(files):
    df = files(("r", "a.py", "Python", PY), ("r", "bad.py", "Python", "def (:\n1\n2\n3\n4\n"),
               ("r", "b.js", "JavaScript", PY))
    nodes = syntax.ast_nodes(df).cache()
    assert nodes.select("file_path").distinct().count() == 1
    assert nodes.count() == sum(1 for _ in ast.walk(ast.parse(PY)))
    functions = syntax.extract_functions(nodes)
    rows = {r.name: r for r in functions.collect()}
    assert [p.name for p in rows["outer"].params] == ["a", "b"] and rows["outer"].has_param_ann
    assert rows["outer"].lineno == 3 and rows["outer"].source.startswith("def outer")
    counts = structure.function_counts(nodes)
    cx = {r.name: r for r in structure.function_complexity(functions, counts).collect()}
    # outer: for, if, one handler; inner: while, two boolean values, comprehension with a condition
    assert (cx["outer"].complexity, cx["inner"].complexity) == (4, 6)
    # outer: while 1 + boolean 1 (the nested chain is hidden) + for 1 + if 2 + try 3 + handler 4
    assert (cx["outer"].cognitive, cx["inner"].cognitive) == (12, 2)
    feats = {r.name: r for r in structure.function_features(functions, counts).collect()}
    assert feats["outer"].depth == 4.0 and feats["outer"].comprehensions == 1.0
    assert structure.calls_in_loops(nodes).filter("title = 'N+1 Query Pattern'").count() == 1
    tokens = {r.fn_id: r.tokens for r in structure.structure_tokens(nodes).collect()}
    for r in rows.values():
        body = ast.parse("\n".join(line[r.source.index("def"):] if line.startswith(" ") else line
                                   for line in r.source.split("\n")) if r.name == "outer"
                         else "\n".join(line[4:] for line in r.source.split("\n")))
        assert len(tokens[r.fn_id]) == sum(1 for _ in ast.walk(body))


def test_manifests(files):
    df = files(
        ("r", "requirements.txt", "", "# c\nFlask==1.2\nflask>=9\n-r x\ngit+https://y\nplain\n"),
        ("r", "venv/requirements.txt", "", "skipped==1\n"),
        ("r", "Pipfile", "", "[packages]\na = \"==1.0\"\n[requires]\nb = \"2\"\n[dev-packages]\nc = \"*\"\n"),
        ("r", "package.json", "", '{"dependencies": {"x": "^1.2.3"}, "peerDependencies": {"y": "latest"}}'),
        ("r", "broken/package.json", "", "{"),
        ("r", "go.mod", "", "require (\n\tx.org/z v1.4.0-rc1\n)\n"),
    )
    got = {(r.name, r.version, r.ecosystem) for r in manifests.collect_dependencies(df).collect()}
    assert got == {("Flask", "1.2", "PyPI"), ("a", "1.0", "PyPI"), ("x", "1.2.3", "npm"),
                   ("x.org/z", "1.4.0-rc1", "Go")}


def test_vulnerable_versions(spark):
    deps = spark.createDataFrame(
        [("r", "f", "Flask", v, "PyPI") for v in ("0.9", "1.0", "1.10", "2.0")],
        "repo string, source_file string, name string, version string, ecosystem string")
    adv = spark.sql(
        "select 'ID' id, 's' summary, array('CVE-1') aliases, 'moderate' severity, "
        "named_struct('name', 'flask', 'ecosystem', 'PyPI') package, "
        "array(named_struct('ranges', array(named_struct('events', array("
        "named_struct('introduced', '1.0', 'fixed', cast(null as string)), "
        "named_struct('introduced', cast(null as string), 'fixed', '2.0')))))) affected")
    rows = vulnerable_dependencies(deps, adv).collect()
    assert {(r.installed_version, r.fixed_version, r.severity, r.cve) for r in rows} == {
        ("1.0", "2.0", "MEDIUM", "CVE-1"), ("1.10", "2.0", "MEDIUM", "CVE-1")}


def test_versions_in_ranges_match_every_pair(spark):
    rng = random.Random(3)
    version = lambda: ".".join(str(rng.randrange(4)) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "-rc1", ".post1"])
    event = lambda: (rng.choice([None, "0", version()]), rng.choice([None, version()]))
    versions = [(rng.choice("pq"), rng.choice([None, version(), version()])) for _ in range(120)]
    advisories = [
        (rng.choice("pqr"), f"A{i}", [([([event() for _ in range(rng.randint(0, 4))],) for _ in range(rng.randint(1, 2))],)
                                     for _ in range(rng.randint(0, 2))]) for i in range(60)]
    v = spark.createDataFrame(versions, "package string, version string")
    a = spark.createDataFrame(
        advisories, "package string, id string, affected array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>")
    got = sorted(map(tuple, dependencies.versions_in_ranges(v, a, ["package"]).collect()))
    want = v.distinct().join(a, "package").filter(dependencies.in_ranges(F.col("version"), F.col("affected"))).select(
        "package", "version", "id")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 500


def test_versions_are_ordered(spark):
    rising = ["0.9", "1.0.dev1", "1.0a1", "1.0-beta.2", "1.0-rc1", "1.0-rc1.1", "1.0-rc2", "v1.0.0+build", "1.0.post1",
              "1.0.0.0.0.0.7", "1.0.0.1", "1.2", "1.10", "2"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rising)], "i int, v string")
    got = [r.v for r in df.orderBy(dependencies.version_key(F.col("v"))).collect()]
    assert got == rising
    same = spark.createDataFrame([("1.0", "v1"), ("2.0.0", "2+x"), ("latest", "0")], "a string, b string")
    assert all(r[0] for r in same.select(
        dependencies.version_key(F.col("a")) == dependencies.version_key(F.col("b"))).collect())


def test_ranges_with_several_intervals(spark):
    def affected(*events):
        rows = ", ".join(
            f"named_struct('introduced', {i}, 'fixed', {f})" for i, f in
            [(f"'{v}'", "cast(null as string)") if k == "i" else ("cast(null as string)", f"'{v}'") for k, v in events])
        return f"array(named_struct('ranges', array(named_struct('events', array({rows})))))"

    two = [("i", "1.0"), ("f", "1.5"), ("i", "2.0"), ("f", "2.3")]
    cases = [(two, "0.9", False), (two, "1.0", True), (two, "1.5", False), (two, "1.9", False), (two, "2.1", True),
             (two, "2.3", False), (two[::-1], "2.1", True), ([("i", "1.0"), ("f", "2.0")], "2.0-rc1", True),
             ([("i", "1.0"), ("f", "2.0")], "1.0-rc1", False), ([("i", "0"), ("f", "2")], "0.0-rc1", True),
             ([("i", "1.0.0.0.0.0.5"), ("f", "1.0.0.0.0.0.9")], "1.0.0.0.0.0.7", True), ([("f", "3")], "2.9", True),
             ([("i", "1")], "99", True)]
    for events, version, want in cases:
        got = spark.sql(f"select '{version}' v, {affected(*events)} a").select(
            dependencies.in_ranges(F.col("v"), F.col("a"))).first()[0]
        assert got is want, (events, version)


def test_files_of_one_partition_are_parsed_by_all_tasks(files):
    rows = [("r", f"f{i}.py" if i % 2 else "same.py", "Python", "import a\n\ndef f():\n    x = 1\n    return x\n") for i in range(200)]
    nodes = syntax.ast_nodes(files(*rows).coalesce(1))
    per_task = nodes.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    one = len(list(ast.walk(ast.parse(rows[0][3]))))
    assert sum(r.n for r in per_task) == 200 * one
    assert len(per_task) == 4 and max(r.n for r in per_task) <= 60 * one


def test_wanted_types_and_columns_are_those_of_the_whole_walk(files):
    rows = [("r", "a.py", "Python", PY), ("r", "b.py", "Python", "@deco(1)\nclass C:\n    x: int = -1\n    async def f(self):\n        return [i for i in self.a]\n")]
    every = syntax.ast_nodes(files(*rows))
    order, some = ["file_path", "node_id"], ["Call", "ClassDef", *syntax.FUNCTION_TYPES]
    wanted = every.filter(F.col("node_type").isin(*some)).orderBy(*order).collect()
    assert syntax.ast_nodes(files(*rows), types=some).orderBy(*order).collect() == wanted and len(wanted) == 8
    few = syntax.ast_nodes(files(*rows), columns=["node_id", "file_path", "loop_depth"])
    assert sorted(few.collect()) == sorted(every.select("file_path", "node_id", "loop_depth").collect())
    # measures read no other nodes than those they name
    for measure in (structure.function_counts, lambda n: structure.halstead(structure.code_tokens(n), ["file_path"])):
        lean = syntax.ast_nodes(files(*rows), types=(*structure.MEASURED_TYPES, *syntax.COMPUTING_TYPES))
        assert sorted(map(str, measure(lean).collect())) == sorted(map(str, measure(every).collect()))


def test_generated_files_are_written_out_by_all_tasks(spark, tmp_path):
    parts = [(i, "red gear", f"Brand#{i % 9}", "LARGE", i % 50) for i in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet")
    per_task = bindings.code_files(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) == 4 and max(r["count"] for r in per_task) <= 110


def test_generated_files_are_dealt_once(spark, tmp_path):
    parts = [(i, "red gear", f"Brand#{i % 5}{i % 3}", "LARGE", i % 50) for i in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(
        f"{tmp_path}/part.parquet")
    once = syntax.ast_nodes(bindings.code_files(spark, str(tmp_path)), deal=False)
    twice = syntax.ast_nodes(bindings.code_files(spark, str(tmp_path)))
    deals = [df._jdf.queryExecution().executedPlan().toString().count("RoundRobinPartitioning") for df in (once, twice)]
    order = ["repo", "file_path", "node_id"]
    assert deals == [1, 2] and once.orderBy(*order).collect() == twice.orderBy(*order).collect() and once.count() > 40


def test_fields_without_nodes_are_not_walked():
    tree = ast.parse("global a\n@d\nasync def f(x: int = 1, *y, z=f'{q!r:>{w}}', **k) -> t:\n    match x:\n"
                     "        case {'a': 1, **r} | [None, *s]: return lambda u: (yield)\nfrom m import n as o\n")
    rows = list(syntax._flatten(tree, []))
    assert [r[7] for r in rows] == [type(n).__name__ for n in ast.walk(tree)] and len(rows) > 40
    assert syntax._below(ast.Constant) == () and syntax._below(ast.Name) == ("ctx",)


def test_nodes_side_by_side_share_their_scope():
    """Nodes are queued with one scope object; what decorates a function stands outside of it."""
    tree = ast.parse("@d(a)\ndef f(x):\n    for i in x:\n        g(i or x)\n    class C:\n        @e\n        def m(self): h()\n")
    calls = {r[14][0][1]: r for r in syntax._flatten(tree, [], frozenset(["Call"]))}
    fns = {dict(r[14])["name"]: r for r in syntax._flatten(tree, [], frozenset(["FunctionDef"]))}
    assert calls["d"][2:7] == (None, (), "f", (), ()) and calls["g"][5:7] == ((fns["f"][0],), (1,)) and calls["g"][10] == 1
    assert calls["h"][5] == (fns["f"][0], fns["m"][0]) and len(calls["h"][3]) == 1 and calls["h"][5] is not calls["g"][5]
    plans = syntax._Plans(frozenset(["Call"]))
    assert list(syntax._flatten(tree, [], plans=plans)) == list(calls.values())
    assert plans[ast.Name] == (False, False, ("ctx",)) and plans[ast.For][1] and plans[ast.Call][0]
