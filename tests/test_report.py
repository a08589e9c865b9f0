from pyspark.sql import functions as F

from corpuscope.plans.report import analyze, report
from corpuscope.sources import runs


def test_report_of_a_small_corpus(files):
    body = "\n".join(["import db.session", "def fetch(a, b, c, d, e, f):", "    password = 'hunter22'",
                      "    for x in a:", "        requests.get(x)", "    return eval(x)  # TODO"])
    df = files(
        ("o/r", "app/api/main.py", "Python", body), ("o/r", "app/api/copy.py", "Python", body),
        ("o/r", "web/a.ts", "TypeScript", "var a = 1\n" * 6), ("o/r", "README.md", "Markdown", "hi\n"),
        ("o/r", "tests/test_main.py", "Python", "import pytest\n\n\ndef test_a():\n    fetch()\n"),
        ("o/r", "requirements.txt", "Text", "flask==1.0\n"), ("o/empty", "x.go", "Go", "package x\n"),
    )
    rows = {r.repo: r for r in report(df, analyze(df)).collect()}
    assert set(rows) == {"o/r", "o/empty"}
    row = rows["o/r"]
    assert row.repo_name == "o/r" and row.total_files_analyzed == 6
    assert row.framework == "pytest" and row.tested_files == 1
    assert row.cards.security_status == "Critical" and row.quality_gate == "fail"
    titles = {i.title for i in row.actionable_insights}
    assert {"Hardcoded Password", "Use of eval()/exec()", "HTTP Request in Loop", "N+1 Query Pattern",
            "Too Many Parameters", "Tech Debt Comments"} <= titles
    assert any(t.startswith("Semantic Clone (exact") for t in titles)
    assert row.critical_issues_count >= 4
    assert rows["o/empty"].quality_gate == "pass" and rows["o/empty"].quality_score == 70.0


def test_report_parts_and_way_into_the_run_history(spark, files):
    body = "def fetch(a, b, c):\n    total = 0\n    for x in a:\n        total += x\n        total -= b\n    return eval(c)\n"
    other = body.replace("total", "amount").replace("fetch", "load")
    df = files(("r", "app/api/one.py", "Python", "import db.session\n" + body), ("r", "app/db/two.py", "Python", "import api.x\n" + body),
               ("r", "app/ui/three.py", "Python", "import os\n" + other))
    before = files(("r", "app/api/one.py", "Python", "import db.session\n" + body), ("r", "app/db/two.py", "Python", "old"),
                   ("r", "app/ui/three.py", "Python", "import os\n" + other))
    blame = spark.createDataFrame(
        [("r", "app/api/one.py", 7, "Ann", "a@x", "0123456789", "2024-01-01", "text")],
        "repo string, file_path string, line_no int, author string, email string, commit_sha string, ts string, summary string")
    commits = spark.createDataFrame([("r", "s1", "a@x", "2024-01-01", "m")], "repo string, sha string, author_email string, ts string, message string")
    touched = spark.createDataFrame([("r", "s1", "app/api/one.py", "M")], "repo string, sha string, file_path string, change string")
    tables = analyze(df, blame=blame, commits=commits, commit_files=touched, before=before)
    out = report(df, tables, analyzed_at=F.lit("2024-05-06 07:08:09"))
    row = out.first()
    kinds = {(c.func_a, c.func_b, c.clone_type) for c in row.clone_pairs}
    assert ("fetch", "fetch", "exact") in kinds and any({a, z} == {"fetch", "load"} and k != "exact" for a, z, k in kinds)
    assert row.ml_summary.clones == len(row.clone_pairs) and row.missing_type_hints[0].missing_params == ["a", "b", "c"]
    assert {(e.source, e.target) for e in row.module_graph.edges} >= {("API", "Database"), ("Database", "API")}
    assert [(a.author_key, a.total_issues > 0) for a in row.author_stats] == [("a@x", True)]
    assert [(h.file_path, h.commit_count) for h in row.git_hotspots] == [("app/api/one.py", 1)]
    assert (row.incremental_stats.total_files, row.incremental_stats.changed_files) == (3, 1)
    assert len(report(df, tables, list_rows=1).first().clone_pairs) == 1
    run = runs.run_from_report(out.select(F.to_json(F.struct("*")).alias("report"))).first()
    assert (run.repo, run.repo_name, str(run.analyzed_at)) == ("r", row.repo_name, "2024-05-06 07:08:09")
    assert run.quality_score == row.quality_score > 0 and run.total_loc == row.total_lines and run.total_files == 3
    assert run.security_high == row.high_total and run.tech_debt_hours == row.tech_debt_hours
    assert run.doc_coverage == row.doc_coverage and run.cyclomatic_avg == row.cyclomatic_avg > 0
    assert run.maintainability == row.cards.maintainability_value and run.critical_count == row.critical_issues_count


def test_analysis_reads_the_files_once(spark, files):
    reads = spark.sparkContext.accumulator(0)
    df = files(("r", "app/api/a.py", "Python", "import os\ndef f(a):\n    return a\n"), ("r", "b.go", "Go", "package b\n"))

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    tables = analyze(df.mapInArrow(seen, df.schema))
    assert reads.value == 2 and tables["lengths"].count() == 1
