"""Queries over joins: blame, advisories, tests, snapshots, clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators import coverage, dependencies, graph, incremental, provenance, similarity
from corpuscope.plans import bindings as b
from corpuscope.plans.queries_scalars import code_functions
from corpuscope.plans.queries_sources import DEPENDENCIES_SQL
from corpuscope.plans.registry import query
from corpuscope.sources import syntax


def line_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as findings; line 7 is about the whole file, dir9 about the architecture."""
    return b.table(spark, sf, "lineitem").select(
        F.lit("r").alias("repo"),
        F.expr("CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'architecture' "
               "ELSE 'o' || l_orderkey END").alias("file_path"),
        F.expr("CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_orderkey % 5 + 1 AS INT) END")
        .alias("line_no"),
        F.col("l_linenumber").alias("seq"), F.col("l_partkey"),
    )


BLAME_SQL = """
findings AS (
  SELECT 'r' AS repo, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'architecture'
         ELSE 'o' || l_orderkey END AS file_path,
         CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_orderkey % 5 + 1 AS INT) END AS line_no,
         l_linenumber AS seq, l_partkey FROM lineitem),
blame AS (
  SELECT 'r' AS repo, 'o' || o_orderkey AS file_path, CAST(o_orderkey % 5 + 1 AS INT) AS line_no,
         'abcdef' || o_orderkey || '0000000000' AS commit_sha, 'a' || o_custkey AS author,
         'a' || o_custkey || '@x.org' AS email, o_orderdate AS ts,
         'priority ' || o_orderpriority AS summary FROM orders)"""


@query("j1_attach_blame", f"""
WITH {BLAME_SQL}
SELECT f.file_path, f.line_no, seq, l_partkey, b.author, substr(b.commit_sha, 1, 8) AS commit,
       b.ts AS blame_ts, substr(b.summary, 1, 60) AS summary
FROM findings f LEFT JOIN blame b ON f.repo = b.repo AND f.file_path = b.file_path
 AND f.line_no = b.line_no AND f.line_no > 0 AND f.file_path <> 'architecture'""")
def blame(spark: SparkSession, sf: str) -> DataFrame:
    lines = b.table(spark, sf, "orders").selectExpr(
        "'r' AS repo", "'o' || o_orderkey AS file_path", "CAST(o_orderkey % 5 + 1 AS INT) AS line_no",
        "'abcdef' || o_orderkey || '0000000000' AS commit_sha", "'a' || o_custkey AS author",
        "'a' || o_custkey || '@x.org' AS email", "o_orderdate AS ts",
        "'priority ' || o_orderpriority AS summary",
    )
    return provenance.attach_blame(
        line_findings(spark, sf), lines, provenance.REFERENCE_SHA, provenance.REFERENCE_SUMMARY
    ).select(
        "file_path", "line_no", "seq", "l_partkey", "author", "commit", "blame_ts", "summary"
    )


@query("j2_vulnerable_dependencies", f"""
WITH {DEPENDENCIES_SQL}, {b.ADVISORY_SQL}
SELECT repo, d.name AS package, d.version AS installed_version,
       coalesce(fixed, 'latest') AS fixed_version, severity, summary, cve, id AS osv_id, source_file
FROM dependencies d JOIN advisory a ON d.ecosystem = 'PyPI' AND lower(d.name) = lower(a.name)
WHERE CAST(split_part(version, '.', 1) AS INT) >= CAST(introduced AS INT)
  AND (fixed IS NULL OR (CAST(split_part(version, '.', 1) AS INT) * 1000
        + CAST(coalesce(nullif(split_part(version, '.', 2), ''), '0') AS INT))
       < (CAST(split_part(fixed, '.', 1) AS INT) * 1000 + CAST(split_part(fixed, '.', 2) AS INT)))""")
def vulnerable(spark: SparkSession, sf: str) -> DataFrame:
    from corpuscope.sources.manifests import collect_dependencies

    deps = collect_dependencies(b.manifest_files(spark, sf))
    return dependencies.vulnerable_dependencies(
        deps, b.advisories(spark, sf), dependencies.REFERENCE_SUMMARY
    ).drop("ecosystem")


def _tests_and_sources(spark: SparkSession, sf: str):
    files = b.coverage_files(spark, sf)
    return coverage.source_files(files), coverage.test_files(files), files


@query("j3_map_tests_by_name", f"WITH {b.COVERAGE_SQL}, {b.BY_NAME_SQL} SELECT * FROM by_name")
def tests_by_name(spark: SparkSession, sf: str) -> DataFrame:
    sources, tests, _ = _tests_and_sources(spark, sf)
    return coverage.map_tests_by_name(sources, tests)


@query("j4_map_tests_by_import",
       f"WITH {b.COVERAGE_SQL}, {b.BY_NAME_SQL}, {b.BY_IMPORT_SQL} SELECT * FROM by_import")
def tests_by_import(spark: SparkSession, sf: str) -> DataFrame:
    sources, tests, _ = _tests_and_sources(spark, sf)
    return coverage.map_tests_by_import(
        sources, tests, coverage.map_tests_by_name(sources, tests)
    )


@query("j5_untested_functions", f"""
WITH {b.COVERAGE_SQL}, {b.BY_NAME_SQL}, {b.BY_IMPORT_SQL},
public AS (SELECT repo, file_path, fn_name AS name FROM sources
           UNION SELECT repo, file_path, 'noop' FROM sources WHERE has_class AND n_methods > 0)
SELECT p.repo, p.file_path, p.name FROM public p
WHERE NOT EXISTS (SELECT 1 FROM mapping m JOIN tests t ON t.repo = m.repo AND t.test_path = m.test_path
                  WHERE m.repo = p.repo AND m.file_path = p.file_path AND contains(t.content, p.name))""")
def untested(spark: SparkSession, sf: str) -> DataFrame:
    sources, tests, _ = _tests_and_sources(spark, sf)
    functions = syntax.extract_functions(syntax.ast_nodes(sources, types=syntax.FUNCTION_TYPES))
    return coverage.untested_functions(functions, coverage.map_tests(sources, tests), tests)


@query("j6_diff_snapshots", f"WITH {b.SNAP_SQL} SELECT * FROM diff")
def diff(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.diff_snapshots(*b.snapshots(spark, sf))


def marked_files(spark: SparkSession, sf: str) -> DataFrame:
    old, new = b.snapshots(spark, sf)
    changed = incremental.changed_paths(incremental.diff_snapshots(old, new))
    return incremental.mark_incremental(new, changed)


MARKED_SQL = """
marked AS (
  SELECT n.repo, n.file_path, c.file_path IS NOT NULL OR n.repo NOT IN (SELECT repo FROM changed)
         AS rescan
  FROM new_snap n LEFT JOIN changed c ON n.repo = c.repo AND n.file_path = c.file_path)"""


@query("j7_split_incremental", f"WITH {b.SNAP_SQL}, {MARKED_SQL} SELECT * FROM marked")
def split(spark: SparkSession, sf: str) -> DataFrame:
    return marked_files(spark, sf).select("repo", "file_path", "rescan")


@query("j8_merge_incremental", f"""
WITH {b.SNAP_SQL},
old_found AS (SELECT repo, file_path, CASE WHEN contains(content, ',') THEN 'HIGH' ELSE 'LOW' END
              AS severity FROM old_snap UNION ALL SELECT DISTINCT repo, 'architecture', 'HIGH' FROM old_snap),
new_found AS (SELECT repo, file_path, CASE WHEN contains(content, 'E') THEN 'HIGH' ELSE 'LOW' END
              AS severity FROM new_snap WHERE (repo, file_path) IN (SELECT (repo, file_path) FROM changed)),
merged AS (SELECT * FROM new_found UNION ALL
           SELECT * FROM old_found o WHERE file_path <> 'architecture'
             AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.repo = o.repo AND c.file_path = o.file_path))
SELECT repo, count(*) AS findings, count(*) FILTER (severity = 'HIGH') AS critical_count
FROM merged GROUP BY repo""")
def merge(spark: SparkSession, sf: str) -> DataFrame:
    old, new = b.snapshots(spark, sf)
    changed = incremental.changed_paths(incremental.diff_snapshots(old, new))

    def found(files: DataFrame, mark: str) -> DataFrame:
        severity = F.when(F.col("content").contains(mark), "HIGH").otherwise("LOW")
        return files.select("repo", "file_path", severity.alias("severity"))

    whole_repo = old.select(
        "repo", F.lit("architecture").alias("file_path"), F.lit("HIGH").alias("severity")
    ).distinct()
    cached = found(old, ",").unionByName(whole_repo)
    fresh = found(new.join(changed, ["repo", "file_path"], "left_semi"), "E")
    return incremental.critical_counts(incremental.merge_incremental(fresh, cached, changed))


@query("j9_orphan_modules", f"""
WITH {b.EVENT_EDGES_SQL},
modules AS (SELECT DISTINCT 'team' || CAST(user_id % 10 AS VARCHAR) AS repo,
              CASE WHEN value > 40 THEN event_type ELSE 'idle_' || event_type END AS module FROM events)
SELECT repo, module FROM modules m WHERE NOT EXISTS (
  SELECT 1 FROM edges e WHERE e.repo = m.repo AND m.module IN (e.src, e.dst))""")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    modules = b.table(spark, sf, "events").select(
        F.expr("'team' || CAST(user_id % 10 AS STRING)").alias("repo"),
        F.expr("CASE WHEN value > 40 THEN event_type ELSE 'idle_' || event_type END").alias("module"),
    )
    return graph.orphan_modules(modules, b.event_edges(spark, sf))


@query("j10_exact_clones", """
WITH hashed AS (SELECT lang || '/' || doc_id AS file_path, source AS name,
                       md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash, lang FROM documents),
groups AS (SELECT lang, hash, count(*) AS n, min(file_path) AS file_a FROM hashed GROUP BY ALL
           HAVING count(*) > 1)
SELECT h.lang AS repo, h.hash, g.file_a, h.file_path AS file_b,
       CAST(n * (n - 1) // 2 AS BIGINT) AS pairs, CAST(1 AS DOUBLE) AS similarity
FROM hashed h JOIN groups g ON h.hash = g.hash AND h.lang = g.lang WHERE h.file_path <> g.file_a""")
def clones(spark: SparkSession, sf: str) -> DataFrame:
    items = b.table(spark, sf, "documents").select(
        F.col("lang").alias("repo"), F.expr("lang || '/' || doc_id").alias("file_path"),
        F.col("source").alias("name"), F.lit(1).alias("lineno"), F.col("text").alias("source"),
    )
    return similarity.exact_clones(items).select(
        "repo", "hash", "file_a", "file_b", "pairs", "similarity"
    )


@query("j10_exact_function_clones", f"""
WITH {b.FUNCTIONS_SQL},
hashed AS (SELECT repo, file_path, name, lineno,
                  md5(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS hash FROM functions),
groups AS (SELECT repo, hash, count(*) AS n, min((file_path, lineno, name)) AS head FROM hashed
           GROUP BY ALL HAVING count(*) > 1),
near AS (SELECT a.repo, a.hash, count(*) AS near FROM hashed a JOIN hashed z
           ON a.repo = z.repo AND a.hash = z.hash AND a.file_path = z.file_path
          AND a.lineno < z.lineno AND z.lineno - a.lineno <= 5 GROUP BY ALL),
kept AS (SELECT g.*, n * (n - 1) // 2 - coalesce(near, 0) AS pairs FROM groups g
         LEFT JOIN near USING (repo, hash)),
partners AS (SELECT h.repo, h.hash, h.file_path, h.lineno, h.name,
                    min(struct_pack(f := z.file_path, l := z.lineno, n := z.name)) AS p
             FROM hashed h JOIN hashed z ON h.repo = z.repo AND h.hash = z.hash
              AND (h.file_path <> z.file_path OR abs(h.lineno - z.lineno) > 5) GROUP BY ALL)
SELECT h.repo, p.f AS file_a, p.l AS line_a, h.file_path AS file_b, h.name AS func_b, h.lineno AS line_b,
       CAST(pairs AS BIGINT) AS pairs
FROM partners h JOIN kept k ON h.repo = k.repo AND h.hash = k.hash
WHERE pairs > 0 AND (h.file_path, h.lineno, h.name) <> k.head""")
def function_clones(spark: SparkSession, sf: str) -> DataFrame:
    _, functions = code_functions(spark, sf, syntax.FUNCTION_TYPES)
    return similarity.exact_clones(functions).select(
        "repo", "file_a", "line_a", "file_b", "func_b", "line_b", "pairs"
    )
