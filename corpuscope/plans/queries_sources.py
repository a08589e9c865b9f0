"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.paths import IGNORED_DIRS, LANGUAGES, detect_language
from corpuscope.operators.scan import explode_lines
from corpuscope.plans import bindings as b
from corpuscope.plans.registry import query
from corpuscope.session import scratch_path
from corpuscope.sources import corpus, imports, manifests, runs, syntax

_EXT = "lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1))"
_LANG_CASE = "CASE " + _EXT + " " + " ".join(
    f"WHEN '{e}' THEN '{v}'" for e, v in LANGUAGES.items()) + " ELSE 'Unknown' END"
_EXT_LIST = ", ".join(f"'{e}'" for e in LANGUAGES)
_DIR_LIST = ", ".join(f"'{d}'" for d in IGNORED_DIRS)


@query("a1_read_corpus", f"""
WITH {b.TREE_SQL}
SELECT repo, file_path, {_LANG_CASE} AS language, size_bytes FROM tree
WHERE size_bytes > 0 AND size_bytes <= 512000 AND {_EXT} IN ({_EXT_LIST})
  AND NOT list_has_any(string_split(file_path, '/')[:-2], [{_DIR_LIST}])""")
def read_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.admit_files(b.tree_files(spark, sf), max_bytes=corpus.REFERENCE_MAX_BYTES).select(
        "repo", "file_path", detect_language(F.col("file_path")).alias("language"), "size_bytes"
    )


@query("a2_detect_language", f"""
WITH {b.TREE_SQL}
SELECT file_path, {_LANG_CASE} AS language FROM tree""")
def language_of_path(spark: SparkSession, sf: str) -> DataFrame:
    return b.tree_files(spark, sf).select(
        "file_path", detect_language(F.col("file_path")).alias("language")
    )


@query("a3_explode_lines", f"""
{b.DOC_LINES_SQL} SELECT repo, file_path, language, line_no, line FROM lines""")
def lines_of_files(spark: SparkSession, sf: str) -> DataFrame:
    return explode_lines(b.doc_files(spark, sf))


@query("a4_write_read_runs", f"""
WITH {b.RUNS_SQL}
SELECT run_id, repo, user_id, quality_score, security_high, analyzed_at FROM runs""")
def write_read_runs(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    runs.write_runs(b.order_runs(spark, sf), path)
    return runs.read_runs(spark, path).select(
        "run_id", "repo", "user_id", "quality_score", "security_high", "analyzed_at"
    )


@query("a5_parse_reports", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def parse_reports(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events")
    return runs.parse_report(events, "props", "struct<k:int>").select(
        "event_id", F.col("report.k").alias("k")
    )


@query("a6_export_json", """
SELECT o_orderkey AS run_id,
       '{"run_id":' || o_orderkey || ',"repo":"' || o_custkey || '","status":"' || o_orderstatus
       || '"}' AS document
FROM orders""")
def export_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.order_runs(spark, sf).withColumn("status", F.col("maintainability"))
    return runs.export_json(rows, ["run_id", "repo", "status"]).select("run_id", "document")


def _manifest_sql(kind: str, body: str) -> str:
    return f"""
WITH manifest AS (SELECT p_brand AS repo, {b.MANIFEST_DIR} || '{kind}' AS source_file,
                         {b.MANIFEST_TEXTS[kind]} AS content, * FROM part),
mlines AS (SELECT repo, source_file, trim(unnest(string_split(content, chr(10))),
                  ' ' || chr(9)) AS line FROM manifest)
{body}"""


_REQ = "^([A-Za-z0-9_\\-\\.]+)\\s*(?:[=~><!\\^]+\\s*([\\d\\.]+\\w*))?"
REQUIREMENTS_BODY = f"""
SELECT repo, source_file, regexp_extract(line, '{_REQ}', 1) AS name,
       regexp_extract(line, '{_REQ}', 2) AS version, 'PyPI' AS ecosystem
FROM mlines WHERE line <> '' AND NOT regexp_matches(line, '^(#|-|git\\+)')
  AND regexp_matches(line, '{_REQ}')"""


def _parsed(parse, spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return parse(b.manifest_files(spark, sf, kind)).select(
        "repo", "source_file", "name", "version", "ecosystem"
    )


@query("a7_parse_requirements", _manifest_sql("requirements.txt", REQUIREMENTS_BODY))
def requirements(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(manifests.parse_requirements, spark, sf, "requirements.txt")


_GO = "^\\s*([\\w\\./\\-]+)\\s+v([\\d\\.]+[\\w\\-]*)"


@query("a8_parse_go_mod", _manifest_sql("go.mod", f"""
SELECT repo, source_file, regexp_extract(line, '{_GO}', 1) AS name,
       regexp_extract(line, '{_GO}', 2) AS version, 'Go' AS ecosystem
FROM mlines WHERE regexp_matches(line, '{_GO}')"""))
def go_mod(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(manifests.parse_go_mod, spark, sf, "go.mod")


@query("a9_parse_package_json", _manifest_sql("package.json", """
, entries AS (
  SELECT repo, source_file, unnest(json_keys(d)) AS name, d
  FROM (SELECT repo, source_file, unnest([json_extract(content, '$.dependencies'),
        json_extract(content, '$.devDependencies'), json_extract(content, '$.peerDependencies')]) AS d
        FROM manifest)
  WHERE d IS NOT NULL)
SELECT repo, source_file, name,
       regexp_extract(json_extract_string(d, '$."' || name || '"'), '[\\d\\.]+') AS version,
       'npm' AS ecosystem FROM entries"""))
def package_json(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(manifests.parse_package_json, spark, sf, "package.json")


_PROJ = '"([A-Za-z0-9_\\-]+)\\s*(?:[>=<!~^]+\\s*([\\d\\.]+))?'


@query("a10_parse_pyproject", _manifest_sql("pyproject.toml", f"""
SELECT repo, source_file, name, coalesce(version, '') AS version, 'PyPI' AS ecosystem
FROM (SELECT repo, source_file, unnest(regexp_extract_all(content, '{_PROJ}', 1)) AS name,
             unnest(regexp_extract_all(content, '{_PROJ}', 2)) AS version FROM manifest)
WHERE length(name) > 1"""))
def pyproject(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(manifests.parse_pyproject, spark, sf, "pyproject.toml")


@query("a11_parse_pipfile", _manifest_sql("Pipfile", f"""
SELECT repo, source_file, replace(p_name, ' ', '-') AS name, {b.PKG_VERSION} AS version,
       'PyPI' AS ecosystem FROM manifest
UNION ALL SELECT repo, source_file, 'any', '', 'PyPI' FROM manifest
UNION ALL SELECT repo, source_file, 'quoted', {b.PKG_VERSION}, 'PyPI' FROM manifest"""))
def pipfile(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(manifests.parse_pipfile, spark, sf, "Pipfile")


DEPENDENCIES_SQL = f"""
typed AS (SELECT *, replace(p_name, ' ', '-') AS pname, {b.PKG_VERSION} AS pver,
                 p_brand AS repo, CAST(p_size AS VARCHAR) AS psize FROM part),
declared AS (
  SELECT repo, {b.MANIFEST_DIR} || 'requirements.txt' AS source_file, pname AS name, pver AS version,
         'PyPI' AS ecosystem, 3 AS seq FROM typed
  WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_size <= 46
  UNION ALL SELECT repo, {b.MANIFEST_DIR} || 'requirements.txt', 'extra-' || lower(p_type), psize,
         'PyPI', 4 FROM typed WHERE p_type IN ('ECONOMY', 'STANDARD')
  UNION ALL SELECT repo, {b.MANIFEST_DIR} || 'Pipfile', pname, pver, 'PyPI', 3 FROM typed
         WHERE p_type = 'PROMO'
  UNION ALL SELECT repo, {b.MANIFEST_DIR} || 'Pipfile', 'quoted', pver, 'PyPI', 6 FROM typed
         WHERE p_type = 'PROMO'
  UNION ALL SELECT repo, {b.MANIFEST_DIR} || 'pyproject.toml', pname, pver, 'PyPI', 0 FROM typed
         WHERE p_type = 'LARGE'
  UNION ALL SELECT repo, {b.MANIFEST_DIR} || 'package.json', pname, pver, 'npm', 0 FROM typed
         WHERE p_type = 'SMALL'
  UNION ALL SELECT repo, {b.MANIFEST_DIR} || 'package.json', 'jest', '29.' || psize, 'npm', 1
         FROM typed WHERE p_type = 'SMALL'
  UNION ALL SELECT repo, {b.MANIFEST_DIR} || 'go.mod', 'x.org/' || pname, pver || '-rc1', 'Go', 3
         FROM typed WHERE p_type = 'MEDIUM'),
dependencies AS (
  SELECT repo, source_file, name, version, ecosystem FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, lower(name), ecosystem
                                 ORDER BY source_file, seq) AS rn FROM declared)
  WHERE rn = 1)"""


@query("a12_collect_dependencies", f"WITH {DEPENDENCIES_SQL} SELECT * FROM dependencies")
def all_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.collect_dependencies(b.manifest_files(spark, sf)).select(
        "repo", "source_file", "name", "version", "ecosystem"
    )


IMPORTS_SQL = f"""
imports AS (
  SELECT p_brand AS repo, {b.CODE_PATH} AS file_path, {b.IMPORT_TARGET} AS target FROM part
  UNION ALL SELECT p_brand, {b.CODE_PATH}, 'lib.tools' FROM part WHERE {b.WILDCARD})"""


@query("a13_extract_imports", f"WITH {IMPORTS_SQL} SELECT * FROM imports")
def python_imports(spark: SparkSession, sf: str) -> DataFrame:
    return imports.extract_imports(b.code_files(spark, sf))


@query("a13_extract_script_imports", """
SELECT repo, file_path, unnest(regexp_extract_all(content,
       '(?:import|require)\\s*[\\(\\s]["'']([^"'']+)["'']', 1)) AS target
FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, url AS file_path,
             replace(replace(html, '<a href=', 'import '), '</a>', 'require("' || page_id || '")')
               AS content FROM pages)""")
def script_imports(spark: SparkSession, sf: str) -> DataFrame:
    pages = b.table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo"),
        F.col("url").alias("file_path"), F.lit("JavaScript").alias("language"),
        F.expr("replace(replace(html, '<a href=', 'import '), '</a>', "
               "'require(\"' || page_id || '\")')").alias("content"),
    )
    return imports.extract_imports(pages)


@query("a14_extract_functions", f"""
WITH {b.FUNCTIONS_SQL}
SELECT repo, file_path, name, lineno, loc, is_async, CAST(n_params AS BIGINT) AS n_params,
       has_param_ann, has_return_ann, documented, pass_only, md5(source) AS source_md5
FROM functions""")
def functions_of_files(spark: SparkSession, sf: str) -> DataFrame:
    files = b.code_files(spark, sf)
    fns = syntax.extract_functions(syntax.ast_nodes(files, types=syntax.FUNCTION_TYPES, deal=False))
    return fns.select(
        "repo", "file_path", "name", "lineno", "loc", "is_async",
        F.size("params").cast("bigint").alias("n_params"), "has_param_ann", "has_return_ann",
        (F.col("docstring") != "").alias("documented"), "pass_only",
        F.md5("source").alias("source_md5"),
    )


@query("a15_ast_node_table", f"""
SELECT p_brand AS repo, {b.CODE_PATH} AS file_path,
       CAST({b.N_IFS} AS BIGINT) AS n_if, CAST({b._int(b.HAS_LOOP)} AS BIGINT) AS n_for,
       CAST({b.FN_CALLS} AS BIGINT) AS n_call, CAST({b._int(b.HAS_COMP)} AS BIGINT) AS n_listcomp,
       CAST(2 * {b._int(b.HAS_BOOL)} AS BIGINT) AS n_boolop,
       CAST(1 + {b._int(b.HAS_CLASS)} * (1 + {b.N_METHODS}) AS BIGINT) AS n_function,
       CAST({b._int(b.HAS_CLASS)} AS BIGINT) AS n_class,
       CAST({b._int(b.HAS_LOOP)} AS BIGINT) AS calls_in_loop
FROM part""")
def node_counts(spark: SparkSession, sf: str) -> DataFrame:
    def count(*types: str):
        return F.count_if(F.col("node_type").isin(*types))

    # every file has a module
    counted = ["Module", "If", "For", "Call", "ListComp", "BoolOp", "ClassDef", *syntax.FUNCTION_TYPES]
    nodes = syntax.ast_nodes(
        b.code_files(spark, sf), columns=["repo", "file_path", "node_type", "loop_depth"], types=counted, deal=False)
    return nodes.groupBy("repo", "file_path").agg(
        count("If").alias("n_if"), count("For").alias("n_for"), count("Call").alias("n_call"),
        count("ListComp").alias("n_listcomp"), count("BoolOp").alias("n_boolop"),
        count("FunctionDef", "AsyncFunctionDef").alias("n_function"),
        count("ClassDef").alias("n_class"),
        F.count_if((F.col("node_type") == "Call") & (F.col("loop_depth") > 0)).alias(
            "calls_in_loop"
        ),
    )
