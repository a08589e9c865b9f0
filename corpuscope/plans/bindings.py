"""Views of the driver tables in the shape the operators read.

Expressions that both Spark and DuckDB can run are kept as SQL text and used
on both sides; ``*_SQL`` names are common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.skew import dealt, previous_value


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- documents as files -----------------------------------------------------

def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.expr("lang || '/' || doc_id").alias("file_path"),
        F.col("lang").alias("language"), F.col("text").alias("content"),
    )


DOC_FILES_SQL = (
    "files AS (SELECT source AS repo, lang || '/' || doc_id AS file_path, lang AS language, "
    "text AS content FROM documents)"
)

# Every line of every file, numbered from 1, without a trailing empty line.
LINES_SQL = """
file_arrays AS (
  SELECT repo, file_path, language, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls
  FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files)
),
lines AS (
  SELECT repo, file_path, language, unnest(ls) AS line,
         CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_no, len(ls) AS n_lines
  FROM file_arrays
)"""
DOC_LINES_SQL = f"WITH {DOC_FILES_SQL}, {LINES_SQL}"


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo"),
        F.col("url").alias("file_path"), F.lit("HTML").alias("language"),
        F.col("html").alias("content"),
    )


PAGE_FILES_SQL = (
    "files AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, url AS file_path, "
    "'HTML' AS language, html AS content FROM pages)"
)

# --- documents as a source tree with paths, extensions and sizes ------------

TREE_PATH = """
CASE lang WHEN 'en' THEN 'src/core/' WHEN 'fr' THEN 'node_modules/' WHEN 'de' THEN 'tests/'
          ELSE '' END
|| CASE WHEN n_chars > 2000 THEN 'test_' ELSE 'doc_' END || CAST(doc_id AS STRING)
|| CASE right(source, 1) WHEN '0' THEN '.py' WHEN '1' THEN '.js' WHEN '2' THEN '.TS'
        WHEN '3' THEN '.java' WHEN '4' THEN '.go' WHEN '5' THEN '.txt' WHEN '6' THEN '.md'
        WHEN '7' THEN '.rb' WHEN '8' THEN '.test.js' ELSE '.yaml' END
"""


def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.expr(TREE_PATH).alias("file_path"),
        F.col("text").alias("content"), F.octet_length("text").cast("bigint").alias("size_bytes"),
    )


TREE_SQL = (
    f"tree AS (SELECT source AS repo, {TREE_PATH} AS file_path, text AS content, "
    "CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents)"
)

# --- one Python file per part -----------------------------------------------

STEM = "replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING)"
VERB = (
    "CASE p_type WHEN 'ECONOMY' THEN 'get' WHEN 'PROMO' THEN 'update' WHEN 'LARGE' THEN 'build' "
    "WHEN 'SMALL' THEN 'check' WHEN 'STANDARD' THEN 'parse' ELSE 'refresh' END"
)
FN_NAME = f"{VERB} || '_' || {STEM}"
PARAM_NAMES = ("name", "count", "user_id", "data", "flag", "x", "callback", "report_url")
N_PARAMS, N_IFS, N_METHODS = "(p_size % 8)", "(p_size % 5)", "(p_size % 20)"
IMPORT_TARGET = (
    "CASE CAST(substr(p_brand, 7) AS INT) % 5 WHEN 0 THEN 'auth.tokens' WHEN 1 THEN 'db.session' "
    "WHEN 2 THEN 'api.routes' WHEN 3 THEN 'utils.text' ELSE 'services.billing' END"
)
RETURNED = (
    "CASE p_type WHEN 'ECONOMY' THEN 'True' WHEN 'PROMO' THEN 'total' WHEN 'LARGE' THEN '[]' "
    "WHEN 'SMALL' THEN chr(39) || 'x' || chr(39) WHEN 'STANDARD' THEN '5' ELSE 'None' END"
)
HAS_DOC = "(p_partkey % 3 = 0)"
PARAM_ANNOTATED = f"(p_size > 40 AND {N_PARAMS} > 0)"
RETURN_ANNOTATED = "(p_size > 45)"
IS_ASYNC = "(p_type = 'PROMO')"
HAS_CLASS = "(p_type = 'LARGE')"
HAS_LOOP, HAS_SLEEP = "(p_name LIKE 'red %')", "(p_name LIKE 'blue %')"
HAS_COMP, HAS_BOOL = "(p_name LIKE '% gear')", "(p_name LIKE 'hot %')"
WILDCARD = "(p_type = 'SMALL')"


def _opt(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN {text} ELSE '' END"


NL = "chr(10)"
PARAMS = " || ".join(
    _opt(f"{N_PARAMS} > {i}", f"'{', ' if i else ''}{name}'"
         + (f" || {_opt(PARAM_ANNOTATED, chr(39) + ': int' + chr(39))}" if i == 0 else ""))
    for i, name in enumerate(PARAM_NAMES)
)
IF_LINES = " || ".join(
    _opt(f"{N_IFS} > {j}", f"'{' ' * (4 + 4 * j)}if total >= {j}:' || {NL}") for j in range(4)
)
FN_SOURCE = f"""(
{_opt(IS_ASYNC, "'async '")} || 'def ' || {FN_NAME} || '(' || {PARAMS} || ')'
|| {_opt(RETURN_ANNOTATED, "' -> int'")} || ':' || {NL}
|| {_opt(HAS_DOC, "'    " + '"""Handles the part."""' + f"' || {NL}")}
|| '    total = 0' || {NL}
|| {IF_LINES}
|| repeat(' ', CAST(4 + 4 * {N_IFS} AS INT)) || 'total += 1' || {NL}
|| {_opt(HAS_LOOP, f"'    for item in [1, 2]:' || {NL} || '        requests.get(item)' || {NL}")}
|| {_opt(HAS_SLEEP, f"'    time.sleep(1)' || {NL}")}
|| {_opt(HAS_COMP, f"'    total = sum([v for v in range(3)])' || {NL}")}
|| {_opt(HAS_BOOL, f"'    ok = total > 1 and total < 9 or total == 5' || {NL}")}
|| '    return ' || {RETURNED})"""
CODE = f"""(
'import ' || {IMPORT_TARGET} || {NL}
|| {_opt(WILDCARD, f"'from lib.tools import *' || {NL}")}
|| {NL} || {FN_SOURCE} || {NL}
|| {_opt(HAS_CLASS, f'''{NL} || 'class Holder:' || {NL} || '    def __init__(self, value):' || {NL}
   || '        self.value = value' || {NL}
   || repeat('    def noop(self):' || {NL} || '        pass' || {NL}, CAST({N_METHODS} AS INT))''')})"""
CODE_PATH = f"lower(p_type) || '/' || {STEM} || '.py'"

# Closed-form measures of the generated function, for the oracle.
DEF_LINE = f"(3 + CASE WHEN {WILDCARD} THEN 1 ELSE 0 END)"


def _int(test: str) -> str:
    return f"(CASE WHEN {test} THEN 1 ELSE 0 END)"


FN_LOC = (
    f"(4 + {_int(HAS_DOC)} + {N_IFS} + 2 * {_int(HAS_LOOP)} + {_int(HAS_SLEEP)} "
    f"+ {_int(HAS_COMP)} + {_int(HAS_BOOL)})"
)
FN_CC = f"(1 + {N_IFS} + {_int(HAS_LOOP)} + {_int(HAS_COMP)} + 2 * {_int(HAS_BOOL)})"
FN_COGNITIVE = f"({N_IFS} * ({N_IFS} + 1) // 2 + {_int(HAS_LOOP)} + {_int(HAS_BOOL)})"
FN_DEPTH = f"greatest({N_IFS}, {_int(HAS_LOOP)})"
FN_CALLS = f"({_int(HAS_LOOP)} + {_int(HAS_SLEEP)} + 2 * {_int(HAS_COMP)})"
FN_ASSIGNS = f"(1 + {_int(HAS_COMP)} + {_int(HAS_BOOL)})"


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are dealt to all tasks before their files are written out, for a narrow table may be one partition."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return dealt(parts).select(
        F.col("p_brand").alias("repo"), F.expr(CODE_PATH).alias("file_path"),
        F.lit("Python").alias("language"), F.expr(CODE).alias("content"),
    )


CODE_FILES_SQL = (
    f"files AS (SELECT p_brand AS repo, {CODE_PATH} AS file_path, 'Python' AS language, "
    f"{CODE} AS content FROM part)"
)

# Every function of the generated files with its measures.
FUNCTIONS_SQL = f"""
functions AS (
  SELECT p_brand AS repo, {CODE_PATH} AS file_path, {FN_NAME} AS name,
         CAST({DEF_LINE} AS INTEGER) AS lineno, {FN_LOC} AS loc, {IS_ASYNC} AS is_async, {N_PARAMS} AS n_params,
         {N_PARAMS} AS arg_count, {PARAM_ANNOTATED} AS has_param_ann,
         {RETURN_ANNOTATED} AS has_return_ann, {HAS_DOC} AS documented, false AS pass_only,
         {FN_CC} AS cc, {FN_COGNITIVE} AS cognitive, {N_IFS} AS n_if, {_int(HAS_LOOP)} AS n_loop,
         {FN_CALLS} AS n_call, {FN_ASSIGNS} AS n_assign, 1 AS n_return, {FN_DEPTH} AS depth,
         {_int(HAS_COMP)} AS n_comp, 2 * {_int(HAS_BOOL)} AS n_bool, {FN_SOURCE} AS source
  FROM part
  UNION ALL
  SELECT p_brand, {CODE_PATH}, '__init__', {DEF_LINE} + {FN_LOC} + 2, 2, false, 1, 2, false,
         false, false, false, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0,
         '    def __init__(self, value):' || chr(10) || '        self.value = value'
  FROM part WHERE {HAS_CLASS}
  UNION ALL
  SELECT repo, file_path, 'noop', CAST(first_line + 2 * i AS INTEGER), 2, false, 0, 1, false,
         false, false, true, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0,
         '    def noop(self):' || chr(10) || '        pass'
  FROM (SELECT p_brand AS repo, {CODE_PATH} AS file_path, {DEF_LINE} + {FN_LOC} + 4 AS first_line,
               unnest(range({N_METHODS})) AS i FROM part WHERE {HAS_CLASS})
)"""

# --- coverage tree: generated sources, and tests named after or importing them

TEST_NAME = f"""
CASE WHEN p_size <= 20 THEN 'test_' || {STEM}
     WHEN p_size <= 25 THEN 'test_' || replace(p_name, ' ', '_')
     ELSE 'zz' || CAST(p_partkey AS STRING) || '_test' END"""
TEST_TEXT = f"""
'import pytest' || {NL} || 'from pkg.' || {STEM} || ' import *' || {NL} || {NL}
|| repeat('def test_case():' || {NL} || '    assert '
   || CASE WHEN p_size <= 10 THEN {FN_NAME} ELSE 'helper' END || '(1)' || {NL},
   CAST(p_size % 3 AS INT))"""
IS_TESTED = "(p_size <= 30)"
# a directory per part keeps test paths apart where names are equal
TEST_PATH = f"'tests/' || lower(p_type) || '_' || CAST(p_partkey AS STRING) || '/' || {TEST_NAME} || '.py'"


def coverage_files(spark: SparkSession, sf: str) -> DataFrame:
    tests = table(spark, sf, "part").filter(IS_TESTED).select(
        F.col("p_brand").alias("repo"), F.expr(TEST_PATH).alias("file_path"),
        F.lit("Python").alias("language"), F.expr(TEST_TEXT).alias("content"),
    )
    return code_files(spark, sf).unionByName(tests)


COVERAGE_SQL = f"""
sources AS (SELECT p_brand AS repo, {CODE_PATH} AS file_path, lower({STEM}) AS stem,
                   {CODE} AS content, 1 + CASE WHEN {HAS_CLASS} THEN 1 + {N_METHODS} ELSE 0 END
                   AS fn_count, {FN_NAME} AS fn_name, {HAS_CLASS} AS has_class,
                   {N_METHODS} AS n_methods FROM part),
tests AS (SELECT p_brand AS repo, {TEST_PATH} AS test_path, {TEST_TEXT} AS content,
                 regexp_replace(regexp_replace(lower({TEST_NAME}),
                   '^test[_-]|[_-]test$|[_-]spec$', '', 'g'),
                   '^test[_-]|[_-]test$|[_-]spec$|^spec[_-]', '', 'g') AS clean,
                 CAST(p_size % 3 AS BIGINT) AS test_count
          FROM part WHERE {IS_TESTED})"""
BY_NAME_SQL = """
by_name AS (
  SELECT repo, test_path, file_path FROM (
    SELECT t.repo, t.test_path, s.file_path, row_number() OVER (
      PARTITION BY t.repo, t.test_path ORDER BY (s.stem <> t.clean), s.file_path) AS rn
    FROM tests t JOIN sources s ON s.repo = t.repo
     AND (s.stem = t.clean OR contains(s.stem, t.clean) OR contains(t.clean, s.stem)))
  WHERE rn = 1)"""
BY_IMPORT_SQL = """
statements AS (
  SELECT repo, test_path, unnest(regexp_extract_all(lower(content),
         '(?:import|from)\\s+[\\w./]+')) AS statement
  FROM tests WHERE (repo, test_path) NOT IN (SELECT (repo, test_path) FROM by_name)),
by_import AS (
  SELECT DISTINCT x.repo, x.test_path, s.file_path
  FROM statements x JOIN sources s ON s.repo = x.repo AND contains(x.statement, s.stem)),
mapping AS (SELECT repo, test_path, file_path FROM by_name
            UNION ALL SELECT repo, test_path, file_path FROM by_import)"""

# --- events as findings, orders as runs, lineitem as change history ----------

SEVERITY = (
    "CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' ELSE 'LOW' END"
)


def event_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with an author, one per event."""
    return table(spark, sf, "events").select(
        F.expr("'repo' || CAST(user_id % 7 AS STRING)").alias("repo"),
        F.expr("'u' || CAST(user_id AS STRING)").alias("author"),
        F.expr("CASE WHEN user_id % 5 = 0 THEN '' ELSE 'u' || CAST(user_id AS STRING) || '@x.org' "
               "END").alias("email"),
        F.expr(SEVERITY).alias("severity"), F.col("event_type").alias("title"),
        F.expr("event_type || '/' || CAST(user_id AS STRING) || '.py'").alias("file_path"),
        F.col("ts").alias("blame_ts"), F.col("event_id").alias("seq"),
    )


EVENT_SQL = f"""
findings AS (
  SELECT 'repo' || CAST(user_id % 7 AS STRING) AS repo, 'u' || CAST(user_id AS STRING) AS author,
         CASE WHEN user_id % 5 = 0 THEN '' ELSE 'u' || CAST(user_id AS STRING) || '@x.org' END
           AS email,
         {SEVERITY} AS severity, event_type AS title,
         event_type || '/' || CAST(user_id AS STRING) || '.py' AS file_path, ts AS blame_ts,
         event_id AS seq FROM events)"""


def order_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("repo"),
        F.expr("'name' || CAST(o_custkey AS STRING)").alias("repo_name"),
        F.expr("'user' || CAST(o_custkey % 50 AS STRING)").alias("user_id"),
        F.expr("'c' || CAST(o_orderkey AS STRING)").alias("commit_sha"),
        F.col("o_orderdate").alias("analyzed_at"), F.col("o_totalprice").alias("quality_score"),
        F.expr("CAST(substr(o_orderpriority, 1, 1) AS INT)").alias("security_high"),
        F.col("o_orderstatus").alias("maintainability"),
    )


RUNS_SQL = """
runs AS (
  SELECT o_orderkey AS run_id, CAST(o_custkey AS VARCHAR) AS repo,
         'name' || CAST(o_custkey AS VARCHAR) AS repo_name,
         'user' || CAST(o_custkey % 50 AS VARCHAR) AS user_id,
         'c' || CAST(o_orderkey AS VARCHAR) AS commit_sha, o_orderdate AS analyzed_at,
         o_totalprice AS quality_score, CAST(substr(o_orderpriority, 1, 1) AS INT) AS security_high,
         o_orderstatus AS maintainability FROM orders)"""

CHANGED_FILE = "'dir' || CAST(l_partkey % 10 AS STRING) || '/part' || CAST(l_partkey AS STRING) || '.py'"


def order_commits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.expr("'repo' || CAST(o_custkey % 20 AS STRING)").alias("repo"),
        F.col("o_orderkey").cast("string").alias("sha"),
        F.expr("'c' || CAST(o_custkey AS STRING) || '@x.org'").alias("author_email"),
        F.col("o_orderdate").alias("ts"),
        F.expr("' order ' || o_orderpriority").alias("message"),
        F.col("o_custkey").alias("o_custkey"),
    )


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("sha"), F.expr(CHANGED_FILE).alias("file_path"),
        F.when(F.col("l_returnflag") == "R", "A").otherwise("M").alias("change"),
    )
    commits = order_commits(spark, sf).select("repo", "sha")
    return items.join(commits, "sha")


COMMITS_SQL = f"""
commits AS (
  SELECT 'repo' || CAST(o_custkey % 20 AS VARCHAR) AS repo, CAST(o_orderkey AS VARCHAR) AS sha,
         'c' || CAST(o_custkey AS VARCHAR) || '@x.org' AS author_email, o_orderdate AS ts,
         ' order ' || o_orderpriority AS message FROM orders),
commit_files AS (
  SELECT c.repo, c.sha, {CHANGED_FILE} AS file_path,
         CASE WHEN l_returnflag = 'R' THEN 'A' ELSE 'M' END AS change
  FROM lineitem JOIN commits c ON c.sha = CAST(l_orderkey AS VARCHAR))"""

# --- two snapshots of the documents ------------------------------------------

# src5 has the same content on both sides and no added or removed path
SNAP_OLD, SNAP_NEW = "(lang <> 'de' OR source = 'src5')", "(lang <> 'es' OR source = 'src5')"
SNAP_TEXT = "CASE WHEN source IN ('src1', 'src2', 'src3') THEN upper(text) ELSE text END"


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    path = F.expr("lang || '/' || doc_id")
    old = docs.filter(SNAP_OLD).select(
        F.col("source").alias("repo"), path.alias("file_path"), F.col("text").alias("content")
    )
    new = docs.filter(SNAP_NEW).select(
        F.col("source").alias("repo"), path.alias("file_path"), F.expr(SNAP_TEXT).alias("content")
    )
    return old, new


SNAP_SQL = f"""
old_snap AS (SELECT source AS repo, lang || '/' || doc_id AS file_path, text AS content
             FROM documents WHERE {SNAP_OLD}),
new_snap AS (SELECT source AS repo, lang || '/' || doc_id AS file_path, {SNAP_TEXT} AS content
             FROM documents WHERE {SNAP_NEW}),
diff AS (
  SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.file_path, n.file_path) AS file_path,
         CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'removed'
              WHEN o.content = n.content THEN 'same' ELSE 'changed' END AS status
  FROM old_snap o FULL OUTER JOIN new_snap n ON o.repo = n.repo AND o.file_path = n.file_path),
changed AS (SELECT repo, file_path FROM diff WHERE status <> 'same')"""

# --- module graphs -----------------------------------------------------------


def event_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from one event type to the next different one of the same user."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    steps = previous_value(
        events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "event_type", "src"
    )
    return steps.filter("src IS NOT NULL AND src <> event_type").select(
        F.expr("'team' || CAST(user_id % 10 AS STRING)").alias("repo"), "src",
        F.col("event_type").alias("dst"),
    ).distinct()


EVENT_EDGES_SQL = """
edges AS (
  SELECT DISTINCT repo, src, dst FROM (
    SELECT 'team' || CAST(user_id % 10 AS VARCHAR) AS repo, event_type AS src,
           lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND src <> dst)"""

DOMAIN = (
    "CASE {c} % 9 WHEN 0 THEN 'UI' WHEN 1 THEN 'API' WHEN 2 THEN 'Service' WHEN 3 THEN 'Model' "
    "WHEN 4 THEN 'Database' WHEN 5 THEN 'Utils' WHEN 6 THEN 'Auth' WHEN 7 THEN 'Test' "
    "ELSE 'Billing' END"
)


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customer side to supplier side of all order lines."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat("c_mktsegment", F.lit("-"), F.substr("o_orderpriority", F.lit(1), F.lit(1)))
            .alias("repo"),
            F.expr(DOMAIN.format(c="c_nationkey")).alias("src"),
            F.expr(DOMAIN.format(c="s_nationkey")).alias("dst"),
        )
        .filter("src <> dst").distinct()
    )


TRADE_EDGES_SQL = f"""
edges AS (
  SELECT DISTINCT repo, src, dst FROM (
    SELECT c_mktsegment || '-' || substr(o_orderpriority, 1, 1) AS repo,
           {DOMAIN.format(c='c_nationkey')} AS src, {DOMAIN.format(c='s_nationkey')} AS dst
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey) WHERE src <> dst)"""

# --- manifests and advisories --------------------------------------------------

PKG_VERSION = "CAST(p_size AS STRING) || '.' || CAST(p_partkey % 10 AS STRING)"
REQUIREMENT_LINE = f"""
CASE WHEN p_size > 48 THEN '# pinned ' || p_name
     WHEN p_size > 46 THEN replace(p_name, ' ', '-')
     ELSE replace(p_name, ' ', '-') || '==' || {PKG_VERSION} END"""
REQUIREMENTS_TEXT = f"""
'# generated' || {NL} || '-r base.txt' || {NL} || {NL} || {REQUIREMENT_LINE} || {NL}
|| 'extra-' || lower(p_type) || ' >= ' || CAST(p_size AS STRING) || {NL} || 'git+https://x.org/y'"""
PIPFILE_TEXT = f"""
'[[source]]' || {NL} || 'url = "https://x.org"' || {NL} || '[packages]' || {NL}
|| replace(p_name, ' ', '-') || ' = "==' || {PKG_VERSION} || '"' || {NL}
|| 'any = "*"' || {NL} || '[dev-packages]' || {NL} || '"quoted" = ">=' || {PKG_VERSION} || '"'
|| {NL} || '[requires]' || {NL} || 'python_version = "3.11"'"""
PYPROJECT_TEXT = f"""
'[project]' || {NL} || 'dependencies = ["' || replace(p_name, ' ', '-') || '>=' || {PKG_VERSION}
|| '", "plain", "x"]' || {NL}"""
PACKAGE_JSON_TEXT = f"""
'{{"name": "app", "dependencies": {{"' || replace(p_name, ' ', '-') || '": "^' || {PKG_VERSION}
|| '"}}, "devDependencies": {{"jest": "~29.' || CAST(p_size AS STRING) || '", "local": "file"}}}}'"""
GO_MOD_TEXT = f"""
'module x.org/app' || {NL} || 'go 1.21' || {NL} || 'require (' || {NL} || chr(9) || 'x.org/'
|| replace(p_name, ' ', '-') || ' v' || {PKG_VERSION} || '-rc1' || {NL} || ')'"""
MANIFEST_TEXTS = {
    "requirements.txt": REQUIREMENTS_TEXT, "Pipfile": PIPFILE_TEXT,
    "pyproject.toml": PYPROJECT_TEXT, "package.json": PACKAGE_JSON_TEXT, "go.mod": GO_MOD_TEXT,
}
# the manifest kind of a part follows its type; its folder makes the path unique
MANIFEST_OF_TYPE = {
    "ECONOMY": "requirements.txt", "STANDARD": "requirements.txt", "PROMO": "Pipfile",
    "LARGE": "pyproject.toml", "SMALL": "package.json", "MEDIUM": "go.mod",
}
MANIFEST_DIR = "'svc' || CAST(p_partkey AS STRING) || '/'"


def manifest_files(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    """Manifest files of one kind from every part, or each part's own kind."""
    part = table(spark, sf, "part")
    if kind is not None:
        path, text = f"{MANIFEST_DIR} || '{kind}'", MANIFEST_TEXTS[kind]
    else:
        path = f"{MANIFEST_DIR} || CASE p_type " + " ".join(
            f"WHEN '{t}' THEN '{m}'" for t, m in MANIFEST_OF_TYPE.items()) + " END"
        text = "CASE p_type " + " ".join(
            f"WHEN '{t}' THEN {MANIFEST_TEXTS[m]}" for t, m in MANIFEST_OF_TYPE.items()) + " END"
    return part.select(
        F.col("p_brand").alias("repo"), F.expr(path).alias("file_path"),
        F.expr(text).alias("content"),
    )


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    """One advisory per supplier about the packages built from part names."""
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("pk"))
    per_name = table(spark, sf, "supplier").join(
        names, F.expr("s_nationkey = pk % 25"))
    event = "struct({i} AS introduced, {f} AS fixed)"
    none = "CAST(NULL AS STRING)"
    low, high = "CAST(s_suppkey % 20 AS STRING)", "CAST(s_suppkey % 20 + 15 AS STRING) || '.5'"
    events = (
        f"array({event.format(i=low, f=none)}, "
        f"{event.format(i=none, f=f'CASE WHEN s_acctbal > 5000 THEN {high} END')})"
    )
    affected = f"array(struct(array(struct({events} AS events)) AS ranges))"
    many = f"array_repeat(struct(array(struct({events} AS events)) AS ranges), 4)"
    return per_name.select(
        F.expr("'OSV-' || CAST(s_suppkey AS STRING) || '-' || CAST(pk AS STRING)").alias("id"),
        F.col("s_name").alias("summary"),
        F.expr("CASE WHEN s_nationkey % 2 = 0 THEN array('GHSA-1', 'CVE-' || CAST(s_suppkey AS "
               "STRING)) ELSE array('GHSA-2') END").alias("aliases"),
        F.expr("CASE WHEN s_acctbal > 8000 THEN 'CRITICAL' WHEN s_acctbal > 6000 THEN 'moderate' "
               "WHEN s_acctbal > 3000 THEN 'low' END").alias("severity"),
        F.struct(F.expr("replace(p_name, ' ', '-')").alias("name"), F.lit("PyPI").alias("ecosystem"))
        .alias("package"),
        F.expr(f"CASE WHEN s_nationkey % 3 = 0 THEN {many} ELSE {affected} END").alias("affected"),
    )


ADVISORY_SQL = """
pkg AS (SELECT p_name, min(p_partkey) AS pk FROM part GROUP BY 1),
advisory AS (
  SELECT 'OSV-' || CAST(s_suppkey AS VARCHAR) || '-' || CAST(pk AS VARCHAR) AS id,
         s_name AS summary, replace(p_name, ' ', '-') AS name,
         CAST(s_suppkey % 20 AS VARCHAR) AS introduced,
         CASE WHEN s_acctbal > 5000 THEN CAST(s_suppkey % 20 + 15 AS VARCHAR) || '.5' END AS fixed,
         CASE WHEN s_acctbal > 8000 THEN 'HIGH' WHEN s_acctbal > 6000 THEN 'MEDIUM'
              WHEN s_acctbal > 3000 THEN 'LOW' WHEN s_nationkey % 3 = 0 THEN 'HIGH'
              ELSE 'MEDIUM' END AS severity,
         CASE WHEN s_nationkey % 2 = 0 THEN 'CVE-' || CAST(s_suppkey AS VARCHAR)
              ELSE 'OSV-' || CAST(s_suppkey AS VARCHAR) || '-' || CAST(pk AS VARCHAR) END AS cve
  FROM supplier JOIN pkg ON s_nationkey = pk % 25)"""
