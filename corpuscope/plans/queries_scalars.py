"""Queries over column functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import hints, paths, scoring
from corpuscope.functions.text import normalized_hash
from corpuscope.operators.dependencies import first_fixed_version, osv_severity, pick_cve
from corpuscope.operators.hints import generate_docstrings, type_hint_gaps
from corpuscope.operators.scan import REFERENCE_SNIPPET, redact_snippet
from corpuscope.plans import bindings as b
from corpuscope.plans.registry import query
from corpuscope.session import materialize
from corpuscope.sources import syntax


def _cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


@query("p1_severity_rank", f"""
WITH {b.EVENT_SQL}
SELECT seq, severity, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2
       ELSE 3 END AS severity_rank FROM findings""")
def severity_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return b.event_findings(spark, sf).select(
        "seq", "severity", scoring.severity_rank(F.col("severity")).alias("severity_rank")
    )


@query("p2_module_of", f"""
WITH {b.TREE_SQL}
SELECT file_path, CASE WHEN contains(file_path, '/') THEN {_cap("split_part(file_path, '/', 1)")}
       ELSE 'Root' END AS module FROM tree""")
def modules(spark: SparkSession, sf: str) -> DataFrame:
    return b.tree_files(spark, sf).select(
        "file_path", paths.module_of(F.col("file_path")).alias("module")
    )


@query("p3_coverage_module", f"""
WITH {b.TREE_SQL}
SELECT file_path, CASE WHEN contains(file_path, '/')
       THEN {_cap("split_part(file_path, '/', -2)")} || '/' || split_part(file_path, '/', -1)
       ELSE file_path END AS module FROM tree""")
def coverage_modules(spark: SparkSession, sf: str) -> DataFrame:
    return b.tree_files(spark, sf).select(
        "file_path", paths.coverage_module(F.col("file_path")).alias("module")
    )


def domain_sql(segments: str, ident: str, source: str) -> str:
    """Domain of each row of ``source``: first segment with a keyword, first keyword in order."""
    rows = ", ".join(
        f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(paths.DOMAIN_KEYWORDS.items())
    )
    return f"""
keywords(seq, word, label) AS (VALUES {rows}),
segs AS (SELECT {ident}, unnest(parts) AS seg, unnest(range(len(parts))) AS pos, parts[1] AS head
         FROM (SELECT {ident}, {segments} AS parts FROM {source})),
hits AS (SELECT {ident}, label, row_number() OVER (PARTITION BY {ident} ORDER BY pos, seq) AS rn
         FROM segs JOIN keywords ON contains(seg, word)),
domains AS (
  SELECT s.*, nullif(coalesce(h.label, replace(upper(substr(head, 1, 1)), 'ẞ', 'Ss') || lower(substr(head, 2))), '')
         AS domain
  FROM (SELECT DISTINCT {ident}, head FROM segs) s
  LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h USING ({ident}))"""


@query("p4_domain_of_path", f"""
WITH pages_in AS (SELECT page_id, url FROM pages),
{domain_sql("string_split(lower(url), '/')", "page_id", "pages_in")}
SELECT page_id, domain FROM domains""")
def path_domains(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "pages").select(
        "page_id", paths.domain_of_path(F.col("url")).alias("domain")
    )


@query("p4_domain_of_import", f"""
WITH pages_in AS (SELECT page_id, url FROM pages),
{domain_sql("regexp_split_to_array(lower(url), '[./\\\\]')", "page_id", "pages_in")}
SELECT page_id, domain FROM domains""")
def import_domains(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "pages").select(
        "page_id", paths.domain_of_import(F.col("url")).alias("domain")
    )


@query("p5_normalize_whitespace_hash", """
SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash FROM documents""")
def whitespace_hash(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select(
        "doc_id", normalized_hash(F.col("text")).alias("hash")
    )


@query("p6_cache_key", """
SELECT page_id, substr(sha256(rtrim(lower(url), '/') || '@' || page_id), 1, 16) AS cache_key
FROM pages""")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "pages").select(
        "page_id", paths.cache_key(F.col("url"), F.col("page_id").cast("string")).alias("cache_key")
    )


@query("p7_grade", """
SELECT doc_id, CASE WHEN n_chars / 40.0 >= 75 THEN 'A' WHEN n_chars / 40.0 >= 55 THEN 'B'
       WHEN n_chars / 40.0 >= 40 THEN 'C' WHEN n_chars / 40.0 >= 25 THEN 'D' ELSE 'F' END AS grade
FROM documents""")
def grades(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select(
        "doc_id", scoring.grade(F.col("n_chars") / 40.0).alias("grade")
    )


@query("p8_risk_level", f"""
{b.DOC_LINES_SQL}, sized AS (
  SELECT f.repo, f.file_path, coalesce(max(n_lines), 0) AS n FROM files f LEFT JOIN lines l USING (repo, file_path) GROUP BY ALL)
SELECT file_path, CASE WHEN n % 40 < 10 AND n > 20 THEN 'HIGH' WHEN n % 40 < 30 AND n > 10
       THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM sized""")
def risk_levels(spark: SparkSession, sf: str) -> DataFrame:
    from corpuscope.sources.corpus import with_line_count

    files = with_line_count(b.doc_files(spark, sf))
    return files.select(
        "file_path",
        scoring.risk_level(F.col("line_count") % 40, F.col("line_count") * 5).alias("risk_level"),
    )


@query("p9_osv_severity", f"WITH {b.ADVISORY_SQL} SELECT id, severity FROM advisory")
def advisory_severity(spark: SparkSession, sf: str) -> DataFrame:
    return b.advisories(spark, sf).select(
        "id", osv_severity(F.col("severity"), F.col("affected")).alias("severity")
    )


@query("p10_first_fixed_version", f"""
WITH {b.ADVISORY_SQL} SELECT id, coalesce(fixed, 'latest') AS fixed_version FROM advisory""")
def fixed_versions(spark: SparkSession, sf: str) -> DataFrame:
    return b.advisories(spark, sf).select(
        "id", first_fixed_version(F.col("affected")).alias("fixed_version")
    )


@query("p11_pick_cve", f"WITH {b.ADVISORY_SQL} SELECT id, cve FROM advisory")
def cves(spark: SparkSession, sf: str) -> DataFrame:
    return b.advisories(spark, sf).select("id", pick_cve(F.col("aliases"), F.col("id")).alias("cve"))


RETURN_TYPE_SQL = "CASE " + " ".join(
    "WHEN regexp_matches(source, '{}') THEN '{}'".format(p.replace("'", "''"), t)
    for p, t in hints.RETURN_TYPES) + " ELSE 'Unknown' END"


@query("p12_infer_return_type", f"""
SELECT p_partkey, {RETURN_TYPE_SQL} AS return_type
FROM (SELECT p_partkey, {b.FN_SOURCE} AS source FROM part)""")
def return_types(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "part").select(
        "p_partkey", hints.infer_return_type(F.expr(b.FN_SOURCE)).alias("return_type")
    )


def param_type_sql(name: str) -> str:
    cases = " ".join(
        f"WHEN contains(lower({name}), '{k}') THEN '{v}'" for k, v in hints.PARAM_TYPES.items()
    )
    return (
        f"CASE {cases} WHEN ends_with(lower({name}), '_id') THEN 'int' "
        f"WHEN ends_with(lower({name}), '_url') OR ends_with(lower({name}), '_path') THEN 'str' "
        "ELSE 'Any' END"
    )


@query("p13_infer_param_type", f"""
SELECT word, {param_type_sql('word')} AS param_type, CAST(count(*) AS BIGINT) AS uses
FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL""")
def param_types(spark: SparkSession, sf: str) -> DataFrame:
    words = b.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("uses")).withColumn(
        "param_type", hints.infer_param_type(F.col("word"))
    )


_VERB_CASE = "CASE verb " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in hints.VERBS.items()) + " END"
_VERB_LIST = ", ".join(f"'{v}'" for v in hints.VERBS)


def purpose_sql(name: str, source: str, keep: str) -> str:
    """CTEs that add ``purpose`` for the column ``name`` of ``source``."""
    return f"""
named AS (SELECT *, string_split(lower(regexp_replace({name}, '([a-z])([A-Z])', '\\1_\\2', 'g')),
                                 '_') AS parts FROM {source}),
verbs AS (SELECT *, list_filter(parts, lambda p: p IN ({_VERB_LIST}))[1] AS verb FROM named),
subjects AS (SELECT *, array_to_string(
    list_filter(parts, lambda p: p <> verb AND length(p) > 1), ' ') AS subject FROM verbs),
purposes AS (
  SELECT {keep}, CASE WHEN verb IS NOT NULL
         THEN {_VERB_CASE} || ' ' || CASE WHEN subject = '' THEN 'the resource' ELSE subject END || '.'
         ELSE 'Performs the ' || replace({name}, '_', ' ') || ' operation.' END AS purpose
  FROM subjects)"""


@query("p14_docstring_purpose", f"""
WITH src AS (SELECT p_partkey, {b.FN_NAME} AS name FROM part),
{purpose_sql('name', 'src', 'p_partkey, name')}
SELECT p_partkey, name, purpose FROM purposes""")
def purposes(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "part").select("p_partkey", F.expr(b.FN_NAME).alias("name")).withColumn(
        "purpose", hints.docstring_purpose(F.col("name"))
    )


def code_functions(spark: SparkSession, sf: str, types: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(node rows, function rows) of the generated Python files, parsed once; only nodes of the ``types`` that are read."""
    nodes = materialize(syntax.ast_nodes(b.code_files(spark, sf), types=types, deal=False), "ast-nodes")
    return nodes, syntax.extract_functions(nodes)


_ALL_PARAMS = "[" + ", ".join(f"'{p}'" for p in b.PARAM_NAMES) + "]"
PARAM_LIST = (
    f"CASE WHEN name = '__init__' THEN ['value'] WHEN name = 'noop' THEN [] "
    f"ELSE {_ALL_PARAMS}[:n_params] END"
)
_RETURN_SENTENCE = "CASE return_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in hints.RETURN_TEXT.items()
) + " ELSE 'Result of operation.' END"


@query("p15_generate_docstrings", f"""
WITH {b.FUNCTIONS_SQL},
src AS (SELECT *, {RETURN_TYPE_SQL} AS return_type, {PARAM_LIST} AS params FROM functions
        WHERE NOT documented AND (NOT starts_with(name, '_') OR name = '__init__')),
{purpose_sql('name', 'src', 'repo, file_path, name, lineno, return_type, params')}
SELECT repo, file_path, name, lineno, return_type,
  '\"\"\"' || chr(10) || purpose || chr(10)
  || CASE WHEN len(params) > 0 THEN chr(10) || 'Args:' || chr(10) || array_to_string(
       list_transform(params[:6], lambda p: '    ' || p || ' (' || {param_type_sql('p')}
                      || '): The ' || replace(p, '_', ' ') || ' value.'), chr(10)) || chr(10)
     ELSE '' END
  || CASE WHEN return_type NOT IN ('Unknown', 'None') THEN chr(10) || 'Returns:' || chr(10)
       || '    ' || return_type || ': ' || {_RETURN_SENTENCE} || chr(10) ELSE '' END
  || '\"\"\"' AS docstring
FROM purposes""")
def docstrings(spark: SparkSession, sf: str) -> DataFrame:
    return generate_docstrings(code_functions(spark, sf, syntax.FUNCTION_TYPES)[1], hints.REFERENCE_PARAMS)


@query("p16_type_hint_gaps", f"""
WITH {b.FUNCTIONS_SQL},
src AS (SELECT *, {RETURN_TYPE_SQL} AS inferred_return,
               CASE WHEN has_param_ann THEN [] ELSE {PARAM_LIST} END AS missing
        FROM functions WHERE name <> '__init__')
SELECT repo, file_path, name, lineno, array_to_string(missing, ',') AS missing_params,
       inferred_return,
       floor((0.5 + CASE WHEN inferred_return <> 'Unknown' THEN 0.2 ELSE 0.0 END
         + CASE WHEN len(missing) > 0 THEN CAST(len(list_filter(missing,
             lambda p: {param_type_sql('p')} <> 'Any')) AS DOUBLE) * 0.3 / len(missing)
           ELSE 0.0 END) * 100.0 + 0.5) / 100.0 AS confidence
FROM src WHERE len(missing) > 0 OR NOT has_return_ann""")
def hint_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return type_hint_gaps(code_functions(spark, sf, syntax.FUNCTION_TYPES)[1]).withColumn(
        "missing_params", F.array_join("missing_params", ",")
    )


_TEST_DIRS = ", ".join(f"'{d}'" for d in paths.TEST_DIRS)


@query("p17_is_test_file", f"""
WITH {b.TREE_SQL}
SELECT file_path, list_has_any(string_split(lower(file_path), '/'), [{_TEST_DIRS}])
       OR regexp_matches(split_part(lower(file_path), '/', -1), '{paths.TEST_NAME}') AS is_test
FROM tree""")
def test_flags(spark: SparkSession, sf: str) -> DataFrame:
    return b.tree_files(spark, sf).select(
        "file_path", paths.is_test_file(F.col("file_path")).alias("is_test")
    )


_STEM_SQL = "regexp_replace(lower(split_part(file_path, '/', -1)), '(.)\\.[^.]*$', '\\1')"


@query("p18_test_stem", f"""
WITH {b.TREE_SQL}
SELECT file_path, regexp_replace(regexp_replace({_STEM_SQL}, '{paths.STEM_AFFIX}', '', 'g'),
                                 '{paths.TEST_AFFIX}', '', 'g') AS stem FROM tree""")
def test_stems(spark: SparkSession, sf: str) -> DataFrame:
    return b.tree_files(spark, sf).select(
        "file_path", paths.test_stem(F.col("file_path")).alias("stem")
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fix_case(pick) -> str:
    return "CASE " + " ".join(
        f"WHEN contains(lower(title), {_sql_text(k.lower())}) "
        f"OR contains({_sql_text(k.lower())}, lower(title)) THEN {pick(k, *v)}"
        for k, v in hints.FIX_TEMPLATES.items()
    )


# event types and part names phrased as issue titles
ISSUE_TITLE = (
    "CASE p_type WHEN 'ECONOMY' THEN 'SQL Injection via ' || p_name WHEN 'PROMO' THEN 'Use of eval' "
    "WHEN 'LARGE' THEN 'god class' WHEN 'SMALL' THEN 'Weak JWT Secret in ' || p_name "
    "WHEN 'STANDARD' THEN 'Debug Mode' ELSE p_name END"
)


@query("p19_fix_template_lookup", f"""
WITH titled AS (SELECT p_partkey, {ISSUE_TITLE} AS title FROM part)
SELECT p_partkey, title, {_fix_case(lambda k, c, w: _sql_text(c))}
       ELSE {_sql_text(hints.DEFAULT_FIX)} END AS fixed_code,
       {_fix_case(lambda k, c, w: _sql_text(w))}
       ELSE 'Manual review recommended for: ' || title END AS explanation,
       CAST({_fix_case(lambda k, c, w: '0.7')} ELSE 0.3 END AS DOUBLE) AS confidence
FROM titled""")
def fixes(spark: SparkSession, sf: str) -> DataFrame:
    titled = b.table(spark, sf, "part").select("p_partkey", F.expr(ISSUE_TITLE).alias("title"))
    fix = titled.withColumn("fix", hints.fix_template(F.col("title")))
    return fix.select("p_partkey", "title", "fix.fixed_code", "fix.explanation", "fix.confidence")


# One report row per order: score 0..100, counts from the order's own fields.
REPORT_SQL = """
reports AS (
  SELECT o_orderkey AS run_id, 'name' || o_custkey AS repo_name,
         CAST(o_custkey % 101 AS DOUBLE) AS score, o_orderkey % 8 AS critical,
         o_custkey % 3 AS vulnerable, CAST(o_orderkey % 101 AS DOUBLE) AS architecture,
         CAST((o_custkey + o_orderkey) % 101 AS DOUBLE) AS coverage, o_orderkey % 4 AS bug_risks,
         o_custkey % 14 AS smells, o_orderstatus AS maintainability,
         CAST(o_custkey % 40 AS DOUBLE) / 4 AS debt FROM orders)"""


def order_reports(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id", "'name' || o_custkey AS repo_name",
        "CAST(o_custkey % 101 AS DOUBLE) AS score", "o_orderkey % 8 AS critical",
        "o_custkey % 3 AS vulnerable", "CAST(o_orderkey % 101 AS DOUBLE) AS architecture",
        "CAST((o_custkey + o_orderkey) % 101 AS DOUBLE) AS coverage", "o_orderkey % 4 AS bug_risks",
        "o_custkey % 14 AS smells", "o_orderstatus AS maintainability",
        "CAST(o_custkey % 40 AS DOUBLE) / 4 AS debt",
    )


def _whole(x: str) -> str:
    return f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"


_TREND = "CASE WHEN score >= 80 THEN '+4.2%' WHEN score >= 60 THEN '+1.8%' ELSE '-2.1%' END"


@query("p20_metric_cards", f"""
WITH {REPORT_SQL}
SELECT run_id, {_whole('score')} AS quality_value, {_TREND} AS quality_delta,
  CASE WHEN score >= 70 THEN 'Improved' ELSE 'Needs Work' END AS quality_status,
  critical AS security_value,
  critical || ' issue' || CASE WHEN critical = 1 THEN '' ELSE 's' END || ' found' AS security_delta,
  CASE WHEN critical > 0 THEN 'Critical' ELSE 'Clean' END AS security_status,
  maintainability AS maintainability_value, 'Stable' AS maintainability_status,
  CAST(debt AS VARCHAR) || 'h' AS debt_value,
  '-' || CAST(floor(debt * 0.12 * 10.0 + 0.5) / 10.0 AS VARCHAR) || 'h' AS debt_delta,
  'Improving' AS debt_status FROM reports""")
def cards(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return order_reports(spark, sf).select(
        "run_id",
        *scoring.metric_cards(c("score"), c("critical"), c("maintainability"), c("debt")),
    )


@query("p21_executive_summary", f"""
WITH {REPORT_SQL}
SELECT run_id, 'This codebase is in ' || CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60
  THEN 'moderate' ELSE 'fragile' END || ' condition with a quality score of ' || {_whole('score')}
  || '/100. Delivery risk is ' || CASE WHEN critical >= 5 THEN 'high'
     WHEN critical > 0 OR vulnerable > 0 THEN 'elevated' ELSE 'controlled' END || ': ' || critical
  || ' critical issues, ' || vulnerable || ' vulnerable dependencies, ' || bug_risks
  || ' ML-flagged bug hotspots, ' || {_whole('coverage')} || '% mapped test coverage, and '
  || {_whole('architecture')} || '% architecture alignment.' AS summary FROM reports""")
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return order_reports(spark, sf).select(
        "run_id",
        scoring.executive_summary(
            c("score"), c("critical"), c("vulnerable"), c("architecture"), c("coverage"),
            c("bug_risks"),
        ).alias("summary"),
    )


@query("p22_roadmap", f"""
WITH {REPORT_SQL},
steps AS (SELECT run_id, list_filter([
  CASE WHEN critical > 0 OR vulnerable > 0 THEN 'Stabilize the repo first by fixing ' || critical
    || ' critical findings and upgrading ' || vulnerable || ' vulnerable dependencies.' END,
  CASE WHEN bug_risks > 0 THEN 'Target the ' || bug_risks
    || ' highest-risk functions with AI-assisted fixes, then add regression tests.' END,
  CASE WHEN coverage < 60 THEN 'Raise coverage from ' || {_whole('coverage')}
    || '% to at least 70% on hotspot modules before major feature work.' END,
  CASE WHEN architecture < 70 THEN 'Reduce cross-layer coupling and circular dependencies to improve '
    || 'maintainability and onboarding speed.' END,
  CASE WHEN smells > 0 THEN 'Refactor the worst ' || least(smells, 10)
    || ' code smells to reduce debt and improve future AI fix accuracy.' END],
  lambda s: s IS NOT NULL) AS s FROM reports)
SELECT run_id, CASE WHEN len(s) = 0 THEN 'Maintain the current quality bar and use the dashboard to '
  || 'monitor regressions over time.' ELSE array_to_string(s[:4], '|') END AS roadmap FROM steps""")
def roadmaps(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    steps = scoring.roadmap(
        c("critical"), c("vulnerable"), c("coverage"), c("architecture"), c("smells"),
        c("bug_risks"), scoring.REFERENCE_STEPS,
    )
    return order_reports(spark, sf).select("run_id", F.array_join(steps, "|").alias("roadmap"))


@query("p23_quality_gate", f"""
WITH {REPORT_SQL}
SELECT run_id, CASE WHEN critical > 0 OR score < 30 THEN 'fail' ELSE 'pass' END AS gate
FROM reports""")
def gates(spark: SparkSession, sf: str) -> DataFrame:
    return order_reports(spark, sf).select(
        "run_id", scoring.quality_gate(F.col("critical"), F.col("score")).alias("gate")
    )


_TICK, _GREEN, _YELLOW, _RED = "✅", scoring.GREEN, scoring.YELLOW, scoring.RED


@query("p24_slack_payload", f"""
WITH {REPORT_SQL}
SELECT run_id, '{{"blocks":[{{"type":"header","text":{{"type":"plain_text","text":"{_TICK} Code Analysis Complete"}}}},'
 || '{{"type":"section","text":{{"type":"mrkdwn","text":"*Repository:* `' || repo_name || '`"}}}},'
 || '{{"type":"section","fields":[{{"type":"mrkdwn","text":"'
 || CASE WHEN score >= 75 THEN '{_GREEN}' WHEN score >= 50 THEN '{_YELLOW}' ELSE '{_RED}' END
 || ' *Quality Score*\\n' || {_whole('score')} || '/100"}},{{"type":"mrkdwn","text":"\U0001f6e1️ *Security Risks*\\n'
 || critical || ' high"}},{{"type":"mrkdwn","text":"⚙️ *Maintainability*\\n' || maintainability
 || '"}},{{"type":"mrkdwn","text":"⏱️ *Tech Debt*\\n' || CAST(debt AS VARCHAR) || '"}}]}},'
 || CASE WHEN critical > 0 THEN '{{"type":"section","text":{{"type":"mrkdwn","text":"⚠️ *' || critical
    || ' critical issue(s)* require immediate attention."}}}},' ELSE '' END
 || CASE WHEN vulnerable > 0 THEN '{{"type":"section","text":{{"type":"mrkdwn","text":"{_RED} *' || vulnerable
    || ' vulnerable dependenc' || CASE WHEN vulnerable = 1 THEN 'y' ELSE 'ies' END
    || '* detected."}}}},' ELSE '' END
 || '{{"type":"divider"}},{{"type":"context","elements":[{{"type":"mrkdwn","text":"Powered by *Code Analysis*"}}]}}]}}'
 AS payload FROM reports""")
def slack_payloads(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    score = F.floor(c("score") + 0.5).cast("bigint")
    return order_reports(spark, sf).select(
        "run_id",
        scoring.slack_payload(
            c("repo_name"), score, c("critical"), c("debt"), c("maintainability"), c("critical"),
            c("vulnerable"),
        ).alias("payload"),
    )


@query("p24_teams_facts", f"""
WITH {REPORT_SQL}
SELECT run_id, unnest(['Quality Score', 'Security Risks', 'Maintainability', 'Tech Debt',
                       'Critical Issues', 'Vulnerable Dependencies']) AS name,
  unnest([{_whole('score')} || '/100', critical || ' high severity', maintainability,
          CAST(debt AS VARCHAR), CAST(critical AS VARCHAR), CAST(vulnerable AS VARCHAR)]) AS value
FROM reports""")
def teams_fact_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    payload = scoring.teams_payload(
        c("repo_name"), F.floor(c("score") + 0.5).cast("bigint"), c("critical"), c("debt"),
        c("maintainability"), c("critical"), c("vulnerable"),
    )
    schema = "struct<sections:array<struct<facts:array<struct<name:string,value:string>>>>>"
    return order_reports(spark, sf).select(
        "run_id", F.explode(F.from_json(payload, schema)["sections"][0]["facts"]).alias("f")
    ).select("run_id", "f.name", "f.value")


@query("p25_redact_secret_snippet", f"""
{b.DOC_LINES_SQL}
SELECT repo, file_path, line_no, CASE WHEN contains(line, '@') THEN '[REDACTED]'
       ELSE substr(trim(line), 1, 120) END AS snippet FROM lines""")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    from corpuscope.operators.scan import explode_lines

    return explode_lines(b.doc_files(spark, sf)).select(
        "repo", "file_path", "line_no",
        redact_snippet(F.col("line"), F.col("line").contains("@"), REFERENCE_SNIPPET).alias("snippet"),
    )


@query("p26_repo_name", """
SELECT page_id, CASE WHEN contains(u, '/') THEN split_part(u, '/', -2) || '/' || split_part(u, '/', -1)
       ELSE u END AS repo_name FROM (SELECT page_id, rtrim(url, '/') AS u FROM pages)""")
def repo_names(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "pages").select("page_id", paths.repo_name(F.col("url")).alias("repo_name"))


# URLs as users type them: whole, without a scheme, as owner/name, or a bare word
TYPED_URL = """
CASE WHEN url LIKE 'https:%' THEN ' ' || url || '/' WHEN url LIKE '%/en/%' THEN 'github.com/' || page_id || '/x'
     WHEN url LIKE '%/fr/%' THEN 'http://GitHub.com/a/' || page_id WHEN url LIKE '%/de/%'
     THEN 'org/' || page_id ELSE 'word' || page_id END"""


@query("p27_normalize_repo_url", f"""
SELECT page_id, regexp_replace(regexp_replace(
  CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') OR starts_with(u, 'git@') THEN u
       WHEN starts_with(lower(u), 'github.com/') THEN 'https://' || u
       WHEN contains(u, '/') THEN 'https://github.com/' || u END,
  '(?i)^http://github\\.com/', 'https://github.com/'), '/$', '') AS repo_url
FROM (SELECT page_id, trim({TYPED_URL}) AS u FROM pages)""")
def repo_urls(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "pages").select(
        "page_id", paths.normalize_repo_url(F.expr(TYPED_URL)).alias("repo_url")
    )


@query("p28_decode_repo_key", """
SELECT page_id, CASE WHEN url LIKE 'https:%' THEN url ELSE '*' || url END AS repo FROM pages""")
def repo_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.rtrim(
        F.translate(F.replace(F.base64(F.encode("url", "UTF-8")), F.lit("\r\n"), F.lit("")), "+/", "-_"),
        F.lit("="),
    )
    typed = F.when(F.col("url").like("https:%"), key).otherwise(F.concat(F.lit("*"), F.col("url")))
    return b.table(spark, sf, "pages").select("page_id", paths.decode_repo_key(typed).alias("repo"))
