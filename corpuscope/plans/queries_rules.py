"""Queries over rule scanning, deduplication and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators import quality, rule_matcher, scan, structure
from corpuscope.operators.rule_packs import (
    JAVASCRIPT, PERFORMANCE, PROSE, SECRETS, SECURITY, Rule, SpanRule,
)
from corpuscope.plans import bindings as b
from corpuscope.plans.queries_scalars import code_functions
from corpuscope.plans.registry import query

# RE2 has no look-around: the same line test, consuming one character instead.
RE2_FORM = {
    "no_timeout": r"requests\.(get|post|put|delete|patch)\s*\([^)]*\)(\s*[^\s.#]|\s*$)",
    "no-innerHTML": r"\.innerHTML\s*=([^=]|$)",
    "react-key-prop": r"\.map\s*\([^)]*=>\s*(?:\(?\s*)?<([^R]|$)",
    "state-mutation": r"(?:this\.state\.\w+|state\.\w+)\s*=([^=]|$)",
    "loose-eq": r"(^|[^=])={2}([^=]|$)",
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rule_hits_sql(rules: list[Rule], alias: str = "hits") -> str:
    """CTE with one row per rule and line, and per match for match-scope rules."""
    parts = []
    for seq, r in enumerate(rules):
        flags = ("i" if "i" in r.flags else "") + ("m" if "m" in r.flags else "")
        pattern = _text((f"(?{flags})" if flags else "") + RE2_FORM.get(r.rule_id, r.regex))
        where = f"regexp_matches(line, {pattern})"
        if r.languages:
            where += " AND language IN (" + ", ".join(_text(x) for x in r.languages) + ")"
        snippet = "'[REDACTED]'" if r.redact else f"substr(trim(line), 1, {r.snippet_len})"
        line_no = "line_no"
        if r.scope == "match":
            line_no = f"unnest(list_transform(regexp_extract_all(line, {pattern}), lambda x: line_no))"
        parts.append(
            f"SELECT repo, file_path, {line_no} AS line_no, {_text(r.rule_id)} AS rule_id, "
            f"{_text(r.title)} AS title, '{r.severity}' AS severity, '{r.category}' AS category, "
            f"{snippet} AS snippet, CAST({seq} AS BIGINT) AS seq FROM lines "
            f"WHERE n_lines >= 5 AND {where}"
        )
    return f"{alias} AS (" + " UNION ALL ".join(parts) + ")"


_COLS = ["repo", "file_path", "line_no", "rule_id", "title", "severity", "category", "snippet", "seq"]
_ALL = [*SECURITY, *SECRETS, *PROSE]


@query("r1_scan_line_rules",
       f"{b.DOC_LINES_SQL}, {rule_hits_sql(_ALL)} SELECT * FROM hits")
def line_rules(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan_files(b.doc_files(spark, sf), _ALL).select(*_COLS)


@query("x1_rules_as_data", f"{b.DOC_LINES_SQL}, {rule_hits_sql(_ALL)} SELECT * FROM hits")
def rules_as_data(spark: SparkSession, sf: str) -> DataFrame:
    """The same packs as one value."""
    return rule_matcher.match_files(b.doc_files(spark, sf), _ALL).select(*_COLS)


@query("r2_scan_secrets", f"""
WITH files AS (SELECT source AS repo, lang || '/' || doc_id AS file_path, lang AS language,
  replace(replace(text, 'the ', 'postgres://the:x@'), 'les ', 'sk-lesleslesleslesles12 ') AS content
  FROM documents), {b.LINES_SQL}, {rule_hits_sql(SECRETS)} SELECT * FROM hits""")
def secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with frequent words rewritten to look like credentials."""
    files = b.doc_files(spark, sf).withColumn("content", F.expr(
        "replace(replace(content, 'the ', 'postgres://the:x@'), 'les ', "
        "'sk-lesleslesleslesles12 ')"))
    return scan.scan_files(files, SECRETS).select(*_COLS)


# pages with markup broken into lines, read as scripts
SCRIPT_LINES = "replace(replace(replace(html, '><', '>' || chr(10) || '<'), ' class=', ' =='), 'href=\"/', 'x.innerHTML = \"')"
SCRIPT_FILES_SQL = (
    "files AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, url AS file_path, "
    "CASE WHEN page_id % 3 = 0 THEN 'HTML' WHEN page_id % 3 = 1 THEN 'TypeScript' "
    f"ELSE 'JavaScript' END AS language, {SCRIPT_LINES} AS content FROM pages)"
)


@query("r3_scan_by_language",
       f"WITH {SCRIPT_FILES_SQL}, {b.LINES_SQL}, {rule_hits_sql(JAVASCRIPT)} SELECT * FROM hits")
def script_rules(spark: SparkSession, sf: str) -> DataFrame:
    files = b.table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo"),
        F.col("url").alias("file_path"),
        F.expr("CASE WHEN page_id % 3 = 0 THEN 'HTML' WHEN page_id % 3 = 1 THEN 'TypeScript' "
               "ELSE 'JavaScript' END").alias("language"),
        F.expr(SCRIPT_LINES).alias("content"),
    )
    return scan.scan_files(files, JAVASCRIPT).select(*_COLS)


PROSE_MATCHES = [
    Rule("prose", "comma_word", "Word After Comma", r", (the|les|der|que) ", "LOW", "QUALITY", "", "",
         scope="match", snippet_len=0),
    Rule("prose", "line_start", "Line Opener", r"^\s*(the|les|an|der)\w*", "LOW", "QUALITY", "", "",
         flags="im", scope="match", snippet_len=0),
    *PERFORMANCE,
]


@query("r4_scan_content_rules",
       f"{b.DOC_LINES_SQL}, {rule_hits_sql(PROSE_MATCHES)} SELECT * FROM hits")
def content_rules(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan_files(b.doc_files(spark, sf), PROSE_MATCHES).select(*_COLS)


PROSE_SPANS = [
    SpanRule("the_until_and", "Opener Then Ender", r"^(The|Les|An|El)", r"(ion|en|es)\.$", "LOW", "", ""),
    SpanRule("comma_until_license", "Comma Then Licence", r",", r"License", "MEDIUM", "", ""),
]


def _span_sql(rule: SpanRule) -> str:
    return f"""
  SELECT repo, file_path, min(line_no) AS line_no, target_line, {_text(rule.rule_id)} AS rule_id,
         '{rule.severity}' AS severity
  FROM (SELECT repo, file_path, line_no, regexp_matches(line, {_text(rule.header)}) AS is_header,
               min(CASE WHEN regexp_matches(line, {_text(rule.target)}) THEN line_no END) OVER (
                 PARTITION BY repo, file_path ORDER BY line_no
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target_line
        FROM lines WHERE n_lines >= 5)
  WHERE is_header AND target_line IS NOT NULL GROUP BY repo, file_path, target_line"""


@query("r5_scan_span_rules", b.DOC_LINES_SQL + " " + " UNION ALL ".join(_span_sql(r) for r in PROSE_SPANS))
def span_rules(spark: SparkSession, sf: str) -> DataFrame:
    lines = scan.explode_lines(b.doc_files(spark, sf), scan.MIN_LINES)
    return scan.scan_spans(lines, PROSE_SPANS).select(
        "repo", "file_path", "line_no", "target_line", "rule_id", "severity"
    )


_LOOP_LINE = (
    f"({b.DEF_LINE} + 3 + {b._int(b.HAS_DOC)} + {b.N_IFS})"
)
_PATH = f"p_brand AS repo, {b.CODE_PATH} AS file_path"


@query("r6_scan_calls_in_loops", f"""
SELECT {_PATH}, {_LOOP_LINE} + 1 AS line_no, 'MEDIUM' AS severity, t.title,
       '"' || {b.FN_NAME} || '"' || t.tail AS description
FROM part, (VALUES ('N+1 Query Pattern', ' runs individual DB queries in a loop.'),
                   ('HTTP Request in Loop', ' creates a new TCP connection per iteration.')) t(title, tail)
WHERE {b.HAS_LOOP}""")
def loop_calls(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = code_functions(spark, sf, ["Call"])
    return structure.calls_in_loops(nodes).select(
        "repo", "file_path", "line_no", "severity", "title", "description"
    )


@query("r7_scan_blocking_in_async", f"""
SELECT {_PATH}, 'HIGH' AS severity, line_no, 'Blocking call "' || callee || '" in async "' || fn
       || '" blocks the event loop.' AS description
FROM (SELECT *, {b.FN_NAME} AS fn, 'requests.get' AS callee, {_LOOP_LINE} + 1 AS line_no FROM part
      WHERE {b.IS_ASYNC} AND {b.HAS_LOOP}
      UNION ALL SELECT *, {b.FN_NAME}, 'time.sleep', {_LOOP_LINE} FROM part
      WHERE {b.IS_ASYNC} AND {b.HAS_SLEEP})""")
def async_calls(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = code_functions(spark, sf, ["Call"])
    return structure.blocking_in_async(nodes).select(
        "repo", "file_path", "severity", "line_no", "description"
    )


@query("r8_scan_list_in_aggregate", f"""
SELECT {_PATH}, 'Unnecessary List in Aggregation' AS title,
       {_LOOP_LINE} + 2 * {b._int(b.HAS_LOOP)} + {b._int(b.HAS_SLEEP)} AS line_no
FROM part WHERE {b.HAS_COMP}
UNION ALL SELECT {_PATH}, 'Wildcard Import', 2 FROM part WHERE {b.WILDCARD}""")
def aggregate_lists(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = code_functions(spark, sf, ["Call", "ImportFrom"])
    return structure.list_in_aggregate(nodes).unionByName(
        structure.wildcard_imports(nodes)
    ).select("repo", "file_path", "title", "line_no")


@query("r9_scan_structural_smells", f"""
SELECT {_PATH}, 'God Class' AS title, 'HIGH' AS severity,
       'Class "Holder" has ' || (1 + {b.N_METHODS}) || ' methods. Consider splitting.' AS description
FROM part WHERE {b.HAS_CLASS} AND 1 + {b.N_METHODS} > 15
UNION ALL
SELECT {_PATH}, 'Too Many Parameters', 'LOW', '"' || {b.FN_NAME} || '" has ' || {b.N_PARAMS}
       || ' parameters.' FROM part WHERE {b.N_PARAMS} > 5
UNION ALL
SELECT {_PATH}, 'Dead Function', 'LOW', CAST({b.N_METHODS} AS VARCHAR) FROM part
WHERE {b.HAS_CLASS} AND {b.N_METHODS} > 0""")
def structural_smells(spark: SparkSession, sf: str) -> DataFrame:
    nodes, functions = code_functions(spark, sf, structure.DOCUMENTED_TYPES)
    dead = structure.dead_functions(functions).groupBy("repo", "file_path").agg(
        F.count("*").cast("string").alias("description")
    ).withColumn("title", F.lit("Dead Function")).withColumn("severity", F.lit("LOW"))
    cols = ["repo", "file_path", "title", "severity", "description"]
    return structure.structural_smells(nodes, functions).select(*cols).unionByName(dead.select(*cols))


@query("r10_scan_deep_nesting", f"""
WITH files AS (SELECT source AS repo, lang || '/' || doc_id AS file_path, lang AS language,
                      replace(text, 'the ', chr(10) || repeat(' ', 20 + length(source) * 2)) AS content
               FROM documents), {b.LINES_SQL}
SELECT repo, file_path, min(line_no) AS line_no,
       CAST(arg_min(length(line) - length(ltrim(line)), line_no) // 4 AS INTEGER) AS levels
FROM lines WHERE length(line) - length(ltrim(line)) >= 24 GROUP BY repo, file_path""")
def deep_nesting(spark: SparkSession, sf: str) -> DataFrame:
    files = b.doc_files(spark, sf).withColumn("content", F.expr(
        "replace(content, 'the ', chr(10) || repeat(' ', 20 + length(repo) * 2))"))
    return scan.scan_deep_nesting(scan.explode_lines(files))


DEBT = ("license", "and", "les", "der", "que")


@query("r11_scan_debt_comments", f"""
{b.DOC_LINES_SQL}
SELECT repo, file_path, count(*) AS debt_lines, min(line_no) AS line_no FROM lines
WHERE regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({"|".join(DEBT)})([^\\p{{L}}\\p{{N}}_]|$)')
GROUP BY repo, file_path""")
def debt_comments(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan_debt_comments(scan.explode_lines(b.doc_files(spark, sf)), DEBT)


@query("r12_scan_long_lines", f"""
{b.DOC_LINES_SQL}
SELECT repo, file_path, count(*) AS long_lines, min(line_no) AS line_no FROM lines
WHERE length(line) > 200 GROUP BY repo, file_path HAVING count(*) > 5""")
def long_lines(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan_long_lines(scan.explode_lines(b.doc_files(spark, sf)))


DENSITY_WORDS = ("if", "for", "and", "les", "der", "que", "in")
# words of a text, as both engines see them
WORDS_SQL = "regexp_extract_all({t}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{{n},}}')"


def words_sql(text: str, n: int = 1) -> str:
    return WORDS_SQL.format(t=text, n=n)


DENSITY_SQL = f"""
density AS (
  SELECT repo, file_path, language,
         least(CAST(len(list_filter({words_sql('content')},
           lambda w: w IN ({", ".join(f"'{w}'" for w in DENSITY_WORDS)}))) AS DOUBLE)
           / greatest(len(CASE WHEN ends_with(content, chr(10)) OR content = ''
             THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END), 1)
           * 100.0, 100.0) AS density FROM files)"""


@query("r13_keyword_density", f"WITH {b.DOC_FILES_SQL}, {DENSITY_SQL} SELECT * FROM density")
def density(spark: SparkSession, sf: str) -> DataFrame:
    return scan.keyword_density(b.doc_files(spark, sf), DENSITY_WORDS)


PROSE_CATEGORIES = {
    "English": (("the", "and", "that", "with", "from", "are", "license"), "HIGH"),
    "French": (("les", "que", "dans", "avec", "une", "par", "qui", "des"), "MEDIUM"),
    "German": (("der", "und", "nicht", "für", "auf", "von", "mit", "eine"), "HIGH"),
    "Licence": (("license", "licensed", "released", "mit", "apache"), "MEDIUM"),
}


def _category_sql() -> str:
    parts = []
    for name, (words, severity) in PROSE_CATEGORIES.items():
        listed = ", ".join(f"'{w}'" for w in words)
        parts.append(
            f"SELECT repo, file_path, line_no, snippet, '{name}' AS category, '{severity}' AS severity, "
            f"least(CAST(len(list_intersect(words, [{listed}])) AS DOUBLE) * 2.5 / {len(words)}, 1.0) "
            f"AS confidence FROM windows WHERE len(list_intersect(words, [{listed}])) > 0"
        )
    return " UNION ALL ".join(parts)


@query("r14_window_classify", f"""
WITH {b.DOC_FILES_SQL}, {b.LINES_SQL},
starts AS (SELECT repo, file_path, ls, unnest(range(0, len(ls), 5)) AS pos FROM file_arrays
           WHERE len(ls) >= 5),
windows AS (SELECT repo, file_path, CAST(pos + 1 AS INTEGER) AS line_no,
                   trim(substr(array_to_string(ls[pos + 1:pos + 10], chr(10)), 1, 120),
                        ' ' || chr(10)) AS snippet,
                   list_distinct({words_sql("lower(array_to_string(ls[pos + 1:pos + 10], chr(10)))")})
                     AS words FROM starts),
found AS ({_category_sql()}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, file_path, line_no // 10, category
                                        ORDER BY line_no) AS rn FROM found WHERE confidence >= 0.15)
SELECT repo, file_path, line_no, category, severity, confidence, snippet FROM ranked WHERE rn = 1""")
def windows(spark: SparkSession, sf: str) -> DataFrame:
    return scan.classify_windows(b.doc_files(spark, sf), PROSE_CATEGORIES, snippet=scan.REFERENCE_SNIPPET).select(
        "repo", "file_path", "line_no", "category", "severity", "confidence", "snippet"
    )


# linter output as JSON text, one report per part
PY_REPORT = """
'{"results": [{"filename": "/src/f' || CAST(p_partkey AS STRING) || '.py", "line_number": '
|| CAST(p_size AS STRING) || ', "test_name": "hardcoded_' || replace(p_name, ' ', '_')
|| '", "issue_severity": "' || CASE WHEN p_size > 40 THEN 'HIGH' WHEN p_size > 20 THEN 'medium'
   ELSE 'LOW' END || '", "issue_confidence": "' || CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'LOW'
   ELSE 'HIGH' END || '", "issue_text": "found", "issue_cwe": {"id": ' || CAST(p_size AS STRING)
|| '}, "code": " x = 1 ", "more_info": "link"}]}'"""


@query("r15_merge_python_linter", """
SELECT p_brand AS repo, CASE WHEN p_type <> 'LARGE' THEN 'f' || p_partkey || '.py'
       ELSE '/src/f' || p_partkey || '.py' END AS file_path, p_size AS line_no,
       'Hardcoded ' || array_to_string(list_transform(string_split(p_name, ' '),
          lambda w: upper(w[1]) || w[2:]), ' ') AS title,
       CASE WHEN p_size > 40 THEN 'HIGH' WHEN p_size > 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       'x = 1' AS snippet, 'CWE-' || p_size AS cwe
FROM part WHERE NOT (p_size <= 20 AND p_type IN ('SMALL', 'PROMO'))""")
def python_linter(spark: SparkSession, sf: str) -> DataFrame:
    part = b.table(spark, sf, "part")
    reports = part.select(F.col("p_brand").alias("repo"), F.expr(PY_REPORT).alias("report"))
    places = part.filter("p_type <> 'LARGE'").selectExpr(
        "p_brand AS repo", "'/src/f' || p_partkey || '.py' AS path",
        "'f' || p_partkey || '.py' AS file_path",
    )
    return scan.merge_python_linter(reports, places, scan.REFERENCE_SNIPPET).select(
        "repo", "file_path", "line_no", "title", "severity", "snippet", "cwe"
    )


JS_REPORT = """
'[{"filePath": "/src/f' || CAST(p_partkey AS STRING) || '.js", "messages": [{"ruleId": "no-'
|| replace(p_name, ' ', '-') || '", "severity": ' || CAST(p_size % 3 AS STRING)
|| ', "message": "m", "line": ' || CAST(p_size AS STRING) || '}, {"ruleId": null, "severity": 2, '
|| '"message": "n", "line": 1}]}]'"""


@query("r15_merge_script_linter", """
SELECT p_brand AS repo, 'f' || p_partkey || '.js' AS file_path, p_size AS line_no,
       'eslint/no-' || replace(p_name, ' ', '-') AS rule_id,
       CASE WHEN p_size % 3 = 2 THEN 'HIGH' ELSE 'LOW' END AS severity FROM part
UNION ALL SELECT p_brand, 'f' || p_partkey || '.js', 1, 'eslint/?', 'HIGH' FROM part""")
def script_linter(spark: SparkSession, sf: str) -> DataFrame:
    part = b.table(spark, sf, "part")
    reports = part.select(F.col("p_brand").alias("repo"), F.expr(JS_REPORT).alias("report"))
    places = part.selectExpr(
        "p_brand AS repo", "'/src/f' || p_partkey || '.js' AS path",
        "'f' || p_partkey || '.js' AS file_path",
    )
    return scan.merge_script_linter(reports, places).select(
        "repo", "file_path", "line_no", "rule_id", "severity"
    )


@query("w1_dedup_first", f"""
WITH {b.EVENT_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, file_path, title
                                                         ORDER BY seq) AS rn FROM findings)
SELECT repo, file_path, title, severity, author, seq FROM ranked WHERE rn = 1""")
def first_findings(spark: SparkSession, sf: str) -> DataFrame:
    return scan.dedup_first(
        b.event_findings(spark, sf).select("repo", "file_path", "title", "severity", "author", "seq"),
        ["repo", "file_path", "title"], ["seq"],
    )


@query("w2_top_by_severity", f"""
WITH {b.EVENT_SQL}
SELECT seq, severity, title FROM findings
ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, seq LIMIT 40""")
def top_findings(spark: SparkSession, sf: str) -> DataFrame:
    return scan.sort_by_severity(
        b.event_findings(spark, sf).select("seq", "severity", "title"), ["seq"], 40
    )


_DEDUP_PROSE_SQL = f"""
{b.DOC_LINES_SQL}, {rule_hits_sql(PROSE)},
first_hits AS (SELECT *, row_number() OVER (PARTITION BY repo, file_path, line_no, title
                                            ORDER BY seq) AS rn FROM hits),
severities AS (
  SELECT repo, count(*) AS findings, count(*) FILTER (severity = 'HIGH') AS high,
         count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low
  FROM first_hits WHERE rn = 1 GROUP BY repo),
langs AS (SELECT repo, language, count(*) AS lines FROM lines GROUP BY ALL),
shares AS (SELECT *, floor(lines * 100.0 / sum(lines) OVER (PARTITION BY repo) * 10.0 + 0.5) / 10.0
           AS share FROM langs)"""


@query("findings_by_source", f"""
{_DEDUP_PROSE_SQL}
SELECT s.repo, language, lines, CAST(share AS DOUBLE) AS share, coalesce(findings, 0) AS findings,
       coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
FROM shares s LEFT JOIN severities USING (repo)""")
def findings_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Severity counts of the prose rules next to each language's share of lines."""
    files = b.doc_files(spark, sf)
    findings = scan.dedup_findings(scan.scan_files(files, PROSE))
    counts = findings.groupBy("repo").agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")],
    )
    return quality.language_breakdown(files).join(counts, "repo", "left").na.fill(
        0, ["findings", "high", "medium", "low"]
    )
