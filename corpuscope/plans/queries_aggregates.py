"""Queries over aggregations: quality, complexity, coverage, coupling, history."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import scoring
from corpuscope.functions.paths import module_of
from corpuscope.functions.text import word_tokens
from corpuscope.operators import coverage, graph, history, incremental, insights, models, provenance
from corpuscope.operators import quality, scan, structure
from corpuscope.plans import bindings as b
from corpuscope.plans.queries_joins import MARKED_SQL, _tests_and_sources, marked_files
from corpuscope.plans.queries_rules import DENSITY_SQL, DENSITY_WORDS, words_sql
from corpuscope.plans.queries_scalars import code_functions
from corpuscope.plans.registry import query
from corpuscope.sources.syntax import COMPUTING_TYPES, FUNCTION_TYPES


def _half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * {10.0 ** digits} + 0.5) / {10.0 ** digits}"


def _bigint(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


@query("g1_language_breakdown", f"""
{b.DOC_LINES_SQL}, langs AS (SELECT repo, language, count(*) AS lines FROM lines GROUP BY ALL)
SELECT repo, language, lines,
       {_half_up("CAST(lines * 100.0 / sum(lines) OVER (PARTITION BY repo) AS DOUBLE)", 1)} AS share
FROM langs""")
def languages(spark: SparkSession, sf: str) -> DataFrame:
    return quality.language_breakdown(b.doc_files(spark, sf))


@query("g2_comment_blank_counts", f"""
WITH files AS (SELECT source AS repo, lang || '/' || doc_id AS file_path, lang AS language,
               replace(replace(text, ' the ', chr(10) || chr(10) || ' # '), ' les ', chr(10) || '-- ')
                 AS content FROM documents), {b.LINES_SQL}
SELECT repo, count(*) AS total_lines,
  count(*) FILTER (regexp_matches(trim(line), '^(#|//|/\\*|\\*|<!--|--)')) AS comment_lines,
  count(*) FILTER (trim(line) = '') AS blank_lines FROM lines GROUP BY repo""")
def comment_counts(spark: SparkSession, sf: str) -> DataFrame:
    files = b.doc_files(spark, sf).withColumn("content", F.expr(
        "replace(replace(content, ' the ', chr(10) || chr(10) || ' # '), ' les ', chr(10) || '-- ')"))
    return quality.comment_blank_counts(files)


@query("g3_duplication_rate", f"""
{b.DOC_LINES_SQL},
clean AS (SELECT repo, file_path, trim(line) AS line,
                 row_number() OVER (PARTITION BY repo, file_path ORDER BY line_no) AS i
          FROM lines WHERE length(trim(line)) > 10),
blocks AS (SELECT repo, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w
                  || chr(10) || lead(line, 3) OVER w AS block
           FROM clean WINDOW w AS (PARTITION BY repo, file_path ORDER BY i)),
counted AS (SELECT repo, count(block) AS blocks, count(DISTINCT block) AS distinct_blocks
            FROM blocks GROUP BY repo)
SELECT r.repo, coalesce(blocks, 0) AS blocks, coalesce(distinct_blocks, 0) AS distinct_blocks,
  CASE WHEN coalesce(blocks, 0) > 0 THEN
    {_half_up("(1.0 - CAST(distinct_blocks AS DOUBLE) / blocks) * 100.0", 1)} ELSE 0.0 END AS duplication_rate
FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN counted USING (repo)""")
def duplication(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplication_rate(b.doc_files(spark, sf))


@query("g4_doc_coverage", f"""
SELECT p_brand AS repo, {_bigint(f"sum(1 + {b._int(b.HAS_CLASS)} * (2 + {b.N_METHODS}))")} AS total,
  {_bigint(f"sum({b._int(b.HAS_DOC)})")} AS documented,
  {_half_up(f"CAST(sum({b._int(b.HAS_DOC)}) AS DOUBLE) * 100.0 / sum(1 + {b._int(b.HAS_CLASS)} * (2 + {b.N_METHODS}))", 1)}
    AS doc_coverage FROM part GROUP BY p_brand""")
def documentation(spark: SparkSession, sf: str) -> DataFrame:
    return structure.doc_coverage(code_functions(spark, sf, structure.DOCUMENTED_TYPES)[0])


@query("g5_function_lengths", f"""
WITH {b.FUNCTIONS_SQL}
SELECT repo, {_half_up("CAST(sum(loc) AS DOUBLE) / count(*)", 1)} AS avg_function_length,
       max(loc) AS max_function_length, count(*) FILTER (pass_only) AS dead_code_count
FROM functions GROUP BY repo""")
def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return structure.function_lengths(code_functions(spark, sf, FUNCTION_TYPES)[1])


MODULE_SCORE_SQL = f"""
scored AS (SELECT repo, upper(substr(split_part(file_path, '/', 1), 1, 1))
             || lower(substr(split_part(file_path, '/', 1), 2)) AS module, density AS score FROM density),
module_scores AS (
  SELECT repo, module, {_half_up("avg(score)", 1)} AS score, count(*) FILTER (score > 10) AS issues
  FROM scored GROUP BY ALL)"""


def scored_modules(spark: SparkSession, sf: str) -> DataFrame:
    density = scan.keyword_density(b.doc_files(spark, sf), DENSITY_WORDS)
    return quality.module_scores(density.select(
        "repo", module_of(F.col("file_path")).alias("module"), F.col("density").alias("score"),
        F.lit(True).alias("is_function"),
    ))


@query("g6_module_scores",
       f"WITH {b.DOC_FILES_SQL}, {DENSITY_SQL}, {MODULE_SCORE_SQL} SELECT * FROM module_scores")
def module_score_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scored_modules(spark, sf)


@query("g6_heat_map", f"""
WITH {b.DOC_FILES_SQL}, {DENSITY_SQL}, {MODULE_SCORE_SQL},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY score DESC, module) AS INT)
           AS rank FROM module_scores)
SELECT * FROM ranked WHERE rank <= 3""")
def heat(spark: SparkSession, sf: str) -> DataFrame:
    return quality.heat_map(scored_modules(spark, sf), 3)


# Words as tokens: short words stand for operators, the others for operands.
TOKENS_SQL = f"""
tokens AS (SELECT source AS repo, lang || '/' || doc_id AS file_path,
                  unnest({words_sql('lower(text)')}) AS token FROM documents),
sums AS (SELECT repo, file_path, count(DISTINCT token) FILTER (length(token) <= 3) AS h1,
                count(DISTINCT token) FILTER (length(token) > 3) AS h2,
                count(*) FILTER (length(token) <= 3) AS N1, count(*) FILTER (length(token) > 3) AS N2
         FROM tokens GROUP BY ALL)"""


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return b.doc_files(spark, sf).select(
        "repo", "file_path", F.explode(word_tokens(F.lower("content"))).alias("token")
    ).withColumn("kind", F.when(F.length("token") <= 3, "operator").otherwise("operand"))


def _rounded(df: DataFrame, names: list[str], digits: int) -> DataFrame:
    from corpuscope.functions.text import round_half_up

    for n in names:
        df = df.withColumn(n, round_half_up(F.col(n), digits))
    return df


@query("g8_halstead", f"""
WITH {TOKENS_SQL}
SELECT repo, file_path, h1, h2, N1, N2, h1 + h2 AS vocabulary, N1 + N2 AS length,
  {_half_up("(N1 + N2) * log2(h1 + h2)", 4)} AS volume,
  {_half_up("CASE WHEN h2 > 0 THEN CAST(h1 * N2 AS DOUBLE) / (h2 * 2.0) ELSE 0.0 END", 4)} AS difficulty,
  {_half_up("CASE WHEN h2 > 0 THEN CAST(h1 * N2 AS DOUBLE) / (h2 * 2.0) ELSE 0.0 END * ((N1 + N2) * log2(h1 + h2))", 2)}
    AS effort FROM sums""")
def halstead(spark: SparkSession, sf: str) -> DataFrame:
    rows = structure.halstead(doc_tokens(spark, sf), ["repo", "file_path"])
    return _rounded(_rounded(rows, ["volume", "difficulty"], 4), ["effort"], 2)


# Operators and operands of the generated function and class.
_OPS = (
    f"(1 + {b.N_IFS} + 5 * {b._int(b.HAS_BOOL)})",                                   # N1
    f"(2 + 2 * {b.N_IFS} + 10 * {b._int(b.HAS_BOOL)})",                              # N2
)
_H1 = (f"(1 + CASE WHEN {b.N_IFS} > 0 THEN 1 ELSE 0 END + {b._int(b.HAS_BOOL)} * 5)")


@query("g7_halstead_mean", f"""
WITH {TOKENS_SQL},
m AS (SELECT repo, h1, h2, N1, N2, h1 + h2 AS vocabulary, N1 + N2 AS length FROM sums)
SELECT repo, {", ".join(f'{_half_up(f"CAST(sum({c}) AS DOUBLE) / count(*) FILTER ({c} <> 0)", 2)} AS {c}'
                        for c in ("h1", "h2", "N1", "N2", "vocabulary", "length"))}
FROM m GROUP BY repo""")
def halstead_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = structure.halstead(doc_tokens(spark, sf), ["repo", "file_path"])
    return structure.halstead_mean(rows).drop("volume", "difficulty", "effort")


@query("g8_halstead_code", f"""
SELECT p_brand AS repo, {b.CODE_PATH} AS file_path,
       {_bigint(_OPS[0])} AS N1, {_bigint(_OPS[1])} AS N2, {_bigint(_H1)} AS h1
FROM part""")
def halstead_code(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = code_functions(spark, sf, COMPUTING_TYPES)
    return structure.halstead(structure.code_tokens(nodes), ["repo", "file_path"]).select(
        "repo", "file_path", "N1", "N2", "h1"
    )


@query("g9_maintainability_index", f"""
WITH {TOKENS_SQL},
m AS (SELECT repo, (N1 + N2) * log2(h1 + h2) AS volume, h1 AS cc, CAST(h2 AS DOUBLE) AS sloc,
             CAST(N1 AS DOUBLE) * 100.0 / (N1 + N2) AS comments FROM sums),
mi AS (SELECT repo, CASE WHEN volume <= 0 OR sloc <= 0 THEN 100.0 ELSE
  least(greatest(0.0, (171.0 - 5.2 * ln(volume) - 0.23 * cc - 16.2 * ln(sloc)
    + 50.0 * sin(sqrt(2.46 * comments * {math.pi / 180.0!r}))) * 100.0 / 171.0), 100.0) END AS mi FROM m)
SELECT repo, {_half_up("avg(mi)", 4)} AS maintainability_index FROM mi GROUP BY repo""")
def maintainability(spark: SparkSession, sf: str) -> DataFrame:
    m = structure.halstead(doc_tokens(spark, sf), ["repo", "file_path"])
    share = F.col("N1") * 100.0 / (F.col("N1") + F.col("N2"))
    mi = m.select("repo", scoring.maintainability_index(
        F.col("volume"), F.col("h1"), F.col("h2").cast("double"), share).alias("mi"))
    return _rounded(
        structure.repo_maintainability(mi, m), ["maintainability_index"], 4
    )


def _complexity(spark: SparkSession, sf: str) -> DataFrame:
    nodes, functions = code_functions(spark, sf, structure.MEASURED_TYPES)
    return structure.function_complexity(functions, structure.function_counts(nodes))


@query("g10_cyclomatic", f"""
WITH {b.FUNCTIONS_SQL}
SELECT repo, file_path, name, lineno, CAST(cc AS BIGINT) AS complexity,
       CASE WHEN cc <= 5 THEN 'A' WHEN cc <= 10 THEN 'B' ELSE 'C' END AS rank, cc > 10 AS is_too_complex
FROM functions""")
def cyclomatic(spark: SparkSession, sf: str) -> DataFrame:
    return _complexity(spark, sf).select(
        "repo", "file_path", "name", "lineno", "complexity", "rank", "is_too_complex"
    )


@query("g11_cognitive", f"""
WITH {b.FUNCTIONS_SQL}
SELECT repo, file_path, name, lineno, CAST(cognitive AS BIGINT) AS cognitive FROM functions""")
def cognitive(spark: SparkSession, sf: str) -> DataFrame:
    return _complexity(spark, sf).select("repo", "file_path", "name", "lineno", "cognitive")


# Events as smells and, for purchases, as functions of complexity value / 4.
QUALITY_SQL = f"""
{b.EVENT_SQL},
cx AS (SELECT repo, CAST(floor(e.value / 4) AS INTEGER) AS complexity FROM findings f
       JOIN events e ON e.event_id = f.seq WHERE event_type = 'purchase'),
cxs AS (SELECT repo, sum(greatest(complexity - 10, 0)) AS excess,
               count(*) FILTER (complexity > 10) AS complex_functions FROM cx GROUP BY repo),
smells AS (SELECT repo, sum(CASE severity WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 1.5 ELSE 0.5 END) AS penalty,
                  sum(CASE severity WHEN 'HIGH' THEN 2.0 WHEN 'MEDIUM' THEN 0.75 ELSE 0.25 END) AS hours,
                  count(*) AS smells FROM findings GROUP BY repo)"""


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    events = b.event_findings(spark, sf).join(
        b.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "value"), "seq"
    )
    cx = events.filter("title = 'purchase'").select(
        "repo", F.floor(F.col("value") / 4).cast("int").alias("complexity"))
    repos = events.select("repo").distinct()
    index = repos.withColumn("maintainability_index", F.lit(95.0))
    lines = events.groupBy("repo").agg(F.count("*").alias("total_lines"))
    return quality.quality_scores(repos, index, cx, events, lines)


@query("g12_quality_score", f"""
WITH {QUALITY_SQL}
SELECT repo, {_half_up("greatest(0.0, 95.0 - least(CAST(excess AS DOUBLE) * 0.4 + CAST(penalty AS DOUBLE), 40.0))", 1)}
  AS quality_score FROM smells JOIN cxs USING (repo)""")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("repo", "quality_score")


@query("g13_tech_debt_hours", f"""
WITH {QUALITY_SQL}, n AS (SELECT repo, count(*) AS total_lines FROM findings GROUP BY repo)
SELECT repo, smells, {_half_up("CAST(complex_functions AS DOUBLE) * 0.5 + CAST(hours AS DOUBLE) + CAST(total_lines AS DOUBLE) / 6000.0", 1)}
  AS tech_debt_hours FROM smells JOIN cxs USING (repo) JOIN n USING (repo)""")
def debt_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("repo", "smells", "tech_debt_hours")


AUTHOR_SQL = f"""
{b.EVENT_SQL},
authors AS (SELECT repo, coalesce(nullif(email, ''), author) AS author_key, min(author) AS name,
   count(*) AS total_issues, count(*) FILTER (severity = 'HIGH') AS high_issues,
   count(DISTINCT file_path) AS files_touched, min(blame_ts) AS first_commit, max(blame_ts) AS last_commit
   FROM findings GROUP BY ALL)"""


@query("g14_author_stats", f"""
WITH {AUTHOR_SQL},
ranked AS (SELECT *, high_issues * 10 + total_issues AS weight, CAST(row_number() OVER (
   PARTITION BY repo ORDER BY high_issues * 10 + total_issues DESC, author_key) AS INT) AS rank FROM authors)
SELECT * FROM ranked WHERE rank <= 10""")
def authors(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.author_stats(b.event_findings(spark, sf), 10)


CHURN_SQL = """
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha) AS rn
                          FROM commits) WHERE rn <= 100),
hot AS (SELECT repo, file_path, count(*) AS commit_count, count(DISTINCT author_email) AS unique_authors
        FROM (SELECT DISTINCT f.repo, f.sha, file_path FROM commit_files f WHERE change = 'M')
        JOIN recent USING (repo, sha) GROUP BY ALL)"""


@query("g15_churn_hotspots", f"""
WITH {b.COMMITS_SQL}, {CHURN_SQL},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY commit_count DESC, file_path)
           AS INT) AS rank FROM hot)
SELECT * FROM ranked WHERE rank <= 10""")
def churn(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.churn_hotspots(b.order_commits(spark, sf), b.changed_files(spark, sf), last=100, limit=10)


DEGREES_SQL = """
ends AS (SELECT repo, src AS module, 1 AS ce, 0 AS ca FROM edges UNION ALL
         SELECT repo, dst, 0, 1 FROM edges),
degrees AS (SELECT repo, module, sum(ce) AS efferent, sum(ca) AS afferent FROM ends GROUP BY ALL)"""


@query("g16_coupling_score", f"""
WITH {b.TRADE_EDGES_SQL}, {DEGREES_SQL}
SELECT repo, count(*) AS modules,
       {_half_up("avg(CAST(efferent AS DOUBLE) / (efferent + afferent)) * 100.0", 1)} AS coupling_score
FROM degrees GROUP BY repo""")
def coupling(spark: SparkSession, sf: str) -> DataFrame:
    return graph.coupling_scores(graph.module_degrees(b.trade_edges(spark, sf)))


@query("g17_largest_component", f"""
WITH {b.TRADE_EDGES_SQL}, {DEGREES_SQL}
SELECT repo, module AS largest_component, {_bigint("afferent")} AS in_degree FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY afferent DESC, module) AS rn FROM degrees
  WHERE afferent > 0) WHERE rn = 1""")
def largest(spark: SparkSession, sf: str) -> DataFrame:
    return graph.largest_component(graph.module_degrees(b.trade_edges(spark, sf)))


COHESION_SQL = f"""
members AS (SELECT lang AS repo, source AS module, doc_id, text FROM documents),
words AS (SELECT DISTINCT repo, module, doc_id, unnest({words_sql('text', 4)}) AS word FROM members),
shared AS (SELECT a.repo, a.module, a.doc_id AS x, z.doc_id AS y FROM words a JOIN words z
   ON a.repo = z.repo AND a.module = z.module AND a.word = z.word AND a.doc_id < z.doc_id
   GROUP BY ALL HAVING count(*) > 5),
pairs AS (SELECT repo, module, count(*) AS sharing_pairs FROM shared GROUP BY ALL),
sizes AS (SELECT repo, module, count(*) AS files FROM members GROUP BY ALL)"""


@query("g18_cohesion", f"""
WITH {COHESION_SQL}
SELECT s.repo, s.module, files, coalesce(sharing_pairs, 0) AS sharing_pairs,
  CASE WHEN files < 2 THEN 1.0 ELSE coalesce(sharing_pairs, 0) / (files * (files - 1) / 2.0) END AS cohesion
FROM sizes s LEFT JOIN pairs p ON s.repo = p.repo AND s.module = p.module""")
def cohesion(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cohesion(_module_documents(spark, sf))


def _module_documents(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select(
        F.col("lang").alias("repo"), F.col("source").alias("module"), F.col("text").alias("content")
    )


@query("g18_cohesion_score", f"""
WITH {COHESION_SQL},
scores AS (SELECT s.repo, CASE WHEN files < 2 THEN 1.0 ELSE coalesce(sharing_pairs, 0)
  / (files * (files - 1) / 2.0) END AS cohesion
  FROM sizes s LEFT JOIN pairs p ON s.repo = p.repo AND s.module = p.module)
SELECT repo, {_half_up("avg(cohesion) * 100.0", 1)} AS cohesion_score FROM scores GROUP BY repo""")
def cohesion_score(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cohesion_scores(graph.cohesion(_module_documents(spark, sf)))


_LEVEL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in graph.LAYERS.items()) + " ELSE 2 END"
VIOLATIONS_SQL = f"""
violations AS (SELECT repo, src, dst, src || ' → ' || dst || ' (layer violation)' AS violation
  FROM edges WHERE {_LEVEL.format(c='dst')} > {_LEVEL.format(c='src')} AND {_LEVEL.format(c='src')} >= 0)"""


CYCLES_SQL = """
walk(repo, start, last, path) AS (
  SELECT repo, src, dst, [src, dst] FROM edges WHERE src < dst
  UNION ALL
  SELECT w.repo, start, e.dst, list_append(path, e.dst) FROM walk w
  JOIN edges e ON e.repo = w.repo AND e.src = w.last
  WHERE e.dst > start AND NOT list_contains(path, e.dst)),
cycles AS (SELECT w.repo, CAST(len(path) AS INT) AS length,
                  array_to_string(list_append(path, start), ' → ') AS cycle
           FROM walk w JOIN edges e ON e.repo = w.repo AND e.src = w.last AND e.dst = w.start)"""


@query("g19_domain_score", f"""
WITH RECURSIVE {b.TRADE_EDGES_SQL}, {VIOLATIONS_SQL}, {CYCLES_SQL},
c AS (SELECT repo, count(*) AS n FROM cycles GROUP BY repo),
v AS (SELECT repo, count(*) AS n FROM violations GROUP BY repo)
SELECT r.repo, CAST(greatest(0.0, 100.0 - coalesce(c.n, 0) * 6.0 - coalesce(v.n, 0) * 4.0) AS DOUBLE) AS domain_score
FROM (SELECT DISTINCT repo FROM edges) r LEFT JOIN c USING (repo) LEFT JOIN v USING (repo)""")
def domain_scores(spark: SparkSession, sf: str) -> DataFrame:
    return graph.architecture_summary(b.trade_edges(spark, sf)).select("repo", "domain_score")


COVERED_SQL = f"""
{b.COVERAGE_SQL}, {b.BY_NAME_SQL}, {b.BY_IMPORT_SQL},
per_file AS (SELECT m.repo, m.file_path, count(*) AS test_files, sum(test_count) AS test_count
             FROM mapping m JOIN tests t ON t.repo = m.repo AND t.test_path = m.test_path GROUP BY ALL),
sized AS (SELECT s.repo, s.file_path, fn_count, len(string_split(content, chr(10))) - 1 AS line_count,
                 coalesce(test_files, 0) AS test_files, coalesce(test_count, 0) AS test_count
          FROM sources s LEFT JOIN per_file p ON p.repo = s.repo AND p.file_path = s.file_path),
covered AS (SELECT *, CASE WHEN test_files = 0 THEN 0.0 ELSE
     {_half_up("least(CAST(test_count AS DOUBLE) / fn_count, 1.0) * 85.0 + 10.0", 1)} END AS coverage
     FROM sized),
rated AS (SELECT *, CASE WHEN coverage < 10 AND line_count > 100 THEN 'HIGH'
     WHEN coverage < 30 AND line_count > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM covered)"""


def _coverage(spark: SparkSession, sf: str):
    from corpuscope.sources import syntax

    sources, tests, files = _tests_and_sources(spark, sf)
    mapping = coverage.map_tests(sources, tests)
    counts = coverage.count_tests(tests)
    functions = syntax.extract_functions(syntax.ast_nodes(sources, types=FUNCTION_TYPES)).groupBy("repo", "file_path").agg(
        F.count("*").alias("functions"))
    return coverage.file_coverage(sources, mapping, counts, functions), mapping, counts


@query("g20_coverage_estimate", f"""
WITH {COVERED_SQL}
SELECT repo, file_path, CAST(test_files AS BIGINT) AS test_files, CAST(test_count AS BIGINT) AS test_count,
       coverage, risk_level FROM rated""")
def coverage_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf)[0].select(
        "repo", "file_path", "test_files", "test_count", "coverage", "risk_level")


@query("g21_count_tests", f"WITH {b.COVERAGE_SQL} SELECT repo, test_path, test_count FROM tests")
def test_counts(spark: SparkSession, sf: str) -> DataFrame:
    _, tests, _ = _tests_and_sources(spark, sf)
    return coverage.count_tests(tests).withColumn("test_count", F.col("test_count").cast("bigint"))


@query("g22_coverage_summary", f"""
WITH {COVERED_SQL},
used AS (SELECT repo, CAST(sum(test_count) AS BIGINT) AS total_test_count FROM tests
         WHERE (repo, test_path) IN (SELECT (repo, test_path) FROM mapping) GROUP BY repo)
SELECT r.repo, count(*) AS total_source_files, count(*) FILTER (test_files > 0) AS tested_files,
  count(*) FILTER (test_files = 0) AS untested_files, {_half_up("avg(coverage)", 1)} AS overall_coverage,
  count(*) FILTER (test_files = 0 AND risk_level = 'HIGH') AS hotspots,
  coalesce(any_value(total_test_count), 0) AS total_test_count
FROM rated r LEFT JOIN used USING (repo) GROUP BY r.repo""")
def coverage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_summary(*_coverage(spark, sf))


PROSE_MARKERS = [("licence", ("License", "Released")), ("french", ("une ", "dans ")), ("other", ("the ",))]


@query("g23_detect_test_framework", """
SELECT source || '-' || lang AS repo, CASE
  WHEN bool_or(contains(text, 'License')) AND bool_or(contains(text, 'Released')) THEN 'licence'
  WHEN bool_or(contains(text, 'une ')) AND bool_or(contains(text, 'dans ')) THEN 'french'
  WHEN bool_or(contains(text, 'the ')) THEN 'other'
  WHEN bool_or(lang = 'es' AND contains(text, 'para')) THEN 'spanish' ELSE 'unknown' END AS framework
FROM documents GROUP BY 1""")
def frameworks(spark: SparkSession, sf: str) -> DataFrame:
    files = b.table(spark, sf, "documents").select(
        F.expr("source || '-' || lang").alias("repo"), F.expr("lang || '/' || doc_id").alias("file_path"),
        F.col("text").alias("content"),
    )
    return coverage.detect_test_framework(files, files, PROSE_MARKERS, [("spanish", "es/", "para")])


@query("g24_ml_summary", f"""
WITH {b.EVENT_SQL}
SELECT repo, count(*) FILTER (title = 'error') AS bugs, count(*) FILTER (title = 'view') AS hints,
       count(*) FILTER (title = 'click' AND severity = 'LOW') AS deceptive FROM findings GROUP BY repo""")
def ml_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.event_findings(spark, sf)
    return models.ml_summary(
        bugs=rows.filter("title = 'error'"), hints=rows.filter("title = 'view'"),
        deceptive=rows.filter("title = 'click'").withColumn("counted", F.col("severity") == "LOW"),
    )


@query("g24_critical_count", f"""
WITH {b.EVENT_SQL}
SELECT repo, count(*) AS insights, count(*) FILTER (severity = 'HIGH') AS critical_count
FROM findings GROUP BY repo""")
def critical_counts(spark: SparkSession, sf: str) -> DataFrame:
    return insights.critical_count(b.event_findings(spark, sf))


_AVG_SCORE = "CAST(sum(CAST(quality_score AS DECIMAL(18, 2))) AS DOUBLE) / count(*)"


@query("g25_repo_rollup", f"""
WITH {b.RUNS_SQL}
SELECT user_id, repo, arg_max(repo_name, (analyzed_at, run_id)) AS repo_name,
       max(analyzed_at) AS last_analyzed, count(*) AS run_count, {_half_up(_AVG_SCORE, 7)} AS avg_quality,
       max(quality_score) AS best_quality, min(quality_score) AS worst_quality
FROM runs GROUP BY user_id, repo""")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(history.repo_rollup(b.order_runs(spark, sf)), ["avg_quality"], 7)


@query("g26_leaderboard", f"""
WITH {b.RUNS_SQL}
SELECT repo, arg_max(repo_name, (analyzed_at, run_id)) AS repo_name, max(quality_score) AS best_score,
       min(security_high) AS min_security_issues, count(*) AS total_runs
FROM runs GROUP BY repo ORDER BY best_score DESC, repo LIMIT 25""")
def leaders(spark: SparkSession, sf: str) -> DataFrame:
    return history.leaderboard(b.order_runs(spark, sf), 25)


@query("g27_incremental_stats", f"""
WITH {b.SNAP_SQL}, {MARKED_SQL}
SELECT repo, count(*) AS total_files, count(*) FILTER (rescan) AS changed_files,
       count(*) FILTER (NOT rescan) AS reused_files,
       {_half_up("CAST(count(*) FILTER (rescan) AS DOUBLE) * 100.0 / count(*)", 1)} AS scan_percent
FROM marked GROUP BY repo""")
def incremental_totals(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.incremental_stats(marked_files(spark, sf))


@query("g28_avg_cyclomatic", f"""
WITH {b.FUNCTIONS_SQL}
SELECT repo, {_half_up("CAST(sum(cc) AS DOUBLE) / count(*)", 1)} AS cyclomatic_avg FROM functions GROUP BY repo
UNION ALL SELECT DISTINCT 'docs-' || lang, 1.0 FROM documents""")
def average_cyclomatic(spark: SparkSession, sf: str) -> DataFrame:
    cx = _complexity(spark, sf)
    repos = b.code_files(spark, sf).select("repo").unionByName(
        b.table(spark, sf, "documents").select(F.expr("'docs-' || lang").alias("repo")))
    return structure.average_complexity(cx, repos)


@query("g29_security_total", f"""
WITH {b.EVENT_SQL}
SELECT repo, count(*) FILTER (severity = 'HIGH') AS high_total
FROM (SELECT repo, severity FROM findings UNION ALL
      SELECT 'repo' || CAST(o_custkey % 7 AS VARCHAR),
             CASE WHEN o_orderpriority = '1-URGENT' THEN 'HIGH' ELSE 'LOW' END FROM orders)
GROUP BY repo""")
def security_totals(spark: SparkSession, sf: str) -> DataFrame:
    orders = b.table(spark, sf, "orders").select(
        F.expr("'repo' || CAST(o_custkey % 7 AS STRING)").alias("repo"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").otherwise("LOW").alias("severity"),
    )
    return quality.security_total(b.event_findings(spark, sf), orders)
