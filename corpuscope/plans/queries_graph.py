"""Queries over graphs, windows, unions and mutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators import graph, history, incremental, insights, provenance, scan
from corpuscope.operators.rule_packs import PROSE
from corpuscope.plans import bindings as b
from corpuscope.plans.queries_aggregates import (
    CYCLES_SQL, DEGREES_SQL, VIOLATIONS_SQL, _half_up,
)
from corpuscope.plans.queries_rules import PROSE_CATEGORIES, _category_sql, rule_hits_sql, words_sql
from corpuscope.plans.queries_scalars import domain_sql
from corpuscope.plans.registry import query
from corpuscope.sources.imports import extract_imports

EVENT_CAPS = {"error": 5, "purchase": 3, "view": 7}


@query("w3_cap_per_group", f"""
WITH {b.EVENT_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, title ORDER BY seq) AS rn FROM findings)
SELECT repo, title, seq FROM ranked WHERE rn <= CASE title WHEN 'error' THEN 5 WHEN 'purchase' THEN 3
  WHEN 'view' THEN 7 ELSE 1000000000 END""")
def capped(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.event_findings(spark, sf).select("repo", "title", "seq")
    return insights.cap_per_group(rows, ["repo"], "title", EVENT_CAPS, [F.asc("seq")])


@query("w4_history", f"""
WITH {b.RUNS_SQL},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY analyzed_at DESC, run_id DESC)
           AS INT) AS rank FROM runs)
SELECT repo, run_id, analyzed_at, quality_score, rank FROM ranked WHERE rank <= 30""")
def newest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return history.history(b.order_runs(spark, sf), 30).select(
        "repo", "run_id", "analyzed_at", "quality_score", "rank"
    )


@query("w5_trend", f"""
WITH {b.RUNS_SQL},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY analyzed_at, run_id)
           AS INT) AS rank FROM runs)
SELECT repo, analyzed_at, quality_score, security_high, rank FROM ranked WHERE rank <= 5""")
def oldest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return history.trend(b.order_runs(spark, sf), 5).select(
        "repo", "analyzed_at", "quality_score", "security_high", "rank"
    )


@query("w5_trend_latest", f"""
WITH {b.RUNS_SQL},
newest AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY analyzed_at DESC, run_id DESC) AS r
           FROM runs),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY analyzed_at, run_id)
           AS INT) AS rank FROM newest WHERE r <= 5)
SELECT repo, analyzed_at, quality_score, security_high, rank FROM ranked""")
def latest_trend(spark: SparkSession, sf: str) -> DataFrame:
    return history.trend(b.order_runs(spark, sf), 5, latest=True).select(
        "repo", "analyzed_at", "quality_score", "security_high", "rank"
    )


@query("w6_run_delta", f"""
WITH {b.RUNS_SQL},
d AS (SELECT *, lag(quality_score) OVER (PARTITION BY repo ORDER BY analyzed_at, run_id) AS previous_score
      FROM runs)
SELECT repo, run_id, previous_score, quality_score - previous_score AS delta,
  CASE WHEN quality_score >= 80 THEN '+4.2%' WHEN quality_score >= 60 THEN '+1.8%' ELSE '-2.1%' END AS label
FROM d""")
def deltas(spark: SparkSession, sf: str) -> DataFrame:
    return history.run_delta(b.order_runs(spark, sf)).select(
        "repo", "run_id", "previous_score", "delta", "label"
    )


@query("w7_recent_commits", f"""
WITH {b.COMMITS_SQL},
newest AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha) AS INT) AS rank
           FROM commits),
sizes AS (SELECT repo, sha, count(DISTINCT file_path) AS files_changed FROM commit_files GROUP BY ALL)
SELECT n.repo, substr(n.sha, 1, 8) AS sha, substr(trim(message), 1, 80) AS message, author_email, ts,
       coalesce(files_changed, 0) AS files_changed, rank
FROM newest n LEFT JOIN sizes s ON s.repo = n.repo AND s.sha = n.sha WHERE rank <= 6""")
def newest_commits(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.recent_commits(
        b.order_commits(spark, sf), b.changed_files(spark, sf), 6, provenance.REFERENCE_SHA, provenance.REFERENCE_MESSAGE
    ).select(
        "repo", "sha", "message", "author_email", "ts", "files_changed", "rank"
    )


# --- union of detectors --------------------------------------------------------

_RANK = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"


@query("u1_compile_insights", f"""
WITH {b.DOC_FILES_SQL}, {b.LINES_SQL}, {rule_hits_sql(PROSE)},
edges AS (SELECT DISTINCT repo, src, dst FROM (
  SELECT source AS repo, CASE lang WHEN 'en' THEN 'Model' WHEN 'fr' THEN 'Service' WHEN 'de' THEN 'UI'
         ELSE 'Utils' END AS src, 'API' AS dst FROM documents) WHERE src <> dst),
{VIOLATIONS_SQL},
starts AS (SELECT repo, file_path, ls, unnest(range(0, len(ls), 5)) AS pos FROM file_arrays
           WHERE len(ls) >= 5),
windows AS (SELECT repo, file_path, CAST(pos + 1 AS INTEGER) AS line_no, '' AS snippet,
   list_distinct({words_sql("lower(array_to_string(ls[pos + 1:pos + 10], chr(10)))")}) AS words FROM starts),
found AS ({_category_sql()}),
classified AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY repo, file_path, line_no // 10, category ORDER BY line_no) AS rn
  FROM found WHERE confidence >= 0.15) WHERE rn = 1 AND confidence >= 0.35 AND severity = 'HIGH'),
parts AS (
  SELECT repo, 'security' AS detector, severity, 'SECURITY' AS category, title, title AS description,
         file_path, line_no, 'Review the line.' AS suggested_fix, 0.0 AS score FROM hits
  UNION ALL
  SELECT repo, 'layer', 'MEDIUM', 'MAINTAINABILITY', 'Architecture Layer Violation',
         'Dependency ' || violation || ' breaks the layered architecture.', 'architecture', 0,
         'Introduce dependency inversion to fix layering.', 0.0 FROM violations
  UNION ALL
  SELECT repo, 'vulnerability', 'HIGH', 'SECURITY', 'ML Classifier: ' || category
         || ' Pattern (confidence ' || CAST(CAST(floor(confidence * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '%)',
         'Vulnerability classifier detects ' || category || ' code pattern.', file_path, line_no,
         'Review this section for the indicated vulnerability category.', confidence FROM classified),
ranked AS (SELECT *, {_RANK} AS severity_rank FROM parts)
SELECT repo, detector, severity, category, title, description, file_path, line_no, suggested_fix,
       CAST(score AS DOUBLE) AS score, severity_rank FROM ranked""")
def all_insights(spark: SparkSession, sf: str) -> DataFrame:
    files = b.doc_files(spark, sf)
    edges = b.table(spark, sf, "documents").select(
        F.col("source").alias("repo"),
        F.expr("CASE lang WHEN 'en' THEN 'Model' WHEN 'fr' THEN 'Service' WHEN 'de' THEN 'UI' "
               "ELSE 'Utils' END").alias("src"), F.lit("API").alias("dst"),
    ).filter("src <> dst").distinct()
    return insights.compile_insights([
        insights.security_insights(scan.scan_files(files, PROSE)),
        insights.layer_insights(graph.layer_violations(edges)),
        insights.vulnerability_insights(scan.classify_windows(files, PROSE_CATEGORIES)),
    ])


@query("u1_dedup_insights", f"""
WITH {b.EVENT_SQL}, ranked AS (SELECT *, row_number() OVER (
  PARTITION BY repo, title, severity, author, file_path ORDER BY seq) AS rn FROM findings)
SELECT repo, title, severity, author AS category, file_path, seq FROM ranked WHERE rn = 1""")
def unique_insights(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.event_findings(spark, sf).select(
        "repo", "title", "severity", F.col("author").alias("category"), "file_path", "seq"
    )
    return insights.dedup_insights(rows, ["seq"])


@query("u2_module_universe", f"""
WITH {b.EVENT_EDGES_SQL}
SELECT repo, src AS module FROM edges UNION SELECT repo, dst FROM edges""")
def universe(spark: SparkSession, sf: str) -> DataFrame:
    return graph.module_universe(b.event_edges(spark, sf))


# --- module graphs ---------------------------------------------------------------

_HREF_IMPORTS = """
imports AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, url AS file_path,
                   unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS target FROM pages)"""


@query("n1_build_module_graph", f"""
WITH {_HREF_IMPORTS}, numbered AS (SELECT *, row_number() OVER () AS id FROM imports),
{domain_sql("string_split(lower(file_path), '/')", "id", "numbered")},
from_domains AS (SELECT id, domain FROM domains),
{domain_sql("regexp_split_to_array(lower(target), '[./\\\\]')", "id", "numbered").replace("keywords", "keywords2").replace("segs AS", "segs2 AS").replace("FROM segs", "FROM segs2").replace("hits AS", "hits2 AS").replace("FROM hits", "FROM hits2").replace("domains AS", "to_domains AS")}
SELECT DISTINCT repo, f.domain AS src, t.domain AS dst
FROM numbered JOIN from_domains f USING (id) JOIN to_domains t USING (id)
WHERE f.domain IS NOT NULL AND t.domain IS NOT NULL AND f.domain <> t.domain""")
def module_graph(spark: SparkSession, sf: str) -> DataFrame:
    imports = b.table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo"), F.col("url").alias("file_path"),
        F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("target"),
    )
    return graph.build_module_graph(imports)


_CODE_GRAPH = {"auth.tokens": "Auth", "db.session": "Database", "api.routes": "API",
               "utils.text": "Utils", "services.billing": "Service"}


@query("n1_code_module_graph", f"""
WITH src AS (SELECT p_brand AS repo, CASE WHEN p_name LIKE '%widget' THEN 'UI'
                    ELSE upper(p_type[1]) || lower(p_type[2:]) END AS src,
                    CASE {b.IMPORT_TARGET} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODE_GRAPH.items())} END AS dst,
                    {b.WILDCARD} AS wildcard FROM part)
SELECT DISTINCT repo, src, dst FROM (SELECT repo, src, dst FROM src
  UNION ALL SELECT repo, src, 'Utils' FROM src WHERE wildcard) WHERE src <> dst""")
def code_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_module_graph(extract_imports(b.code_files(spark, sf)))


@query("n2_find_cycles", f"""
WITH RECURSIVE {b.EVENT_EDGES_SQL}, {CYCLES_SQL} SELECT repo, length, cycle FROM cycles""")
def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.find_cycles(b.event_edges(spark, sf))


@query("n2_find_trade_cycles", f"""
WITH RECURSIVE {b.TRADE_EDGES_SQL}, {CYCLES_SQL} SELECT repo, length, cycle FROM cycles""")
def trade_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.find_cycles(b.trade_edges(spark, sf))


@query("n3_layer_violations", f"""
WITH {b.TRADE_EDGES_SQL}, {VIOLATIONS_SQL} SELECT * FROM violations""")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.layer_violations(b.trade_edges(spark, sf))


@query("n4_graph_nodes", f"""
WITH {b.EVENT_EDGES_SQL}, {DEGREES_SQL}
SELECT repo, module AS id, module AS label, CAST(efferent AS BIGINT) AS weight FROM degrees""")
def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_nodes(b.event_edges(spark, sf))


@query("n4_graph_edges", f"""
WITH {b.TRADE_EDGES_SQL} SELECT repo, src AS source, dst AS target, 1 AS weight FROM edges""")
def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_edges(b.trade_edges(spark, sf))


@query("n5_architecture_summary", f"""
WITH RECURSIVE {b.TRADE_EDGES_SQL}, {VIOLATIONS_SQL}, {CYCLES_SQL}, {DEGREES_SQL},
c AS (SELECT repo, count(*) AS cycles FROM cycles GROUP BY repo),
v AS (SELECT repo, count(*) AS violations FROM violations GROUP BY repo),
m AS (SELECT repo, count(*) AS modules,
        {_half_up("avg(CAST(efferent AS DOUBLE) / (efferent + afferent)) * 100.0", 1)} AS coupling_score
      FROM degrees GROUP BY repo),
l AS (SELECT repo, module AS largest_component FROM (SELECT *, row_number() OVER (
        PARTITION BY repo ORDER BY afferent DESC, module) AS rn FROM degrees) WHERE rn = 1),
j AS (SELECT m.*, coalesce(cycles, 0) AS cycles, coalesce(violations, 0) AS violations, largest_component
      FROM m LEFT JOIN c USING (repo) LEFT JOIN v USING (repo) LEFT JOIN l USING (repo))
SELECT repo, modules, cycles, violations, coupling_score,
  CAST(greatest(0.0, 100.0 - cycles * 6.0 - violations * 4.0) AS DOUBLE) AS domain_score, largest_component,
  CASE WHEN cycles = 0 AND violations = 0 THEN 'Clean layered architecture detected. ' ELSE '' END
  || CASE WHEN cycles > 0 THEN cycles || ' circular ' || CASE WHEN cycles = 1 THEN 'dependency'
     ELSE 'dependencies' END || ' found. ' ELSE '' END
  || CASE WHEN violations > 0 THEN violations || ' layer violations detected. ' ELSE '' END
  || modules || ' modules analyzed.' AS summary FROM j""")
def architecture(spark: SparkSession, sf: str) -> DataFrame:
    return graph.architecture_summary(b.trade_edges(spark, sf))


# --- mutable tables ------------------------------------------------------------------


@query("s1_upsert_latest", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
                FROM events)
SELECT user_id, event_id, event_type, (SELECT min(ts) FROM events e WHERE e.user_id = r.user_id) AS created_at,
       ts AS last_seen FROM ranked r WHERE rn = 1""")
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Users from the sign-up events, overwritten by all their other events."""
    rows = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return history.upsert_latest(
        rows.filter("event_type = 'signup'"), rows.filter("event_type <> 'signup'"),
        ["user_id"], "ts", ["event_id"],
    )


@query("s2_report_cache_reuse", """
SELECT source AS repo, CASE WHEN lang = 'es' THEN NULL ELSE lang || doc_id END AS commit_sha
FROM documents WHERE lang = 'es' OR NOT (n_chars > 500 OR lang = 'fr')""")
def not_analyzed(spark: SparkSession, sf: str) -> DataFrame:
    """Long and French documents have a run already, under a differently written address."""
    docs = b.table(spark, sf, "documents")
    snapshots = docs.selectExpr(
        "source AS repo", "CASE WHEN lang = 'es' THEN NULL ELSE lang || doc_id END AS commit_sha")
    runs = docs.filter("n_chars > 500 OR lang = 'fr'").selectExpr(
        "upper(source) || '/' AS repo", "lang || doc_id AS commit_sha")
    return incremental.not_yet_analyzed(snapshots, runs).select("repo", "commit_sha")
