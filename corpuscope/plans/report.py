"""The whole analysis of a multi-repository corpus as one plan.

``analyze`` writes every result table once to the shared folder and returns
them by name, so no later step repeats a scan or a parse and plans stay small;
``report`` folds them into one nested row per repository.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import scoring
from corpuscope.functions.paths import domain_of_path, module_of, repo_name
from corpuscope.operators import (
    coverage, dependencies, graph, hints, incremental, insights, models, provenance, quality, scan, similarity, structure,
)
from corpuscope.operators.rule_packs import JAVASCRIPT, PERFORMANCE, SECRETS, SECURITY, SPAN
from corpuscope.session import materialize, scratch_root
from corpuscope.skew import shuffled, top_per_key
from corpuscope.sources import imports as import_source
from corpuscope.sources import manifests, syntax

# Languages that hold no code.
DATA_LANGUAGES = ("Markdown", "YAML", "JSON", "TOML")
#: result tables that are worked on side by side; most are chains of short jobs that leave cores idle
TABLES_AT_ONCE = 6


def _performance(files: DataFrame, lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pattern, span and syntax-tree findings, the first per (file, line, title)."""
    cols = ["repo", "file_path", "line_no", "severity", "title", "description", "fix", "seq"]
    rows = scan.scan_files(files, PERFORMANCE).select(*cols)
    rows = rows.unionByName(scan.scan_spans(lines, SPAN).select(*cols))
    for part in (structure.calls_in_loops, structure.blocking_in_async,
                 structure.list_in_aggregate, structure.wildcard_imports):
        rows = rows.unionByName(part(nodes).withColumn("seq", F.col("seq") + 1000).select(*cols))
    return scan.dedup_findings(rows)


def _smells(code: DataFrame, nodes: DataFrame, functions: DataFrame) -> DataFrame:
    cols = ["repo", "file_path", "line_no", "title", "severity", "description"]
    lines = scan.explode_lines(code)
    nested = scan.scan_deep_nesting(lines.filter("language = 'Python'")).select(
        "repo", "file_path", "line_no", F.lit("Deep Nesting").alias("title"),
        F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("Code nested "), F.col("levels").cast("string"),
                 F.lit(" levels deep at line "), F.col("line_no").cast("string"), F.lit("."))
        .alias("description"),
    )
    debt = scan.scan_debt_comments(lines).select(
        "repo", "file_path", "line_no", F.lit("Tech Debt Comments").alias("title"),
        F.lit("LOW").alias("severity"),
        F.concat(F.col("debt_lines").cast("string"), F.lit(" TODO/FIXME/HACK comments found."))
        .alias("description"),
    )
    wide = scan.scan_long_lines(lines.filter("language <> 'Python'")).select(
        "repo", "file_path", "line_no", F.lit("Long Lines").alias("title"),
        F.lit("LOW").alias("severity"),
        F.concat(F.col("long_lines").cast("string"), F.lit(" lines >200 chars.")).alias("description"),
    )
    rows = structure.structural_smells(nodes, functions).select(*cols)
    for part in (nested, debt, wide):
        rows = rows.unionByName(part.select(*cols))
    return rows


def clone_pairs(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exact copies of functions, and functions of similar structure, with both names."""
    tokens = structure.structure_tokens(nodes)
    docs = materialize(functions.join(shuffled(tokens), ["repo", "file_path", "fn_id"]).select(
        "repo", F.concat_ws(":", "file_path", F.lpad(F.col("lineno").cast("string"), 9, "0"), F.col("fn_id").cast("string")).alias("id"),
        "file_path", "lineno", "name", F.array_join("tokens", " ").alias("text")), "structure")
    similar = similarity.similar_pairs(docs, similarity.ngrams(F.col("text")))
    names = docs.select("repo", "id", "name")
    similar = similar.join(shuffled(names.withColumnsRenamed({"id": "id_a", "name": "func_a"})), ["repo", "id_a"]).join(
        shuffled(names.withColumnsRenamed({"id": "id_b", "name": "func_b"})), ["repo", "id_b"])
    columns = ["repo", "file_a", "func_a", "line_a", "file_b", "func_b", "line_b", "similarity", "clone_type"]
    return similarity.exact_clones(functions).select(*columns).unionByName(similar.select(*columns))


def analyze(
    files: DataFrame, advisories: DataFrame | None = None, blame: DataFrame | None = None,
    commits: DataFrame | None = None, commit_files: DataFrame | None = None, before: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All result tables of a corpus, worked on side by side. ``files``: repo, file_path, language, content.

    ``blame`` adds author statistics of the security findings, ``commits`` with ``commit_files`` change hotspots, and
    ``before``, the files of the last analysis, the share of files that had to be read again.
    """
    spark = files.sparkSession
    scratch_root(spark)  # one folder for all threads
    files = materialize(files, "files")  # some twenty tables read them; texts are made or fetched once
    code = files.filter(~F.col("language").isin(*DATA_LANGUAGES))
    nodes = materialize(syntax.ast_nodes(files, min_lines=3), "ast-nodes")
    functions = syntax.extract_functions(nodes)
    python = files.filter("language = 'Python'")
    sources, tests = coverage.source_files(files), coverage.test_files(files)
    tables: dict[str, Future[DataFrame]] = {}
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:

        def start(name: str, made: Callable[[], DataFrame]) -> Future[DataFrame]:
            return pool.submit(inheritable_thread_target(spark)(lambda: materialize(made(), name)))

        def add(**more: Callable[[], DataFrame]) -> None:
            for name, made in more.items():
                tables[name] = start(name, made)

        def test_mapping() -> tuple[DataFrame, DataFrame, DataFrame]:
            mapping, test_counts = coverage.map_tests(sources, tests), coverage.count_tests(tests)
            fn_counts = functions.groupBy("repo", "file_path").agg(F.count("*").alias("functions"))
            return mapping, test_counts, materialize(
                coverage.file_coverage(sources, mapping, test_counts, fn_counts), "file-coverage")

        try:
            add(clones=lambda: clone_pairs(functions, nodes))  # the longest chain
            mapped = pool.submit(inheritable_thread_target(spark)(test_mapping))
            counting = start("function-counts", lambda: structure.function_counts(nodes))
            grouping = start("edges", lambda: graph.build_module_graph(import_source.extract_imports(files)))
            measuring = start("halstead-files", lambda: structure.halstead(structure.code_tokens(nodes), structure.FILE))
            packing = start("packages", lambda: manifests.collect_dependencies(files))
            add(
                cohesion=lambda: graph.cohesion_scores(graph.cohesion(
                    files.select("repo", domain_of_path(F.col("file_path")).alias("module"), "content"))),
                duplication=lambda: quality.duplication_rate(code),
                smells=lambda: _smells(code, nodes, functions),
                performance=lambda: _performance(files, scan.explode_lines(files, scan.MIN_LINES), nodes),
                security=lambda: scan.dedup_findings(scan.scan_files(files, [*SECURITY, *SECRETS])),
                scripts=lambda: scan.dedup_findings(scan.scan_files(files, JAVASCRIPT), "rule_id"),
                vulnerability_windows=lambda: scan.classify_windows(files),
                languages=lambda: quality.language_breakdown(files),
                line_counts=lambda: quality.comment_blank_counts(code),
                documentation=lambda: structure.doc_coverage(nodes),
                lengths=lambda: structure.function_lengths(functions),
                framework=lambda: coverage.detect_test_framework(tests, files),
                hints=lambda: hints.type_hint_gaps(functions),
                docstrings=lambda: hints.generate_docstrings(functions),
            )
            if before is not None:
                add(incremental=lambda: incremental.incremental_stats(incremental.mark_incremental(
                    files, incremental.changed_paths(incremental.diff_snapshots(before, files)))))
            if commits is not None and commit_files is not None:
                add(hotspots=lambda: provenance.churn_hotspots(commits, commit_files))

            edges = grouping.result()
            add(violations=lambda: graph.layer_violations(edges),
                architecture=lambda: graph.architecture_summary(edges))
            counts = counting.result()
            features = structure.function_features(functions, counts)
            add(complexity=lambda: structure.function_complexity(functions, counts),
                bug_risks=lambda: models.bug_risk_model(features), ml_complexities=lambda: models.complexity_model(features))
            mapping, test_counts, covered = mapped.result()
            add(coverage_summary=lambda: coverage.coverage_summary(covered, mapping, test_counts),
                untested=lambda: coverage.untested_functions(functions, mapping, tests))
            deps = packing.result()
            if advisories is not None:
                add(vulnerable=lambda: dependencies.vulnerable_dependencies(deps, advisories))
            halstead, complexity = measuring.result(), tables["complexity"].result()
            heuristic = scan.keyword_density(code.filter("language <> 'Python'"))
            scored = complexity.select(
                "repo", module_of(F.col("file_path")).alias("module"),
                F.col("complexity").cast("double").alias("score"), F.lit(True).alias("is_function"),
            ).unionByName(heuristic.select(
                "repo", module_of(F.col("file_path")).alias("module"), F.col("density").alias("score"),
                F.lit(False).alias("is_function")))
            add(module_scores=lambda: quality.module_scores(scored), halstead=lambda: structure.halstead_mean(halstead),
                maintainability=lambda: structure.repo_maintainability(
                    structure.file_maintainability(python, halstead, complexity), files))
            if blame is not None:
                security = tables["security"].result()
                add(authors=lambda: provenance.author_stats(provenance.attach_blame(security, blame)))
            return {"edges": edges, "coverage": covered, "dependencies": deps} | {name: t.result() for name, t in tables.items()}
        except BaseException:
            pool.shutdown(wait=True, cancel_futures=True)
            raise


def _listed(table: DataFrame, order: list, fields: list[str], name: str, rows: int | None) -> DataFrame:
    """All rows of a repository, or its first ``rows``, as one ordered array."""
    if rows is not None:
        table = top_per_key(table, ["repo"], order, rows, "_place")
    else:
        table = table.withColumn("_place", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
    items = F.array_sort(F.collect_list(F.struct("_place", *fields)))
    return table.groupBy("repo").agg(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def ranked_insights(t: dict[str, DataFrame]) -> DataFrame:
    """All insights of all detectors."""
    parts = [
        insights.security_insights(t["security"]), insights.script_insights(t["scripts"]),
        insights.performance_insights(t["performance"]), insights.smell_insights(t["smells"]),
        insights.complexity_insights(t["complexity"]),
        insights.coverage_insights(coverage.coverage_hotspots(t["coverage"]), t["untested"]),
        insights.layer_insights(t["violations"]), insights.bug_risk_insights(t["bug_risks"]),
        insights.clone_insights(similarity.clone_report(t["clones"])),
        insights.deceptive_insights(t["ml_complexities"]),
        insights.vulnerability_insights(t["vulnerability_windows"]),
    ]
    if "vulnerable" in t:
        parts.append(insights.dependency_insights(t["vulnerable"]))
    return insights.compile_insights(parts)


def _more_parts(t: dict[str, DataFrame], rows: int | None) -> list[DataFrame]:
    """Tables of one row per repository: the module graph, model counts, and lists of clones, hints, authors and changes."""
    nodes = graph.graph_nodes(t["edges"]).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("id", "label", "weight"))).alias("nodes"))
    arcs = graph.graph_edges(t["edges"]).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("source", "target", "weight"))).alias("edges"))
    counts = models.ml_summary(
        clones=t["clones"], bug_risks=t["bug_risks"], missing_hints=t["hints"], docstrings=t["docstrings"],
        complexities=t["ml_complexities"].withColumn("counted", F.col("deceptive")), windows=t["vulnerability_windows"])
    kinds = [c for c in counts.columns if c != "repo"]
    clones = ["file_a", "func_a", "line_a", "file_b", "func_b", "line_b", "similarity", "clone_type"]
    spots = ["file_path", "lineno", "name"]
    parts = [
        nodes.join(arcs, "repo").select("repo", F.struct("nodes", "edges").alias("module_graph")),
        counts.select("repo", F.struct(*kinds).alias("ml_summary")),
        _listed(t["clones"], [F.desc("similarity"), *map(F.asc, clones)], clones, "clone_pairs", rows),
        _listed(t["hints"], [*map(F.asc, spots)], [*spots, "missing_params", "inferred_return", "confidence"],
                "missing_type_hints", rows),
    ]
    if "authors" in t:
        fields = ["author_key", "name", "total_issues", "high_issues", "files_touched", "weight"]
        parts.append(_listed(t["authors"], [F.desc("weight"), F.asc("author_key")], fields, "author_stats", rows))
    if "hotspots" in t:
        fields = ["file_path", "commit_count", "unique_authors"]
        parts.append(_listed(t["hotspots"], [F.desc("commit_count"), F.asc("file_path")], fields, "git_hotspots", rows))
    if "incremental" in t:
        fields = [c for c in t["incremental"].columns if c != "repo"]
        parts.append(t["incremental"].select("repo", F.struct(*fields).alias("incremental_stats")))
    return parts


def report(
    files: DataFrame, tables: dict[str, DataFrame], caps: dict[str, int] | None = None,
    heat_rows: int | None = None, list_rows: int | None = None, analyzed_at: Column | None = None,
) -> DataFrame:
    """One row per repository; joins are between tables of one row per repository.

    Counts, summary and roadmap rest on all insights. The lists inside the row, insights and heat map, are whole
    unless ``caps``, such as ``insights.DETECTOR_CAPS``, and ``heat_rows`` bound them. A repository with very many insights
    makes a very long row; then give caps, or read the tables ``ranked_insights`` and ``module_scores``. ``list_rows`` does the
    same for clones, missing hints, authors and change hotspots. A row as JSON is what ``run_from_report`` reads.
    """
    t = tables
    every = materialize(ranked_insights(t), "insights")
    shown = every if caps is None else insights.cap_per_group(every, ["repo"], "detector", caps, insights.leading())
    critical = every.groupBy("repo").agg(
        F.count_if(F.col("severity") == "HIGH").alias("critical_issues_count"))
    listed = shown.groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct(
            "severity_rank", "detector", "title", "file_path", "line_no", "severity", "category",
            "description", "suggested_fix"))).alias("actionable_insights"),
    ).join(critical, "repo")
    high = quality.security_total(
        t["security"], t["scripts"], *([t["vulnerable"]] if "vulnerable" in t else []))
    scores = quality.quality_scores(
        files, t["maintainability"], t["complexity"], t["smells"], t["line_counts"])
    risky = t["bug_risks"].filter("risk_level = 'HIGH'").groupBy("repo").agg(
        F.count("*").alias("high_bug_risks"))
    vulnerable = (
        t["vulnerable"].groupBy("repo").agg(F.count("*").alias("vulnerable_dependencies"))
        if "vulnerable" in t else
        files.select("repo").distinct().withColumn("vulnerable_dependencies", F.lit(0)))
    heat = quality.heat_map(t["module_scores"], heat_rows).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("rank", "module", "score", "issues"))).alias(
            "complexity_heatmap"))
    langs = t["languages"].groupBy("repo").agg(
        F.map_from_entries(F.collect_list(F.struct("language", "share"))).alias("language_breakdown"))
    out = files.groupBy("repo").agg(F.count("*").alias("total_files_analyzed"))
    for part in (
        scores, t["line_counts"].drop("comment_lines"), t["duplication"].drop("blocks", "distinct_blocks"),
        t["documentation"].select("repo", "doc_coverage"), t["lengths"],
        structure.average_complexity(t["complexity"], files),
        t["halstead"].select("repo", F.struct(*structure.HALSTEAD).alias("halstead_metrics")),
        t["architecture"].select(
            "repo", F.struct("summary", "modules", "cycles", "violations", "coupling_score",
                             "domain_score", "largest_component").alias("architecture")),
        t["cohesion"], t["coverage_summary"], t["framework"], high, risky, vulnerable, heat, langs,
        listed, *_more_parts(t, list_rows),
    ):
        out = out.join(part, "repo", "left")
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    arch = F.coalesce(c("architecture.domain_score"), F.lit(100.0))
    covered = F.coalesce(c("overall_coverage"), F.lit(0.0))
    cards = scoring.metric_cards(
        c("quality_score"), zero("high_total"), scoring.grade(c("maintainability_index")),
        c("tech_debt_hours"))
    card = lambda kind, names: F.struct(*[c(f"cards.{kind}_{n}").alias(n) for n in names])
    out = out.withColumn("cards", F.struct(*cards))
    return out.select(
        "*", repo_name(c("repo")).alias("repo_name"), c("repo").alias("repo_url"),
        (F.current_timestamp() if analyzed_at is None else analyzed_at).alias("analyzed_at"),
        c("total_lines").alias("total_lines_of_code"),
        card("security", ("value", "delta", "status")).alias("security_risks"),
        card("maintainability", ("value", "status")).alias("maintainability"),
        card("debt", ("value", "delta", "status")).alias("estimated_tech_debt_hours"),
        F.struct(c("duplication_rate"), c("doc_coverage").alias("documentation_coverage"),
                 c("cyclomatic_avg").alias("cyclomatic_complexity")).alias("code_health_trend"),
        scoring.executive_summary(
            c("quality_score"), zero("critical_issues_count"), zero("vulnerable_dependencies"),
            arch, covered, zero("high_bug_risks")).alias("executive_summary"),
        scoring.roadmap(
            zero("critical_issues_count"), zero("vulnerable_dependencies"), covered, arch,
            zero("smells"), zero("high_bug_risks")).alias("recommended_roadmap"),
        scoring.quality_gate(zero("high_total"), c("quality_score")).alias("quality_gate"),
    )
