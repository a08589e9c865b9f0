"""Merging the results of all detectors into one ranked list of insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.hints import fix_template
from corpuscope.functions.scoring import severity_rank
from corpuscope.functions.text import first_items, number_text
from corpuscope.operators.scan import dedup_first
from corpuscope.skew import SALTS

# How many findings of a detector reach the report, in report order.
DETECTOR_CAPS = {
    "security": 20, "js_security": 10, "dependency": 10, "performance": 12, "js_performance": 6,
    "smell": 8, "complexity": 5, "coverage": 6, "layer": 3, "bug_risk": 6, "clone": 4,
    "deceptive": 4, "vulnerability": 5,
}

INSIGHT_COLS = [
    "repo", "detector", "severity", "category", "title", "description", "file_path", "line_no",
    "suggested_fix", "score",
]


def _insight(
    rows: DataFrame, detector: str, severity: Column, category: str, title: Column,
    description: Column, path: Column, line: Column, fix: Column, score: Column | None = None,
) -> DataFrame:
    return rows.select(
        "repo", F.lit(detector).alias("detector"), severity.alias("severity"),
        F.lit(category).alias("category"), title.alias("title"), description.alias("description"),
        path.alias("file_path"), line.cast("int").alias("line_no"), fix.alias("suggested_fix"),
        (F.lit(0.0) if score is None else score.cast("double")).alias("score"),
    )


def _fix_or_template(fix: Column, title: Column) -> Column:
    return F.when(fix != "", fix).otherwise(fix_template(title)["fixed_code"])


def _tag(c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(" ["), c, F.lit("]"))).otherwise("")


def security_insights(findings: DataFrame) -> DataFrame:
    c = F.col
    return _insight(
        findings, "security", c("severity"), "SECURITY", c("title"),
        F.concat(c("description"), _tag(c("cwe")), _tag(c("owasp"))), c("file_path"), c("line_no"),
        _fix_or_template(c("fix"), c("title")),
    )


def script_insights(findings: DataFrame) -> DataFrame:
    """Security and performance findings of the script pack."""
    c = F.col
    title = F.concat(F.lit("[JS/TS] "), c("title"))

    def part(category: str, detector: str, fix: Column) -> DataFrame:
        return _insight(
            findings.filter(c("category") == category), detector, c("severity"), category, title,
            c("description"), c("file_path"), c("line_no"), fix,
        )

    return part("SECURITY", "js_security", _fix_or_template(c("fix"), c("title"))).unionByName(
        part("PERFORMANCE", "js_performance", c("fix"))
    )


def dependency_insights(vulnerable: DataFrame) -> DataFrame:
    c = F.col
    return _insight(
        vulnerable, "dependency", c("severity"), "SECURITY",
        F.concat(F.lit("Vulnerable Dependency: "), c("package")),
        F.concat(c("package"), F.lit(" "), c("installed_version"), F.lit(" — "), c("summary"),
                 F.lit(". CVE: "), c("cve"), F.lit(". Fixed in: "), c("fixed_version")),
        c("source_file"), F.lit(0),
        F.concat(F.lit("Upgrade "), c("package"), F.lit(" to "), c("fixed_version")),
    )


def performance_insights(findings: DataFrame) -> DataFrame:
    c = F.col
    return _insight(
        findings, "performance", c("severity"), "PERFORMANCE", c("title"), c("description"),
        c("file_path"), c("line_no"), _fix_or_template(c("fix"), c("title")),
    )


def smell_insights(smells: DataFrame) -> DataFrame:
    c = F.col
    return _insight(
        smells, "smell", c("severity"), "QUALITY", c("title"), c("description"), c("file_path"),
        c("line_no"), F.lit("See description for refactoring guidance."),
    )


def complexity_insights(complexity: DataFrame) -> DataFrame:
    c = F.col
    return _insight(
        complexity.filter("is_too_complex"), "complexity", F.lit("LOW"), "QUALITY",
        F.concat(F.lit("Complex Function (CC:"), c("complexity").cast("string"),
                 F.lit("/Cognitive:"), c("cognitive").cast("string"), F.lit(")")),
        F.concat(F.lit('"'), c("name"), F.lit('" exceeds complexity limit. '),
                 c("loc").cast("string"), F.lit(" lines.")),
        c("file_path"), c("lineno"), F.lit("Apply Extract Method refactoring."), c("complexity"),
    )


def coverage_insights(hotspots: DataFrame, untested: DataFrame, names_shown: int | None = None) -> DataFrame:
    """High-risk files without tests, naming all or ``names_shown`` of their functions."""
    c = F.col
    names = untested.groupBy("repo", "file_path").agg(
        first_items(F.array_sort(F.collect_set("name")), names_shown).alias("fns")
    )
    rows = hotspots.join(names, ["repo", "file_path"], "left")
    listed = F.coalesce(F.array_join("fns", ", "), F.lit(""))
    return _insight(
        rows, "coverage", F.lit("MEDIUM"), "QUALITY",
        F.concat(F.lit("Zero Test Coverage: "), c("module")),
        F.concat(c("file_path"), F.lit(" has no test files mapped to it. "),
                 F.lit("Untested public functions: "), listed),
        c("file_path"), F.lit(0),
        F.concat(F.lit("Create tests/"), F.replace(c("module"), F.lit("/"), F.lit("_")),
                 F.lit("_test.py with tests for each public function.")),
    )


def layer_insights(violations: DataFrame) -> DataFrame:
    return _insight(
        violations, "layer", F.lit("MEDIUM"), "MAINTAINABILITY",
        F.lit("Architecture Layer Violation"),
        F.concat(F.lit("Dependency "), F.col("violation"),
                 F.lit(" breaks the layered architecture.")),
        F.lit("architecture"), F.lit(0),
        F.lit("Introduce dependency inversion to fix layering."),
    )


def bug_risk_insights(risks: DataFrame, factors_shown: int | None = None) -> DataFrame:
    c = F.col
    return _insight(
        risks.filter(c("risk_level") == "HIGH"), "bug_risk", F.lit("HIGH"), "QUALITY",
        F.concat(F.lit("ML Bug Risk: "), c("name"), F.lit("() — "),
                 number_text(c("risk_score")), F.lit("/100")),
        F.concat(F.lit("ML model flags high bug likelihood. Factors: "),
                 F.array_join(first_items(F.col("factors"), factors_shown), ", ")),
        c("file_path"), c("lineno"),
        F.lit("Add error handling, reduce complexity, add types and docs."), c("risk_score"),
    )


def clone_insights(reported: DataFrame) -> DataFrame:
    """Rows of ``clone_report``."""
    c = F.col
    return _insight(
        reported, "clone", F.lit("MEDIUM"), "QUALITY", c("title"), c("description"), c("file_a"),
        c("line_a"), F.lit("Extract shared logic into a common utility function."),
        c("similarity"),
    )


def deceptive_insights(complexities: DataFrame) -> DataFrame:
    c = F.col
    return _insight(
        complexities.filter("deceptive"), "deceptive", F.lit("MEDIUM"), "QUALITY",
        F.concat(F.lit("Deceptively Complex: "), c("name"), F.lit("() (ML:"),
                 number_text(c("ml_complexity")), F.lit(" vs CC:"),
                 c("complexity").cast("string"), F.lit(")")),
        F.concat(F.lit("ML score is "), number_text(c("delta")),
                 F.lit(" pts higher than cyclomatic suggests. Dense code.")),
        c("file_path"), c("lineno"),
        F.lit("Refactor: clearer names, extract steps, add comments."), c("ml_complexity"),
    )


def vulnerability_insights(windows: DataFrame) -> DataFrame:
    c = F.col
    return _insight(
        windows.filter((c("confidence") >= 0.35) & (c("severity") == "HIGH")),
        "vulnerability", F.lit("HIGH"), "SECURITY",
        F.concat(F.lit("ML Classifier: "), c("category"), F.lit(" Pattern (confidence "),
                 number_text(c("confidence") * 100.0), F.lit("%)")),
        F.concat(F.lit("Vulnerability classifier detects "), c("category"),
                 F.lit(" code pattern.")),
        c("file_path"), c("line_no"),
        F.lit("Review this section for the indicated vulnerability category."), c("confidence"),
    )


def leading() -> list[Column]:
    """Order in which insights of a detector are shown."""
    return [F.asc("severity_rank"), F.desc("score"), F.asc("file_path"), F.asc("line_no"),
            F.asc("title"), F.asc("description")]


def cap_per_group(
    rows: DataFrame, keys: list[str], group: str, caps: dict[str, int], order: list[Column]
) -> DataFrame:
    """The first rows of each group, as many as its cap; other groups are kept whole.

    A first round caps inside (key, group, salt), so a hot group is cut down
    before any single task sees it.
    """
    cap = F
    for name, value in caps.items():
        cap = cap.when(F.col(group) == name, F.lit(value))
    capped = rows.filter(F.col(group).isin(*caps))
    salted = capped.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    first = Window.partitionBy(*keys, group, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys, group).orderBy(*order)
    most = max(caps.values())
    kept = (
        salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= most)
        .withColumn("_rn", F.row_number().over(final))
        .filter((F.col("_rn") <= most) & (F.col("_rn") <= cap))
        .drop("_rn", "_salt")
    )
    other = rows.filter(~F.col(group).isin(*caps) | F.col(group).isNull())
    return kept.unionByName(other)


def compile_insights(parts: list[DataFrame], caps: dict[str, int] | None = None) -> DataFrame:
    """One table of all insights; with caps, the leading ones of each detector and repository."""
    rows = None
    for part in parts:
        part = part.select(*INSIGHT_COLS)
        rows = part if rows is None else rows.unionByName(part)
    ranked = rows.withColumn("severity_rank", severity_rank(F.col("severity")))
    if caps is not None:
        ranked = cap_per_group(ranked, ["repo"], "detector", caps, leading())
    return ranked


def dedup_insights(insights: DataFrame, order: list[str]) -> DataFrame:
    """First insight per (title, category, file, severity) of a repository."""
    return dedup_first(insights, ["repo", "title", "category", "file_path", "severity"], order)


def critical_count(insights: DataFrame) -> DataFrame:
    return insights.groupBy("repo").agg(
        F.count("*").alias("insights"),
        F.count_if(F.col("severity") == "HIGH").alias("critical_count"),
    )
