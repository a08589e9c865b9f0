"""The run history table: write, read, look up, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def with_bucket(runs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return runs.withColumn("repo_bucket", F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int"))


def write_runs(runs: DataFrame, path: str) -> None:
    """Append runs as Parquet, partitioned by repository bucket.

    Bucket and day decide the task, so that a repository with very many runs
    is written by many tasks and each partition still gets few files.
    """
    (
        with_bucket(runs)
        .repartition("repo_bucket", F.to_date("analyzed_at"))
        .write.mode("append").partitionBy("repo_bucket").parquet(path)
    )


def read_runs(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """All runs, or those of one repository with its bucket pruned."""
    runs = spark.read.parquet(path)
    if repo is not None:
        bucket = F.pmod(F.xxhash64(F.lit(repo)), F.lit(BUCKETS)).cast("int")
        runs = runs.filter((F.col("repo_bucket") == bucket) & (F.col("repo") == repo))
    return runs.drop("repo_bucket")


def _card(report: Column, name: str) -> Column:
    """Value of a headline card, which may be an object or a bare value."""
    inner = F.get_json_object(report, f"$.{name}.value")
    return F.coalesce(inner, F.get_json_object(report, f"$.{name}"))


def run_from_report(reports: DataFrame, report: str = "report") -> DataFrame:
    """Run columns read off a report document, next to the document itself."""
    doc = F.col(report)

    def field(path: str) -> Column:
        return F.get_json_object(doc, f"$.{path}")

    def number(c: Column) -> Column:
        return F.coalesce(c.try_cast("double"), F.lit(0.0))

    def whole(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.lit(0))

    return reports.select(
        F.coalesce(field("repo_url"), F.lit("")).alias("repo"),
        F.coalesce(field("repo_name"), F.lit("")).alias("repo_name"),
        F.coalesce(field("commit_sha"), F.lit("")).alias("commit_sha"),
        F.to_timestamp(field("analyzed_at")).alias("analyzed_at"),
        number(_card(doc, "quality_score")).alias("quality_score"),
        whole(_card(doc, "security_risks")).alias("security_high"),
        F.coalesce(_card(doc, "maintainability"), F.lit("C")).alias("maintainability"),
        number(F.replace(_card(doc, "estimated_tech_debt_hours"), F.lit("h"), F.lit(""))).alias(
            "tech_debt_hours"
        ),
        whole(field("total_files_analyzed")).alias("total_files"),
        whole(field("total_lines_of_code")).alias("total_loc"),
        number(field("code_health_trend.duplication_rate")).alias("duplication_rate"),
        number(field("code_health_trend.documentation_coverage")).alias("doc_coverage"),
        number(field("code_health_trend.cyclomatic_complexity")).alias("cyclomatic_avg"),
        whole(field("critical_issues_count")).alias("critical_count"),
        whole(field("vulnerable_dependencies")).alias("vuln_deps"),
        F.coalesce(field("cached").try_cast("boolean"), F.lit(False)).alias("cached"),
        doc.alias("full_report"),
    )


def parse_report(df: DataFrame, column: str, schema: str, out: str = "report") -> DataFrame:
    """Typed report next to its text; a document that does not parse gives null fields."""
    return df.withColumn(out, F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))


def load_run(runs: DataFrame, run_id: int, schema: str) -> DataFrame:
    """One run by id with its report parsed."""
    return parse_report(runs.filter(F.col("run_id") == run_id), "full_report", schema)


def export_json(df: DataFrame, fields: list[str], out: str = "document") -> DataFrame:
    """One JSON document per row."""
    return df.withColumn(out, F.to_json(F.struct(*fields)))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
