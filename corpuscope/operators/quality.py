"""Corpus-level counts and scores per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.scoring import (
    SMELL_HOURS, SMELL_PENALTY, quality_score, severity_weight, tech_debt_hours,
)
from corpuscope.functions.text import round_half_up, split_lines, strip
from corpuscope.skew import spread, top_per_key


def language_breakdown(files: DataFrame) -> DataFrame:
    """Lines and share of lines per language of every repository."""
    lines = F.size(split_lines(F.col("content")))
    sums = files.groupBy("repo", "language").agg(F.sum(lines).alias("lines")).filter("lines > 0")
    # one row per (repo, language) from here on
    total = F.greatest(F.sum("lines").over(Window.partitionBy("repo")), F.lit(1))
    return sums.select(
        "repo", "language", "lines",
        round_half_up(F.col("lines") * F.lit(100.0) / total, 1).alias("share"),
    )


# Openings of a comment line.
COMMENT_STARTS = ("#", "//", "/*", "*", "<!--", "--")


def comment_blank_counts(files: DataFrame) -> DataFrame:
    """Total, comment and blank lines per repository, counted inside each row."""
    trimmed = F.transform(split_lines(F.col("content")), strip)
    comment = r"^(#|//|/\*|\*|<!--|--)"
    per_file = files.select(
        "repo", F.size(trimmed).alias("n"),
        F.size(F.filter(trimmed, lambda s: s == "")).alias("blank"),
        F.size(F.filter(trimmed, lambda s: s.rlike(comment))).alias("comment"),
    )
    return per_file.groupBy("repo").agg(
        F.sum("n").alias("total_lines"), F.sum("comment").alias("comment_lines"),
        F.sum("blank").alias("blank_lines"),
    )


def duplication_rate(
    files: DataFrame, window: int = 4, min_chars: int = 10, limit_files: int | None = None
) -> DataFrame:
    """Percent of repeated blocks of ``window`` consecutive cleaned lines, per repository.

    Blocks are cut and hashed inside the row, counted per distinct block with a
    map-side combine, and only then summed per repository, so a repository of
    any size is spread over its distinct blocks.
    """
    if limit_files is not None:
        files = top_per_key(files, ["repo"], [F.asc("file_path")], limit_files, "_rn").drop("_rn")
    clean = F.filter(
        F.transform(split_lines(F.col("content")), strip), lambda s: F.length(s) > min_chars
    )
    blocks = (
        spread(files, ["file_path"]).select("repo", clean.alias("c"))
        .filter(F.size("c") >= window)
        .select("repo", F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("c") - (window - 1)),
                lambda i: F.unhex(F.md5(F.array_join(F.slice("c", i, F.lit(window)), "\n"))),
            )
        ).alias("block"))
    )
    counted = blocks.groupBy("repo", "block").agg(F.count("*").alias("n"))
    rates = counted.groupBy("repo").agg(
        F.sum("n").alias("blocks"), F.count("*").alias("distinct_blocks")
    )
    return (
        files.select("repo").distinct().join(rates, "repo", "left")
        .select(
            "repo", F.coalesce("blocks", F.lit(0)).alias("blocks"),
            F.coalesce("distinct_blocks", F.lit(0)).alias("distinct_blocks"),
        )
        .withColumn(
            "duplication_rate",
            F.when(
                F.col("blocks") > 0,
                round_half_up(
                    (F.lit(1.0) - F.col("distinct_blocks") / F.col("blocks")) * F.lit(100.0), 1
                ),
            ).otherwise(F.lit(0.0)),
        )
    )


def module_scores(scored: DataFrame, too_complex: float = 10.0) -> DataFrame:
    """Mean score and too-complex count per (repo, module).

    ``scored``: repo, module, score, is_function. Only functions can be too complex.
    """
    return scored.groupBy("repo", "module").agg(
        round_half_up(F.avg("score"), 1).alias("score"),
        F.count_if(F.col("is_function") & (F.col("score") > too_complex)).alias("issues"),
    )


def heat_map(modules: DataFrame, limit: int | None = None) -> DataFrame:
    """Modules of each repository, ranked by score; with ``limit`` the highest ones."""
    order = Window.partitionBy("repo").orderBy(F.desc("score"), "module")
    ranked = modules.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def smell_totals(smells: DataFrame) -> DataFrame:
    """Penalty and hours of all smells of a repository."""
    return smells.groupBy("repo").agg(
        F.sum(severity_weight(F.col("severity"), SMELL_PENALTY)).alias("penalty"),
        F.sum(severity_weight(F.col("severity"), SMELL_HOURS)).alias("hours"),
        F.count_if(F.col("title") == "God Class").alias("gods"),
        F.count("*").alias("smells"),
    )


def complexity_totals(complexity: DataFrame) -> DataFrame:
    return complexity.groupBy("repo").agg(
        F.sum(F.greatest(F.col("complexity") - 10, F.lit(0))).alias("excess"),
        F.count_if(F.col("complexity") > 10).alias("complex_functions"),
    )


def quality_scores(
    repos: DataFrame, index: DataFrame, complexity: DataFrame, smells: DataFrame,
    line_counts: DataFrame,
) -> DataFrame:
    """Quality score and debt hours per repository from pre-aggregated parts."""
    def value(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("double")

    joined = (
        repos.select("repo").distinct()
        .join(index, "repo", "left").join(complexity_totals(complexity), "repo", "left")
        .join(smell_totals(smells), "repo", "left").join(line_counts, "repo", "left")
    )
    mi = F.coalesce("maintainability_index", F.lit(70.0))
    return joined.select(
        "repo", mi.alias("maintainability_index"),
        round_half_up(quality_score(mi, value("excess"), value("penalty")), 1).alias(
            "quality_score"
        ),
        round_half_up(
            tech_debt_hours(
                value("complex_functions"), value("hours"), value("gods"), value("total_lines")
            ), 1,
        ).alias("tech_debt_hours"),
        F.coalesce("smells", F.lit(0)).alias("smells"),
        F.coalesce("gods", F.lit(0)).alias("god_classes"),
    )


def security_total(*findings: DataFrame) -> DataFrame:
    """HIGH findings per repository over any number of finding tables."""
    rows = None
    for part in findings:
        part = part.select("repo", "severity")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("repo").agg(F.count_if(F.col("severity") == "HIGH").alias("high_total"))
