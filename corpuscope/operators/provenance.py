"""Authorship and change history joined to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import first_chars
from corpuscope.skew import salted_join, top_per_key


#: characters of a commit, a blame summary and a commit message that the reference shows
REFERENCE_SHA, REFERENCE_SUMMARY, REFERENCE_MESSAGE = 8, 60, 80


def attach_blame(
    findings: DataFrame, blame: DataFrame, sha_chars: int | None = None, summary_chars: int | None = None
) -> DataFrame:
    """Author, commit, time and summary of each finding's line, the texts whole or cut to so many characters.

    Findings about a whole file or the architecture keep null columns. Blame
    has one row per line, so a key is only as hot as one line's findings.
    """
    lines = blame.select(
        "repo", "file_path", "line_no", "author", "email",
        first_chars(F.col("commit_sha"), sha_chars).alias("commit"),
        F.col("ts").alias("blame_ts"),
        first_chars(F.col("summary"), summary_chars).alias("summary"),
    )
    placed = (F.col("line_no") > 0) & (F.col("file_path") != "architecture")
    key = findings.withColumn("_line", F.when(placed, F.col("line_no")))
    return key.join(
        lines.withColumnRenamed("line_no", "_line"), ["repo", "file_path", "_line"], "left"
    ).drop("_line")


def author_stats(blamed: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings per author, who is known by e-mail or else by name."""
    who = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.col("author"))
    stats = (
        blamed.filter(F.col("author").isNotNull())
        .groupBy("repo", who.alias("author_key"))
        .agg(
            F.min("author").alias("name"),
            F.count("*").alias("total_issues"),
            F.count_if(F.col("severity") == "HIGH").alias("high_issues"),
            F.countDistinct("file_path").alias("files_touched"),
            F.min("blame_ts").alias("first_commit"), F.max("blame_ts").alias("last_commit"),
        )
        .withColumn("weight", F.col("high_issues") * 10 + F.col("total_issues"))
    )
    if limit is None:
        return stats
    return top_per_key(stats, ["repo"], [F.desc("weight"), F.asc("author_key")], limit)


def latest_commits(commits: DataFrame, limit: int) -> DataFrame:
    return top_per_key(commits, ["repo"], [F.desc("ts"), F.asc("sha")], limit)


def churn_hotspots(
    commits: DataFrame, commit_files: DataFrame, last: int | None = None, limit: int | None = None
) -> DataFrame:
    """Commits and authors per modified file, over all or the ``last`` commits of a repository.

    Files of other commits leave before repeated ones are removed.
    """
    recent = latest_commits(commits, last) if last is not None else commits
    touched = commit_files.filter(
        (F.col("change") == "M") & F.col("file_path").contains(".")
        & F.col("file_path").contains("/")
    ).select("repo", "sha", "file_path")
    hot = (
        touched.join(recent.select("repo", "sha", "author_email"), ["repo", "sha"]).distinct()
        .groupBy("repo", "file_path")
        .agg(F.count("*").alias("commit_count"),
             F.countDistinct("author_email").alias("unique_authors"))
    )
    if limit is None:
        return hot
    return top_per_key(hot, ["repo"], [F.desc("commit_count"), F.asc("file_path")], limit)


def recent_commits(
    commits: DataFrame, commit_files: DataFrame, limit: int | None = None, sha_chars: int | None = None,
    message_chars: int | None = None,
) -> DataFrame:
    """Commits of each repository with the number of files they changed; with ``limit`` the newest and their rank."""
    newest = commits if limit is None else latest_commits(commits, limit)
    sizes = (
        salted_join(
            commit_files.select("repo", "sha", "file_path"),
            newest.select("repo", "sha"), ["repo", "sha"], ["file_path"], "left_semi",
        )
        .distinct().groupBy("repo", "sha").agg(F.count("*").alias("files_changed"))
    )
    return newest.join(sizes, ["repo", "sha"], "left").select(
        "repo", first_chars(F.col("sha"), sha_chars).alias("sha"),
        first_chars(F.trim("message"), message_chars).alias("message"), "author_email", "ts",
        F.coalesce("files_changed", F.lit(0)).alias("files_changed"), *([] if limit is None else ["rank"]),
    )
