"""Snapshot diffs and reuse of earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.paths import cache_key
from corpuscope.functions.text import round_half_up
from corpuscope.skew import salted_join

KEY = ["repo", "file_path"]


def _fingerprint(snapshot: DataFrame, name: str) -> DataFrame:
    """Path and content hash: file contents never travel to the diff."""
    return snapshot.select(*KEY, F.sha2("content", 256).alias(name))


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, changed, removed or same for each path of two snapshots."""
    both = _fingerprint(old, "_old").join(_fingerprint(new, "_new"), KEY, "full_outer")
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    )
    return both.select(*KEY, status.alias("status"))


def changed_paths(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status") != "same").select(*KEY)


def mark_incremental(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files with ``rescan``: true for changed paths, and for every file of a
    repository that has no diff at all."""
    marked = files.join(changed.select(*KEY).distinct().withColumn("_hit", F.lit(True)), KEY, "left")
    with_diff = changed.select("repo").distinct().withColumn("_diff", F.lit(True))
    return salted_join(marked, with_diff, ["repo"], ["file_path"], "left").withColumn(
        "rescan", F.col("_hit").isNotNull() | F.col("_diff").isNull()
    ).drop("_hit", "_diff")


def split_incremental(files: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to scan again, files whose results are kept)."""
    marked = mark_incremental(files, changed)
    return marked.filter("rescan").drop("rescan"), marked.filter("not rescan").drop("rescan")


def merge_incremental(new: DataFrame, cached: DataFrame, changed: DataFrame) -> DataFrame:
    """New findings with the cached findings of files that did not change."""
    kept = cached.filter(F.col("file_path") != "architecture").join(changed, KEY, "left_anti")
    return new.withColumn("reused", F.lit(False)).unionByName(
        kept.withColumn("reused", F.lit(True))
    )


def critical_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo").agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("severity") == "HIGH").alias("critical_count"),
    )


def incremental_stats(marked: DataFrame) -> DataFrame:
    """Totals of a marked file table, per repository."""
    return marked.groupBy("repo").agg(
        F.count("*").alias("total_files"), F.count_if("rescan").alias("changed_files"),
    ).select(
        "repo", "total_files", "changed_files",
        (F.col("total_files") - F.col("changed_files")).alias("reused_files"),
        round_half_up(F.col("changed_files") * 100.0 / F.col("total_files"), 1).alias(
            "scan_percent"
        ),
    )


def not_yet_analyzed(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Snapshots (repo, commit_sha) that no run covers, by cache key."""
    key = cache_key(F.col("repo"), F.col("commit_sha"))
    done = runs.select(key.alias("cache_key")).distinct()
    known = F.coalesce(F.col("commit_sha"), F.lit("unknown")) != "unknown"
    fresh = snapshots.filter(~known).withColumn("cache_key", key)
    return snapshots.filter(known).withColumn("cache_key", key).join(
        done, "cache_key", "left_anti"
    ).unionByName(fresh)
