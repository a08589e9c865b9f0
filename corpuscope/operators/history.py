"""Queries over the run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.scoring import quality_trend
from corpuscope.skew import previous_value, top_per_key


def history(runs: DataFrame, limit: int | None = None, repo: str | None = None) -> DataFrame:
    """Runs of each repository, or of one; with ``limit`` the newest ones and, for all repositories, their rank."""
    if repo is not None:
        runs = runs.filter(F.col("repo") == repo)
        if limit is None:
            return runs
        return runs.orderBy(F.desc("analyzed_at"), F.desc("run_id")).limit(limit)
    if limit is None:
        return runs
    return top_per_key(runs, ["repo"], [F.desc("analyzed_at"), F.desc("run_id")], limit)


def trend(runs: DataFrame, limit: int | None = None, latest: bool = False) -> DataFrame:
    """Score series of each repository.

    With ``limit`` the oldest so many runs and their rank; ``latest`` takes the newest ones.
    """
    if limit is None:
        return runs
    if latest:
        newest = top_per_key(runs, ["repo"], [F.desc("analyzed_at"), F.desc("run_id")], limit)
        runs = newest.drop("rank")
    return top_per_key(runs, ["repo"], [F.asc("analyzed_at"), F.asc("run_id")], limit)


def run_delta(runs: DataFrame) -> DataFrame:
    """Change of the quality score against the previous run of the repository."""
    with_prev = previous_value(
        runs, ["repo"], ["analyzed_at", "run_id"], F.to_date("analyzed_at"), "quality_score",
        "previous_score",
    )
    return with_prev.withColumn(
        "delta", F.col("quality_score") - F.col("previous_score")
    ).withColumn("label", quality_trend(F.col("quality_score")))


def repo_rollup(runs: DataFrame, by: tuple[str, ...] = ("user_id", "repo")) -> DataFrame:
    """Last run, run count and score range per repository of each user."""
    return runs.groupBy(*by).agg(
        F.max_by("repo_name", F.struct("analyzed_at", "run_id")).alias("repo_name"),
        F.max("analyzed_at").alias("last_analyzed"), F.count("*").alias("run_count"),
        F.avg("quality_score").alias("avg_quality"),
        F.max("quality_score").alias("best_quality"),
        F.min("quality_score").alias("worst_quality"),
    )


def rollup_parts(runs: DataFrame, by: tuple[str, ...] = ("user_id", "repo")) -> DataFrame:
    """What a batch of runs adds to ``repo_rollup`` and ``leaderboard``: counts, sums and extremes that merge in any order."""
    return runs.groupBy(*by).agg(
        F.max(F.struct("analyzed_at", "run_id", "repo_name")).alias("newest"), F.count("*").alias("run_count"),
        F.count("quality_score").alias("scored"), F.sum("quality_score").alias("total_quality"),
        F.max("quality_score").alias("best_quality"), F.min("quality_score").alias("worst_quality"),
        F.min("security_high").alias("min_security_issues"),
    )


def merge_rollups(parts: DataFrame, by: tuple[str, ...] = ("user_id", "repo")) -> DataFrame:
    """Parts of the same repositories as one; the result is a table of parts again."""
    return parts.groupBy(*by).agg(
        F.max("newest").alias("newest"), F.sum("run_count").alias("run_count"), F.sum("scored").alias("scored"),
        F.sum("total_quality").alias("total_quality"), F.max("best_quality").alias("best_quality"),
        F.min("worst_quality").alias("worst_quality"), F.min("min_security_issues").alias("min_security_issues"),
    )


def finish_rollup(parts: DataFrame, by: tuple[str, ...] = ("user_id", "repo")) -> DataFrame:
    """Merged parts as ``repo_rollup`` gives them."""
    return parts.select(
        *by, F.col("newest.repo_name").alias("repo_name"), F.col("newest.analyzed_at").alias("last_analyzed"), "run_count",
        F.try_divide("total_quality", "scored").alias("avg_quality"), "best_quality", "worst_quality",
    )


def finish_leaderboard(parts: DataFrame, limit: int | None = None) -> DataFrame:
    """Merged parts as ``leaderboard`` gives them."""
    best = merge_rollups(parts, ("repo",)).select(
        "repo", F.col("newest.repo_name").alias("repo_name"), F.col("best_quality").alias("best_score"),
        "min_security_issues", F.col("run_count").alias("total_runs"))
    return best if limit is None else best.orderBy(F.desc("best_score"), F.asc("repo")).limit(limit)


def leaderboard(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Repositories by best score."""
    best = runs.groupBy("repo").agg(
        F.max_by("repo_name", F.struct("analyzed_at", "run_id")).alias("repo_name"),
        F.max("quality_score").alias("best_score"),
        F.min("security_high").alias("min_security_issues"), F.count("*").alias("total_runs"),
    )
    if limit is None:
        return best
    return best.orderBy(F.desc("best_score"), F.asc("repo")).limit(limit)


def upsert_latest(
    current: DataFrame, incoming: DataFrame, keys: list[str], ts: str, tie: list[str]
) -> DataFrame:
    """Current rows overwritten by newer rows of the same key.

    Keeps the first time a key was seen as ``created_at`` and the last as
    ``last_seen``. Both tables carry the same columns; the aggregation is
    combined map-side, so many updates of one key cost one row per task.
    """
    return latest_by_key(current.unionByName(incoming), keys, ts, tie)


def latest_by_key(rows: DataFrame, keys: list[str], ts: str, tie: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in [*keys, ts, "created_at", "last_seen"]]
    created = F.col("created_at") if "created_at" in rows.columns else F.col(ts)
    newest: Column = F.max_by(F.struct(*rest), F.struct(ts, *tie))
    return (
        rows.groupBy(*keys)
        .agg(newest.alias("_row"), F.min(created).alias("created_at"), F.max(ts).alias("last_seen"))
        .select(*keys, "_row.*", "created_at", "last_seen")
    )
