"""Streaming forms: rules on arriving files, deduplication, trends, alerts, upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscope.functions.scoring import high_alert_payload
from corpuscope.operators.history import latest_by_key, merge_rollups, rollup_parts
from corpuscope.operators.rule_packs import Rule
from corpuscope.operators.scan import MIN_LINES, explode_lines, scan_lines
from corpuscope.session import folder_names, materialize, remove


def stream_findings(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Rule findings of a stream of files; stateless, same plan as the batch scan."""
    return scan_lines(explode_lines(files, MIN_LINES), rules)


def stream_dedup(
    findings: DataFrame, keys: list[str], event_time: str, delay: str = "1 day"
) -> DataFrame:
    """One row per key within the watermark delay; state is dropped behind it."""
    return findings.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def stream_trend(
    runs: DataFrame, event_time: str, value: str, by: list[str], size: str = "1 day",
    slide: str | None = None, delay: str = "1 day",
) -> DataFrame:
    """Run count and score range per time window; rows behind the watermark are dropped."""
    span = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    return (
        runs.withWatermark(event_time, delay).groupBy(span, *by)
        .agg(F.count("*").alias("run_count"), F.max(value).alias("best"),
             F.min(value).alias("worst"))
        .select(F.col("window.start").alias("window_start"), *by, "run_count", "best", "worst")
    )


def stream_high_alerts(findings: DataFrame) -> DataFrame:
    """Alert rows with their chat payload for every HIGH finding."""
    return findings.filter(F.col("severity") == "HIGH").withColumn(
        "payload", high_alert_payload(F.col("repo"), F.col("title"), F.col("file_path"))
    )


def run_available(
    stream: DataFrame, out: str, checkpoint: str, mode: str = "append"
) -> DataFrame:
    """Drain what the source holds now into Parquet files and read them back."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def for_each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


#: buckets of an upserted table; a batch rewrites those that hold its keys
BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _generations(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """Bucket -> the batches that have written it whole, oldest first."""
    found: dict[int, list[int]] = {}
    batches = [int(n[4:]) for n in folder_names(spark, table) if n.startswith("gen=")]
    for batch in sorted(batches):
        names = folder_names(spark, f"{table}/gen={batch}")
        if "_SUCCESS" in names:
            for n in names:
                if n.startswith("bucket="):
                    found.setdefault(int(n[7:]), []).append(batch)
    return found


def _read_buckets(spark: SparkSession, table: str, latest: dict[int, int]) -> DataFrame:
    paths = [f"{table}/gen={batch}/bucket={bucket}" for bucket, batch in sorted(latest.items())]
    return spark.read.option("basePath", table).parquet(*paths).drop("gen", "bucket")


def stream_upsert(
    stream: DataFrame, table: str, checkpoint: str, keys: list[str], ts: str, tie: list[str], buckets: int = BUCKETS
) -> None:
    """Keep the newest row per key in a table of key buckets.

    A micro-batch reads and rewrites only the buckets that hold its keys, as a generation of its own, so a batch that
    is run again after a failure starts from the same older generations and writes the same rows. A half-written generation
    is not read. Older generations of a bucket go when the next batch begins; they are at most one folder per
    bucket and batch. ``read_upserted`` reads each bucket's latest generation and folds nothing.
    """
    rest = [c for c in stream.columns if c not in [*keys, ts]]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = materialize(
            latest_by_key(batch.select(*keys, *rest, ts), keys, ts, tie).withColumn("bucket", _bucket(keys, buckets)), "upserts")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most so many buckets
        latest = {}
        for bucket, batches in _generations(spark, table).items():
            before = [b for b in batches if b < batch_id]
            for old in before[:-1]:
                remove(spark, f"{table}/gen={old}/bucket={bucket}")
            if before and bucket in touched:
                latest[bucket] = before[-1]
        rows = fresh.drop("bucket")
        if latest:
            rows = rows.unionByName(_read_buckets(spark, table, latest))
        merged = latest_by_key(rows.withColumn("_ts", F.col("last_seen")), keys, "_ts", tie)
        merged.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{table}/gen={batch_id}")

    for_each_batch(stream, merge, checkpoint).awaitTermination()


def read_upserted(spark: SparkSession, table: str, keys: list[str], tie: list[str]) -> DataFrame:
    """Latest row per key with the first and last time it was seen."""
    latest = {bucket: batches[-1] for bucket, batches in _generations(spark, table).items()}
    if not latest:
        raise FileNotFoundError(f"no batch has written {table}")
    return _read_buckets(spark, table, latest)


def compact_upserted(
    spark: SparkSession, table: str, target: str, keys: list[str], tie: list[str], buckets: int = BUCKETS
) -> None:
    """Copy the latest rows into a new table of a single generation."""
    rows = read_upserted(spark, table, keys, tie).withColumn("bucket", _bucket(keys, buckets))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{target}/gen=-1")


def stream_rollup(stream: DataFrame, table: str, checkpoint: str, by: tuple[str, ...] = ("user_id", "repo")) -> None:
    """Write what each micro-batch of runs adds to the rollup and the leaderboard; a repeated batch overwrites only itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rollup_parts(batch, by).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    for_each_batch(stream, write, checkpoint).awaitTermination()


def read_rollup(spark: SparkSession, table: str, by: tuple[str, ...] = ("user_id", "repo")) -> DataFrame:
    """The parts of all batches merged, for ``finish_rollup`` and ``finish_leaderboard``; late runs count as any others."""
    return merge_rollups(spark.read.parquet(table).drop("batch"), by)
