"""Join and window shapes that stay bounded when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join many rows per key with a lookup that is small per key.

    Rows of one key are spread over ``salts`` partitions by a hash of
    ``spread_by``; each lookup row is repeated once per salt. ``how`` may be
    inner, left, left_semi or left_anti.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never sent through the driver.

    The planner takes the size of a written table's files for that of its rows. Files of many equal or nested values are far
    smaller, so such a side passes for one that can be broadcast, and the driver that collects it runs out of memory.
    """
    return df.hint("merge")


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """``lag(value)`` per key without putting a whole key into one task.

    The window runs inside (key, bucket), where ``bucket`` is a non-decreasing
    function of the first order column such as its day. The first row of a
    bucket takes the last value of the nearest earlier bucket, found on the
    much smaller table of one row per (key, bucket).
    """
    tagged = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    local = tagged.withColumn("_prev", F.lag(value).over(inner)).withColumn(
        "_first", F.row_number().over(inner) == 1
    )
    ends = tagged.groupBy(*keys, "_b").agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_last")
    )
    carry = ends.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))
    ).select(*keys, "_b", "_carry")
    return (
        local.join(carry, keys + ["_b"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_b", "_prev", "_first", "_carry")
    )


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key in the given order, with their rank.

    A first round keeps ``k`` rows per key and salt, so no task ever sorts a whole hot key.
    """
    cols = df.columns
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(SALTS)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = salted.withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return first.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


#: partitions for per-row work on texts, for sessions that read few large row groups
MIN_PARTITIONS = "spark.corpuscope.minPartitions"


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly, copies too, to as many partitions as the session shuffles to.

    For steps that spend far more per row than a shuffle of it costs: a narrow file may be a single input partition.
    """
    spark = df.sparkSession
    return df if df.isStreaming else df.repartition(int(spark.conf.get(MIN_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """The input as it is, or dealt by ``keys`` to as many partitions as the session's ``MIN_PARTITIONS`` says.

    Per-row work on texts needs no shuffle where the input has partitions enough, so nothing is set by default.
    """
    count = df.sparkSession.conf.get(MIN_PARTITIONS, None)
    return df if count is None or df.isStreaming else df.repartition(int(count), *keys)
