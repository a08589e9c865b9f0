"""What the operators share: reading tables, row ids, the size of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import materialize, remove, scratch_path  # noqa: F401


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts_for(df: DataFrame, text_col: str, each_mb: float) -> int:
    """Number of parts of about ``each_mb`` MB of stored input.

    Files tell their size through Spark's statistics. Where those know nothing (rows that no file holds), texts are measured.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return int(max(1, size / (each_mb * 1e6)) + 0.999)


def replaced(df: DataFrame, label: str, before: str | None = None) -> tuple[DataFrame, str]:
    """Write a round's table, delete that of the round before, and read the new one; also its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if before is not None:
        remove(df.sparkSession, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fresh_names(df: DataFrame, count: int) -> list[str]:
    """Column names that the table has not, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    return [f"own{i}" for i in range(count + len(taken)) if f"own{i}" not in taken][:count]
