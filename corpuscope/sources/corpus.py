"""Reading source trees into the ``files`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.paths import detect_language, in_ignored_dir, is_supported
from corpuscope.functions.text import split_lines

#: the largest file that the reference reads
REFERENCE_MAX_BYTES = 500 * 1024


def _fits(size: str, max_bytes: int | None) -> Column:
    """Not empty, and not larger than ``max_bytes`` unless that is None."""
    some = F.col(size) > 0
    return some if max_bytes is None else some & (F.col(size) <= max_bytes)


def admit_files(
    files: DataFrame, path: str = "file_path", size: str = "size_bytes", max_bytes: int | None = None
) -> DataFrame:
    """Supported extension, no ignored directory, not empty; with ``max_bytes``, such as ``REFERENCE_MAX_BYTES``, not larger."""
    p = F.col(path)
    return files.filter(_fits(size, max_bytes) & is_supported(p) & ~in_ignored_dir(p))


def read_corpus(
    spark: SparkSession, root: str, repo: Column | None = None, commit_sha: str = "",
    max_bytes: int | None = None,
) -> DataFrame:
    """The ``files`` table of a directory tree.

    Every size is read unless ``max_bytes`` is given; that limit is pushed to the file listing, so
    larger files are never opened. By default the first directory under ``root`` names the repository.
    """
    base = root.rstrip("/")
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        .filter(_fits("length", max_bytes))
    )
    tail = F.regexp_replace("path", "^.*?" + _quote(base) + "/", "")
    if repo is None:
        repo = F.regexp_extract("rel", "^([^/]+)/", 1)
        file_path = F.regexp_replace("rel", "^[^/]+/", "")
    else:
        file_path = F.col("rel")
    text = F.decode("content", "UTF-8")
    return (
        admit_files(raw.withColumn("rel", tail), "rel", "length", max_bytes)
        .select(
            repo.alias("repo"), F.lit(commit_sha).alias("commit_sha"),
            file_path.alias("file_path"), detect_language(F.col("rel")).alias("language"),
            F.when(F.is_valid_utf8(F.col("content").cast("string")), text)
            .otherwise(F.decode("content", "ISO-8859-1")).alias("content"),
            F.col("length").alias("size_bytes"),
        )
        .withColumn("line_count", F.size(split_lines(F.col("content"))))
    )


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def with_line_count(files: DataFrame) -> DataFrame:
    return files.withColumn("line_count", F.size(split_lines(F.col("content"))))
