"""Exact deduplication by a tree-merge of sorted digest runs.

Each scan task writes one run: digest, length and a second hash of its normalised texts, sorted by
digest. Runs merge in rounds. In round r, ``fan_in`` neighbouring nodes exchange their entries, equal
digests meet in a grouping by (node, digest) with map-side combine, and the smallest identifier goes up.
The root knows each group's smallest row and size; the way down hands both back node by node. A digest has
at most ``fan_in`` entries below a node, so copies of one text never gather in one task, however
many there are. Only digests move, never texts.

Defined cases: null text counts as empty; null ids come after all others; of rows with equal id
and text one stays; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import fresh_names, materialize

KEY = ["digest", "n_bytes", "witness"]
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(text: str | Column) -> list[Column]:
    """A text's key: SHA-256, and length and another hash by which a merge verifies equality."""
    clean = normalised(text)
    return [F.sha2(clean, 256).alias("digest"), F.octet_length(clean).alias("n_bytes"),
            F.xxhash64(clean).alias("witness")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_bytes."""
    ident = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    runs = materialize(
        docs.select(F.col(id_col).alias("id"), *digests(F.col(text_col)))
        .withColumns({"row": F.monotonically_increasing_id(), "node": F.spark_partition_id()})
        .sortWithinPartitions(*KEY, "id"),
        "digest-runs",
    )
    levels = [materialize(
        runs.groupBy("node", *KEY).agg(F.min(ident).alias("keep"), F.count("*").alias("size")), "digest-level")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last > 0:
        up = levels[-1].withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        levels.append(materialize(
            up.groupBy("node", *KEY).agg(F.min("keep").alias("keep"), F.sum("size").alias("size")), "digest-level"))
        last //= fan_in
    known = levels.pop()
    for level in reversed(levels):
        above = known.select(F.col("node").alias("above"), *KEY, "keep", "size")
        known = (
            level.select("node", *KEY, F.floor(F.col("node") / fan_in).cast("int").alias("above"))
            .join(above, ["above", *KEY])
            .select("node", *KEY, "keep", "size")
        )
    return runs.join(known, ["node", *KEY]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256"), "n_bytes",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first of equal texts; columns as given, whatever their names."""
    own_id, own_digest, kept_id, kept_digest = fresh_names(docs, 4)
    first = (
        exact_groups(docs, id_col, text_col).filter("kept")
        .select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_digest))
    )
    keyed = docs.withColumns({
        own_digest: F.sha2(normalised(F.col(f"`{text_col}`")), 256), own_id: F.col(f"`{id_col}`")})
    same = F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_digest) == F.col(kept_digest))
    return keyed.join(first, same, "left_semi").dropDuplicates([own_id, own_digest]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
