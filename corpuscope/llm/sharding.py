"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``points`` places on a ring of 64-bit hashes. A document belongs to the first place
clockwise of its own hash. A shard takes its exact share of the rows (shares differ by one at most);
what overflows goes on clockwise to the first shard with room, so row counts are balanced by
construction and most rows stay with their place when the number of shards changes.

Documents between two places are alike for this, so only counts per place decide: ``shards * points``
numbers, whatever the input. The driver walks them; rows get their rank within their place by a window
over (place, salt) plus the offset of the salt, so that even one id on a third of all rows is ranked
in many tasks.

Defined cases: null text has size 16 and CRC 0; null ids hash alike; repeated rows are rows of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpuscope.llm.tables import materialize

SALTS = 64


def ring(shards: int, points: int) -> tuple[list[int], list[int]]:
    """Places in clockwise order as signed 64-bit numbers, and the shard of each."""
    places = sorted(
        (int(np.uint64(xxh64_intdigest(f"shard {s} point {p}")).astype(np.int64)), s)
        for s in range(shards) for p in range(points)
    )
    return [p for p, _ in places], [s for _, s in places]


def place_of(position: Column, places: list[int]) -> Column:
    """Number of places before a position by binary search; behind the last place the ring begins anew."""
    bits = len(places).bit_length()
    padded = F.lit(places + [2**63 - 1] * ((1 << bits) - len(places)))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(F.element_at(padded, at + step) < position, at + step).otherwise(at),
    )
    return F.when(found >= len(places), F.lit(0)).otherwise(found)


def fill(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, first slot) after each shard took its own and the rest went on."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, over = [], []

    def take(place: int, begin: int, count: int, shard: int) -> int:
        n = min(count, room[shard] - used[shard])
        if n:
            out.append((place, begin, begin + n, shard, used[shard]))
            used[shard] += n
        return n

    for place, count in enumerate(counts):
        n = take(place, 0, count, owner[place])
        if n < count:
            over.append((place, n))
    for place, begin in over:
        at = place
        while begin < counts[place]:
            at = (at + 1) % len(counts)
            begin += take(place, begin, counts[place] - begin, owner[at])
    return out


def shard_rows(
    docs: DataFrame, shards: int = 40, points: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    places, owner = ring(shards, points)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        )
        .withColumns({"position": F.xxhash64(F.col("id")), "row": F.monotonically_increasing_id()})
        .withColumns({"place": place_of(F.col("position"), places), "salt": F.spark_partition_id() % SALTS}),
        "ring-rows",
    )
    cells = rows.groupBy("place", "salt").count()
    before = Window.partitionBy("place").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("place", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    counts = [0] * len(places)
    for place, n in cells.groupBy("place").agg(F.sum("count")).collect():  # one row per place: shards * points
        counts[place] = n
    segments = spark.createDataFrame(
        fill(counts, owner, shards) or [(0, 0, 0, 0, 0)],
        "place int, begin long, end long, shard int, slot long",
    )
    inner = Window.partitionBy("place", "salt").orderBy("position", "id", "row")
    ranked = rows.withColumn("rank", F.row_number().over(inner) - 1).join(
        F.broadcast(offsets), ["place", "salt"]  # at most places * SALTS rows
    ).withColumn("rank", F.col("rank") + F.col("before"))
    return (
        ranked.join(F.broadcast(segments), "place")
        .filter((F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end")))
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                (F.col("slot") + F.col("rank") - F.col("begin")).alias("slot"))
    )
