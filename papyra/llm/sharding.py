"""Sharding: weighted rendezvous hashing of stable record keys.

Every shard draws a number from the hash of (key, shard); the weighted draw
-ln(u) / weight that is smallest takes the record.  A shard that is added later
draws anew and takes only the records that it wins, so nothing moves between
old shards.  Copies of one text have their own keys, so a large group of them
spreads over all shards.

Slots number the rows of a shard without gaps in the order of (key, size, crc).
They come from the position inside range partitions plus the counts of earlier
partitions, one row per partition and shard, so no shard is gathered in a task.

Edge cases: null text has no bytes (size 8, crc32 0), a null key is the key
"null", repeated rows get slots of their own, shards of weight 0 or less get
nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import in_order, unit_hash


def _draw(key: Column, shard: int, weight: float) -> Column:
    return F.struct((-F.log(unit_hash(key, F.lit(shard))) / weight).alias("draw"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """Struct (draw, shard) of the shard that wins ``key``."""
    draws = [_draw(key, s, float(w)) for s, w in weights.items() if w > 0]
    if not draws:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*draws))


def shard_rows(docs: DataFrame, weights: dict[int, float], added: tuple[int, float],
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and grown_shard with one shard ``added`` (number, weight)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("_won", F.struct(rendezvous(F.col("doc_id"), weights).alias("w"),
                                            _draw(F.col("doc_id"), *added).alias("a")))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("_won.w.shard").alias("shard"),
                       F.least("_won.w", "_won.a")["shard"].alias("grown_shard"))
    placed = in_order(rows, "shard", "doc_id", "size", "text_crc32")
    # at most (range partitions + shards) rows
    runs = placed.groupBy("shard", "_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("first"))
    before = Window.partitionBy("shard").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "_pid", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (placed.join(F.broadcast(runs), ["shard", "_pid"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("_mid") - F.col("first") + F.col("start")).alias("slot"), "grown_shard"))
