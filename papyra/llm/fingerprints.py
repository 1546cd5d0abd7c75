"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark expressions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's
five-word shingles (words are lower-cased; a text of fewer words is one shingle).
Sketches of parts merge into the sketch of the whole, and two sketches estimate
resemblance, containment and the number of distinct shingles; a sketch of fewer
than k hashes is the whole set, for which the estimates are exact.

Edge cases: null and empty texts have the empty sketch; two empty sketches are
alike (1), an empty and another one are not (0); long texts are read whole;
repeated rows get equal sketches; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import in_order, without

SHINGLE = 5
K = 128
_SPACE = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text_col: str = "text", name: str = "sketch", k: int = K) -> DataFrame:
    """Add the sketch of a text column (an older column of that name is replaced)."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), _SPACE), lambda w: w != "")
    df = without(df, name).withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE),
                       lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(SHINGLE)]))
    shingles = (F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64("_hashes")))
                .otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop("_hashes")


def merge_sketches(df: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch) of the union of each key's sketches.

    Hashes are made distinct and cut to k per key before and after the shuffle,
    so a key with a third of all rows sends at most k hashes from each task.
    """
    hashes = df.select(F.col(key), F.explode(sketch).alias("h")).distinct()
    least = Window.partitionBy(key).orderBy("h")
    merged = (hashes.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k)
              .groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch)))
    keys = df.select(F.col(key).alias("_key")).distinct()
    return (keys.join(merged, F.col("_key").eqNullSafe(F.col(key)), "left")
            .select(F.col("_key").alias(key), F.coalesce(sketch, F.array().cast("array<bigint>")).alias(sketch)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return (F.when(a == b, 1.0)
            .otherwise(F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated size of a sketched set: the k-th of n uniform hashes lies near k / n of their range."""
    kth = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the set of ``a`` that lies in the set of ``b``."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    common = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """Sixteen hexadecimal digits per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _with_next(ids: DataFrame) -> DataFrame:
    """(doc_id, take) -> (doc_id, before, take): the id whose next one, in descending order, is doc_id, and its take.

    Positions come from range partitions and their row counts; only narrow rows move.
    """
    ranked = in_order(ids, "doc_id")
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("first"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offsets = counts.select("_pid", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    total = ranked.count()
    placed = (ranked.join(F.broadcast(offsets), "_pid")
              .select("doc_id", "take", (F.col("_mid") - F.col("first") + F.col("start")).alias("at")))
    # positions ascend with doc_id, so the predecessor in descending order is one position up
    up = placed.select((F.pmod(F.col("at") - 1 + total, F.lit(max(total, 1)))).alias("at"),
                       F.col("doc_id").alias("before"), "take")
    return placed.select("doc_id", "at").join(up, "at").select("doc_id", "before", "take")


def with_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text -> doc_id, n_chars, edited, sketch, next_sketch: each text and one that borrows from the next.

    The last third of a text gives way to as much of the next document (descending
    ids, the last one's next is the first).  Whole texts are shuffled once, by id;
    what moves on to the predecessor is the borrowed beginning and the sketch.  Of
    rows that share an id the smallest text is the next document; a row without an
    id has none, so it loses its last third and is not like it.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    dealt = known.repartition("doc_id")            # one exchange serves both uses
    third = F.floor(F.length("text") / 3)
    ids = known.groupBy("doc_id").agg(F.max(third).cast("int").alias("take"))
    one = Window.partitionBy("doc_id").orderBy("text")
    lent = (dealt.withColumn("_before", F.lag("doc_id").over(one)).where("_before IS NULL").drop("_before")
            .join(_with_next(ids), "doc_id"))
    lent = (with_sketch(lent, name="next_sketch", k=k)
            .select(F.col("before").alias("doc_id"), F.substring("text", F.lit(1), F.col("take")).alias("_lent"),
                    "next_sketch"))
    joined = (dealt.join(lent, "doc_id", "left")
              .unionByName(docs.where("doc_id IS NULL"), allowMissingColumns=True))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - third).cast("int")),
                      F.substring(F.coalesce("_lent", F.lit("")), F.lit(1), third.cast("int")))
    return with_sketch(joined.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"),
                                     "next_sketch"), k=k).drop("text")
