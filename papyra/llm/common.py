"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import cut_lineage, scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_POS_BITS = 33   # monotonically_increasing_id = partition index << 33 | position in it


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def unit_hash(*parts: Column) -> Column:
    """A stable number in (0, 1): 52 bits of the md5 of the parts joined by ':' (null: 'null')."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def in_order(df: DataFrame, *cols: str) -> DataFrame:
    """Rows range-partitioned and sorted on ``cols``, written to the shared checkpoint folder.

    ``_mid`` grows along the order and ``_pid`` is the range partition.  The rows
    are materialised once so that later passes see the same partitions, also
    after an executor is lost.  Nothing passes through one task.
    """
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    return ranged.withColumn("_pid", F.shiftright("_mid", _POS_BITS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    A checkpoint keeps the size estimate of its plan.  In a loop of joins that is a
    product of products, a number of millions of digits after a few rounds; a
    written table has the size of its files.  For narrow rows: nothing removes them.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder that this session has written under the checkpoint folder and read for the last time."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a (checkpointed or otherwise cheap) frame has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add, whatever their letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
