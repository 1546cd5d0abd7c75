"""Sinks (2.2): every writer is a distributed DataFrame write, nothing passes the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.names import plain_path
from papyra.plans.ordinal import global_ordinal, running_sums


def write_docs(outcome: DataFrame, path: str, run_id: str, mode: str = "append") -> None:
    """B1: kept document records as JSON Lines, one directory per run (no giant map object)."""
    kept = outcome.filter(F.col("outcome") == "kept")
    (kept.select("file_name", "content", "is_resume", "contact_info", "hash_id",
                 *(["created_time"] if "created_time" in kept.columns else []))
         .withColumn("run_id", F.lit(run_id))
         .write.mode(mode).partitionBy("run_id").json(path))


def write_docmap(records: DataFrame, path: str, batch_col: str = "batch_index",
                 key_col: str = "file_name", mode: str = "overwrite") -> None:
    """Reference-compatible doc-map files: one JSON object ``{file_name: record}`` per batch.

    A batch is bounded by the flush size, so gathering it into one map is bounded too.  A name
    that stands twice in a batch keeps its greatest record; a null name is written as "".
    """
    ci = F.col("contact_info")
    file_ci = F.struct(ci["emails"].alias("emails"),
                       F.transform(ci["phone_numbers"], lambda p: F.array(
                           p["country"], p["area"], p["prefix"], p["line"])).alias("phone_numbers"),
                       ci["linkedin"].alias("linkedin"), ci["github"].alias("github"), ci["urls"].alias("urls"))
    rec = F.struct(F.col("content"), F.col("is_resume"), file_ci.alias("contact_info"),
                   F.col("created_time").cast("string").alias("created_time"), F.col("hash_id"))
    per_batch = (records.groupBy(batch_col)
                        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce(key_col, F.lit("")).alias("k"), rec.alias("r"))))
                             .alias("l"))
                        .withColumn("l", F.expr("filter(l, (x, i) -> i = size(l) - 1 OR l[i + 1].k <> x.k)"))
                        .select(batch_col, F.to_json(F.map_from_entries("l")).alias("value")))
    per_batch.repartition(batch_col).write.mode(mode).partitionBy(batch_col).text(path)


def write_hash_ledger(outcome: DataFrame, path: str, batch_col: str | None = None, mode: str = "append") -> None:
    """B2: ``Filename, Hash ID, Is Resume`` with a header, one CSV per flush batch when given."""
    kept = outcome.filter(F.col("outcome") == "kept").select(
        F.col("file_name").alias("Filename"), F.col("hash_id").alias("Hash ID"),
        F.when(F.col("is_resume"), "True").otherwise("False").alias("Is Resume"),
        *([batch_col] if batch_col else []))
    w = kept.repartition(batch_col) if batch_col else kept
    w = w.write.mode(mode).option("header", True)
    if batch_col:
        w = w.partitionBy(batch_col)
    w.csv(path)


def write_run_summary(summary: DataFrame, path: str, started, finished, mode: str = "append") -> None:
    """The one-row counters plus run times as JSON."""
    (summary.withColumn("run_start_time", F.lit(started.isoformat()))
            .withColumn("run_end_time", F.lit(finished.isoformat()))
            .withColumn("duration_seconds", F.lit((finished - started).total_seconds()))
            .coalesce(1).write.mode(mode).json(path))


def write_parquet_table(df: DataFrame, path: str, partition_col: str | None = None, mode: str = "overwrite") -> None:
    """Snappy Parquet, optionally one directory per source file."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def append_status_ledger(results: DataFrame, path: str) -> None:
    """``document_name, status, error_message, timestamp`` appended (header in every file)."""
    (results.select("document_name", "status",
                    F.coalesce(F.col("error_message"), F.lit("")).alias("error_message"),
                    F.current_timestamp().alias("timestamp"))
            .write.mode("append").option("header", True).csv(path))


def append_processed_list(names: DataFrame, path: str, name_col: str = "file_name") -> None:
    """Processed file names, one per line."""
    names.select(name_col).write.mode("append").text(path)


def write_vectors(points: DataFrame, path: str, mode: str = "append") -> None:
    """Points as Parquet, clustered by document so one document's vectors sit together."""
    (points.repartition("payload.document_name")
           .sortWithinPartitions("payload.document_name", "id")
           .write.mode(mode).parquet(path))


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Cluster assignments as Parquet (no driver collect)."""
    clusters.write.mode("overwrite").parquet(path)


def write_line_list(df: DataFrame, path: str, col: str) -> None:
    """One value per line."""
    df.select(F.col(col).cast("string")).write.mode("overwrite").text(path)


def write_join_csv(df: DataFrame, path: str) -> None:
    """A join result as CSV with a header, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _swapped_in(spark: SparkSession, fresh: str, path: str) -> None:
    """``fresh`` takes the place of ``path`` by renames; a stop between the two leaves the old folder as ``path``.old."""
    conf, fs_path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, at, old = fs_path(fresh), fs_path(path), fs_path(path + ".old")
    fs = at.getFileSystem(conf)
    if fs.exists(at):
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, at):
        raise OSError(f"{fresh} could not be put in place")
    fs.delete(old, True)


def compact(spark: SparkSession, src: str, dst: str, target_bytes: int = 128 << 20) -> bool:
    """The Parquet files of ``src`` as files of about ``target_bytes`` in ``dst``, which may be ``src``.

    The files are laid end to end in the order of their paths and cut every ``target_bytes``; a row goes
    to the cut that its split begins in, so a new file holds less than ``target_bytes`` and one split
    more of the old bytes, and large files are cut too.  The new folder is complete before it takes its
    place.  False, and nothing is written, where ``src`` is ``dst`` and has at most twice the files that
    its bytes need and none above twice the target: a second run changes nothing.  The columns of
    partition folders become columns of the files.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
              .load(src).select(plain_path("path").alias("_file"), F.col("length").alias("_bytes")))
    size = listed.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"),
                      F.coalesce(F.max("_bytes"), F.lit(0)).alias("largest")).first()
    need = max(1, -(-size["bytes"] // target_bytes))
    if src.rstrip("/") == dst.rstrip("/") and size["files"] <= 2 * need and size["largest"] <= 2 * target_bytes:
        return False
    numbered = global_ordinal(listed, ["_file"], "_at").withColumn("_at", F.col("_at") + 1)
    begin = running_sums(numbered, "_at", ["_bytes"]).select("_file", (F.col("running__bytes") - F.col("_bytes")).alias("_begin"))
    table = spark.read.option("pathGlobFilter", "*.parquet").parquet(src)
    rows = table.select("*", plain_path("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    cut = F.least(F.floor((F.col("_begin") + F.col("_split")) / target_bytes), F.lit(need - 1)).cast("int")
    placed = rows.join(begin, "_file").withColumn("_cut", cut).repartitionById(need, "_cut")
    fresh = f"{dst.rstrip('/')}.next-{uuid.uuid4().hex}"
    placed.select(table.columns).write.parquet(fresh)
    _swapped_in(spark, fresh, dst.rstrip("/"))
    return True
