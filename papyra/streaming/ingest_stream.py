"""Incremental ingest as Structured Streaming.

New document files are picked up by a file-stream source; every micro-batch
runs the *same* batch operators (outcome against the ledger, ledger append,
record sink).  The ledger written by epoch e is visible to epochs > e only,
which is the reference's per-batch visibility.  Every sink partition is keyed
by epoch and overwritten dynamically, so a re-executed epoch (after a driver
restart or executor loss) rewrites its own output instead of appending twice.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.operators import ingest as I

LEDGER_SCHEMA = "file_name string, hash_id string, is_resume boolean, epoch long"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _known_hashes(spark: SparkSession, ledger_dir: str, epoch: int) -> DataFrame:
    try:
        led = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":     # anything but "no epoch written yet" is an error
            raise
        return spark.createDataFrame([], "hash_id string")
    return led.filter(F.col("epoch") < epoch).select("hash_id")


def _ingest_batch(batch: DataFrame, epoch: int, out_dir: str, name_col: str, text_col: str,
                  created_col: str | None = None) -> None:
    """One micro-batch: outcome against the ledger of earlier epochs, then the epoch's sinks."""
    started = time.time()
    s = batch.sparkSession
    known = _known_hashes(s, f"{out_dir}/ledger", epoch)
    obs = Observation(f"ingest_{epoch}")
    o = F.col("outcome")
    out = (I.ingest_outcome(batch, known, name_col=name_col, text_col=text_col, created_col=created_col)
            .withColumn("epoch", F.lit(epoch).cast("long"))
            .observe(obs, F.count(F.lit(1)).alias("files"),
                     F.count_if(o == I.DUPLICATE).alias("duplicates"),
                     F.count_if((o == I.KEPT) & F.col("is_resume")).alias("resumes"),
                     F.count_if(o == I.UNPROCESSED).alias("unprocessed")))
    # One job computes the outcome; the ledger and counters are read from its output.
    more = [c for c in ("contact_info", "created_time", "path") if c in out.columns]
    (out.select(name_col, "outcome", "hash_id", "is_resume", "content", *more, "epoch")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch")
        .parquet(f"{out_dir}/outcome"))
    written = s.read.parquet(f"{out_dir}/outcome").filter(F.col("epoch") == epoch)
    (written.filter(F.col("outcome") == I.KEPT)
            .select(F.col(name_col).alias("file_name"), "hash_id", "is_resume", "epoch")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch")
            .parquet(f"{out_dir}/ledger"))
    m = obs.get
    elapsed = time.time() - started
    (s.createDataFrame([(epoch, m["files"], m["duplicates"], m["resumes"], m["unprocessed"], elapsed)],
                       "epoch long, files long, duplicates long, resumes long, unprocessed long, "
                       "seconds double")
      .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch")
      .parquet(f"{out_dir}/metrics"))


def _start(stream: DataFrame, per_batch, checkpoint_dir: str, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def ingest_stream(spark: SparkSession, source_dir: str, source_schema, out_dir: str,
                  checkpoint_dir: str, *, max_files_per_trigger: int = 1,
                  name_col: str = "file_name", text_col: str = "text",
                  available_now: bool = True) -> StreamingQuery:
    """Extracted-text records arriving as Parquet files; outputs under ``out_dir``:
    ledger/, outcome/, metrics/ (all partitioned by epoch)."""
    src = (spark.readStream.schema(source_schema)
                .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    return _start(src, lambda b, e: _ingest_batch(b, e, out_dir, name_col, text_col),
                  checkpoint_dir, available_now)


def ingest_file_stream(spark: SparkSession, folder: str, out_dir: str, checkpoint_dir: str, *,
                       max_files_per_trigger: int = 1000, pdf_extractors=(), doc_extractors=(),
                       available_now: bool = True) -> StreamingQuery:
    """S1 on raw documents: a ``binaryFile`` stream picks up only files not seen before.

    Each micro-batch (at most ``max_files_per_trigger`` files, the reference's
    batch of 1000) keeps the supported suffixes, extracts text like
    ``ingest_folder`` and runs the same per-batch ingest as ``ingest_stream``.
    """
    from papyra.functions.names import file_basename
    from papyra.operators.ingest import has_supported_extension
    from papyra.plans.ingest_plan import extracted_text

    src = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
                .option("recursiveFileLookup", True)
                .option("maxFilesPerTrigger", max_files_per_trigger).load(folder))

    def per_batch(batch: DataFrame, epoch: int) -> None:
        files = (batch.withColumn("file_name", file_basename("path"))
                      .filter(has_supported_extension("file_name")))
        with_text = extracted_text(files, list(pdf_extractors), list(doc_extractors)).drop("content")
        _ingest_batch(with_text, epoch, out_dir, "file_name", "text", created_col="modificationTime")

    return _start(src, per_batch, checkpoint_dir, available_now)


def stream_dedup(spark: SparkSession, source_dir: str, source_schema, out_dir: str, checkpoint_dir: str,
                 text_col: str = "text", watermark: tuple[str, str] | None = None,
                 max_files_per_trigger: int = 1000) -> StreamingQuery:
    """First occurrence of every content hash across the whole stream.

    Without a watermark the hash state grows with the number of distinct
    documents (exact, like the reference's ever-growing set); with one,
    ``dropDuplicatesWithinWatermark`` bounds the state to the horizon.  The state lies in RocksDB
    on the executors' disks, with its changes in the checkpoint, not in their memory.
    """
    for key, value in STATE_STORE.items():            # read when the query starts
        spark.conf.set(key, value)
    src = spark.readStream.schema(source_schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    h = src.withColumn("hash_id", F.md5(F.col(text_col)))
    if watermark:
        h = h.withWatermark(*watermark).dropDuplicatesWithinWatermark(["hash_id"])
    else:
        h = h.dropDuplicates(["hash_id"])
    return (h.select("hash_id").writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def batch_metrics(spark: SparkSession, out_dir: str) -> DataFrame:
    """S3: per-epoch counters observed while the stream ran, with running totals."""
    from papyra.plans.ordinal import running_sums

    m = spark.read.parquet(f"{out_dir}/metrics")
    dense = m.withColumn("batch_index", F.col("epoch") + 1)
    return running_sums(dense, "batch_index", ["files", "duplicates", "resumes", "unprocessed", "seconds"],
                        prefix="total_")


def throughput_eta(metrics: DataFrame, total_files) -> DataFrame:
    """Files per second and estimated seconds left after each batch."""
    from papyra.functions.scoring import eta_seconds, throughput

    return metrics.select("epoch", "total_files", "total_seconds",
                          throughput("total_files", "total_seconds").alias("files_per_second"),
                          eta_seconds(total_files, "total_files", "total_seconds").alias("eta_seconds"))
