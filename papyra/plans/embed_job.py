"""The embed job: document records -> chunks -> vectors -> points.

``resume_points`` is the plain plan; ``embed_run`` the job that can be stopped and run again.

Html keys and non-resumes are skipped by default; the two filters are flags
because one reference variant embeds every record.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.embedding import bucket_counts, hashing_embedding
from papyra.operators import chunking as CH
from papyra.operators import routing as R
from papyra.operators import vectors as VO
from papyra.session import scratch_dir
from papyra.sinks import writers as W
from papyra.sinks.point_store import PointCollection
from papyra.sources import readers as SR

EMBED_DIM = 64


def resume_points(records: DataFrame, skip_html: bool = True, resumes_only: bool = True,
                  dim: int = EMBED_DIM) -> DataFrame:
    recs = records
    if skip_html:
        recs = R.exclude_html_keys(recs)
    if resumes_only:
        recs = R.resume_only(recs)
    chunks = CH.chunk_documents(recs, "content", ["key"])
    chunks = (chunks.withColumn("document_name", F.concat("key", F.lit(".npz")))
                    .withColumn("vector", hashing_embedding("chunk_text", dim)))
    return VO.to_points(chunks, "document_name", "chunk_index", "vector", "chunk_text", keep=("chunk_index",))


# -- the restartable job (A6, E2, B5, B7) --------------------------------------
ATTEMPT = ("document_name STRING, status STRING, error_message STRING, "
           "chunks ARRAY<STRUCT<chunk_index: INT, chunk_text: STRING, vector: ARRAY<FLOAT>>>")
_ARROW = pa.schema([("document_name", pa.string()), ("status", pa.string()), ("error_message", pa.string()),
                    ("chunks", pa.list_(pa.struct([("chunk_index", pa.int32()), ("chunk_text", pa.string()),
                                                   ("vector", pa.list_(pa.float32()))])))])
_FLUSH = 64                      # documents per Arrow batch of results


def default_encoder() -> Callable[[list[str]], np.ndarray]:
    return lambda texts: bucket_counts(texts, EMBED_DIM)


def embed_attempts(records: DataFrame, make_encoder: Callable = default_encoder, dim: int = EMBED_DIM,
                   key_col: str = "key", text_col: str = "content") -> DataFrame:
    """One row per document: its chunks with vectors, or ``fail`` and why; a failure stays in its row.

    The encoder is built once per task.  A document fails as a whole: without content, or when
    the encoder raises or answers with another count, another dimension or a non-finite number.
    """
    def run(batches):
        encode = make_encoder()

        def attempt(text):
            if text is None:
                raise ValueError("no content")
            texts = CH.split_text(text)
            vectors = np.asarray(encode(texts), np.float32) if texts else np.zeros((0, dim), np.float32)
            if vectors.shape != (len(texts), dim) or not np.isfinite(vectors).all():
                raise ValueError(f"encoder gave {vectors.shape} for {len(texts)} chunks of {dim}")
            return [{"chunk_index": i, "chunk_text": t, "vector": v} for i, (t, v) in enumerate(zip(texts, vectors, strict=True))]

        for b in batches:
            for at in range(0, b.num_rows, _FLUSH):
                rows = []
                for name, text in zip(*(c.to_pylist() for c in b.slice(at, _FLUSH).columns), strict=True):
                    try:
                        rows.append((name, "success", "", attempt(text)))
                    except Exception as e:  # noqa: BLE001  whatever an encoder raises concerns this document only
                        rows.append((name, "fail", f"{type(e).__name__}: {e}", []))
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)

    return records.select(key_col, text_col).mapInArrow(run, ATTEMPT)


def embed_run(records: DataFrame, collection: PointCollection, ledger: str, *, make_encoder: Callable = default_encoder,
              skip_html: bool = True, resumes_only: bool = True) -> dict[str, int]:
    """Embed what the status ledger does not yet name as a success; counts by status.

    Attempts are written once, then the vectors are committed to the collection, then the
    statuses are appended.  Point ids follow from document and chunk, so a run that was stopped
    between the two is made good by the next one: the same points again, then their status.
    Points of a document that a further attempt no longer makes are deleted.  Failed documents
    are tried again by every run; a name that stands twice is embedded once, with its greatest text.
    """
    spark = records.sparkSession
    if skip_html:
        records = R.exclude_html_keys(records)
    if resumes_only:
        records = R.resume_only(records)
    done = success_or_none(spark, ledger)
    pending = records.where("key IS NOT NULL").groupBy("key").agg(F.max("content").alias("content"))
    if done is not None:
        pending = pending.join(done.withColumnRenamed("document_name", "key"), "key", "left_anti")
    at = scratch_dir(spark, "embedded")
    embed_attempts(pending, make_encoder, collection.manifest()["dim"]).write.parquet(at)
    tried = spark.read.schema(ATTEMPT).parquet(at)
    counts = {r["status"]: r["count"] for r in tried.groupBy("status").count().collect()}
    if counts.get("success"):
        chunks = tried.where("status = 'success'").select(
            F.concat("document_name", F.lit(".npz")).alias("stored"), F.inline("chunks"))
        points = VO.to_points(chunks, "stored", "chunk_index", "vector", "chunk_text")
        own = collection.points().select("id", F.col("payload.document_name").alias("stored"))
        stale = (own.join(chunks.select("stored").distinct(), "stored", "left_semi")
                 .join(points.select("id"), "id", "left_anti").select("id"))
        collection.upsert(points)
        if not stale.isEmpty():
            collection.delete(stale)
    if counts:
        W.append_status_ledger(tried, ledger)
    return {"success": counts.get("success", 0), "fail": counts.get("fail", 0)}


def success_or_none(spark: SparkSession, ledger: str) -> DataFrame | None:
    """Names that the ledger calls a success; None before the first run, an error for anything but a missing path."""
    try:
        return SR.read_success_ledger(spark, ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
