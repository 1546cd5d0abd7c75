"""File ingest end to end: listing -> extracted text -> outcome against the ledger.

The reference walks a folder, extracts text per file type, hashes, checks the
ledger, cleans, extracts contacts and classifies.  Here the folder is a
``binaryFile`` scan; HTML is decoded and reduced to text by the native
``html_to_text`` chain; PDF and DOC text comes from caller-supplied extractor
columns combined by the reference's fallback rules (first non-empty for PDF,
first that did not fail for DOC).  Binary document parsers are not part of
papyra; without extractors those files are ``unprocessed``, like a file whose
every extractor failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import html_to_text
from papyra.operators import ingest as I
from papyra.operators.routing import first_success, first_success_nonempty
from papyra.sources.readers import list_all_files, scan_allowlist, scan_files

Extractor = Callable[[Column], Column]        # binary content -> text (null on failure)


def extracted_text(files: DataFrame, pdf_extractors: list[Extractor] = (),
                   doc_extractors: list[Extractor] = ()) -> DataFrame:
    """Add ``text`` per routed kind; null when no extractor produced text."""
    kind = I.route_by_extension("file_name")
    content = F.col("content")
    # bytes that are no UTF-8 give null, so the file counts as unprocessed and the run goes on
    html = html_to_text(F.try_validate_utf8(content.cast("string")))
    pdf = first_success_nonempty(*[e(content) for e in pdf_extractors]) if pdf_extractors else F.lit(None)
    doc = first_success(*[e(content) for e in doc_extractors]) if doc_extractors else F.lit(None)
    text = (F.when(kind == "html", html).when(kind == "pdf", pdf).when(kind == "doc", doc)
             .otherwise(F.lit(None)).cast("string"))
    return files.withColumn("text", text)


def ingest_folder(spark: SparkSession, path: str, ledger_hashes: DataFrame, *, recursive: bool = False,
                  allow: DataFrame | None = None, pdf_extractors: list[Extractor] = (),
                  doc_extractors: list[Extractor] = (), classifier: str = "v1",
                  in_run_dedup: bool = False) -> DataFrame:
    """Outcome of every listed file (A1/A2 listing, or A3 allow-list without the suffix filter)."""
    if allow is None:
        files = scan_files(spark, path, recursive=recursive)
    else:
        files = scan_allowlist(list_all_files(spark, path, recursive), allow)
    with_text = extracted_text(files, list(pdf_extractors), list(doc_extractors)).drop("content")
    return I.ingest_outcome(with_text, ledger_hashes, classifier=classifier, in_run_dedup=in_run_dedup,
                            key_col="path", created_col="modificationTime")
