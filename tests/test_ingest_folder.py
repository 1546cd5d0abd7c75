"""End-to-end file ingest from a folder of documents (temp dir)."""

import hashlib
import os

from pyspark.sql import functions as F

from papyra.plans.ingest_plan import ingest_folder
from papyra.sinks import writers as W
from papyra.sources import readers as SR
from papyra.operators import ingest as I

PAGE = ("<html><head><title>Jane Doe</title><style>p{}</style></head><body><p>Resume</p>"
        "<p>Software engineer since 2019 &amp; more</p><p>jane@example.org</p></body></html>")


def _folder(base):
    os.makedirs(os.path.join(base, "sub"))
    files = {"a.html": PAGE, "B.HTML": PAGE, "c.pdf": "%PDF fake", "d.txt": "plain", "sub/e.html": "<p>other</p>"}
    for name, body in files.items():
        with open(os.path.join(base, name), "w") as f:
            f.write(body)
    return files


def test_ingest_folder_outcomes_and_rerun(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    _folder(src)
    empty = spark.createDataFrame([], "hash_id string")
    # the pdf "extractor" reads the bytes as text; an empty result would fall through
    pdf = [lambda c: F.nullif(F.decode(c, "UTF-8"), F.lit(""))]
    out = ingest_folder(spark, src, empty, recursive=True, pdf_extractors=pdf, in_run_dedup=True)
    got = {r.file_name: r for r in out.collect()}
    assert set(got) == {"a.html", "B.HTML", "c.pdf", "sub/e.html".split("/")[-1]}     # d.txt is not listed
    text = "Jane Doe\nResume\nSoftware engineer since 2019 & more\njane@example.org"
    assert got["a.html"].hash_id == hashlib.md5(text.encode()).hexdigest()
    assert {got["a.html"].outcome, got["B.HTML"].outcome} == {"kept", "duplicate"}   # in-run copy
    kept = got["a.html"] if got["a.html"].outcome == "kept" else got["B.HTML"]
    assert kept.is_resume and kept.contact_info.emails == ["jane@example.org"]
    assert kept.created_time is not None and got["c.pdf"].outcome == "kept"
    # write the ledger, ingest again: nothing is kept the second time
    led = os.path.join(tmp_dir, "csv")
    W.write_hash_ledger(out, led)
    again = ingest_folder(spark, src, SR.read_hash_ledger(spark, led), recursive=True, pdf_extractors=pdf)
    assert again.filter("outcome = 'kept'").count() == 0


def test_allowlist_processes_unsupported_as_unprocessed(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    _folder(src)
    allow = spark.createDataFrame([("a.html",), ("d.txt",), ("missing.pdf",)], "file_name string")
    out = ingest_folder(spark, src, spark.createDataFrame([], "hash_id string"), allow=allow)
    got = {r.file_name: r.outcome for r in out.collect()}
    assert got == {"a.html": "kept", "d.txt": "unprocessed"}
    s = I.run_summary(out).first()
    assert s.total_files_processed == 2 and s.unprocessed_documents_count == 1
