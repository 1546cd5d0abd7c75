"""Inputs that real files hold: bad bytes, quotes in names, dotted names, repeated ids."""

import csv
import os

from pyspark.sql import functions as F

from papyra.functions.names import swap_extension
from papyra.operators.vectors import upsert_points
from papyra.plans.ingest_plan import extracted_text
from papyra.sources import readers


def test_swap_extension_is_splitext(spark):
    names = ["a..b", "a...", ".rc", "..x", "d.d/a", "d/a.b.c", "a", "x.y/.rc"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(swap_extension("n")).collect()]
    assert got == [os.path.splitext(n)[0] + ".parquet" for n in names]


def test_upsert_keeps_one_row_per_id(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, version int")
    rows = upsert_points(old, new, version_col="version").collect()
    assert sorted((r["id"], r["v"]) for r in rows) == [(1, "a"), (2, "d"), (3, "e")]
    assert upsert_points(old, new).count() == 3


def test_bad_bytes_leave_one_file_without_text(spark):
    df = spark.createDataFrame([("a.html", bytearray(b"<p>caf\xe9</p>")), ("b.html", bytearray("<p>café</p>", "utf8"))],
                               "file_name string, content binary")
    got = {r["file_name"]: r["text"] for r in extracted_text(df).select("file_name", "text").collect()}
    assert got["a.html"] is None and "café" in got["b.html"]


def test_ledgers_written_by_csv_modules(spark, tmp_dir):
    name = 'J "JD", Doe\n2.pdf'
    with open(os.path.join(tmp_dir, "l.csv"), "w", newline="") as f:
        w = csv.writer(f)
        w.writerows([[c for c in readers.S.STATUS_LEDGER.fieldNames()],
                     [name if c == "document_name" else "success" for c in readers.S.STATUS_LEDGER.fieldNames()]])
    rows = readers.read_status_ledger(spark, tmp_dir).where(F.col("status") == "success").collect()
    assert [r["document_name"] for r in rows] == [name]
