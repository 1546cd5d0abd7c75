"""Views derived from the driver tables, shared by queries, tests and oracles.

Every view keeps all rows of its source table; derived attributes (file
extension, planted resume text) are deterministic functions of each row, so
the work of every query grows with the tables.  The same expressions are
written once and used by both Spark (``selectExpr``) and DuckDB (SQL text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# File name and planted text.  Plain SQL expressions valid in Spark and DuckDB.
PLANTED_FILE_NAME = (
    "concat('doc_', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.pdf' "
    "WHEN 1 THEN '.DOCX' WHEN 2 THEN '.html' WHEN 3 THEN '.doc' ELSE '.txt' END)"
)
PLANTED_TEXT = (
    "concat(text, CASE doc_id % 8 "
    "WHEN 0 THEN concat(' Work Experience: software engineer at Acme Inc since 2019-05-01 "
    "https://www.linkedin.com/in/user-', CAST(doc_id AS STRING), ' https://github.com/user-', "
    "CAST(doc_id AS STRING), ' jane.', CAST(doc_id AS STRING), '@example.org +1 (212) 555-0147, 212.555.0148') "
    "WHEN 1 THEN ' CURRICULUM VITAE' "
    "WHEN 2 THEN ' senior developer' "
    "WHEN 3 THEN ' skills specialist at a company' "
    "WHEN 4 THEN ' academic background 2020-01-02 see http://example.org/a.b,' "
    "WHEN 5 THEN concat(' a', chr(160), chr(9), ' b', chr(10), chr(10), 'c', chr(92), 'u00a0d education') "
    "WHEN 6 THEN concat(' objective ', chr(233), '2020') "
    "ELSE '' END)"
)
PLANTED_SELECT = ["doc_id", "lang", "source", f"{PLANTED_FILE_NAME} AS file_name", f"{PLANTED_TEXT} AS text"]


def planted_sql() -> str:
    return "SELECT " + ", ".join(PLANTED_SELECT) + " FROM documents"


def docs_planted(documents: DataFrame) -> DataFrame:
    """Documents with a file name and resume/contact text planted by a fixed rule."""
    return documents.selectExpr(*PLANTED_SELECT)


def docs_named(documents: DataFrame) -> DataFrame:
    """Raw documents with the planted file name only (exact copies stay copies)."""
    return documents.selectExpr("doc_id", "lang", "source", f"{PLANTED_FILE_NAME} AS file_name", "text")


def prior_ledger(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Hash ledger of an earlier run: the documents that already carry labels."""
    seen = labels.select("doc_id")
    return (docs.join(seen, "doc_id", "left_semi")
                .select(F.md5(F.col(text_col)).alias("hash_id")).distinct())


PRIOR_LEDGER_SQL = "SELECT DISTINCT md5({t}.text) AS hash_id FROM {t} WHERE doc_id IN (SELECT doc_id FROM labels)"
