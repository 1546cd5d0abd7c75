"""Sources (2.1): file listings, doc-map JSON, ledgers, vector tables.

Every reader declares its schema; nothing is inferred or collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import lexicons as L
from papyra import schemas as S
from papyra.functions.names import file_basename, plain_path

_EXT_RE = r"(?i)\.(" + "|".join(e.lstrip(".").replace(".", r"\.") for e in L.SUPPORTED_EXTENSIONS) + r")$"


# -- A1 / A2 ------------------------------------------------------------------
def _parent_is(path_col: str, base: str):
    """File sits directly in ``base``, whatever the form of either path."""
    if "://" not in base and not base.startswith("file:"):
        import os
        base = os.path.abspath(base)
    parent = F.regexp_replace(plain_path(path_col), r"/[^/]*$", "")
    return parent == F.regexp_replace(plain_path(F.lit(base)), "/+$", "")


def scan_files(spark: SparkSession, path: str, recursive: bool = False, with_content: bool = True) -> DataFrame:
    """Supported documents under ``path`` (case-insensitive suffix), as binary rows.

    ``pathGlobFilter`` is case-sensitive, so the suffix test is a column filter.
    The listing always uses ``recursiveFileLookup`` (no partition inference, so
    arbitrary sub-folders are fine); the flat variant keeps files directly in
    ``path``.  Without ``with_content`` the content column is pruned from the scan.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
               .withColumn("file_name", file_basename("path")))
    df = df.filter(F.col("file_name").rlike(_EXT_RE))
    if not recursive:
        df = df.filter(_parent_is("path", path))
    cols = ["path", "file_name", "modificationTime", "length"] + (["content"] if with_content else [])
    return df.select(*cols)


def list_all_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Every file under ``path`` (no suffix filter), content included."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
               .withColumn("file_name", file_basename("path")))
    return df if recursive else df.filter(_parent_is("path", path))


# -- A9 -----------------------------------------------------------------------
def list_files(spark: SparkSession, path: str, suffix: str, recursive: bool = False) -> DataFrame:
    """Names of the files under ``path`` ending in ``suffix`` (content pruned from the scan)."""
    df = list_all_files(spark, path, recursive).select("path", "file_name", "modificationTime", "length")
    return df.filter(F.col("file_name").endswith(suffix))


# -- A3 -----------------------------------------------------------------------
def scan_allowlist(files: DataFrame, allow: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Only listed names that exist; no extension filter (unsupported ones become unprocessed)."""
    return files.join(allow.select(name_col).distinct(), name_col, "left_semi")


# -- A4 -----------------------------------------------------------------------
def read_docmap(spark: SparkSession, path: str, partitioned: bool = False) -> DataFrame:
    """Doc-map JSON files ``{file_name: record}`` -> one row per record.

    Each file is one value (a flush batch, bounded by the flush size).  A file
    that does not parse yields one row with ``error`` set and no key.  With
    ``partitioned`` the ``run=.../batch_index=...`` folders become partition
    columns, so a join on them prunes files at run time (point lookups).
    """
    r = spark.read.option("wholetext", True)
    if not partitioned:
        r = r.option("recursiveFileLookup", True)
    raw = r.text(path)
    parts = [c for c in ("run", "batch_index") if partitioned and c in raw.columns]
    raw = raw.select(F.col("_metadata.file_path").alias("source_file"), *parts,
                     F.from_json("value", S.DOCMAP).alias("m"))
    rows = raw.select("source_file", *parts, F.explode_outer("m").alias("key", "r"),
                      F.col("m").isNull().alias("_bad"))
    ci = F.col("r.contact_info")
    phones = F.transform(ci["phone_numbers"], lambda p: F.struct(
        F.coalesce(p[0], F.lit("")).alias("country"), F.coalesce(p[1], F.lit("")).alias("area"),
        F.coalesce(p[2], F.lit("")).alias("prefix"), F.coalesce(p[3], F.lit("")).alias("line")))
    return rows.select(
        "source_file", *parts, "key",
        F.col("r.content").alias("content"), F.col("r.is_resume").alias("is_resume"),
        F.when(ci.isNotNull(), F.struct(ci["emails"].alias("emails"), phones.alias("phone_numbers"),
                                        ci["linkedin"].alias("linkedin"), ci["github"].alias("github"),
                                        ci["urls"].alias("urls"))).alias("contact_info"),
        F.col("r.created_time").alias("created_time"), F.col("r.hash_id").alias("hash_id"),
        F.when(F.col("_bad"), F.lit("malformed doc-map file")).alias("error"))


# -- A5 -----------------------------------------------------------------------
def read_hash_ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """All ledger CSV rows under ``path`` (header skipped, schema fixed)."""
    return (spark.read.schema(S.HASH_LEDGER).option("header", True)
                 .option("escape", '"').option("multiLine", True)
                 .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path))


def read_hash_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Known hashes: distinct non-null values of the second column."""
    return read_hash_ledger_rows(spark, path).select(F.col("Hash ID").alias("hash_id")).dropna().distinct()


# -- A6 -----------------------------------------------------------------------
def read_status_ledger(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(S.STATUS_LEDGER).option("header", True)
                 .option("escape", '"').option("multiLine", True)
                 .option("recursiveFileLookup", True).csv(path))


def read_success_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Names whose status is 'success'; 'fail' rows are retried."""
    return (read_status_ledger(spark, path).filter(F.col("status") == "success")
            .select("document_name").distinct())


# -- A7 / A12 -----------------------------------------------------------------
def read_line_list(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Headerless one-value-per-line files; no line is skipped."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias(name))


# -- A8 / A10 / A11 -----------------------------------------------------------
def read_corpus_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored points (id, vector array<float>, payload)."""
    return spark.read.schema(S.POINT).parquet(path)


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


# -- F3 -----------------------------------------------------------------------
def csv_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Data rows per CSV file under ``path`` (header-only files count 0) plus a total row.

    The listing comes from a content-pruned ``binaryFile`` scan so empty files
    still appear; the counts are a distributed aggregate over ``_metadata``.
    """
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                    .option("pathGlobFilter", "*.csv").load(path).select(plain_path("path").alias("path")))
    rows = (spark.read.option("header", True).option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "*.csv").csv(path)
                 .select(plain_path("_metadata.file_path").alias("path"))
                 .groupBy("path").agg(F.count(F.lit(1)).alias("rows")))
    per_file = (listing.join(rows, "path", "left")
                       .select("path", F.coalesce("rows", F.lit(0)).alias("rows")))
    return (per_file.rollup("path")
                    .agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files")))
