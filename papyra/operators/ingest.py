"""Ingest operators: routing, ledger dedup, per-document outcome, run summary,
in-run duplicate groups, flush batches and per-batch counters.

Input shape for ``ingest_outcome``: one row per listed file with at least a
file name and its extracted text (null when every extractor failed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType, StringType

from papyra import lexicons as L
from papyra.functions import text as T
from papyra.plans.ordinal import global_ordinal, running_sums

KEPT, DUPLICATE, UNPROCESSED = "kept", "duplicate", "unprocessed"


# -- C1 -----------------------------------------------------------------------
def route_by_extension(name) -> Column:
    """Extractor family from the lower-cased suffix: pdf / doc / html / unsupported."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    return (F.when(n.endswith(".pdf"), "pdf")
             .when(n.endswith(".doc") | n.endswith(".docx"), "doc")
             .when(n.endswith(".html"), "html")
             .otherwise("unsupported"))


def has_supported_extension(name, extensions=None) -> Column:
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    cond = F.lit(False)
    for ext in (extensions or L.SUPPORTED_EXTENSIONS):
        cond = cond | n.endswith(ext)
    return cond


# -- E1 -----------------------------------------------------------------------
def _spread_nulls(df: DataFrame, hash_col: str) -> Column:
    """A number of the hash, or of the whole row where there is none.

    As a second join key it deals rows without a hash, which match nothing, over all tasks; by the
    hash alone they are one group.  It follows from the row, so a task that is run again deals alike.
    """
    own = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, (StringType, NumericType, DatetimeType))]
    h = F.col(f"`{hash_col}`")
    return F.when(h.isNotNull(), F.xxhash64(h)).otherwise(F.xxhash64(*own))


def mark_known_hashes(df: DataFrame, ledger_hashes: DataFrame, hash_col: str = "hash_id",
                      flag: str = "in_ledger") -> DataFrame:
    """Flag rows whose hash is already in the ledger (one left join, no second scan).

    The ledger is reduced to distinct hashes first (map-side partial aggregate),
    so a hash repeated across many ledger files never multiplies rows.  AQE
    broadcasts the ledger when its runtime size is small and splits skewed
    hash partitions otherwise.  Rows without a hash are dealt by their other columns.
    """
    known = (ledger_hashes.select(F.col(hash_col).alias("_known")).dropna()
             .withColumn("_none", F.xxhash64("_known")).distinct().withColumn(flag, F.lit(True)))
    own = df.withColumn("_spread", _spread_nulls(df, hash_col))
    out = (own.join(known, (own[hash_col] == known["_known"]) & (own["_spread"] == known["_none"]), "left")
              .drop("_known", "_none", "_spread"))
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def dedup_vs_ledger(df: DataFrame, ledger_hashes: DataFrame, hash_col: str = "hash_id") -> DataFrame:
    """Rows whose hash is new (left anti join)."""
    known = ledger_hashes.select(F.col(hash_col)).dropna().distinct()
    return df.join(known, hash_col, "left_anti")


def duplicates_vs_ledger(df: DataFrame, ledger_hashes: DataFrame, hash_col: str = "hash_id") -> DataFrame:
    known = ledger_hashes.select(F.col(hash_col)).dropna().distinct()
    return df.join(known, hash_col, "left_semi")


# -- F8 -----------------------------------------------------------------------
def duplicate_groups(df: DataFrame, key_col: str, hash_col: str = "hash_id",
                     min_copies: int = 2) -> DataFrame:
    """Exact-duplicate groups: hash, number of copies, keeper (= lowest key).

    A plain aggregate, so Spark combines map-side: a hash holding a third of
    all rows still sends one partial row per task through the shuffle.
    """
    return (df.groupBy(hash_col)
              .agg(F.count(F.lit(1)).alias("copies"), F.min(key_col).alias("keeper"))
              .filter(F.col("copies") >= min_copies))


def mark_in_run_duplicates(df: DataFrame, key_col: str, hash_col: str = "hash_id",
                           flag: str = "in_run_duplicate") -> DataFrame:
    """Flag every row that is not the keeper (lowest key) of its hash group."""
    own = df.withColumn("_spread", _spread_nulls(df, hash_col))
    keepers = (own.where(F.col(hash_col).isNotNull()).groupBy(hash_col, "_spread")
               .agg(F.min(key_col).alias("_keeper")))
    out = own.join(keepers, [hash_col, "_spread"], "left")
    return out.withColumn(flag, F.col(key_col) != F.col("_keeper")).drop("_keeper", "_spread")


# -- C7 -----------------------------------------------------------------------
def ingest_outcome(files: DataFrame, ledger_hashes: DataFrame, *, name_col: str = "file_name",
                   text_col: str = "text", key_col: str | None = None, classifier: str = "v1",
                   in_run_dedup: bool = False, created_col: str | None = None) -> DataFrame:
    """One row per input file with ``outcome`` in kept / duplicate / unprocessed.

    Order of work mirrors the reference and saves cost at scale: route, hash
    the raw text, drop ledger duplicates, and only then clean, extract contacts
    and classify (those expressions are evaluated for kept rows only).
    """
    kind = route_by_extension(name_col)
    d = (files.withColumn("kind", kind)
              .withColumn("hash_id", F.when((F.col("kind") != "unsupported") & F.col(text_col).isNotNull(),
                                            T.content_hash(text_col))))
    d = mark_known_hashes(d, ledger_hashes, "hash_id", "in_ledger")
    dup = F.col("in_ledger")
    if in_run_dedup:
        d = mark_in_run_duplicates(d.withColumn("_k", F.col(key_col or name_col)), "_k", "hash_id")
        dup = dup | F.coalesce(F.col("in_run_duplicate"), F.lit(False))
    outcome = (F.when(F.col("hash_id").isNull(), F.lit(UNPROCESSED))
                .when(dup, F.lit(DUPLICATE))
                .otherwise(F.lit(KEPT)))
    d = d.withColumn("outcome", outcome)
    kept = F.col("outcome") == KEPT
    content = F.when(kept, T.clean_text(text_col))
    d = d.withColumn("content", content)
    classify = T.is_resume_v1 if classifier == "v1" else T.is_resume_v2
    d = (d.withColumn("is_resume", F.when(kept, classify(F.col("content"))))
          .withColumn("contact_info", F.when(kept, T.contact_info(F.col("content")))))
    if created_col:
        from papyra.functions.names import iso_timestamp
        d = d.withColumn("created_time", F.when(kept, iso_timestamp(created_col)))
    drop = [c for c in ("in_ledger", "in_run_duplicate", "_k") if c in d.columns]
    return d.drop(*drop)


# -- F1 -----------------------------------------------------------------------
def run_summary(outcome: DataFrame) -> DataFrame:
    """Counters of one ingest run as a single row (a global aggregate, map-side combined).

    Every row of ``outcome`` counts; a folder run lists supported suffixes only, an allow-list
    run any name.  The name lists of duplicate and unprocessed files are *not* gathered into
    this row (they are unbounded); ``outcome_names`` returns them as rows.
    """
    o = F.col("outcome")
    return outcome.agg(
        F.count(F.lit(1)).alias("total_files_processed"),
        F.count_if(o == DUPLICATE).alias("total_duplicates_count"),
        F.count_if((o == KEPT) & F.col("is_resume")).alias("total_resumes_detected"),
        F.count_if(o == UNPROCESSED).alias("unprocessed_documents_count"),
    )


def outcome_names(outcome: DataFrame, which: str, name_col: str = "file_name", extra=()) -> DataFrame:
    """The duplicate or unprocessed file names of a run, one per row."""
    return outcome.filter(F.col("outcome") == which).select(name_col, *extra)


# -- B12 ----------------------------------------------------------------------
def assign_batches(df: DataFrame, order_cols: list[str], batch_size: int,
                   name: str = "batch_index") -> DataFrame:
    """1-based flush batch of each row: floor(position / batch_size) + 1 in ``order_cols`` order.

    Every row has a position of its own, also rows with equal or null order columns.
    """
    d = global_ordinal(df, order_cols, "_ord")
    return d.withColumn(name, (F.floor(F.col("_ord") / F.lit(batch_size)) + 1).cast("long")).drop("_ord")


# -- F2 -----------------------------------------------------------------------
def batch_counters(outcome: DataFrame, batch_col: str = "batch_index") -> DataFrame:
    """Per-batch counters plus running totals over batches."""
    o = F.col("outcome")
    per = outcome.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(o == DUPLICATE).alias("duplicates"),
        F.count_if((o == KEPT) & F.col("is_resume")).alias("resumes"),
        F.count_if(o == UNPROCESSED).alias("unprocessed"),
    )
    return running_sums(per, batch_col, ["files", "duplicates", "resumes", "unprocessed"], prefix="total_")
