"""Incremental bookkeeping: what is already done, what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pending_documents(docs: DataFrame, done_names: DataFrame, name_col: str = "document_name") -> DataFrame:
    """Documents not yet successfully processed (failed ones are retried)."""
    return docs.join(done_names.select(name_col).distinct(), name_col, "left_anti")


def pending_files(files: DataFrame, processed: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Files whose name is not in the processed list."""
    return files.join(processed.select(name_col).distinct(), name_col, "left_anti")


def distinct_hashes(ledger: DataFrame, hash_col: str = "hash_id") -> DataFrame:
    """the set of known hashes."""
    return ledger.select(hash_col).dropna().distinct()


def union_ledgers(known: DataFrame, new: DataFrame, hash_col: str = "hash_id") -> DataFrame:
    """Known hashes plus the hashes kept in this run, as a set."""
    return known.select(hash_col).unionByName(new.select(hash_col)).dropna().distinct()


def merge_lists(*lists: DataFrame) -> DataFrame:
    """Concatenate per-batch name lists (duplicates kept, like list.extend)."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out
