"""Projections, filters and extractor fallback rules (2.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.vectors import has_dim


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def first_success_nonempty(*candidates) -> Column:
    """C2 (PDF rule): the first candidate with non-empty text; null when all fail or are empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in candidates])


def first_success(*candidates) -> Column:
    """C3 (DOC rule): the first candidate that did not fail (null); empty text is accepted."""
    return F.coalesce(*[_c(c) for c in candidates])


def exclude_html_keys(df: DataFrame, key_col: str = "key") -> DataFrame:
    """C4: drop records whose key contains '.html' anywhere (case-sensitive)."""
    return df.filter(~F.col(key_col).contains(".html"))


def resume_only(df: DataFrame, flag_col: str = "is_resume") -> DataFrame:
    """Keep resumes; a missing flag counts as false instead of aborting the file."""
    return df.filter(F.coalesce(F.col(flag_col), F.lit(False)))


def project_defaults(df: DataFrame, cols=("key", "content", "hash_id"), key_col: str = "key") -> DataFrame:
    """Fixed columns; a missing or null field becomes ''."""
    return df.select(*[F.col(c) if c == key_col else F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols])


def project_hits(hits: DataFrame, keep=()) -> DataFrame:
    """Payload fields and score of search hits."""
    return hits.select(*keep, "payload.text_id", "payload.text", "payload.document_name", "score")


def split_by_dim(points: DataFrame, dim: int, vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by the collection's fixed dimension; rejects go to quarantine."""
    ok = has_dim(vector_col, dim)
    return points.filter(ok), points.filter(~ok | ok.isNull())
