"""Match scoring, score parsing and rate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import lexicons as L


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def term_coverage(query_terms, doc_terms) -> Column:
    """|query ∩ doc| / |query| over distinct terms; 0 when the query list is empty."""
    q = F.array_distinct(_c(query_terms))
    return F.when(F.size(q) > 0,
                  F.size(F.array_intersect(q, _c(doc_terms))) / F.size(q)).otherwise(F.lit(0.0))


def weighted_match_score(skills, experience, projects, education, doc_terms,
                         weights=None) -> Column:
    """Rubric score in [0, 100]: skills 40, experience 30, projects 20, education 10."""
    w = weights or L.MATCH_WEIGHTS
    s = (F.lit(w["skills"]) * term_coverage(skills, doc_terms)
         + F.lit(w["experience"]) * term_coverage(experience, doc_terms)
         + F.lit(w["projects"]) * term_coverage(projects, doc_terms)
         + F.lit(w["education"]) * term_coverage(education, doc_terms))
    return s * F.lit(100.0)


def overall_score_numeric(col) -> Column:
    """'85%' -> 85.0; anything without a number -> 0.0."""
    num = F.regexp_extract(_c(col), r"(\d+(\.\d+)?)", 1)
    return F.coalesce(num.try_cast("double"), F.lit(0.0))


def throughput(done, elapsed_seconds) -> Column:
    """Files per second; null while no time has elapsed."""
    e = _c(elapsed_seconds)
    return F.when(e > 0, _c(done) / e)


def eta_seconds(total, done, elapsed_seconds) -> Column:
    """Remaining files divided by the current rate; null when the rate is unknown or zero."""
    rate = throughput(done, elapsed_seconds)
    return F.when(rate > 0, (_c(total) - _c(done)) / rate)
