"""Page assembly (F5) and per-document vector grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_pages(pages: DataFrame, doc_col: str, order_col: str, text_col: str,
                   sep: str = "\n", out_col: str = "text") -> DataFrame:
    """Join the page texts of each document in page order.

    The gathered group is one document's pages, which is exactly the size of
    the assembled output row; no group larger than its own result is built.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
    return (pages.groupBy(doc_col)
                 .agg(F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias(out_col)))


def vectors_per_document(points: DataFrame, doc_col: str = "document_name",
                         order_col: str = "chunk_index", vector_col: str = "vector") -> DataFrame:
    """all chunk vectors of a document, in chunk order (one document's vectors per row)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("i"), F.col(vector_col).alias("v"))))
    return (points.groupBy(doc_col)
                  .agg(F.transform(ordered, lambda x: x["v"]).alias("vectors"),
                       F.size(ordered).alias("n_vectors")))
