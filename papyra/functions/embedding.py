"""Text embedding (D22): a built-in hashing embedding plus a model-agnostic hook.

The built-in default needs no model weights: tokens of the cleaned,
lower-cased text are hashed into ``dim`` buckets (first 32 bits of the token's
md5), counted, and the count vector is the embedding (cosine normalises it).
The hash is plain md5, so any SQL engine can reproduce the vectors; Spark
computes them over Arrow batches (O(tokens) per text).  A real encoder plugs
in through ``embed_with_model``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def token_buckets(col, dim: int) -> Column:
    """Bucket id of every token (JVM expression form of the embedding's hash)."""
    toks = F.split(F.lower(_c(col)), " ")
    return F.transform(toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"),
                                                F.lit(dim)))


def bucket_counts(texts, dim: int):
    """Dense token-count vectors of a batch of texts (numpy, float32, shape (n, dim))."""
    import hashlib

    import numpy as np

    out = np.zeros((len(texts), dim), dtype=np.float32)
    rows, cols = [], []
    for r, t in enumerate(texts):
        if t is None:
            continue
        for tok in t.lower().split(" "):
            rows.append(r)
            cols.append(int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim)
    if rows:
        np.add.at(out, (np.asarray(rows), np.asarray(cols)), 1.0)
    return out


def hashing_embedding(col, dim: int = 64) -> Column:
    """``array<float>`` of token counts per md5 bucket (empty text -> one empty token).

    Evaluated over Arrow batches: one md5 per token and one scatter-add per
    batch, O(tokens), where the equivalent SQL form (``token_buckets`` + a
    count per bucket) costs O(tokens x dim) in interpreted lambdas.
    """
    @F.pandas_udf("array<float>")
    def _embed(texts: pd.Series) -> pd.Series:
        m = bucket_counts(texts.tolist(), dim)
        return pd.Series(list(m))

    return _embed(_c(col))


def embed_with_model(df: DataFrame, text_col: str, out_col: str, make_model: Callable,
                     dim: int, batch_size: int = 64) -> DataFrame:
    """Run any batch encoder over Arrow batches; the model is built once per Python worker.

    ``make_model()`` returns ``f(np.ndarray[str]) -> np.ndarray[float32, (n, dim)]``.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(out_col, udf(F.col(text_col)))
