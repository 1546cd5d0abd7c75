"""Best-fit packing by sums of squares.

Documents are tokenized once where they lie; only (id, length, crc) of each piece
moves on.  A piece goes where the sum, over all residual gaps g, of the squared
number of open sequences with gap g becomes smallest, which may be a new
sequence.  Pieces of full length are sequences of their own.  The others are
dealt by hash into groups of bounded size, each packed in one task; a second
round packs the sequences that the groups left open, as units, in the same way.

Edge cases: null text is empty, an empty text is the end token alone, a text of
exactly the limit is one piece, longer ones are cut so that only the first piece
is shorter; repeated rows and null ids are packed like any others; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.session import cut_lineage

GROUP = 1 << 14        # pieces packed in one task
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SPECIAL = "<|endoftext|>"


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer file and the file with the same vocabulary as ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of the byte-level tokenizer file; ranks of the same vocabulary, where given, give them faster."""

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer
        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as lines:
                merged = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged,
                                          special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _SPECIAL in text:       # the ranks do not know the tokenizer's own token
            return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.fast.encode_ordinary(text)


def cut(ids: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = (len(ids) - 1) % limit + 1
    return [(0, first)] + [(at, limit) for at in range(first, len(ids), limit)]


def tokenized_pieces(docs: DataFrame, limit: int = 1024, end_id: int = 2, tokenizer: tuple[str, str | None] | None = None,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    files = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*files)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = np.array([*encoder.ids(text or ""), end_id], "<u4")
                rows += [(doc, i, at, n, zlib.crc32(tokens[at:at + n].tobytes()))
                         for i, (at, n) in enumerate(cut(tokens, limit))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, _PIECES)


def pack(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order."""
    open_by_gap: list[list[int]] = [[] for _ in range(limit + 1)]
    count = np.zeros(limit + 1, np.int64)      # open sequences by gap; 0 and the full gap stay 0
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # change of the sum of squares by moving one sequence from gap g to gap g - n; a full one leaves the sum
        change = 1 - 2 * count[n:]
        change[1:] += 2 * count[1:limit - n + 1] + 1
        change[count[n:] == 0] = np.iinfo(np.int64).max
        change[limit - n] = 2 * count[limit - n] + 1 if n < limit else 0      # a new sequence
        gap = n + int(change.argmin())                                        # ties: the smallest gap
        if gap < limit:
            b = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            b, made = made, made + 1
        bins[i], offsets[i] = b, limit - gap
        if gap > n:
            open_by_gap[gap - n].append(b)
            count[gap - n] += 1
    return bins, offsets


def _packed(units: DataFrame, limit: int, n: int) -> DataFrame:
    """unit, length -> unit, bin, at, fill: each group's pieces from long to short; bins are numbered per group."""
    groups = -(-n // GROUP)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "unit"], ascending=[False, True])
        bins, at = pack(pdf["length"].to_numpy(), limit)
        fill = np.bincount(bins, weights=pdf["length"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"unit": pdf["unit"], "bin": bins * groups + key[0], "at": at, "fill": fill[bins]})

    return (units.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups))).groupBy("g")
            .applyInPandas(run, "unit long, bin long, at long, fill long"))


def pack_documents(docs: DataFrame, limit: int = 1024, end_id: int = 2, tokenizer: tuple[str, str | None] | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = cut_lineage(tokenized_pieces(docs, limit, end_id, tokenizer, id_col, text_col)
                         .withColumn("unit", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < limit)
    n = short.count()
    first = cut_lineage(_packed(short.select("unit", "length"), limit, max(n, 1)))
    left = first.where(F.col("fill") < limit).groupBy("bin").agg(F.first("fill").alias("length"))
    left = cut_lineage(left)
    again = (_packed(left.select(F.col("bin").alias("unit"), "length"), limit, max(left.count(), 1))
             .select(F.col("unit").alias("bin"), F.col("bin").alias("home"), F.col("at").alias("shift")))
    # three kinds of sequences share the numbers: 3x whole pieces, 3x + 1 filled in the first round, 3x + 2 in the second
    placed = (first.join(again, "bin", "left")
              .select("unit", F.when(F.col("home").isNull(), F.col("bin") * 3 + 1)
                      .otherwise(F.col("home") * 3 + 2).alias("sequence_id"),
                      (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset")))
    return (pieces.join(placed, "unit", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.coalesce("sequence_id", F.col("unit") * 3).alias("sequence_id"),
                    F.coalesce("offset", F.lit(0)).cast("long").alias("offset")))
