"""Similarity search and point rows (G1, G2, B8, I5, I6, E7); the index (G5) is in ``inverted_file``.

Exact search never materialises query x corpus pairs in a shuffle: each task
scores its corpus rows against a broadcast block of query vectors with one
matrix product per Arrow batch and keeps, per query, only its k best rows over
all its batches (ties broken by id).  The final top-k is a window over at most
k x tasks rows per query.  The broadcast block is size-checked; larger
query sets are split into blocks, one corpus pass per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra import lexicons as L
from papyra.functions.names import point_id
from papyra.functions.vectors import cosine_similarity, l2_normalize
from papyra.session import cut_lineage

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def round6(x: np.ndarray) -> np.ndarray:
    """Half-away-from-zero rounding to 6 decimals (scores are compared at this precision)."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, m / n, np.nan)


def _batch_topk(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact k best rows of one batch for every query at once.

    Order: rounded score descending, then id ascending.  Both go into one
    integer key (score in millionths x (rows + 1) + rank of the id in the
    batch), so a single ``argpartition`` along the rows decides all queries,
    ties included.  NaN scores (zero vectors) sort last and are dropped.
    Returns (row index, query index) pairs.
    """
    b, q = scores.shape
    kk = min(k, b)
    rank = np.empty(b, dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(b)
    micro = np.where(np.isnan(scores), -2_000_000, np.rint(scores * 1e6)).astype(np.int64)
    key = -micro * (b + 1) + rank[:, None]
    rows = np.argpartition(key, kk - 1, axis=0)[:kk] if kk < b else np.tile(np.arange(b)[:, None], (1, q))
    cols = np.broadcast_to(np.arange(q), rows.shape)
    keep = ~np.isnan(scores[rows, cols])
    return rows[keep], cols[keep]


class _Best:
    """The k best rows of every query over all batches of a task: ids, scores and carried columns only.

    At most k rows a query are held whatever the number of batches; a row enters
    only with a score that reaches its query's k-th one.  Order: rounded score
    descending, then id ascending, null ids first.
    """

    def __init__(self, n_queries: int, k: int, id_col: str):
        self.k, self.id_col, self.held = k, id_col, None
        self.low = np.full(n_queries, np.iinfo(np.int64).min)              # k-th score in millionths

    def add(self, rows: pa.RecordBatch, row: np.ndarray, query: np.ndarray, score: np.ndarray) -> None:
        micro = np.rint(score * 1e6).astype(np.int64)
        reach = micro >= self.low[query]
        if not reach.any():
            return
        part = pa.Table.from_batches([rows]).take(pa.array(row[reach]))
        part = part.append_column("_q", pa.array(query[reach])).append_column("_micro", pa.array(micro[reach]))
        held = part if self.held is None else pa.concat_tables([self.held, part])
        order = pc.sort_indices(held, [("_q", "ascending"), ("_micro", "descending"), (self.id_col, "ascending")],
                                null_placement="at_start").to_numpy()
        q = held.column("_q").to_numpy()[order]
        first = np.searchsorted(q, q)
        order = order[np.arange(len(q)) - first < self.k]
        self.held = held.take(pa.array(order))
        q, micro = self.held.column("_q").to_numpy(), self.held.column("_micro").to_numpy()
        last = np.flatnonzero(np.append(q[1:] != q[:-1], True))
        full = last[last - np.searchsorted(q, q[last]) == self.k - 1]
        self.low[q[full]] = micro[full]

    def rows(self, names: list[str], qids: pa.Array) -> list[pa.RecordBatch]:
        if self.held is None:
            return []
        score = self.held.column("_micro").to_numpy() / 1e6
        out = [self.held.column(c) for c in names] + [qids.take(self.held.column("_q")), pa.array(score)]
        return pa.table(out, [*names, "query_id", "score"]).to_batches()


def _matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have ``dim`` components, and these as unit rows (unusable ones NaN)."""
    at = np.flatnonzero(pc.equal(pc.list_value_length(lists), dim).fill_null(False).to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(at)).flatten().cast(pa.float64())
    return at, _unit_rows(flat.to_numpy(zero_copy_only=False).reshape(len(at), dim))


def _scorer(sent, k: int, id_col: str, vec_col: str, carry: list[str]):
    """Per Arrow batch one matrix product per vector length; the k best rows per query leave the task at its end."""
    def run(batches):
        qids, by_dim = sent.value
        best = _Best(len(qids), k, id_col)
        for b in batches:
            for dim, (query, unit) in by_dim.items():
                at, vecs = _matrix(b.column(vec_col), dim)
                if not len(at):
                    continue
                rank = np.empty(len(at), np.int64)
                rank[pc.sort_indices(b.column(id_col).take(pa.array(at)), null_placement="at_start").to_numpy()] = np.arange(len(at))
                scores = round6(vecs @ unit.T)                             # (rows, queries); zero rows -> NaN
                r, c = _batch_topk(scores, rank, k)
                best.add(b.select([id_col, *carry]), at[r], query[c], scores[r, c])
        yield from best.rows([id_col, *carry], qids)
    return run


def usable_vector(col: str):
    """Whether a vector has a length, no null, NaN or infinite component, and a norm."""
    v = F.col(col)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def refused_queries(queries: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Queries that no search can answer (G2 leaves them out): null, empty, zero or non-finite vectors."""
    return queries.where(~usable_vector(vector_col))


def _as_block(rows: pa.Table) -> tuple[pa.Array, dict]:
    """Query ids and, per vector length, the places of its queries and their unit vectors."""
    vectors = rows.column("qv").combine_chunks()
    dims = np.array(pc.list_value_length(vectors).to_pylist(), np.int64)
    by_dim = {int(d): _matrix(vectors, int(d)) for d in np.unique(dims)}
    return rows.column("query_id").combine_chunks(), by_dim


def _query_rows(q: DataFrame, max_block: int):
    """Usable queries as bounded Arrow tables, one broadcast block each.

    The common case is one bounded gather.  A larger query set is cut by a hash of
    a row number, so that repeated queries spread over the blocks too.
    """
    q = q.where(usable_vector("qv")).withColumn("qv", F.col("qv").cast("array<double>"))
    rows = q.limit(max_block + 1).toArrow()
    cap = max(1, min(max_block, MAX_BROADCAST_BYTES * max(rows.num_rows, 1) // max(rows.nbytes, 1)))
    if rows.num_rows <= cap:
        yield rows
        return
    q = cut_lineage(q.withColumn("_row", F.monotonically_increasing_id()))
    n_blocks = -(-2 * q.count() // cap)                                     # half full on average
    for b in range(n_blocks):
        yield q.where(F.pmod(F.xxhash64("_row"), F.lit(n_blocks)) == b).drop("_row").toArrow()


def exact_topk(corpus: DataFrame, queries: DataFrame, k: int = L.SEARCH_LIMIT, *,
               id_col: str = "id", vector_col: str = "vector", carry: tuple[str, ...] = (),
               query_id_col: str = "query_id", query_vector_col: str = "vector",
               max_block: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """The k most cosine-similar corpus rows per query (query_id, id, score, rank, carry...).

    A task holds and passes on at most k rows a query.  Queries without a usable vector give no
    rows (``refused_queries`` names them); corpus vectors meet only queries of their own length.
    """
    spark = corpus.sparkSession
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vector_col).alias("qv"))
    out_schema = T.StructType([corpus.schema[id_col]] + [corpus.schema[c] for c in carry]
                              + [q.schema["query_id"], T.StructField("score", T.DoubleType())])
    base = corpus.select(id_col, vector_col, *carry)
    cand = None
    for rows in _query_rows(q, max_block):
        sent = spark.sparkContext.broadcast(_as_block(rows))
        part = base.mapInArrow(_scorer(sent, k, id_col, vector_col, list(carry)), out_schema)
        cand = part if cand is None else cand.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def topk_single(corpus: DataFrame, query_vector: list[float], k: int = L.SEARCH_LIMIT, *,
                id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """G1: one query; a JVM cosine expression + ORDER BY ... LIMIT (TakeOrderedAndProject)."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    scored = corpus.withColumn("score", F.round(cosine_similarity(vector_col, q), 6))
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def query_scores(corpus: DataFrame, query_vector: list[float], *, vector_col: str = "vector") -> DataFrame:
    """E7 for one query: the score of every stored vector (a narrow projection, no join)."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return corpus.withColumn("score", cosine_similarity(vector_col, q))


# -- points, upsert, delete, shards ------------------------------------------
def to_points(df: DataFrame, document_col: str, chunk_col: str, vector_col: str,
              text_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows -> points (id, vector, payload{text_id, text, document_name}, keep...); id is deterministic."""
    pid = point_id(document_col, chunk_col)
    text = F.col(text_col) if text_col else F.lit(None).cast("string")
    return (df.withColumn("_pid", pid)
              .select(F.col("_pid").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"),
                      F.struct(F.col("_pid").alias("text_id"), text.alias("text"),
                               F.col(document_col).alias("document_name")).alias("payload"),
                      *keep))


def upsert_points(current: DataFrame, new: DataFrame, id_col: str = "id",
                  version_col: str | None = None) -> DataFrame:
    """Insert-or-replace by id (new rows win); ``PointCollection.upsert`` writes it as a new version.

    An id that ``new`` holds several times keeps its row of the largest ``version_col``; among
    those, or where no version is named, the row with the largest other columns in their order.
    """
    order = ([version_col] if version_col else []) + [c for c in new.columns if c not in (id_col, version_col)]
    row = F.max(F.struct(*[F.col(f"`{c}`") for c in [*order, id_col]])).alias("_row")
    new = new.groupBy(F.col(id_col).alias("_id")).agg(row).select("_row.*").select(*[F.col(f"`{c}`") for c in new.columns])
    return current.join(new.select(id_col), id_col, "left_anti").unionByName(new)


def delete_points(current: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Remove points whose id is listed."""
    return current.join(ids.select(id_col).distinct(), id_col, "left_anti")


def shard_of(id_col: str = "id", shards: int = L.VECTOR_SHARDS):
    """Stable shard number of a point: the first 32 bits of the id's md5, modulo ``shards`` (a null id: 0)."""
    head = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(head, F.lit(shards)), F.lit(0)).cast("int")


def shard_layout(points: DataFrame, shards: int = L.VECTOR_SHARDS, id_col: str = "id") -> DataFrame:
    """Rows dealt by shard; a shard gets as many tasks (and so files) as its bytes need.

    REBALANCE lets the runtime split a shard above the advisory partition size and join small ones.
    """
    return points.withColumn("shard", shard_of(id_col, shards)).hint("rebalance", "shard")
