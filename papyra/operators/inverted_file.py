"""Inverted-file index of a vector collection (G5): coarse lists, probed by the nearest centres.

Centres are fitted by KMeans on a bounded sample; every vector is assigned to its
nearest centre, so points that come later need no rebuild.  The index table is
partitioned by ``part``, a run of neighbouring lists, and sorted by ``list``; a
search reads only the parts that hold a probed list, scores whole vectors where
their list is probed, and a task passes on k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra import lexicons as L
from papyra.operators import vectors as VO
from papyra.session import BroadcastTooLarge, cut_lineage

SAMPLE_ROWS = 1 << 16            # of a fit, less where vectors are long
SAMPLE_BYTES = 64 * 1024 * 1024
PER_LIST = 256                   # points of a list
PROBED_SHARE = 0.15              # of all points that a query's lists hold, at most (its first list always counts)
BLOCK_CELLS = 1 << 22            # products, and scored pairs, that a task or the driver holds at once (32 MB of doubles)
CENTRES = "list int, part int, size long, centre array<double>"
ENTRIES = "id {id}, vector array<float>, list int, part int"


def fit_centres(points: DataFrame, n_points: int, per_list: int = PER_LIST, id_col: str = "id",
                vector_col: str = "vector", seed: int = 7, max_iter: int = 12) -> np.ndarray:
    """Unit centres of about n / per_list lists, from rows whose id's hash falls into the sample's share."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dim = points.agg(F.max(F.size(vector_col))).first()[0] or 1
    wanted = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim))
    lists = max(1, min(n_points // per_list, wanted // 3))
    share = min(1.0, wanted / max(n_points, 1))
    sample = points.where((VO.shard_of(id_col, 1 << 20) < share * (1 << 20)) & VO.usable_vector(vector_col))
    sample = cut_lineage(sample.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")))
    if sample.isEmpty():
        return np.zeros((0, dim))
    model = KMeans(k=lists, distanceMeasure="cosine", initMode="random", maxIter=max_iter, seed=seed).fit(sample)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def parts_of(centres: np.ndarray) -> np.ndarray:
    """A folder number per list: about sqrt(lists) runs along the centres' first principal axis."""
    n = len(centres)
    if n < 2:
        return np.zeros(n, np.int64)
    axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    rank = np.empty(n, np.int64)
    rank[np.argsort(centres @ axis, kind="stable")] = np.arange(n)
    return rank * max(1, math.isqrt(n)) // n


def nearest_lists(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, ties to the smaller number; as many rows at once as BLOCK_CELLS lets."""
    out, step = np.zeros(len(unit), np.int64), max(1, BLOCK_CELLS // max(1, len(centres)))
    for at in range(0, len(unit) if len(centres) else 0, step):
        out[at:at + step] = (unit[at:at + step] @ centres.T).argmax(1)
    return out


def assigned(points: DataFrame, centres: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, vector, list, part) of every usable point: its nearest centre, ties to the smaller number."""
    if centres.nbytes > VO.MAX_BROADCAST_BYTES:
        raise BroadcastTooLarge("centres above the broadcast bound; raise per_list")
    sent = points.sparkSession.sparkContext.broadcast((centres, parts_of(centres)))
    rows = points.where(VO.usable_vector(vector_col)).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))

    def run(batches):
        centres, part = sent.value
        for b in batches:
            at, unit = VO._matrix(b.column("vector"), centres.shape[1])
            b = b.take(pa.array(at))
            nearest = nearest_lists(unit, centres)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("vector"), pa.array(nearest.astype(np.int32)),
                 pa.array(part[nearest].astype(np.int32))], ["id", "vector", "list", "part"])

    return rows.mapInArrow(run, ENTRIES.format(id=rows.schema["id"].dataType.simpleString()))


def probes_of(unit: np.ndarray, centres: np.ndarray, sizes: np.ndarray, share: float) -> list[np.ndarray]:
    """The lists of each query: nearest first, as long as they hold at most ``share`` of all points."""
    out, step = [], max(1, BLOCK_CELLS // max(1, len(centres)))
    for at in range(0, len(unit), step):
        order = np.argsort(-(unit[at:at + step] @ centres.T), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        out += [o[:max(1, int(np.searchsorted(h, share * sizes.sum(), "right")))].astype(np.int32)
                for o, h in zip(order, held, strict=True)]
    return out


def _probing(sent, k: int):
    def run(batches):
        qids, unit, queries = sent.value                                    # queries: list -> those that probe it
        best = VO._Best(len(qids), k, "id")
        for b in batches:
            at, vecs = VO._matrix(b.column("vector"), unit.shape[1])
            lists = b.column("list").to_numpy()[at]
            by = np.argsort(lists, kind="stable")
            rows, asked, scores, held = [], [], [], 0
            for own in np.split(by, np.flatnonzero(np.diff(lists[by])) + 1):
                query = queries.get(int(lists[own[0]])) if len(own) else None
                if query is None:
                    continue
                s = VO.round6(vecs[own] @ unit[query].T)
                r, c = np.nonzero(np.rint(s * 1e6) >= best.low[query][None])
                rows.append(at[own[r]])
                asked.append(query[c])
                scores.append(s[r, c])
                held += len(r)
                if held > BLOCK_CELLS // 4:
                    best.add(b.select(["id"]), *(np.concatenate(x) for x in (rows, asked, scores)))
                    rows, asked, scores, held = [], [], [], 0
            if rows:
                best.add(b.select(["id"]), *(np.concatenate(x) for x in (rows, asked, scores)))
        yield from best.rows(["id"], qids)
    return run


def probed_search(entries: DataFrame, centres: np.ndarray, sizes: np.ndarray, queries: DataFrame,
                  k: int = L.SEARCH_LIMIT, share: float = PROBED_SHARE, *, query_id_col: str = "query_id",
                  query_vector_col: str = "vector", max_block: int = VO.MAX_BROADCAST_QUERIES):
    """(query_id, id, score, rank) over a table of ENTRIES, and the share of (query, point) pairs scored."""
    spark, part = entries.sparkSession, parts_of(centres)
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vector_col).alias("qv"))
    schema = T.StructType([T.StructField("id", entries.schema["id"].dataType), q.schema["query_id"],
                           T.StructField("score", T.DoubleType())])
    cand, scored, asked = spark.createDataFrame([], schema), 0, 0
    for rows in VO._query_rows(q, max_block):
        qids, by_dim = VO._as_block(rows)
        place, unit = by_dim.get(centres.shape[1], (np.zeros(0, np.int64), None))
        if not len(place) or not len(centres):
            continue
        probed = probes_of(unit, centres, sizes, share)
        of = np.repeat(np.arange(len(place), dtype=np.int32), [len(p) for p in probed])
        lists = np.concatenate(probed)
        scored, asked = scored + int(sizes[lists].sum()), asked + len(place)
        by = np.argsort(lists, kind="stable")
        cuts = np.flatnonzero(np.diff(lists[by])) + 1
        queries_of = {int(lists[own[0]]): of[own] for own in np.split(by, cuts)}
        sent = spark.sparkContext.broadcast((qids.take(pa.array(place)), unit, queries_of))
        live = entries.where(F.col("part").isin([int(p) for p in np.unique(part[lists])]))   # folders, at planning
        cand = cand.unionByName(live.select("id", "vector", "list").mapInArrow(_probing(sent, k), schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top, scored / max(1, asked * int(sizes.sum()))
