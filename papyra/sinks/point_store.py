"""Point collections that are written to.

A collection is a folder of Parquet files and numbered manifests.  Points lie in
buckets by a hash of their id.  A write makes new folders for the buckets that
hold a changed id, and only those, and then puts the next manifest in place; that
one step is the commit.  A reader takes one manifest and so sees one version,
whatever is written meanwhile.  Two writers of one version: the second finds the
manifest there and starts again from it.  Folders that no manifest names are what
a failed write has left; they are never read.

A written point needs an id and a vector of the collection's dimension without
null or non-finite components; other rows go to the quarantine with a reason.
An id that a write holds several times keeps its row of the largest ``version_col``,
among those (or without one) the row with the largest columns in schema order.

The index is an inverted file.  Points written later are assigned to its lists as
a further segment; rows of older segments that were replaced or deleted are told
by the ids that each write lists.  Below ``index_threshold`` points, or without an
index, a search is exact.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra import lexicons as L
from papyra.operators import inverted_file as IV
from papyra.operators import vectors as VO
from papyra.session import cut_lineage
from papyra.sinks.collections import POINT_DDL

INDEX_THRESHOLD = 20_000
_RETRIES = 5


class VersionTaken(RuntimeError):
    """Another writer has committed the version that this write was to become."""


class _Files:
    """The few file-system calls of a commit, on whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        self.fs, self.conf, self.gateway = sc._jvm.org.apache.hadoop.fs, sc._jsc.hadoopConfiguration(), sc._gateway
        self.root = path.rstrip("/")
        self.system = self.fs.Path(path).getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        at = self.fs.Path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def put_new(self, name: str, text: str) -> None:
        """A file with its whole content, or VersionTaken where the name exists."""
        draft, final = (self.fs.Path(f"{self.root}/{n}") for n in (f"{name}.{uuid.uuid4().hex}", name))
        out = self.system.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.gateway.new_array(getattr(self.fs, "Options$Rename"), 0)
        try:
            self.fs.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, final, none)
        except Exception as e:
            self.system.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise VersionTaken(name) from None
            raise


def _reason(dim: int, id_col: str, vector_col: str):
    """Why a row is no point of a collection; null for those that are."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.when(F.col(id_col).isNull(), "no id").when(v.isNull(), "no vector")
            .when(F.size(v) != dim, "dimension").when(bad, "component"))


class PointCollection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files = spark, path.rstrip("/"), _Files(spark, path)

    # -- life cycle -------------------------------------------------------------
    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, columns: str = POINT_DDL, buckets: int = 64,
               metric: str = "cosine", index_threshold: int = INDEX_THRESHOLD) -> PointCollection:
        """An empty collection; VersionTaken where one exists.  ``columns`` need an id and a vector."""
        if metric != "cosine" or dim < 1 or buckets < 1:
            raise ValueError("a collection has a positive dimension, buckets, and cosine similarity")
        schema = T.StructType.fromDDL(columns)
        if not {"id", "vector"} <= set(schema.names):
            raise ValueError("a collection needs the columns id and vector")
        new = cls(spark, path)
        new._commit({"version": 0, "dim": dim, "metric": metric, "buckets": buckets, "schema": schema.json(), "live": {},
                     "points": 0, "index_threshold": index_threshold, "quarantine": [], "index": None})
        return new

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._files.names("_manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The named or the latest version."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"no version {'' if version is None else version} in {self.path}")
        name = f"{self.path}/_manifest/{known[-1] if version is None else version:010d}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def _commit(self, man: dict) -> int:
        self._files.put_new(f"_manifest/{man['version']:010d}.json", json.dumps(man))
        return man["version"]

    def _again(self, change) -> int:
        """``change`` of the latest manifest, committed; anew where another writer was first."""
        for left in reversed(range(_RETRIES)):
            man = self.manifest()
            man["version"] += 1
            change(man, f"v={man['version']:010d}-{uuid.uuid4().hex[:8]}")
            try:
                return self._commit(man)
            except VersionTaken:
                if not left:
                    raise
        raise AssertionError

    # -- reading ----------------------------------------------------------------
    def _read(self, man: dict, buckets=None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(man["schema"]))
        paths = [f"{self.path}/points/{v}/bucket={b}" for b, v in man["live"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def points(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def quarantined(self) -> DataFrame:
        """Rows that writes have refused, with ``reason`` and the version that refused them."""
        man = self.manifest()
        schema = T.StructType.fromJson(json.loads(man["schema"])).add("reason", "string").add("version", "long")
        if not man["quarantine"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/quarantine/{q}" for q in man["quarantine"]])

    # -- writing ----------------------------------------------------------------
    def _bucketed(self, df: DataFrame, man: dict) -> DataFrame:
        return df.withColumn("bucket", VO.shard_of("id", man["buckets"]))

    def _rewrite(self, man: dict, tag: str, rows: DataFrame, changed: list[int]) -> None:
        """New folders for the changed buckets; a bucket gets as many files as its bytes need."""
        self._bucketed(rows, man).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/points/{tag}")
        written = {n.split("=")[1] for n in self._files.names(f"points/{tag}") if n.startswith("bucket=")}
        before = self._read(man, changed).count()
        for b in changed:
            man["live"].pop(str(b), None)
            if str(b) in written:
                man["live"][str(b)] = tag
        man["points"] += self._read(man, changed).count() - before

    def _index_changes(self, man: dict, tag: str, ids: DataFrame, new: DataFrame | None) -> None:
        if not man["index"]:
            return
        ids.select("id").distinct().withColumn("version", F.lit(man["version"])).write.parquet(f"{self.path}/index/{tag}-gone")
        man["index"]["gone"].append(f"{tag}-gone")
        if new is not None:
            centres, _ = self._centres(man)
            self._segment(man, tag, new, centres)

    def upsert(self, new: DataFrame, version_col: str | None = None) -> int:
        """Insert or replace by id; the committed version.  The same write twice leaves the same points."""
        extra = [version_col] if version_col else []

        def change(man: dict, tag: str) -> None:
            schema = T.StructType.fromJson(json.loads(man["schema"]))
            plain = new.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema],
                               *[F.col(f"`{c}`").alias("_order") for c in extra])
            judged = cut_lineage(plain.withColumn("reason", _reason(man["dim"], "id", "vector")))   # new is read once
            bad = judged.where("reason IS NOT NULL").drop("_order").withColumn("version", F.lit(man["version"]).cast("long"))
            if not bad.isEmpty():
                bad.write.parquet(f"{self.path}/quarantine/{tag}")
                man["quarantine"].append(tag)
            others = [n for n in schema.names if n != "id"]
            row = F.max(F.struct(*[f"`{c}`" for c in (["_order"] if extra else []) + others])).alias("_row")
            good = (judged.where("reason IS NULL").groupBy("id").agg(row).select("id", "_row.*")
                    .select(*[f"`{n}`" for n in schema.names]))
            good = cut_lineage(self._bucketed(good, man))
            changed = [r[0] for r in good.select("bucket").distinct().collect()]             # at most the buckets
            good = good.drop("bucket")
            if changed:
                kept = self._read(man, changed).join(good.select("id"), "id", "left_anti").select(*good.columns)
                self._rewrite(man, tag, kept.unionByName(good), changed)
                self._index_changes(man, tag, good, good)

        return self._again(change)

    def delete(self, ids: DataFrame) -> int:
        """Remove the listed ids; the committed version."""
        def change(man: dict, tag: str) -> None:
            gone = cut_lineage(self._bucketed(ids.select("id").where("id IS NOT NULL").distinct(), man))
            changed = [b for r in gone.select("bucket").distinct().collect() if str(b := r[0]) in man["live"]]
            if changed:
                self._rewrite(man, tag, self._read(man, changed).join(gone.select("id"), "id", "left_anti"), changed)
                self._index_changes(man, tag, gone, None)

        return self._again(change)

    # -- index and search -------------------------------------------------------
    def _segment(self, man: dict, tag: str, points: DataFrame, centres: np.ndarray) -> None:
        rows = IV.assigned(points, centres).withColumn("version", F.lit(man["version"]).cast("long"))
        (rows.repartitionByRange("part", "list", "id").sortWithinPartitions("part", "list")
         .write.partitionBy("part").parquet(f"{self.path}/index/{tag}"))
        man["index"]["segments"].append(tag)
        sizes = dict.fromkeys(range(len(centres)), 0) | {
            r["list"]: r["n"] for r in self._entries(man, [tag]).groupBy("list").agg(F.count("*").alias("n")).collect()}
        man["index"]["sizes"] = (np.array(man["index"]["sizes"]) + np.array(list(sizes.values()))).tolist()

    def _centres(self, man: dict) -> tuple[np.ndarray, np.ndarray]:
        rows = self.spark.read.schema("list int, centre array<double>").parquet(f"{self.path}/index/{man['index']['centres']}")
        held = sorted((r["list"], r["centre"]) for r in rows.collect())                      # bounded when fitted
        return np.array([c for _, c in held]).reshape(len(held), man["dim"]), np.array(man["index"]["sizes"], np.int64)

    def _entries(self, man: dict, tags: list[str]) -> DataFrame:
        id_type = T.StructType.fromJson(json.loads(man["schema"]))["id"].dataType
        schema = f"id {id_type.simpleString()}, vector array<float>, list int, version long, part int"
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.path}/index/{t}").parquet(f"{self.path}/index/{t}")
                 for t in tags]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def build_index(self, per_list: int = IV.PER_LIST, seed: int = 7) -> int:
        """Fit the lists and assign all points; the index replaces the one before at the commit."""
        def change(man: dict, tag: str) -> None:
            centres = IV.fit_centres(self._read(man), man["points"], per_list, seed=seed)
            rows = [(i, c.tolist()) for i, c in enumerate(centres)]
            self.spark.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.parquet(
                f"{self.path}/index/{tag}-centres")
            man["index"] = {"centres": f"{tag}-centres", "segments": [], "gone": [], "sizes": [0] * len(centres)}
            if len(centres):
                self._segment(man, tag, self._read(man), centres)

        return self._again(change)

    def search(self, queries: DataFrame, k: int = L.SEARCH_LIMIT, share: float = IV.PROBED_SHARE,
               payload: tuple[str, ...] = ()) -> DataFrame:
        """(query_id, id, score, rank, payload...): exact below the threshold or without an index."""
        return self.search_with_share(queries, k, share, payload)[0]

    def search_with_share(self, queries: DataFrame, k: int = L.SEARCH_LIMIT, share: float = IV.PROBED_SHARE,
                          payload: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
        """``search`` and the share of (query, point) pairs that it scores."""
        man = self.manifest()
        if not man["index"] or man["points"] < man["index_threshold"] or not man["index"]["segments"]:
            top, scored = VO.exact_topk(self._read(man), queries, k), 1.0
        else:
            entries = self._entries(man, man["index"]["segments"])
            if man["index"]["gone"]:                          # rows of older segments that were replaced or deleted
                gone = self.spark.read.parquet(*[f"{self.path}/index/{g}" for g in man["index"]["gone"]])
                gone = gone.groupBy("id").agg(F.max("version").alias("_gone"))
                entries = entries.join(gone, "id", "left").where(
                    F.col("_gone").isNull() | (F.col("version") >= F.col("_gone"))).drop("_gone")
            top, scored = IV.probed_search(entries, *self._centres(man), queries, k, share)
        top = top.select("query_id", "id", "score", "rank")
        if payload:                                           # joined last: k rows a query, whole points only for these
            top = top.join(self._read(man).select("id", *payload), "id")
        return top, scored
