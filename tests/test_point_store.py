"""Written collections: versions, copy-on-write, quarantine, index and search."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import vectors as VO
from papyra.session import table
from papyra.sinks import point_store as PS

COLUMNS = "id string, vector array<float>, payload struct<text_id: string, text: string, document_name: string>"


def _points(spark, rows):
    return spark.createDataFrame([(i, v, (i, t, "d")) for i, v, t in rows], COLUMNS)


def _held(points):
    return {r.id: (list(r.vector), r.payload.text) for r in points.collect()}


def test_upsert_twice_equals_once_and_versions_stay_readable(spark, tmp_dir):
    c = PS.PointCollection.create(spark, f"{tmp_dir}/c", 2, buckets=8)
    first = _points(spark, [(f"p{i}", [float(i), 1.0], "a") for i in range(20)])
    assert c.upsert(first) == 1
    new = _points(spark, [("p3", [9.0, 9.0], "b"), ("q1", [0.0, 1.0], "b")])
    assert c.upsert(new) == 2
    two = _held(c.points())
    c.upsert(new)
    assert _held(c.points()) == two and len(two) == 21 and two["p3"] == ([9.0, 9.0], "b")
    assert _held(c.points(1)) == _held(first) and c.manifest()["points"] == 21
    # only the buckets of changed ids were written again
    old, now = c.manifest(1)["live"], c.manifest(2)["live"]
    moved = {b for b in now if now[b] != old.get(b)}
    assert moved == {str(r[0]) for r in new.select(VO.shard_of("id", 8)).distinct().collect()} and len(moved) <= 2
    c.delete(spark.createDataFrame([("p3",), ("none",), (None,)], "id string"))
    assert set(_held(c.points())) == set(two) - {"p3"} and c.manifest()["points"] == 20
    c.delete(c.points().select("id"))
    assert c.points().count() == 0 and c.manifest()["live"] == {} and c.manifest()["points"] == 0
    with pytest.raises(PS.VersionTaken):
        PS.PointCollection.create(spark, f"{tmp_dir}/c", 2)


def test_a_reader_keeps_its_version_and_a_second_writer_starts_again(spark, tmp_dir, monkeypatch):
    c = PS.PointCollection.create(spark, f"{tmp_dir}/c", 1, buckets=2)
    c.upsert(_points(spark, [("a", [1.0], "x")]))
    reading = c.points()
    other, plain, seen = PS.PointCollection(spark, f"{tmp_dir}/c"), PS.PointCollection._rewrite, []

    def late(self, man, tag, rows, changed):
        plain(self, man, tag, rows, changed)
        if not seen:                                          # another write commits before this one does
            seen.append(1)
            other.upsert(_points(spark, [("b", [2.0], "y")]))

    monkeypatch.setattr(PS.PointCollection, "_rewrite", late)
    assert c.upsert(_points(spark, [("c", [3.0], "z")])) == 3
    assert set(_held(c.points())) == {"a", "b", "c"} and set(_held(reading)) == {"a"}


def test_a_stopped_write_leaves_no_trace(spark, tmp_dir, monkeypatch):
    c = PS.PointCollection.create(spark, f"{tmp_dir}/c", 1, buckets=2)
    c.upsert(_points(spark, [("a", [1.0], "x")]))

    def stop(self, man):
        raise OSError("driver stopped")

    with monkeypatch.context() as m:
        m.setattr(PS.PointCollection, "_commit", stop)
        with pytest.raises(OSError):
            c.upsert(_points(spark, [("a", [5.0], "y"), ("b", [2.0], "y")]))
    assert _held(c.points()) == {"a": ([1.0], "x")}
    c.upsert(_points(spark, [("a", [5.0], "y"), ("b", [2.0], "y")]))
    assert _held(c.points()) == {"a": ([5.0], "y"), "b": ([2.0], "y")}


def test_refused_rows_and_repeated_ids(spark, tmp_dir):
    c = PS.PointCollection.create(spark, f"{tmp_dir}/c", 2, buckets=4)
    rows = [("a", [1.0, 2.0], "low"), ("a", [1.0, 2.0], "top"), ("a", [0.0, 5.0], "zzz"), ("b", [1.0], "x"), ("c", None, "x"),
            (None, [1.0, 1.0], "x"), ("d", [1.0, float("nan")], "x"), ("e", [1.0, None], "x"), ("f", [float("inf"), 0.0], "x")]
    c.upsert(_points(spark, rows))
    assert _held(c.points()) == {"a": ([1.0, 2.0], "top")}    # the largest vector, then the largest payload
    assert sorted((r.id or "", r.reason, r.version) for r in c.quarantined().collect()) == [
        ("", "no id", 1), ("b", "dimension", 1), ("c", "no vector", 1), ("d", "component", 1), ("e", "component", 1),
        ("f", "component", 1)]
    new = _points(spark, [("a", [7.0, 7.0], "old"), ("a", [0.0, 0.5], "new")]).withColumn(
        "at", F.when(F.col("payload.text") == "new", 2).otherwise(1))
    c.upsert(new, version_col="at")
    assert _held(c.points()) == {"a": ([0.0, 0.5], "new")}


def _recall(found, exact):
    a, b = ({(r.query_id, r.id) for r in x.collect()} for x in (found, exact))
    return len(a & b) / len(b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_index_recall_and_share(spark, tmp_dir, sf):
    """Every vector with an id divisible by 50 against all: recall >= 0.9 with a share of pairs <= 0.15."""
    emb = table(spark, f"/root/testdata/{sf}", "embeddings").selectExpr("vec_id AS id", "embedding AS vector")
    c = PS.PointCollection.create(spark, f"{tmp_dir}/c", 64, "id long, vector array<float>", buckets=16, index_threshold=100)
    c.upsert(emb)
    c.build_index(per_list=2)
    queries = emb.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    top, share = c.search_with_share(queries, 5)
    recall = _recall(top, VO.exact_topk(emb, queries, 5))
    print(f"{sf}: recall {recall:.3f}, share of pairs scored {share:.3f}")
    assert recall >= 0.9 and share <= 0.15
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan


def test_index_follows_later_writes(spark, tmp_dir):
    rng = np.random.default_rng(1)
    at = rng.normal(size=(6, 8)) * 4
    rows = [(f"p{i:03d}", (at[i % 6] + rng.normal(size=8)).tolist(), "a") for i in range(240)]
    c = PS.PointCollection.create(spark, f"{tmp_dir}/c", 8, buckets=4, index_threshold=50)
    c.upsert(_points(spark, rows[:200]))
    queries = spark.createDataFrame([(i, at[i].tolist()) for i in range(6)] + [(9, None), (10, [1.0]), (11, [0.0] * 8)],
                                    "query_id int, vector array<double>")
    assert c.search_with_share(queries, 3)[1] == 1.0          # no index yet: exact
    c.build_index(per_list=20)
    c.upsert(_points(spark, [(rows[0][0], at[1].tolist(), "moved")] + rows[200:]))
    c.delete(spark.createDataFrame([(rows[1][0],)], "id string"))
    top, share = c.search_with_share(queries, 3, share=0.6, payload=("payload",))
    assert share < 1 and _recall(top, VO.exact_topk(c.points(), queries, 3)) >= 0.9
    got = {(r.query_id, r.rank): (r.id, r.payload.text) for r in top.collect()}
    assert got[1, 1] == (rows[0][0], "moved") and {q for q, _ in got} == set(range(6))
    assert rows[1][0] not in {i for i, _ in got.values()}
    c.build_index(per_list=20)                                # a rebuild starts anew
    assert c.manifest()["index"]["gone"] == [] and len(c.manifest()["index"]["segments"]) == 1
    assert sorted(x[0] for x in {(r.query_id, r.id) for r in c.search(queries, 3).collect()}) == sorted([*range(6)] * 3)


def test_manifests_are_whole_files(spark, tmp_dir):
    c = PS.PointCollection.create(spark, f"{tmp_dir}/c", 1)
    names = os.listdir(f"{tmp_dir}/c/_manifest")
    assert [n for n in names if n.endswith(".json") and not n.startswith(".")] == ["0000000000.json"]
    assert json.load(open(f"{tmp_dir}/c/_manifest/0000000000.json"))["dim"] == 1 and c.points().count() == 0


def test_best_rows_leave_a_task_once(spark):
    """k rows a query leave a task, over however many batches; odd and null queries are refused, not an error."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        rows = [(i, [float(i % 17), 1.0], f"t{i}") for i in range(400)]
        corpus = spark.createDataFrame(rows, "id long, vector array<float>, text string").coalesce(1)
        queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [0.0, 0.0]),
                                         (6, [float("nan"), 1.0])], "query_id int, vector array<double>")
        block = VO._as_block(next(VO._query_rows(queries.selectExpr("query_id", "vector AS qv"), 10)))
        sent = spark.sparkContext.broadcast(block)
        out = corpus.mapInArrow(VO._scorer(sent, 3, "id", "vector", ["text"]),
                                "id long, text string, query_id int, score double")
        assert out.count() == 6
        top = {(r.query_id, r["rank"]): (r.id, r.text) for r in VO.exact_topk(corpus, queries, 3, carry=("text",)).collect()}
        assert [top[1, r] for r in (1, 2, 3)] == [(16, "t16"), (33, "t33"), (50, "t50")]
        assert [top[2, r] for r in (1, 2, 3)] == [(0, "t0"), (17, "t17"), (34, "t34")] and len(top) == 6
        assert {r.query_id for r in VO.refused_queries(queries).collect()} == {3, 5, 6}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
