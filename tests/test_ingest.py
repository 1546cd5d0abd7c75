"""Ingest operators: outcome accounting, rerun idempotence, ordinals, skew-safe aggregates."""

import hashlib

from pyspark.sql import functions as F

from papyra.operators import ingest as I
from papyra.plans.ordinal import global_ordinal, running_sums

FILES = [("a.pdf", "Resume: software engineer 2019"), ("b.DOCX", "plain words"), ("c.html", "plain words"),
         ("d.txt", "skills 2020"), ("e.doc", None), ("f.pdf", "Resume: software engineer 2019")]


def _files(spark):
    return spark.createDataFrame(FILES, "file_name string, text string")


def test_outcome_accounting_and_rerun(spark):
    files = _files(spark)
    empty = spark.createDataFrame([], "hash_id string")
    first = I.ingest_outcome(files, empty)
    got = {r.file_name: r.outcome for r in first.collect()}
    # unsupported suffix and failed extraction are unprocessed; copies within a run are both kept
    assert got == {"a.pdf": "kept", "b.DOCX": "kept", "c.html": "kept", "d.txt": "unprocessed",
                   "e.doc": "unprocessed", "f.pdf": "kept"}
    s = I.run_summary(first).first()
    assert s.total_files_processed == 6 and s.unprocessed_documents_count == 2
    assert s.total_duplicates_count == 0 and s.total_resumes_detected == 2
    ledger = first.filter("outcome = 'kept'").select("hash_id")
    second = I.ingest_outcome(files, ledger)
    assert second.filter("outcome = 'kept'").count() == 0          # a rerun keeps nothing
    counts = {r.outcome: r["count"] for r in second.groupBy("outcome").count().collect()}
    assert counts["duplicate"] + counts["unprocessed"] == len(FILES)


def test_in_run_dedup_keeps_lowest(spark):
    out = I.ingest_outcome(_files(spark), spark.createDataFrame([], "hash_id string"), in_run_dedup=True)
    got = {r.file_name: r.outcome for r in out.collect()}
    assert got["a.pdf"] == "kept" and got["f.pdf"] == "duplicate"
    assert got["b.DOCX"] == "kept" and got["c.html"] == "duplicate"


def test_content_hash_is_of_raw_text(spark):
    out = I.ingest_outcome(_files(spark), spark.createDataFrame([], "hash_id string"))
    r = out.filter("file_name = 'a.pdf'").first()
    assert r.hash_id == hashlib.md5(FILES[0][1].encode()).hexdigest()


def test_rows_without_a_hash_are_dealt_over_all_tasks(spark):
    files = spark.createDataFrame([(f"f{i}.{'txt' if i % 2 else 'pdf'}", f"text {i}") for i in range(2000)] + [(None, None)] * 2,
                                  "file_name string, text string")
    ledger = spark.createDataFrame([(hashlib.md5(f"text {i}".encode()).hexdigest(),) for i in range(0, 2000, 4)] + [(None,)],
                                   "hash_id string")
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k in held:
            spark.conf.set(k, "false" if "adaptive" in k else "-1")
        out = I.ingest_outcome(files, ledger)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.min("outcome")).collect()]
        got = sorted((str(r.file_name), r.outcome) for r in out.collect())
        in_run = I.ingest_outcome(files, ledger, in_run_dedup=True).select("file_name", "outcome").collect()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert max(sizes) < 0.25 * 2002 and sum(sizes) == 2002
    want = [(f"f{i}.txt", "unprocessed") if i % 2 else (f"f{i}.pdf", "kept" if i % 4 else "duplicate") for i in range(2000)]
    assert got == sorted(want + [("None", "unprocessed")] * 2)
    assert sorted((str(r.file_name), r.outcome) for r in in_run) == got


def test_duplicate_groups_with_hot_hash(spark):
    # one hash holds a third of all rows: the aggregate still combines map-side
    rows = [(i, "hot" if i % 3 == 0 else f"h{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, hash_id string").repartition(16)
    g = I.duplicate_groups(df, "doc_id").collect()
    assert len(g) == 1 and g[0].copies == 1000 and g[0].keeper == 0
    plan = I.duplicate_groups(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_global_ordinal_computes_rows_once(spark):
    done = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(k):
        done.add(1)
        return k

    df = spark.range(300).select((F.col("id") % 40).cast("string").alias("k"), "id").withColumn("v", counted("k"))
    got = sorted((r.ordinal, r.k) for r in global_ordinal(df, ["k"], num_partitions=5).collect())
    assert done.value == 300
    assert [o for o, _ in got] == list(range(300)) and [k for _, k in got] == sorted(k for _, k in got)


def test_global_ordinal_matches_sort(spark):
    import random
    keys = [f"k{random.Random(7).randint(0, 10**9)}_{i}" for i in range(2500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    got = {r.k: r.ordinal for r in global_ordinal(df, ["k"], num_partitions=5).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_batches_and_running_sums(spark):
    df = spark.createDataFrame([(f"f{i:04d}",) for i in range(250)], "file_name string")
    b = I.assign_batches(df, ["file_name"], 100)
    sizes = sorted((r.batch_index, r["count"]) for r in b.groupBy("batch_index").count().collect())
    assert sizes == [(1, 100), (2, 100), (3, 50)]
    vals = spark.createDataFrame([(i, i * 2) for i in range(1, 10001)], "b long, v long")
    rs = {r.b: r.running_v for r in running_sums(vals, "b", ["v"], prefix="running_", block=97).collect()}
    assert rs[1] == 2 and rs[10000] == 10000 * 10001 and rs[5000] == 5000 * 5001


def test_route(spark):
    df = spark.createDataFrame([("X.PDF",), ("y.docx",), ("z.Doc",), ("w.html",), ("v.htm",)], "n string")
    got = [r[0] for r in df.select(I.route_by_extension("n")).collect()]
    assert got == ["pdf", "doc", "doc", "html", "unsupported"]


def test_batch_counters_totals(spark):
    o = spark.createDataFrame([(1, "kept", True), (1, "duplicate", None), (2, "unprocessed", None),
                               (3, "kept", False)], "batch_index long, outcome string, is_resume boolean")
    rows = {r.batch_index: r for r in I.batch_counters(o).collect()}
    assert rows[3].total_files == 4 and rows[3].total_resumes == 1 and rows[2].total_unprocessed == 1
    assert rows[1].duplicates == 1 and rows[2].total_duplicates == 1


def test_summary_names_are_rows_not_lists(spark):
    out = I.ingest_outcome(_files(spark), spark.createDataFrame([], "hash_id string"))
    names = sorted(r.file_name for r in I.outcome_names(out, I.UNPROCESSED).collect())
    assert names == ["d.txt", "e.doc"]
    assert all(F.col is not None for _ in [0])
