"""Features (stop list, KMeans property) and streaming (stream result = batch result)."""

import os

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from papyra import lexicons as L
from papyra.operators import features as FE
from papyra.operators import ingest as I
from papyra.streaming import ingest_stream as ST


def test_stop_words_equal_spark_default(spark):
    assert L.ENGLISH_STOP_WORDS == list(StopWordsRemover.loadDefaultStopWords("english"))


def test_kmeans_assigns_nearest_centre(spark):
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(c, 0.1, size=(40, 3)) for c in (0, 5, 10)])
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(i, Vectors.dense(p.tolist())) for i, p in enumerate(pts)], ["id", "features"])
    model, assigned = FE.kmeans(df, k=3, seed=1, max_iter=20)
    centres = np.array(model.clusterCenters())
    for r in assigned.select("prediction", vector_to_array("features").alias("v")).collect():
        d = ((centres - np.array(r.v)) ** 2).sum(axis=1)
        assert int(np.argmin(d)) == r.prediction
    assert sorted(r["size"] for r in FE.cluster_sizes(assigned).collect()) == [40, 40, 40]
    elbow = FE.kmeans_elbow(df, (2, 4), max_iter=10).collect()
    assert [r.k for r in elbow] == [2, 3, 4] and elbow[0].wcss >= elbow[2].wcss


def test_clustering_reads_texts_once(spark, monkeypatch):
    from papyra.plans import queries as Q
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [(f"k{i}", " ".join(f"w{i * j % 23}" for j in range(5 + i % 7))) for i in range(40)]
    texts = spark.createDataFrame(rows, "key string, content string")
    monkeypatch.setattr(Q, "_feature_corpus", lambda *_: texts.withColumn("content", counted("content")))
    assert Q.q_kmeans_clusters(spark, "").count() == 40 and read.value == 40
    _, plain = FE.text_pipeline(texts)
    assert sorted(FE.feature_vectors(texts).collect()) == sorted(plain.select("key", "features").collect())
    assert [r.k for r in Q.q_kmeans_elbow(spark, "").collect()] == [5, 6, 7, 8, 9, 10] and read.value == 80


def test_bigrams_read_all_documents_with_their_planted_part(spark, tmp_dir):
    from papyra.plans import queries as Q
    from tests.oracle_compare import compare
    texts = ["the red fox", "Alpha beta", None, "gamma", "one two", "delta", "", "last words", "red fox", "Alpha beta", None]
    (spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
          .coalesce(1).write.parquet(f"{tmp_dir}/parts"))
    spark.createDataFrame([(1,), (4,)], "doc_id long").coalesce(1).write.parquet(f"{tmp_dir}/labelled")
    for name, part in (("documents", "parts"), ("labels", "labelled")):
        found = [f for f in os.listdir(f"{tmp_dir}/{part}") if f.endswith(".parquet")]
        os.symlink(f"{tmp_dir}/{part}/{found[0]}", f"{tmp_dir}/{name}.parquet")
    got = {r.key: r.bigrams for r in Q.q_bigrams(spark, tmp_dir).collect()}
    assert len(got) == len(texts)
    assert got["doc_1.DOCX"] == "alpha beta|beta curriculum|curriculum vitae"           # labelled: a duplicate of the prior run
    assert got["doc_2.html"] == "senior developer" and got["doc_10.pdf"] == "senior developer"    # no text
    assert got["doc_3.doc"] == "gamma skills|skills specialist|specialist company"
    assert got["doc_4.txt"] == "one two|two academic|academic background|background 2020-01-02|2020-01-02 see|see http://example.org/a.b,"
    assert got["doc_7.html"] == "last words"                                            # nothing planted
    assert compare(spark, "bigrams", tmp_dir)["values_match"]


def test_tfidf_terms_formula(spark):
    df = spark.createDataFrame([("a", ["x y z", "x y z"]), ("b", ["x y z"]), ("c", [])], "key string, trigrams array<string>")
    t = {(r.key, r.term): (r.tf, r.df, r.tfidf) for r in FE.tfidf_terms(df, "key").collect()}
    import math
    assert t[("a", "x y z")] == (2, 2, 2 * math.log(4 / 3))


def test_stream_shards_have_more_files_for_more_bytes(spark, tmp_dir, monkeypatch):
    import os

    from papyra.plans import queries as Q
    rows = [(i, f"{i} " * 50, "en", "a") for i in range(400)]
    (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
          .write.parquet(f"{tmp_dir}/documents.parquet"))
    monkeypatch.setattr(Q, "_STREAM_FILE_BYTES", 4000)
    monkeypatch.setattr(Q, "_STREAM_RUNS", {})
    path, _, files = Q._shards(spark, tmp_dir)
    assert files > sum(len(t) for _, t, *_ in rows) // 16000 and len([f for f in os.listdir(path.replace("file:", "")) if f.endswith(".parquet")]) == 4 * files
    metrics = Q.q_batch_metrics(spark, tmp_dir).collect()
    assert sorted(r.epoch for r in metrics) == [0, 1, 2, 3] and sum(r.files for r in metrics) == 400
    assert Q.q_stream_dedup(spark, tmp_dir).distinct().count() == 400


def _write_shards(spark, base, n_files=3):
    rows = [(i, f"f{i:03d}.pdf", f"body {i % 7} skills 2020") for i in range(30)] + [(99, "z.txt", "x")]
    df = spark.createDataFrame(rows, "doc_id long, file_name string, text string")
    src = os.path.join(base, "src")
    df.repartitionByRange(n_files, "file_name").write.parquet(src)
    return src, df


def test_stream_equals_batch_by_shard(spark, tmp_dir):
    src, df = _write_shards(spark, tmp_dir)
    out = os.path.join(tmp_dir, "out")
    ST.ingest_stream(spark, src, "doc_id long, file_name string, text string", out,
                     os.path.join(tmp_dir, "ckpt")).awaitTermination()
    got = spark.read.parquet(os.path.join(out, "outcome"))
    assert got.count() == df.count()
    counts = {r.outcome: r["count"] for r in got.groupBy("outcome").count().collect()}
    assert counts["unprocessed"] == 1
    # each hash is kept at most once across epochs, and never after it was seen in an earlier epoch
    kept = got.filter("outcome = 'kept'").groupBy("hash_id").agg(F.countDistinct("epoch").alias("e"))
    assert kept.filter("e > 1").count() == 0
    # batch semantics on the same shards: hashes kept = distinct hashes of supported files
    want = df.filter(~F.col("file_name").endswith(".txt")).select(F.md5("text")).distinct().count()
    assert got.filter("outcome = 'kept'").select("hash_id").distinct().count() == want
    m = ST.batch_metrics(spark, out).orderBy("epoch").collect()
    assert m[-1].total_files == df.count()


def test_stream_restart_is_idempotent(spark, tmp_dir):
    src, df = _write_shards(spark, tmp_dir)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    schema = "doc_id long, file_name string, text string"
    ST.ingest_stream(spark, src, schema, out, ck).awaitTermination()
    first = spark.read.parquet(os.path.join(out, "outcome")).count()
    ST.ingest_stream(spark, src, schema, out, ck).awaitTermination()     # restart: nothing new to read
    assert spark.read.parquet(os.path.join(out, "outcome")).count() == first


def test_stream_dedup(spark, tmp_dir):
    src, df = _write_shards(spark, tmp_dir)
    out = os.path.join(tmp_dir, "dd")
    ST.stream_dedup(spark, src, "doc_id long, file_name string, text string", out,
                    os.path.join(tmp_dir, "ck2")).awaitTermination()
    assert spark.read.parquet(out).count() == df.select(F.md5("text")).distinct().count()


def test_outcome_unchanged_by_in_run_flag_without_copies(spark):
    files = spark.createDataFrame([("a.pdf", "one"), ("b.pdf", "two")], "file_name string, text string")
    e = spark.createDataFrame([], "hash_id string")
    a = sorted(tuple(r) for r in I.ingest_outcome(files, e).select("file_name", "outcome").collect())
    b = sorted(tuple(r) for r in I.ingest_outcome(files, e, in_run_dedup=True).select("file_name", "outcome").collect())
    assert a == b


def test_file_stream_picks_up_only_new_files(spark, tmp_dir):
    page = "<html><body><p>Resume</p><p>Software engineer {n} since 2019</p></body></html>"
    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    for n in range(3):
        with open(os.path.join(src, f"p{n}.html"), "w") as f:
            f.write(page.format(n=n))
    with open(os.path.join(src, "skip.txt"), "w") as f:
        f.write("ignored")
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    ST.ingest_file_stream(spark, src, out, ck).awaitTermination()
    first = spark.read.parquet(os.path.join(out, "outcome"))
    assert sorted(r.file_name for r in first.collect()) == ["p0.html", "p1.html", "p2.html"]
    # new arrivals: one copy of an old page and one new page; old files are not read again
    with open(os.path.join(src, "p9.html"), "w") as f:
        f.write(page.format(n=0))
    with open(os.path.join(src, "p3.html"), "w") as f:
        f.write(page.format(n=3))
    ST.ingest_file_stream(spark, src, out, ck).awaitTermination()
    allrows = {r.file_name: r.outcome for r in spark.read.parquet(os.path.join(out, "outcome")).collect()}
    assert allrows == {"p0.html": "kept", "p1.html": "kept", "p2.html": "kept",
                       "p9.html": "duplicate", "p3.html": "kept"}


def test_terms_move_once_and_shared_keys_meet(spark):
    from collections import Counter
    import math
    rows = [("a", ["x y z", "p q r", "x y z"]), ("b", ["x y z"]), ("b", ["x y z", "s t u"]), (None, ["p q r"]), (None, ["p q r"]),
            ("c", []), ("d", None)]
    df = spark.createDataFrame(rows, "key string, trigrams array<string>").repartition(5)
    tf = Counter((k, t) for k, terms in rows for t in terms or [])
    of = Counter(t for _, t in tf)
    got = FE.tfidf_terms(df, "key")
    assert got.columns == ["term", "key", "tf", "df", "idf", "tfidf"]
    assert Counter((r.key, r.term, r.tf, r.df) for r in got.collect()) == Counter((k, t, n, of[t]) for (k, t), n in tf.items())
    assert {r.term: (r.df, round(r.idf, 9)) for r in FE.idf_table(df, "key").collect()} == {
        t: (n, round(math.log((len(rows) + 1) / (n + 1)), 9)) for t, n in of.items()}
    plain = df.where("key IN ('a', 'c')")
    for t in (FE.tfidf_terms(plain, "key"), FE.idf_table(plain, "key")):
        assert t._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
