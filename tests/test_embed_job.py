"""The restartable embed job and the stored search cache."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import search as S
from papyra.plans import embed_job as EJ
from papyra.sinks import point_store as PS
from papyra.sinks import writers as W
from papyra.sources import readers as SR

ROWS = [("a.pdf", "alpha " * 300, True), ("b.pdf", "beta", True), ("poison.pdf", "poison here", True), ("none.pdf", None, True),
        ("empty.pdf", "", True), ("page.html", "html", True), ("no.pdf", "not a resume", False), (None, "no name", True),
        ("twice.pdf", "one", True), ("twice.pdf", "two", True)]


def _records(spark, rows=ROWS):
    return spark.createDataFrame(rows, "key string, content string, is_resume boolean")


def _poisoned():
    def encode(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("cannot encode")
        return np.ones((len(texts), 4))
    return encode


def _plain():
    return lambda texts: np.full((len(texts), 4), 2.0)


def _counted(calls):
    def make():
        def encode(texts):
            raise AssertionError(f"encoded again: {texts}")
        return encode
    return make


def _held(c):
    rows = c.points().groupBy("payload.document_name").agg(F.count("*").alias("n")).collect()
    return {r["document_name"]: r["n"] for r in rows}


def test_runs_retry_failures_only(spark, tmp_dir):
    c, ledger = PS.PointCollection.create(spark, f"{tmp_dir}/c", 4, buckets=4), f"{tmp_dir}/ledger"
    assert EJ.embed_run(_records(spark), c, ledger, make_encoder=_poisoned) == {"success": 4, "fail": 2}
    errors = {r.document_name: r.error_message for r in SR.read_status_ledger(spark, ledger).where("status = 'fail'").collect()}
    assert errors == {"poison.pdf": "RuntimeError: cannot encode", "none.pdf": "ValueError: no content"}
    first = _held(c)
    assert set(first) == {"a.pdf.npz", "b.pdf.npz", "twice.pdf.npz"} and first["a.pdf.npz"] > 1
    assert EJ.embed_run(_records(spark), c, ledger, make_encoder=_plain) == {"success": 1, "fail": 1}
    assert _held(c) == first | {"poison.pdf.npz": 1}
    done = _records(spark, [r for r in ROWS if r[1] is not None])
    assert EJ.embed_run(done, c, ledger, make_encoder=_counted([])) == {"success": 0, "fail": 0}   # nothing is encoded


def test_stopped_between_points_and_ledger(spark, tmp_dir, monkeypatch):
    c, ledger = PS.PointCollection.create(spark, f"{tmp_dir}/c", 4, buckets=4), f"{tmp_dir}/ledger"

    def stop(*_):
        raise OSError("driver stopped")

    with monkeypatch.context() as m:
        m.setattr(W, "append_status_ledger", stop)
        with pytest.raises(OSError):
            EJ.embed_run(_records(spark), c, ledger, make_encoder=_plain)
    before = _held(c)
    ids = {r.id for r in c.points().select("id").collect()}
    assert EJ.embed_run(_records(spark), c, ledger, make_encoder=_plain)["success"] == 5
    assert _held(c) == before and {r.id for r in c.points().select("id").collect()} == ids
    # a document that got shorter before it succeeded leaves no old chunks
    shorter = _records(spark, [("a.pdf", "alpha", True)])
    assert EJ.embed_run(shorter, c, f"{tmp_dir}/other", make_encoder=_plain) == {"success": 1, "fail": 0}
    assert _held(c)["a.pdf.npz"] == 1


def test_bad_answers_of_an_encoder_fail_their_document(spark):
    def make():
        return lambda texts: {"few": np.ones((0, 4)), "odd": np.ones((1, 3)), "nan": np.full((1, 4), np.nan)}.get(
            texts[0], np.ones((1, 4)))

    got = EJ.embed_attempts(_records(spark, [(k, k, True) for k in ("few", "odd", "nan", "fine")]), make, 4)
    assert {r.document_name: r.status for r in got.collect()} == {"few": "fail", "odd": "fail", "nan": "fail", "fine": "success"}


def test_cached_requests_read_no_vector(spark, tmp_dir):
    requests = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None)], "query_id int, job string")
    asked = []

    def compute(missing):
        asked.append({r.job for r in missing.collect()})
        hits = missing.where("job = 'y'")                     # x and null have no results
        return hits.select("request_key", F.lit(0.5).alias("score"))

    first = S.memo_lookup(requests.where("query_id < 3"), f"{tmp_dir}/m", compute, ["job"], version="7")
    assert [r.score for r in first.collect()] == [0.5]
    both = S.memo_lookup(requests, f"{tmp_dir}/m", compute, ["job"], version="7")
    assert both.count() == 1 and asked == [{"x", "y"}, {None}]

    def never(missing):
        raise AssertionError("searched")

    plan = S.memo_lookup(requests, f"{tmp_dir}/m", never, ["job"], version="7")
    assert plan.count() == 1
    S.memo_lookup(requests, f"{tmp_dir}/m", compute, ["job"], version="8")    # another version of the collection
    assert asked[-1] == {"x", "y", None}


def test_every_sentence_is_dealt(spark):
    text = "one a. two b! three c? four d. five e. six. seven. eight. nine"
    r = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(S.job_requirements("t").alias("r")).collect()
    assert r[0].r.asDict() == {"skills": ["one", "a", "five", "e", "nine"], "experience": ["two", "b", "six"],
                               "projects": ["three", "c", "seven"], "education": ["four", "d", "eight"]}
    assert r[1].r.skills == [] and r[2].r.education == []
