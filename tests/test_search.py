"""Search operators: index precedence, joins, memo, scoring, analysis parsing."""

from pyspark.sql import functions as F

from papyra.functions.scoring import weighted_match_score
from papyra.operators import search as S


def test_build_index_last_wins(spark):
    listing = spark.createDataFrame([("a", "f1.json", 1), ("a", "f3.json", 3), ("a", "f2.json", 2), ("b", "f1.json", 1)],
                                    "document_name string, file_path string, ord int")
    got = {r.document_name: r.file_path for r in S.build_index(listing, order_col="ord").collect()}
    assert got == {"a": "f3.json", "b": "f1.json"}


def test_hits_to_index_and_content(spark):
    hits = spark.createDataFrame([(1, "a.pdf.npz", 0.9), (1, "zz.pdf.npz", 0.8), (2, "b.doc.npz", 0.7)],
                                 "query_id int, stored string, score double")
    index = spark.createDataFrame([("a.pdf", "f1"), ("b.doc", "f2")], "document_name string, file_path string")
    recs = spark.createDataFrame([("f1", "a.pdf", "text a"), ("f2", "b.doc", "")],
                                 "source_file string, key string, content string")
    h = S.hits_to_index(hits, index, "stored")
    assert sorted(r.document_name for r in h.collect()) == ["a.pdf", "b.doc"]     # unmatched hit dropped
    c = S.index_to_content(h, recs)
    assert [r.document_name for r in c.collect()] == ["a.pdf"]                    # empty content dropped


def test_weighted_score(spark):
    df = spark.createDataFrame([(["a", "b"], ["c"], [], ["d", "e"], ["a", "c", "d"])],
                               "s array<string>, e array<string>, p array<string>, ed array<string>, doc array<string>")
    got = df.select(weighted_match_score("s", "e", "p", "ed", "doc")).first()[0]
    assert abs(got - 100 * (0.4 * 0.5 + 0.3 * 1.0 + 0.2 * 0.0 + 0.1 * 0.5)) < 1e-9


def test_parse_match_json_quarantines_malformed(spark):
    good = ('{"Overall_Match_Score":"85%","Skill_Match_Breakdown":{"Technical_Skills":"90%","Soft_Skills":"80%",'
            '"Certifications":"10%"},"Experience_Relevance":{"Years_of_Relevant_Experience":"3",'
            '"Experience_Quality":"High"},"Project_Alignment":[{"Project_Name":"x","Description":"y",'
            '"Relevance_Score":0.5}],"Key_Strengths":["k"],"Notable_Gaps":["g"],"Overall_Assessment":"ok",'
            '"Recommendations":{"next":"call"}}')
    df = spark.createDataFrame([(1, good), (2, good[:40]), (3, None)], "id int, j string")
    p = {r.id: r for r in S.parse_match_json(df, "j").collect()}
    assert p[1].analysis.Overall_Match_Score == "85%" and not p[1].parse_error
    assert p[2].analysis is None and p[2].parse_error
    assert p[3].analysis is None and not p[3].parse_error
    parsed = S.parse_match_json(df, "j").filter("NOT parse_error AND analysis IS NOT NULL")
    assert [tuple(r)[1:] for r in S.skill_rows(parsed, keys=("id",)).collect()] == [
        ("Technical Skills", "90%"), ("Soft Skills", "80%"), ("Certifications", "10%")]
    assert S.project_rows(parsed, keys=("id",)).first().Project_Name == "x"
    kinds = sorted(r.kind for r in S.strength_gap_rows(parsed, keys=("id",)).collect())
    assert kinds == ["gap", "recommendation", "strength"]


def test_memo_lookup_computes_only_misses(spark, tmp_dir):
    reqs = spark.createDataFrame([("q1", 5), ("q2", 5)], "query string, lim int")
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.select("request_key", F.lit("fresh" if len(calls) > 1 else "cached").alias("result"))

    S.memo_lookup(reqs.where("query = 'q1'"), f"{tmp_dir}/m", compute, ["query", "lim"])
    out = sorted(r.result for r in S.memo_lookup(reqs, f"{tmp_dir}/m", compute, ["query", "lim"]).collect())
    assert out == ["cached", "fresh"] and calls == [1, 1]


def test_terms_and_requirements(spark):
    df = spark.createDataFrame([("Python, SQL. Five years! Built ETL",)], "t string")
    r = df.select(S.job_requirements("t").alias("r")).first().r
    assert sorted(r.skills) == ["python", "sql"] and sorted(r.experience) == ["five", "years"]
    assert sorted(r.projects) == ["built", "etl"] and r.education == []
