"""Search over the vector collection joined back to documents (2.4, 2.6, 2.7).

The reference's request path (encode query -> vector search -> strip suffix
-> index lookup -> read the doc-map -> analyse -> sort) becomes one DataFrame:
the hit list is small (k per query), so every join after the search is a
join of k x queries rows against a keyed table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra import lexicons as L
from papyra import schemas as S
from papyra.functions import scoring as SC
from papyra.functions.names import plain_path, request_key, strip_suffix
from papyra.functions.regex import java_regex
from papyra.session import cut_lineage

_TERM = java_regex(r"[\p{L}\p{N}]+")


def terms(col) -> Column:
    """Distinct lower-case letter/digit runs of a text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(_TERM), 0))


def job_requirements(text_col) -> Column:
    """Deal all sentences of a job text to the rubric's four term lists in turn: sentence i to list i mod 4."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    sentences = F.split(c, r"[.!?]")

    def every_fourth(first: int) -> Column:
        return F.filter(sentences, lambda _, place: place % 4 == first)

    part = [terms(F.coalesce(F.array_join(every_fourth(i), " "), F.lit(""))) for i in range(4)]
    return F.struct(part[0].alias("skills"), part[1].alias("experience"),
                    part[2].alias("projects"), part[3].alias("education"))


# -- F7 -----------------------------------------------------------------------
def build_index(listing: DataFrame, name_col: str = "document_name", file_col: str = "file_path",
                order_col: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """document_name -> file of its latest record (greatest order, then path): a keyed aggregate.

    ``carry`` columns (e.g. the file's partition values) come from the same latest record.
    """
    order = F.struct(F.col(order_col), F.col(file_col)) if order_col else F.col(file_col)
    latest = F.max_by(F.struct(F.col(file_col), *[F.col(c) for c in carry]), order)
    return (listing.groupBy(name_col).agg(latest.alias("_l"))
                   .select(name_col, *[F.col(f"_l.{c}").alias(c) for c in (file_col, *carry)]))


# -- D15 + E5 -----------------------------------------------------------------
def hits_to_index(hits: DataFrame, index: DataFrame, stored_name_col: str = "document_name") -> DataFrame:
    """Strip the stored-file suffix and look the document up; unmatched hits are dropped."""
    h = hits.withColumn("document_name", strip_suffix(stored_name_col))
    return h.join(index, "document_name")


# -- E6 -----------------------------------------------------------------------
def index_to_content(hits: DataFrame, records: DataFrame, file_col: str = "file_path",
                     key_col: str = "key", content_col: str = "content",
                     partition_cols: tuple[str, ...] = (), hits_bounded: bool = False) -> DataFrame:
    """Fetch each hit's content from the file the index names; null or empty content is dropped.

    When the records are a partitioned table and the hits carry its partition
    values, the equi-join on them lets Spark prune the record files at run time
    (dynamic partition pruning): only the batches that hold a hit are read.
    ``hits_bounded`` says the hit table has a proven size bound (k x a checked
    query block), so it is broadcast, which is what enables the pruning.
    """
    r = records.select(*partition_cols, F.col("source_file").alias(file_col),
                       F.col(key_col).alias("document_name"), F.col(content_col).alias("content"))
    h = F.broadcast(hits) if hits_bounded else hits
    out = r.join(h, [*partition_cols, file_col, "document_name"])
    return out.filter(F.col("content").isNotNull() & (F.length("content") > 0))


# -- E8 -----------------------------------------------------------------------
def existing_files_semi(results: DataFrame, listing: DataFrame, file_col: str = "file_path") -> DataFrame:
    """Keep results whose file is present in a listing, whatever the form of either path."""
    there = listing.select(plain_path("path").alias("_path")).distinct()
    return results.join(there, plain_path(file_col) == F.col("_path"), "left_semi")


# -- E9 -----------------------------------------------------------------------
def memo_lookup(requests: DataFrame, cache: str, compute, key_cols: list[str], version: str = "") -> DataFrame:
    """Answer requests from a stored result table; search only for the misses and store their answers.

    ``compute(missing_requests) -> DataFrame`` gives rows with ``request_key``.  The key holds
    ``version`` (that of the searched collection), so answers of another version never match.  The
    misses are settled before the search is planned: with none, ``compute`` isn't called and nothing
    that it would read is read.  A request without results is stored as answered too; answers are
    written before the keys that vouch for them, so a stopped run only searches again.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("request_key", request_key(*key_cols, *([F.lit(version)] if version else [])))
    answered, results = f"{cache}/answered", f"{cache}/results"
    known = _stored(spark, answered, "request_key string, run string")
    if known is not None:
        missing = keyed.join(known.select("request_key"), "request_key", "left_anti")
    else:
        missing = keyed
    missing = cut_lineage(missing.dropDuplicates(["request_key"]))
    if not missing.isEmpty():
        run = uuid.uuid4().hex
        compute(missing).withColumn("run", F.lit(run)).write.mode("append").parquet(results)
        missing.select("request_key", F.lit(run).alias("run")).write.mode("append").parquet(answered)
    keys = spark.read.parquet(answered).join(keyed.select("request_key"), "request_key", "left_semi")
    # one run per key: two sessions that missed the same request at once have both stored its answer
    keys = keys.groupBy("request_key").agg(F.min("run").alias("run"))
    return spark.read.parquet(results).join(keys, ["request_key", "run"], "left_semi").drop("run")


def _stored(spark, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# -- D23 ----------------------------------------------------------------------
PROMPT_TEMPLATE = ("Analyze and quantify the relevance between the provided job description and "
                   "candidate's resume.\n\nJob Description: %s\nResume: %s\n")


def build_prompts(job_col, resume_col, template: str = PROMPT_TEMPLATE) -> Column:
    return F.format_string(template, F.col(job_col), F.col(resume_col))


# -- D25 ----------------------------------------------------------------------
def match_components(req_col: str, doc_terms_col: str) -> Column:
    r = F.col(req_col)
    d = F.col(doc_terms_col)
    return F.struct(SC.term_coverage(r["skills"], d).alias("skills"),
                    SC.term_coverage(r["experience"], d).alias("experience"),
                    SC.term_coverage(r["projects"], d).alias("projects"),
                    SC.term_coverage(r["education"], d).alias("education"))


def weighted_score(req_col: str, doc_terms_col: str) -> Column:
    r = F.col(req_col)
    return SC.weighted_match_score(r["skills"], r["experience"], r["projects"], r["education"],
                                   F.col(doc_terms_col))


# -- G3 -----------------------------------------------------------------------
def rank_by_match(results: DataFrame, score_col: str, group_col: str = "query_id",
                  tie_cols=("score", "text_id")) -> DataFrame:
    """Order each query's results by numeric match score (desc), ties broken deterministically."""
    order = [F.desc(score_col)] + [F.desc(tie_cols[0])] + [F.asc(c) for c in tie_cols[1:]]
    w = Window.partitionBy(group_col).orderBy(*order)
    return results.withColumn("match_rank", F.row_number().over(w).cast("long"))


# -- analysis records (D24, D26-D29) -----------------------------------------
def analysis_json(req_col: str, doc_terms_col: str, max_chars: int | None = None,
                  truncate_when: Column | None = None) -> Column:
    """A match-analysis JSON document (the shape of the reference's model output), built deterministically.

    ``truncate_when`` cuts the JSON to ``max_chars`` (an output-limit failure) so
    the parser's quarantine path is exercised by real rows.
    """
    comp = match_components(req_col, doc_terms_col)
    pct = lambda x: F.format_string("%d%%", F.round(x * 100).cast("int"))
    r = F.col(req_col)
    d = F.col(doc_terms_col)
    overall = weighted_score(req_col, doc_terms_col)
    strengths = F.array_sort(F.array_intersect(r["skills"], d))
    gaps = F.array_sort(F.array_except(r["skills"], d))
    projects = F.transform(F.array_sort(F.array_intersect(r["projects"], d)),
                           lambda t: F.struct(t.alias("Project_Name"),
                                              F.concat(F.lit("uses "), t).alias("Description"),
                                              F.round(comp["projects"], 4).alias("Relevance_Score")))
    rec = F.struct(
        F.format_string("%d%%", F.round(overall).cast("int")).alias("Overall_Match_Score"),
        F.struct(pct(comp["skills"]).alias("Technical_Skills"), pct(comp["experience"]).alias("Soft_Skills"),
                 pct(comp["education"]).alias("Certifications")).alias("Skill_Match_Breakdown"),
        F.struct(F.format_string("%d terms", F.size(F.array_intersect(r["experience"], d))).alias(
            "Years_of_Relevant_Experience"),
                 F.when(comp["experience"] >= 0.5, "High").when(comp["experience"] >= 0.2, "Medium")
                  .otherwise("Low").alias("Experience_Quality")).alias("Experience_Relevance"),
        projects.alias("Project_Alignment"),
        strengths.alias("Key_Strengths"),
        gaps.alias("Notable_Gaps"),
        F.format_string("%d of %d skill terms present", F.size(F.array_intersect(r["skills"], d)),
                        F.size(r["skills"])).alias("Overall_Assessment"),
        F.create_map(F.lit("next_step"), F.when(overall >= 50, "interview").otherwise("review")).alias(
            "Recommendations"),
    )
    js = F.to_json(rec)
    if max_chars and truncate_when is not None:
        js = F.when(truncate_when, F.left(js, F.lit(max_chars))).otherwise(js)
    return js


def parse_match_json(df: DataFrame, json_col: str, out_col: str = "analysis") -> DataFrame:
    """Parse the analysis JSON; malformed rows keep ``analysis`` null and set ``parse_error``."""
    schema = T.StructType(S.ANALYSIS.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(F.col(json_col), schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    d = df.withColumn("_parsed", parsed)
    bad = F.col("_parsed").isNull() | F.col("_parsed._corrupt_record").isNotNull()
    return (d.withColumn("parse_error", F.col(json_col).isNotNull() & bad)
             .withColumn(out_col, F.when(~F.col("parse_error"), F.col("_parsed").dropFields("_corrupt_record")))
             .drop("_parsed"))


def skill_rows(df: DataFrame, analysis_col: str = "analysis", keys=("query_id", "document_name")) -> DataFrame:
    """The three skill lines of each analysis as rows (Skill Type, Match)."""
    b = F.col(f"{analysis_col}.Skill_Match_Breakdown")
    return df.select(*keys, F.inline(F.array(
        F.struct(F.lit("Technical Skills").alias("skill_type"), b["Technical_Skills"].alias("match")),
        F.struct(F.lit("Soft Skills").alias("skill_type"), b["Soft_Skills"].alias("match")),
        F.struct(F.lit("Certifications").alias("skill_type"), b["Certifications"].alias("match")))))


def project_rows(df: DataFrame, analysis_col: str = "analysis", keys=("query_id", "document_name")) -> DataFrame:
    """One row per aligned project."""
    return df.select(*keys, F.inline(F.col(f"{analysis_col}.Project_Alignment")))


def strength_gap_rows(df: DataFrame, analysis_col: str = "analysis", keys=("query_id", "document_name")) -> DataFrame:
    """Strengths, gaps and recommendations as (kind, key, value) rows."""
    a = F.col(analysis_col)
    s = df.select(*keys, F.lit("strength").alias("kind"), F.lit(None).cast("string").alias("key"),
                  F.explode(a["Key_Strengths"]).alias("value"))
    g = df.select(*keys, F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("key"),
                  F.explode(a["Notable_Gaps"]).alias("value"))
    r = df.select(*keys, F.lit("recommendation").alias("kind"), F.explode(a["Recommendations"]).alias("key", "value"))
    return s.unionByName(g).unionByName(r)


SEARCH_LIMIT = L.SEARCH_LIMIT
