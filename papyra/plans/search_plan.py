"""End-to-end resume search (G4) composed from papyra operators.

corpus: current-run resume records (doc-map) -> chunks -> hashing embedding -> points
queries: benchmark job texts -> cleaned -> embedding + rubric requirement terms
search: exact top-k chunks per job -> strip suffix -> index -> content -> rubric score -> rank
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.functions.embedding import hashing_embedding
from papyra.operators import search as S
from papyra.operators import vectors as VO
from papyra.plans import artifacts as A
from papyra.plans import embed_job as EJ
from papyra.session import table
from papyra.sources import readers as SR

EMBED_DIM = EJ.EMBED_DIM
TOP_K = 5


def docmap_records(spark: SparkSession, sf_dir: str, all_runs: bool = False) -> DataFrame:
    """Current-run records, or every run's records as a table partitioned by (run, batch_index)."""
    paths = A.artifacts(spark, sf_dir)
    if all_runs:
        return SR.read_docmap(spark, paths["docmaps"], partitioned=True)
    return SR.read_docmap(spark, paths["docmap"])


def resume_points(spark: SparkSession, sf_dir: str, stored: bool = True, skip_html: bool = True,
                  resumes_only: bool = True) -> DataFrame:
    """The vector collection: read as stored by the ingest-time embed job, or computed."""
    if stored and skip_html and resumes_only:
        return SR.read_vectors(spark, A.artifacts(spark, sf_dir)["points"])
    return EJ.resume_points(docmap_records(spark, sf_dir), skip_html, resumes_only)


def job_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                 T.clean_text("text").alias("job_text"))
    return (b.withColumn("vector", hashing_embedding("job_text", EMBED_DIM))
             .withColumn("req", S.job_requirements("job_text")))


def index(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """Index over the doc-map files of every run; the latest (run, batch) file wins.

    ``stored`` reads the table written at ingest time (a narrow Parquet lookup);
    otherwise it is built from the doc-maps (the build step itself).
    """
    paths = A.artifacts(spark, sf_dir)
    if stored:
        return spark.read.parquet(paths["index"])
    return A.build_document_index(spark, paths["docmaps"])


def hits(spark: SparkSession, sf_dir: str, k: int = TOP_K, jobs: DataFrame | None = None) -> DataFrame:
    """``jobs``: rows of ``job_queries`` to search for; all of them by default."""
    q = job_queries(spark, sf_dir) if jobs is None else jobs
    top = VO.exact_topk(resume_points(spark, sf_dir), q.select("query_id", "vector"), k, carry=("payload",))
    return top.select("query_id", F.col("payload.text_id").alias("text_id"),
                      F.col("payload.document_name").alias("stored_name"), "score",
                      F.col("rank").cast("long").alias("rank"))


def with_index(spark: SparkSession, sf_dir: str, k: int = TOP_K, jobs: DataFrame | None = None) -> DataFrame:
    return S.hits_to_index(hits(spark, sf_dir, k, jobs), index(spark, sf_dir), "stored_name")


def with_content(spark: SparkSession, sf_dir: str, k: int = TOP_K, jobs: DataFrame | None = None) -> DataFrame:
    # hits: k rows per job query, and the job queries passed the broadcast-block check
    n_jobs = (job_queries(spark, sf_dir) if jobs is None else jobs).limit(VO.MAX_BROADCAST_QUERIES + 1).count()
    return S.index_to_content(with_index(spark, sf_dir, k, jobs), docmap_records(spark, sf_dir, all_runs=True),
                              partition_cols=("run", "batch_index"),
                              hits_bounded=n_jobs <= VO.MAX_BROADCAST_QUERIES)


def scored(spark: SparkSession, sf_dir: str, k: int = TOP_K, jobs: DataFrame | None = None) -> DataFrame:
    q = (job_queries(spark, sf_dir) if jobs is None else jobs).select("query_id", "job_text", "req")
    # Both sides are O(queries); AQE broadcasts the job table only if its runtime size is small.
    h = with_content(spark, sf_dir, k, jobs).join(q, "query_id")
    h = h.withColumn("doc_terms", S.terms("content"))
    return h.withColumn("match_score", F.round(S.weighted_score("req", "doc_terms"), 6))


def ranked(spark: SparkSession, sf_dir: str, k: int = TOP_K, jobs: DataFrame | None = None) -> DataFrame:
    return S.rank_by_match(scored(spark, sf_dir, k, jobs), "match_score")


def analyses(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    s = scored(spark, sf_dir, k)
    js = S.analysis_json("req", "doc_terms")
    return S.parse_match_json(s.withColumn("analysis_json", js), "analysis_json")
