"""Registered queries: each binds papyra operators to the driver tables.

Signature of every entry: ``(spark, sf_dir) -> DataFrame``.  Arrays are
rendered as joined strings and doubles rounded to 6 digits so results can be
hash-compared with the DuckDB oracle in ``papyra.plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import names as N
from papyra.functions import scoring as SC
from papyra.functions import text as T
from papyra.functions import vectors as V
from papyra.functions.embedding import hashing_embedding
from papyra.operators import chunking as CH
from papyra.operators import features as FE
from papyra.operators import ingest as I
from papyra.operators import ledger as LG
from papyra.operators import pages as PG
from papyra.operators import routing as R
from papyra.operators import search as S
from papyra.operators import vectors as VO
from papyra.plans import artifacts as A
from papyra.plans import embed_job as EJ
from papyra.plans import fixtures as X
from papyra.plans import search_plan as SP
from papyra.session import scratch_dir, table
from papyra.sinks import point_store as PS
from papyra.sinks import writers as W
from papyra.sources import readers as SR
from papyra.streaming import ingest_stream as ST

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _planted(spark, sf_dir):
    return X.docs_planted(table(spark, sf_dir, "documents"))


def _cleaned(spark, sf_dir):
    return _planted(spark, sf_dir).select("doc_id", "file_name", T.clean_text("text").alias("content"))


# ---------------------------------------------------------------- text (2.7)
@register("content_hash")
def q_content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.content_hash("text").alias("hash_id"))


@register("clean_text")
def q_clean_text(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", "content")


@register("clean_html_text")
def q_clean_html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.clean_html_text("html").alias("text"))


@register("html_to_text")
def q_html_to_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.html_to_text("html").alias("text"))


@register("is_resume_v1")
def q_is_resume_v1(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", T.is_resume_v1("content").alias("is_resume"))


@register("is_resume_v2")
def q_is_resume_v2(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", T.is_resume_v2("content").alias("is_resume"))


@register("extract_emails")
def q_extract_emails(spark, sf_dir):
    c = _cleaned(spark, sf_dir)
    return c.select("doc_id", F.array_join(T.extract_emails("content"), "|").alias("emails"))


@register("extract_phones")
def q_extract_phones(spark, sf_dir):
    c = _cleaned(spark, sf_dir)
    return c.select("doc_id", T.phones_as_text(T.extract_phones("content")).alias("phone_numbers"))


@register("extract_linkedin")
def q_extract_linkedin(spark, sf_dir):
    c = _cleaned(spark, sf_dir)
    return c.select("doc_id", F.array_join(T.extract_linkedin("content"), "|").alias("linkedin"))


@register("extract_github")
def q_extract_github(spark, sf_dir):
    c = _cleaned(spark, sf_dir)
    return c.select("doc_id", F.array_join(T.extract_github("content"), "|").alias("github"))


@register("extract_urls")
def q_extract_urls(spark, sf_dir):
    c = _cleaned(spark, sf_dir)
    return c.select("doc_id", F.array_join(T.extract_urls("content"), "|").alias("urls"))


def _contact_strings(ci):
    return [F.array_join(ci["emails"], "|").alias("emails"),
            T.phones_as_text(ci["phone_numbers"]).alias("phone_numbers"),
            F.array_join(ci["linkedin"], "|").alias("linkedin"),
            F.array_join(ci["github"], "|").alias("github"),
            F.array_join(ci["urls"], "|").alias("urls")]


@register("contact_info")
def q_contact_info(spark, sf_dir):
    c = _cleaned(spark, sf_dir).select("doc_id", T.contact_info("content").alias("ci"))
    return c.select("doc_id", *_contact_strings(F.col("ci")))


# ------------------------------------------------------------ ingest (2.3-2.5)
@register("route_by_extension")
def q_route_by_extension(spark, sf_dir):
    d = X.docs_named(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "file_name", I.route_by_extension("file_name").alias("kind"))


def _ingest_outcome(spark, sf_dir, **kw):
    docs = _planted(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    ledger = X.prior_ledger(docs, labels)
    return I.ingest_outcome(docs, ledger, **kw)


@register("dedup_vs_ledger")
def q_dedup_vs_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("hash_id"))
    ledger = X.prior_ledger(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return I.mark_known_hashes(d, ledger, "hash_id", "is_duplicate")


@register("outcome_routing")
def q_outcome_routing(spark, sf_dir):
    o = _ingest_outcome(spark, sf_dir)
    return o.select("doc_id", "file_name", "kind", "outcome", "hash_id", "is_resume",
                    *_contact_strings(F.col("contact_info")))


@register("run_summary")
def q_run_summary(spark, sf_dir):
    """A folder run: files of other suffixes are not listed, so they count nowhere."""
    outcome = _ingest_outcome(spark, sf_dir)
    return I.run_summary(outcome.where(I.has_supported_extension("file_name")))


@register("duplicate_groups")
def q_duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("hash_id"))
    return I.duplicate_groups(d, "doc_id")


@register("batched_flush")
def q_batched_flush(spark, sf_dir):
    d = X.docs_named(table(spark, sf_dir, "documents")).select("doc_id", "file_name")
    return I.assign_batches(d, ["file_name"], 100)


@register("batch_counters")
def q_batch_counters(spark, sf_dir):
    o = _ingest_outcome(spark, sf_dir).select("file_name", "outcome", "is_resume")
    return I.batch_counters(I.assign_batches(o, ["file_name"], 100))


# ------------------------------------------------------------ names (2.7)
@register("file_basename")
def q_file_basename(spark, sf_dir):
    d = X.docs_named(table(spark, sf_dir, "documents"))
    path = F.concat_ws("/", F.lit("input"), F.col("source"), F.col("file_name"))
    return d.select("doc_id", N.file_basename(path).alias("base_name"))


@register("strip_suffix")
def q_strip_suffix(spark, sf_dir):
    d = X.docs_named(table(spark, sf_dir, "documents"))
    stored = F.concat(F.col("file_name"), F.lit(".npz"))
    return d.select("doc_id", N.strip_suffix(stored).alias("document_name"),
                    N.remove_all(stored, ".npz").alias("without_npz"))


@register("swap_extension")
def q_swap_extension(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", N.swap_extension(N.file_basename("url")).alias("parquet_name"))


@register("iso_timestamps")
def q_iso_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", N.iso_timestamp("ts").alias("created_time"), N.run_stamp("ts").alias("stamp"))


@register("request_key")
def q_request_key(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", N.request_key(F.col("text"), F.lit(5)).alias("cache_key"))


# ------------------------------------------------------------ chunking


@register("chunk_text")
def q_chunk_text(spark, sf_dir):
    return CH.chunk_documents(_cleaned(spark, sf_dir), "content", ["doc_id"])


# ------------------------------------------------------------ routing (2.3)

CANDIDATES = ["doc_id",
              "CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN '' ELSE text END AS c1",
              "concat('[2] ', text) AS c2"]


@register("first_success_nonempty")
def q_first_success_nonempty(spark, sf_dir):
    c = table(spark, sf_dir, "documents").selectExpr(*CANDIDATES)
    return c.select("doc_id", R.first_success_nonempty("c1", "c2").alias("text"))


@register("first_success")
def q_first_success(spark, sf_dir):
    c = table(spark, sf_dir, "documents").selectExpr(*CANDIDATES)
    return c.select("doc_id", R.first_success("c1", "c2").alias("text"))


def _docmap(spark, sf_dir):
    return SR.read_docmap(spark, A.artifacts(spark, sf_dir)["docmap"])


@register("read_docmap")
def q_read_docmap(spark, sf_dir):
    d = _docmap(spark, sf_dir)
    return d.select("key", "content", "hash_id", "is_resume",
                    F.array_join("contact_info.emails", "|").alias("emails"),
                    T.phones_as_text(F.col("contact_info.phone_numbers")).alias("phone_numbers"))


@register("exclude_html_keys")
def q_exclude_html_keys(spark, sf_dir):
    return R.exclude_html_keys(_docmap(spark, sf_dir)).select("key")


@register("project_defaults")
def q_project_defaults(spark, sf_dir):
    return R.project_defaults(R.exclude_html_keys(_docmap(spark, sf_dir)))


@register("resume_only")
def q_resume_only(spark, sf_dir):
    return R.resume_only(R.exclude_html_keys(_docmap(spark, sf_dir))).select("key", "hash_id")


# ------------------------------------------------------------ ledgers
@register("read_hash_ledger")
def q_read_hash_ledger(spark, sf_dir):
    rows = SR.read_hash_ledger_rows(spark, A.artifacts(spark, sf_dir)["hash_ledger"])
    return rows.select(F.col("Filename").alias("file_name"), F.col("Hash ID").alias("hash_id"),
                       F.col("Is Resume").alias("is_resume"))


@register("distinct_hashes")
def q_distinct_hashes(spark, sf_dir):
    return LG.distinct_hashes(SR.read_hash_ledger(spark, A.artifacts(spark, sf_dir)["hash_ledger"]))


@register("union_ledgers")
def q_union_ledgers(spark, sf_dir):
    known = SR.read_hash_ledger(spark, A.artifacts(spark, sf_dir)["hash_ledger"])
    new = A.current_outcome(spark, sf_dir).filter(F.col("outcome") == "kept")
    return LG.union_ledgers(known, new)


@register("read_success_ledger")
def q_read_success_ledger(spark, sf_dir):
    return SR.read_success_ledger(spark, A.artifacts(spark, sf_dir)["status"])


@register("pending_documents")
def q_pending_documents(spark, sf_dir):
    docs = X.docs_named(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("file_name").alias("document_name"))
    done = SR.read_success_ledger(spark, A.artifacts(spark, sf_dir)["status"])
    return LG.pending_documents(docs, done)


@register("pending_files")
def q_pending_files(spark, sf_dir):
    files = X.docs_named(table(spark, sf_dir, "documents")).select(
        "doc_id", F.concat("file_name", F.lit(".npz")).alias("file_name"))
    processed = SR.read_line_list(spark, A.artifacts(spark, sf_dir)["processed"], "file_name")
    return LG.pending_files(files, processed)


@register("merge_duplicates")
def q_merge_duplicates(spark, sf_dir):
    o = I.assign_batches(A.current_outcome(spark, sf_dir).select("file_name", "outcome"), ["file_name"], 100)
    dups = I.outcome_names(o, I.DUPLICATE, extra=["batch_index"]).withColumn("list", F.lit("duplicate"))
    unp = I.outcome_names(o, I.UNPROCESSED, extra=["batch_index"]).withColumn("list", F.lit("unprocessed"))
    return LG.merge_lists(dups, unp)


@register("row_counts_per_file")
def q_row_counts_per_file(spark, sf_dir):
    counts = SR.csv_row_counts(spark, A.artifacts(spark, sf_dir)["hash_ledger"])
    batch = F.regexp_extract("path", r"batch_index=(\d+)", 1)
    return counts.select(F.when(F.col("path").isNotNull(), batch.cast("long")).alias("batch_index"),
                         "rows", "files")


@register("scan_allowlist")
def q_scan_allowlist(spark, sf_dir):
    files = X.docs_named(table(spark, sf_dir, "documents")).select("doc_id", "file_name")
    allow = files.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("file_name")
    return SR.scan_allowlist(files, allow)


# ------------------------------------------------------------ pages
@register("assemble_pages")
def q_assemble_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return PG.assemble_pages(c, "conv_id", "turn", "text", "\n")


# ------------------------------------------------------------ vectors (2.6, 2.9)


def centroids(emb: DataFrame, group_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group: a partial (map-side) average per (group, position)."""
    e = emb.select(group_col, F.posexplode(vec_col).alias("i", "x"))
    m = e.groupBy(group_col, "i").agg(F.avg("x").alias("m"))
    return (m.groupBy(group_col)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector")))


def _round_vec(col):
    return F.transform(col, lambda x: F.round(x.cast("double"), 6))


@register("cosine_similarity")
def q_cosine_similarity(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    c = centroids(emb).withColumnRenamed("vector", "centroid")
    j = emb.join(c, "label")
    return j.select("vec_id", "label", F.round(V.cosine_similarity("embedding", "centroid"), 6).alias("score"))


@register("l2_normalize")
def q_l2_normalize(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", _round_vec(V.l2_normalize("embedding")).alias("vector"))


@register("validate_vector_dim")
def q_validate_vector_dim(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    ok, bad = R.split_by_dim(emb, 64)
    return ok.select("vec_id", F.lit(True).alias("valid")).unionByName(
        bad.select("vec_id", F.lit(False).alias("valid")))


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"),
                                                      "label")


@register("vector_topk")
def q_vector_topk(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    # The query is the corpus mean direction: one vector of `dim` floats.
    mean = centroids(corpus.withColumn("g", F.lit(0)), "g", "vector").first()["vector"]
    top = VO.topk_single(corpus, mean, 5)
    return top.select(F.col("id").alias("vec_id"), "score")


@register("vector_topk_batch")
def q_vector_topk_batch(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    queries = centroids(corpus, "label", "vector").withColumnRenamed("label", "query_id")
    top = VO.exact_topk(corpus, queries, 5)
    return top.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def _points(spark, sf_dir):
    """Each embedding is the vector of chunk 0 of the document with the same id."""
    emb = table(spark, sf_dir, "embeddings")
    docs = X.docs_named(table(spark, sf_dir, "documents")).select("doc_id", "file_name")
    j = emb.join(docs, emb["vec_id"] == docs["doc_id"])
    j = j.select("vec_id", "label", F.concat("file_name", F.lit(".npz")).alias("document_name"),
                 F.lit(0).alias("chunk_index"), "embedding")
    return VO.to_points(j, "document_name", "chunk_index", "embedding", keep=("vec_id", "label"))


@register("project_hits")
def q_project_hits(spark, sf_dir):
    pts = _points(spark, sf_dir)
    queries = centroids(pts, "label", "vector").withColumnRenamed("label", "query_id")
    hits = VO.exact_topk(pts, queries, 5, carry=("payload",))
    return R.project_hits(hits, keep=("query_id",))


def _collection(spark, sf_dir, name="collection"):
    """A written collection of all points: the first version of each query's own collection."""
    own = PS.PointCollection.create(spark, scratch_dir(spark, name), 64,
                                    PS.POINT_DDL + ", vec_id LONG", buckets=16, index_threshold=100)
    own.upsert(_points(spark, sf_dir).select("id", "vector", "payload", "vec_id"))
    return own


@register("upsert_points")
def q_upsert_points(spark, sf_dir):
    """The labelled points again as unit vectors, each id twice: the row of the later run wins; written twice."""
    own = _collection(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    again = own.points().join(lab, "vec_id", "left_semi")
    runs = again.withColumn("run", F.lit(1)).unionByName(
        again.withColumns({"vector": V.l2_normalize("vector"), "run": F.lit(2)}))
    for _ in range(2):
        own.upsert(runs, version_col="run")
    return own.points().select("vec_id", _round_vec(F.col("vector")).alias("vector"))


@register("delete_points")
def q_delete_points(spark, sf_dir):
    own = _collection(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("vec_id"))
    own.delete(own.points().join(toxic, "vec_id", "left_semi").select("id"))
    return own.points().select("vec_id")


@register("collection_versions")
def q_collection_versions(spark, sf_dir):
    """Points per bucket of each version, after an upsert of labelled and a deletion of toxic points."""
    own = _collection(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    again = own.points().join(lab, "vec_id")
    own.upsert(again.withColumn("vector", V.l2_normalize("vector")))
    own.delete(again.where("toxic = 1").select("id"))
    out = [own.points(v).groupBy(VO.shard_of("id", 16).alias("bucket")).agg(F.count("*").alias("points"))
           .withColumn("version", F.lit(v).cast("long")) for v in own.versions()[1:]]
    return reduce(DataFrame.unionByName, out).select("version", "bucket", "points")


@register("collection_quarantine")
def q_collection_quarantine(spark, sf_dir):
    """Points of label 1 lose a component, of 2 their vector, of 3 their id, of 4 get a NaN: refused with a reason."""
    own = PS.PointCollection.create(spark, scratch_dir(spark, "collection"), 64, PS.POINT_DDL + ", vec_id LONG", buckets=16)
    vec = (F.when(F.col("label") == 1, F.slice("vector", 1, 63)).when(F.col("label") == 2, F.lit(None))
           .when(F.col("label") == 4, F.concat(F.slice("vector", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
           .otherwise(F.col("vector")))
    own.upsert(_points(spark, sf_dir).withColumn("vector", vec)
               .withColumn("id", F.when(F.col("label") != 3, F.col("id"))))
    kept = own.points().select("vec_id", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(own.quarantined().select("vec_id", "reason"))


@register("shard_layout")
def q_shard_layout(spark, sf_dir):
    pts = _points(spark, sf_dir)
    return VO.shard_layout(pts).select("vec_id", "shard")


@register("read_vectors")
def q_read_vectors(spark, sf_dir):
    path = scratch_dir(spark, "points")
    W.write_vectors(_points(spark, sf_dir).select("id", "vector", "payload"), path)
    back = SR.read_vectors(spark, path)
    return back.select("payload.document_name", _round_vec(F.col("vector")).alias("vector"))


@register("approx_vector_topk")
def q_approx_vector_topk(spark, sf_dir):
    """Every vector with an id divisible by 50 against a written collection with an index.

    The vectors of this table point everywhere alike, so lists are small: two points each.
    """
    corpus = _corpus(spark, sf_dir)
    own = PS.PointCollection.create(spark, scratch_dir(spark, "collection"), 64, "id LONG, vector ARRAY<FLOAT>", buckets=16,
                                    index_threshold=100)
    own.upsert(corpus.select("id", "vector"))
    own.build_index(per_list=2)
    top = own.search(corpus.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 5)
    return top.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


# ------------------------------------------------------------ search (2.4, 2.6, 2.7)

@register("embed_text")
def q_embed_text(spark, sf_dir):
    recs = R.resume_only(R.exclude_html_keys(SP.docmap_records(spark, sf_dir)))
    ch = CH.chunk_documents(recs, "content", ["key"])
    return ch.select("key", "chunk_index", hashing_embedding("chunk_text", SP.EMBED_DIM).alias("vector"))


@register("vectors_per_document")
def q_vectors_per_document(spark, sf_dir):
    pts = SP.resume_points(spark, sf_dir, stored=False)
    per = pts.select(F.col("payload.document_name").alias("document_name"), "chunk_index", "vector")
    g = PG.vectors_per_document(per, "document_name", "chunk_index", "vector")
    return g.select("document_name", F.col("n_vectors").cast("long").alias("n_vectors"),
                    F.transform("vectors", lambda v: _round_vec(v)).alias("vectors"))


@register("build_index")
def q_build_index(spark, sf_dir):
    ix = SP.index(spark, sf_dir, stored=False)
    return ix.select("document_name", F.col("run").cast("long").alias("run"),
                     F.col("batch_index").cast("long").alias("batch_index"))


@register("hits_to_index")
def q_hits_to_index(spark, sf_dir):
    h = SP.with_index(spark, sf_dir)
    return h.select("query_id", "document_name", "text_id", "score", "rank",
                    F.col("run").cast("long").alias("run"), F.col("batch_index").cast("long").alias("batch_index"))


@register("index_to_content")
def q_index_to_content(spark, sf_dir):
    h = SP.with_content(spark, sf_dir)
    return h.select("query_id", "document_name", "text_id", "score",
                    F.length("content").alias("content_chars"), F.md5("content").alias("content_md5"))


@register("existing_files_semi")
def q_existing_files_semi(spark, sf_dir):
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        A.artifacts(spark, sf_dir)["docmaps"]).select("path")
    h = S.existing_files_semi(SP.with_content(spark, sf_dir), listing)
    return h.select("query_id", "document_name", "text_id")


@register("weighted_match_score")
def q_weighted_match_score(spark, sf_dir):
    return SP.scored(spark, sf_dir).select("query_id", "text_id", "match_score")


@register("search_ranked")
def q_search_ranked(spark, sf_dir):
    r = SP.ranked(spark, sf_dir)
    return r.select("query_id", "match_rank", "document_name", "text_id", "score", "match_score")


@register("build_prompts")
def q_build_prompts(spark, sf_dir):
    s = SP.scored(spark, sf_dir).withColumn("prompt", S.build_prompts("job_text", "content"))
    return s.select("query_id", "text_id", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@register("parse_match_json")
def q_parse_match_json(spark, sf_dir):
    a = SP.analyses(spark, sf_dir)
    return a.select("query_id", "text_id", "parse_error",
                    F.col("analysis.Overall_Match_Score").alias("overall_match_score"),
                    F.col("analysis.Experience_Relevance.Experience_Quality").alias("experience_quality"))


@register("overall_score_numeric")
def q_overall_score_numeric(spark, sf_dir):
    a = SP.analyses(spark, sf_dir)
    return a.select("query_id", "text_id",
                    SC.overall_score_numeric(F.col("analysis.Overall_Match_Score")).alias("overall_score"))


@register("rank_by_match")
def q_rank_by_match(spark, sf_dir):
    a = SP.analyses(spark, sf_dir).withColumn(
        "overall_score", SC.overall_score_numeric(F.col("analysis.Overall_Match_Score")))
    r = S.rank_by_match(a, "overall_score")
    return r.select("query_id", "text_id", "overall_score", "match_rank")


@register("skill_rows")
def q_skill_rows(spark, sf_dir):
    a = SP.analyses(spark, sf_dir).filter(~F.col("parse_error"))
    return S.skill_rows(a, keys=("query_id", "text_id"))


@register("project_rows")
def q_project_rows(spark, sf_dir):
    a = SP.analyses(spark, sf_dir).filter(~F.col("parse_error"))
    return S.project_rows(a, keys=("query_id", "text_id"))


@register("strength_gap_rows")
def q_strength_gap_rows(spark, sf_dir):
    a = SP.analyses(spark, sf_dir).filter(~F.col("parse_error"))
    return S.strength_gap_rows(a, keys=("query_id", "text_id"))


@register("memo_lookup")
def q_memo_lookup(spark, sf_dir):
    """Requests of all jobs after an earlier session has asked for every second one."""
    jobs = SP.job_queries(spark, sf_dir)
    requests = jobs.select("query_id", "job_text").withColumn("limit", F.lit(SP.TOP_K))
    cache = scratch_dir(spark, "search-cache")

    def compute(missing):
        own = jobs.join(missing.select("query_id", "request_key"), "query_id")
        found = SP.ranked(spark, sf_dir, jobs=own.drop("request_key"))
        return (found.join(missing.select("query_id", "request_key"), "query_id")
                .select("request_key", "query_id", "text_id", "match_score", "match_rank"))

    S.memo_lookup(requests.where("query_id % 2 = 0"), cache, compute, ["job_text", "limit"])
    return S.memo_lookup(requests, cache, compute, ["job_text", "limit"])


@register("embed_job")
def q_embed_job(spark, sf_dir):
    """The status ledger of three runs of the embed job: some records lack their content in the first."""
    records = SP.docmap_records(spark, sf_dir)
    own = PS.PointCollection.create(spark, scratch_dir(spark, "collection"), EJ.EMBED_DIM, buckets=16)
    ledger = scratch_dir(spark, "embedding-tracking")
    broken = records.withColumn("content", F.when(F.length("key") % 2 == 0, F.col("content")))
    for run in (broken, records, records):
        EJ.embed_run(run, own, ledger)
    return SR.read_status_ledger(spark, ledger).select("document_name", "status", F.coalesce("error_message", F.lit("")).alias(
        "error_message"))


@register("embed_job_points")
def q_embed_job_points(spark, sf_dir):
    """Vectors per document in the collection after two runs of the embed job, the first stopped before its ledger."""
    records = SP.docmap_records(spark, sf_dir)
    own = PS.PointCollection.create(spark, scratch_dir(spark, "collection"), EJ.EMBED_DIM, buckets=16)
    for ledger in ("lost", "embedding-tracking"):
        EJ.embed_run(records, own, scratch_dir(spark, ledger))
    return own.points().groupBy("payload.document_name").agg(F.count("*").alias("n_vectors"))


# ------------------------------------------------------------ features (2.8)


def _feature_corpus(spark, sf_dir, view=X.docs_named):
    """The flat document table of the clustering job: key, content, hash_id of all documents."""
    d = view(table(spark, sf_dir, "documents"))
    return R.project_defaults(d.select(F.col("file_name").alias("key"), T.clean_text("text").alias("content"),
                                       T.content_hash("text").alias("hash_id")))


def _ingested(documents):
    """The texts an ingest reads, of all documents: without a text, the planted part alone."""
    return X.docs_planted(documents.fillna("", "text"))


def _feature_frame(spark, sf_dir, view=X.docs_named):
    d = FE.tokenize(_feature_corpus(spark, sf_dir, view))
    d = FE.remove_stopwords(d)
    d = FE.ngrams(d, 2, out_col="bigrams")
    return FE.ngrams(d, 3, out_col="trigrams")


@register("tokenize")
def q_tokenize(spark, sf_dir):
    d = FE.tokenize(_feature_corpus(spark, sf_dir))
    return d.select("key", F.size("words").cast("long").alias("n_words"), F.array_join("words", "|").alias("words"))


@register("remove_stopwords")
def q_remove_stopwords(spark, sf_dir):
    d = FE.remove_stopwords(FE.tokenize(_feature_corpus(spark, sf_dir)))
    return d.select("key", F.array_join("filtered_words", "|").alias("filtered_words"))


@register("bigrams")
def q_bigrams(spark, sf_dir):
    return _feature_frame(spark, sf_dir, _ingested).select("key", F.array_join("bigrams", "|").alias("bigrams"))


@register("trigrams")
def q_trigrams(spark, sf_dir):
    return _feature_frame(spark, sf_dir).select("key", F.array_join("trigrams", "|").alias("trigrams"))


@register("combined_terms")
def q_combined_terms(spark, sf_dir):
    return _feature_frame(spark, sf_dir).select("key", FE.combined_terms().alias("combined"))


@register("tfidf_terms")
def q_tfidf_terms(spark, sf_dir):
    t = FE.tfidf_terms(_feature_frame(spark, sf_dir), "key", "trigrams")
    return t.select("key", "term", "tf", "df", F.round("tfidf", 6).alias("tfidf"))


@register("idf")
def q_idf(spark, sf_dir):
    t = FE.idf_table(_feature_frame(spark, sf_dir), "key", "trigrams")
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


@register("hashing_tf")
def q_hashing_tf(spark, sf_dir):
    _, d = FE.text_pipeline(_feature_corpus(spark, sf_dir))
    counts = vector_to_array("rawFeatures")
    return d.select("key", F.size(F.filter(counts, lambda x: x > 0)).alias("buckets_used"),
                    F.aggregate(counts, F.lit(0.0), lambda a, x: a + x).alias("trigram_count"))


def _clusters(spark, sf_dir):
    _, assigned = FE.kmeans(FE.feature_vectors(_feature_corpus(spark, sf_dir)))
    return assigned


@register("kmeans_clusters")
def q_kmeans_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("key", "prediction")


@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    return FE.cluster_sizes(_clusters(spark, sf_dir))


@register("kmeans_elbow")
def q_kmeans_elbow(spark, sf_dir):
    return FE.kmeans_elbow(FE.feature_vectors(_feature_corpus(spark, sf_dir)))


# ------------------------------------------------------------ streaming (2.11)

_STREAM_SHARDS = 4
_STREAM_FILE_BYTES = 64 << 20    # of texts in a file of a shard


def _shards(spark, sf_dir, planted: bool = True):
    """Four arrivals of files in ranges of names; an arrival has as many files as its bytes ask for."""
    docs = table(spark, sf_dir, "documents")
    d = (X.docs_planted(docs) if planted else X.docs_named(docs)).select("doc_id", "file_name", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = 1 + size // (_STREAM_SHARDS * _STREAM_FILE_BYTES)
    path = scratch_dir(spark, "stream-source")
    d.repartitionByRange(_STREAM_SHARDS * files, "file_name").write.parquet(path)
    return path, "doc_id long, file_name string, text string", files


_STREAM_RUNS: dict = {}


def _run_ingest_stream(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STREAM_RUNS:
        src, schema, files = _shards(spark, sf_dir)
        out = scratch_dir(spark, "stream-out")
        q = ST.ingest_stream(spark, src, schema, out, scratch_dir(spark, "stream-ckpt"), max_files_per_trigger=files)
        q.awaitTermination()
        _STREAM_RUNS[key] = out
    return _STREAM_RUNS[key]


@register("ingest_stream")
def q_ingest_stream(spark, sf_dir):
    out = _run_ingest_stream(spark, sf_dir)
    return spark.read.parquet(f"{out}/outcome").select("file_name", "outcome", "hash_id", "epoch")


@register("batch_metrics")
def q_batch_metrics(spark, sf_dir):
    return ST.batch_metrics(spark, _run_ingest_stream(spark, sf_dir))


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    src, schema, _ = _shards(spark, sf_dir, planted=False)
    out = scratch_dir(spark, "dedup-out")
    ST.stream_dedup(spark, src, schema, out, scratch_dir(spark, "dedup-ckpt")).awaitTermination()
    return spark.read.parquet(out).select("hash_id")


# ------------------------------------------------------------ remaining keyed rows
@register("write_hash_ledger")
def q_write_hash_ledger(spark, sf_dir):
    path = scratch_dir(spark, "ledger-out")
    W.write_hash_ledger(A.current_outcome(spark, sf_dir), path)
    rows = SR.read_hash_ledger_rows(spark, path)
    return rows.select(F.col("Filename").alias("file_name"), F.col("Hash ID").alias("hash_id"),
                       F.col("Is Resume").alias("is_resume"))


@register("point_ids")
def q_point_ids(spark, sf_dir):
    ch = CH.chunk_documents(_cleaned(spark, sf_dir), "content", ["doc_id", "file_name"])
    return ch.select("doc_id", "chunk_index", N.point_id(F.concat("file_name", F.lit(".npz")), "chunk_index")
                     .alias("id"))


@register("throughput_eta")
def q_throughput_eta(spark, sf_dir):
    total = table(spark, sf_dir, "documents").count()
    return ST.throughput_eta(ST.batch_metrics(spark, _run_ingest_stream(spark, sf_dir)), F.lit(total))


@register("join_paths_by_name")
def q_join_paths_by_name(spark, sf_dir):
    """Processed vector files -> object paths of the source documents with the same base name."""
    processed = SR.read_line_list(spark, A.artifacts(spark, sf_dir)["processed"], "name")
    names = processed.select(N.remove_all("name", ".npz").alias("filenames"))
    blobs = X.docs_named(table(spark, sf_dir, "documents")).select(
        F.concat_ws("/", F.lit("bucket"), "source", "file_name").alias("filepaths"))
    blobs = blobs.withColumn("filenames", N.file_basename("filepaths"))
    return names.join(blobs, "filenames", "inner")


@register("query_corpus_scores")
def q_query_corpus_scores(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    mean = centroids(corpus.withColumn("g", F.lit(0)), "g", "vector").first()["vector"]
    return VO.query_scores(corpus, mean).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))
