"""Registered queries of the corpus operators: whole tables in, the contract's columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import (collocations, decontaminate, fingerprints, jaccard_join, langid, lm_scoring, mixing, packing,
                        sharding, signature_search, topk, toxicity, url_filter)
from papyra.llm.common import crc_fold, read, written

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHARDS = 24


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fingerprints.with_edited(read(spark, sf_dir, "documents").select("doc_id", "text"))
    both = fingerprints.with_sketch(texts, text_col="edited", name="edited_sketch")
    own = F.col("sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(own, F.col("edited_sketch")).alias("near_edited"),
        F.coalesce(fingerprints.resemblance(own, F.col("next_sketch")), F.lit(0.0)).alias("near_next"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    placed = sharding.shard_rows(docs, {s: 1.0 for s in range(SHARDS)}, added=(SHARDS, 1.0))
    return placed.selectExpr("doc_id", "size", "text_crc32", "'key' AS law", "shard", "slot", "grown_shard")


def op5_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("row", F.monotonically_increasing_id())
    vectors = topk.quantised(written(rows, "vectors"))       # one row, one number, in both readings
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), k=20)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 7) == 2
    model, counts = lm_scoring.learn_model(docs.where(~held_out))
    scored = lm_scoring.score_texts(docs.select("doc_id", "text", held_out.alias("held_out")), model, counts)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
                         "base_score", "score")


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.poisson_mix(docs).select("doc_id", "source", "text", "copy", "n_copies", "rate", "order_key")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    profiles = langid.learn_profiles(docs.where(~held_out))
    judged = langid.predict_languages(docs.select("doc_id", "text", held_out.alias("held_out")), profiles)
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    labels = read(spark, sf_dir, "labels").where(~held_out)
    model = toxicity.learn_field(docs, labels)
    judged = toxicity.score_toxicity(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return judged.select("doc_id", "held_out", "score", "predicted", "spans")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = signature_search.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


REGISTRY = {f.__name__: f for f in (op1_fingerprints, op2_jaccard_join, op3_url_filter, op4_rendezvous, op5_block_topk,
                                    op6_best_fit_packing, op7_lm_scoring,
                                    op8_poisson_mix,
                                    op9_language_id, op10_toxicity, op11_collocations, op12_ranked_search,
                                    op13_decontaminate)}
