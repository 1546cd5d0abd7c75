"""The corpus pipeline: language, toxicity, near copies, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``docs``.  A stage fits its model on the documents it is given:
language identification on their ``lang``, toxicity on the ``labels`` of their
ids.  Empty tables pass through; null texts are rejected by the first stage.  Rows
without an id and rows that share one are kept or dropped by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import jaccard_join, langid, mixing, packing, toxicity
from papyra.llm.common import read, written
from papyra.session import ARROW_ROWS, bound_batches, scratch_dir  # noqa: F401
from papyra.session import prepare as prepare_session


def prepare(spark: SparkSession) -> None:
    """Also bounds the Arrow batches of a session that has no bound of its own: five stages share its executors."""
    prepare_session(spark)
    bound_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones; those without a letter go."""
    prepare(spark)
    judged = langid.predict_languages(docs, langid.learn_profiles(docs))
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half."""
    prepare(spark)
    model = toxicity.learn_field(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts: that with the smallest id; those without an id come last.

    Rows are told apart by a written number, not by their ids: repeated rows and several texts
    under one id are judged by their texts.  Rows without a word link with nothing and all stay.
    """
    prepare(spark)
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = jaccard_join.jaccard_components(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    keep = (found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id")
            .agg(F.min_by("_row", order).alias("_row")).select("_row"))
    return rows.join(keep, "_row", "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the Poisson counts of their sources, in a global shuffle."""
    prepare(spark)
    return mixing.poisson_mix(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("drop_toxic", drop_toxic), ("drop_near_copies", drop_near_copies),
          ("mix_sources", mix_sources), ("pack", pack)]

# Trained models, graph components and a tokenizer are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
