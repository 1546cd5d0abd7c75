"""Text features and clustering (2.8) on Spark ML.

The reference settings: tokens -> English stop words removed -> bigrams and
trigrams -> trigram counts hashed to 5000 buckets -> IDF -> KMeans(k=9,
seed=1, maxIter=50).  ``tfidf_terms`` is the same weighting keyed by the
trigram itself, which an SQL engine can check.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, NGram, StopWordsRemover, Tokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra import lexicons as L
from papyra.session import cut_lineage, written

TERMS_PER_TASK = 1 << 22      # rows of about 100 bytes that a task sorts by term


def text_stages(text_col: str = "content", num_features: int = L.TFIDF_NUM_FEATURES):
    """H1-H7 as ML stages (bigrams are an output only; features use trigrams)."""
    return [
        Tokenizer(inputCol=text_col, outputCol="words"),
        StopWordsRemover(inputCol="words", outputCol="filtered_words"),
        NGram(n=2, inputCol="filtered_words", outputCol="bigrams"),
        NGram(n=3, inputCol="filtered_words", outputCol="trigrams"),
        HashingTF(inputCol="trigrams", outputCol="rawFeatures", numFeatures=num_features),
        IDF(inputCol="rawFeatures", outputCol="features"),
    ]


def text_pipeline(df: DataFrame, text_col: str = "content") -> tuple[PipelineModel, DataFrame]:
    """H8: fit the feature pipeline (one pass for IDF document frequencies) and transform."""
    model = Pipeline(stages=text_stages(text_col)).fit(df)
    return model, model.transform(df)


def feature_vectors(df: DataFrame, key_col: str = "key", text_col: str = "content") -> DataFrame:
    """H8 for passes to come: (key, features) of ``text_pipeline``, from counts that are written once.

    Texts are split and hashed by the write alone; the IDF fit, the clustering and its
    assignment read the counts, which take less room than the weighted vectors.
    """
    *counting, idf = text_stages(text_col)
    counts = written(PipelineModel(counting).transform(df).select(key_col, idf.getInputCol()), "term-counts")
    return idf.fit(counts).transform(counts).select(key_col, idf.getOutputCol())


def tokenize(df: DataFrame, text_col: str = "content") -> DataFrame:
    return Tokenizer(inputCol=text_col, outputCol="words").transform(df)


def remove_stopwords(df: DataFrame, words_col: str = "words", out_col: str = "filtered_words") -> DataFrame:
    return StopWordsRemover(inputCol=words_col, outputCol=out_col).transform(df)


def ngrams(df: DataFrame, n: int, words_col: str = "filtered_words", out_col: str | None = None) -> DataFrame:
    return NGram(n=n, inputCol=words_col, outputCol=out_col or f"ngram{n}").transform(df)


def combined_terms(words="filtered_words", bigrams="bigrams", trigrams="trigrams"):
    """H5: words, bigrams and trigrams in one space-separated string."""
    return F.concat_ws(" ", F.col(words), F.col(bigrams), F.col(trigrams))


def _counted_in_rows(df: DataFrame, key_col: str, terms_col: str) -> DataFrame:
    """(key, term, tf) of each row by itself: its terms are sorted and runs of equal ones counted, so no row moves."""
    rows = df.select(key_col, F.array_sort(terms_col).alias("_sorted"))
    n = F.size("_sorted")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: (i <= n) & ((i == n) | ~F.get("_sorted", i).eqNullSafe(F.get("_sorted", i - 1))))
    rows = rows.select(key_col, "_sorted", ends.alias("_ends"))
    runs = F.transform("_ends", lambda e, j: F.struct(
        F.get("_sorted", e - 1).alias("term"), (e - F.coalesce(F.get("_ends", j - 1), F.lit(0))).cast("long").alias("tf")))
    return rows.select(key_col, F.explode(runs).alias("_run")).select(key_col, "_run.term", "_run.tf")


def term_frequencies(df: DataFrame, key_col: str, terms_col: str = "trigrams") -> DataFrame:
    """(document, term) -> occurrences; only rows whose key other rows share (or have none, too) meet in a shuffle."""
    keys = df.groupBy(key_col).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col(key_col).alias("_key"))
    keys = cut_lineage(keys)
    if keys.isEmpty():
        return _counted_in_rows(df, key_col, terms_col)
    same = F.col(key_col).eqNullSafe(F.col("_key"))
    shared = (_counted_in_rows(df.join(keys, same, "left_semi"), key_col, terms_col)
              .groupBy(key_col, "term").agg(F.sum("tf").alias("tf")))
    return _counted_in_rows(df.join(keys, same, "left_anti"), key_col, terms_col).unionByName(shared)


def _by_term(tf: DataFrame, n_terms: int) -> DataFrame:
    """Rows of a term together, in as many partitions as keep each one's sort in memory."""
    least = int(tf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tf.repartition(max(least, -(-n_terms // TERMS_PER_TASK)), "term")


def _sizes(df: DataFrame, terms_col: str) -> tuple[int, int]:
    """Documents, and their terms with repeats."""
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size(terms_col), F.lit(0))), F.lit(0))).first())


def _idf(df_col: str, n_docs: int):
    return F.log((F.lit(n_docs) + 1.0) / (F.col(df_col) + 1.0))


def tfidf_terms(df: DataFrame, key_col: str, terms_col: str = "trigrams") -> DataFrame:
    """H7 keyed by term: tf x ln((N + 1) / (df + 1)), N = number of documents.

    A document's terms are counted where it lies, and (document, term) rows move once, to
    their term, where the window counts them.  No term has more rows than there are documents.
    """
    n_docs, n_terms = _sizes(df, terms_col)
    tf = _by_term(term_frequencies(df, key_col, terms_col).where("term IS NOT NULL"), n_terms)
    return (tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term"))).withColumn("idf", _idf("df", n_docs))
            .select("term", key_col, "tf", "df", "idf").withColumn("tfidf", F.col("tf") * F.col("idf")))


def idf_table(df: DataFrame, key_col: str, terms_col: str = "trigrams") -> DataFrame:
    """H7 per term: term -> document frequency and ln((N + 1) / (df + 1)); terms alone move, once."""
    n_docs, n_terms = _sizes(df, terms_col)
    terms = _by_term(term_frequencies(df, key_col, terms_col).select("term"), n_terms)
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", _idf("df", n_docs))


def _spread(features: DataFrame, features_col: str) -> DataFrame:
    """The vectors alone, dealt evenly and checkpointed: one narrow shuffle, whatever passes a fit makes."""
    return cut_lineage(features.select(features_col).repartition(
        int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def kmeans(features: DataFrame, k: int = L.KMEANS_K, seed: int = L.KMEANS_SEED,
           max_iter: int = L.KMEANS_MAX_ITER, features_col: str = "features"):
    """H9: fit KMeans and assign every row a cluster."""
    model = KMeans(k=k, seed=seed, featuresCol=features_col, maxIter=max_iter).fit(_spread(features, features_col))
    return model, model.transform(features)


def project_clusters(assigned: DataFrame, key_col: str = "key") -> DataFrame:
    """The columns the clustering report keeps."""
    return assigned.select(key_col, "filtered_words", "bigrams", "trigrams", "prediction")


def cluster_sizes(assigned: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """Rows per cluster."""
    return assigned.groupBy(pred_col).agg(F.count(F.lit(1)).alias("size"))


def kmeans_elbow(features: DataFrame, k_range=L.ELBOW_K_RANGE, seed: int = L.KMEANS_SEED,
                 max_iter: int = L.KMEANS_MAX_ITER, features_col: str = "features") -> DataFrame:
    """Within-cluster sum of squares for each k.

    Every fit holds the vectors as KMeans keeps them and lets them go; a cache beside it would
    hold them twice and be decoded in every pass.
    """
    spread = _spread(features, features_col)
    costs = []
    for k in range(k_range[0], k_range[1] + 1):
        m = KMeans(k=k, seed=seed, featuresCol=features_col, maxIter=max_iter).fit(spread)
        cost = m.summary.trainingCost
        costs.append((k, float(cost) if not math.isnan(cost) else None))
    return features.sparkSession.createDataFrame(costs, "k int, wcss double")
