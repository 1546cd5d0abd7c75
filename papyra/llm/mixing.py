"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture.  Its repetition rate is
target bytes / own bytes, and every document of it is repeated k times, k drawn
by inverting the Poisson distribution with that mean at a number hashed from the
document id.  The draw needs no other row, so a source that holds a third of
all rows costs no more than any other; only the per-source totals are shuffled,
pre-aggregated.  The copies are dealt out in the order of a hash of
(document, copy), which is the global shuffle.

Without explicit targets a source weighs its bytes to the power ``alpha``.

Edge cases: a null source is a source of its own; null texts count one byte like
empty ones; explicit targets that name no present source are ignored, sources
without a target get none; repeated rows draw alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import fits, unit_hash, without
from papyra.session import cut_lineage

MAX_BROADCAST_SOURCES = 4096     # rows of (source, rate, cdf); above it the rates are joined by shuffle


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5,
                 epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, rate, cdf): repetition rate and Poisson distribution function of each source."""
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) + 1
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(size).alias("bytes"))
    if targets is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(alpha)))
    else:
        weight = F.lit(None).cast("double")
        for name, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        sizes = sizes.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    sizes = cut_lineage(sizes)
    total = sizes.agg(F.sum("bytes").alias("b"), F.sum("weight").alias("w")).first()       # one row
    share = F.col("weight") / float(total["w"]) if total["w"] else F.lit(0.0)
    rates = sizes.withColumn("rate", F.lit(float(epochs)) * share * float(total["b"] or 0) / F.col("bytes"))
    # twelve deviations beyond the mean hold all of the distribution that a 52-bit number can reach
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    terms = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_fact = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    log_rate = F.when(F.col("rate") > 0, F.log("rate")).otherwise(0.0)
    p = (F.when(F.col("rate") > 0, F.exp(F.col("k") * log_rate - F.col("rate") - log_fact))
         .otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0)))
    cdf = terms.withColumn("p", p).withColumn("cdf", F.sum("p").over(upto))
    return (cdf.groupBy("source").agg(F.first("rate").alias("rate"),
                                      F.array_sort(F.collect_list("cdf")).alias("cdf")))


def poisson_mix(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
                seed: int = 8, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """The mixture: every column of ``docs`` plus copy (from 0), n_copies, rate and order_key, shuffled."""
    rates = cut_lineage(source_rates(docs, targets, alpha, epochs, source_col, text_col)
                        .withColumnsRenamed({"source": "_source", "rate": "_rate", "cdf": "_cdf"}))
    small = fits(rates, MAX_BROADCAST_SOURCES)
    doc = F.col(f"`{id_col}`")
    drawn = (without(docs, "copy", "n_copies", "rate", "order_key")
             .join(F.broadcast(rates) if small else rates, F.col(f"`{source_col}`").eqNullSafe(F.col("_source")))
             .withColumn("_u", unit_hash(F.lit(f"count{seed}"), doc))
             .withColumn("_n", F.expr("size(filter(_cdf, c -> c < _u))")).where("_n > 0"))
    copies = (drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
              .withColumns({"n_copies": F.col("_n"), "rate": F.col("_rate"),
                            "order_key": unit_hash(F.lit(f"order{seed}"), doc, F.col("copy"))})
              .drop("_source", "_rate", "_cdf", "_u", "_n"))
    return copies.repartitionByRange("order_key", id_col).sortWithinPartitions("order_key", id_col)
