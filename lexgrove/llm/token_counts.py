"""Token counts by an exact length histogram.

Documents are aggregated by encoded length (end id included) into (length, documents); everything else
comes from that histogram. For a context limit L: total tokens, tokens left when every document is cut
at L (tokens of the shorter ones + L times the number of longer ones, a suffix sum), documents cut, and
the share of documents up to L (quantiles are the first length whose share reaches q).

The number of distinct lengths is bounded by the longest document, not by the table. Prefix sums run in
two levels (within blocks of lengths, then over block totals), so no task holds the whole histogram.

Defined cases: null and empty texts have length 1 (the end id); repeated rows count each; very long texts
are encoded whole; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut
from lexgrove.llm.tokens import lengths

BLOCK = 1024


def histogram(lengths_: DataFrame) -> DataFrame:
    """context_limit, n_docs, and cumulative figures, one row per distinct length of lengths_(n_tokens)."""
    h = cut(lengths_.groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count(F.lit(1)).alias("n_docs")))  # texts are encoded once
    h = h.withColumn("_block", F.floor(F.col("context_limit") / BLOCK)).withColumn("_tokens", F.col("n_docs") * F.col("context_limit"))
    totals = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    every = W.orderBy("_block")
    before = every.rowsBetween(W.unboundedPreceding, -1)
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select(
        "_block",
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_d").over(whole).alias("_dall"), F.sum("_t").over(whole).alias("total_tokens"),
    )
    inside = W.partitionBy("_block").orderBy("context_limit").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = h.withColumn("_dc", F.sum("n_docs").over(inside)).withColumn("_tc", F.sum("_tokens").over(inside)).join(totals, "_block")
    up_to = F.col("_d0") + F.col("_dc")
    return h.select(
        "context_limit", "n_docs", up_to.alias("docs_up_to"), (F.col("_dall") - up_to).alias("docs_cut"),
        (F.col("_t0") + F.col("_tc")).alias("tokens_up_to"), "total_tokens",
        (F.col("_t0") + F.col("_tc") + F.col("context_limit") * (F.col("_dall") - up_to)).alias("tokens_if_cut"),
        (up_to / F.col("_dall")).alias("share_up_to"),
    )


def answers(hist: DataFrame, limits: list[int], quantiles: list[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """For each asked limit (any integer, also one that no document has): kind, asked, n, from the histogram."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "asked long")
    cut = hist.crossJoin(F.broadcast(asked)).groupBy("asked").agg(
        F.sum(F.col("n_docs") * F.least("context_limit", "asked")).alias("tokens_if_cut"), F.sum(F.when(F.col("context_limit") > F.col("asked"), F.col("n_docs")).otherwise(0)).alias("docs_cut")
    )
    at = spark.createDataFrame([(float(q),) for q in quantiles], "q double")
    quant = hist.crossJoin(F.broadcast(at)).where("share_up_to >= q").groupBy("q").agg(F.min("context_limit").alias("length"))
    return cut.selectExpr("'limit' kind", "cast(asked as double) asked", "tokens_if_cut n", "docs_cut").unionByName(quant.selectExpr("'quantile' kind", "q asked", "length n", "cast(null as long) docs_cut"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
