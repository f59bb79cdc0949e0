"""Exact dedup by skew-safe combining, in DataFrame operations only.

Stage 0 counts digests (no text moves). A digest that occurs once has no partner, so only rows of
repeated digests go on. Stage 1 groups those rows by (digest, salt, full content): Spark's map-side
half of that aggregate is the local dedup, its reduce-side half merges one salted group. Stage 2
combines the salt winners by (digest, full content). Every stage compares whole contents; should two
contents share a digest, they stay two groups. A group of any size sends at most one row per map task
and salt, so a third of all rows in one group is not a hot task.

Defined cases: null text counts as empty; empty texts are equal; ties go to the smallest doc_id, a null
doc_id comes last; rows that repeat a doc_id with an equal text are one identity: all are marked kept if
that doc_id stays; an empty table gives an empty result; other columns are ignored. ``without_copies`` decides
per row instead: one row of each group stays, also where doc_ids are equal or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut, ids_are_keys, with_row_key

#: Salted groups a repeated digest is merged in before the winners meet.
SALTS = 16


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \t\n\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest=sha256, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text).

    With ``row``, a written column unique to each row, that column comes too and ``kept`` holds for one row of a group.
    """
    own = [] if row is None else [row]
    base = docs.select("doc_id", *own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    full = base.select(
        "doc_id",
        *own,
        F.char_length("_text").alias("_len"),
        normalised(F.col("_text")).alias("_content"),
    ).withColumn("_digest", digest(F.col("_content")))
    sha = F.sha2(F.col("_content"), 256)
    keyed = cut(full.select("doc_id", *own, "_digest", *([] if digest is sha256 else [sha.alias("_sha")])))

    # written first: a side that is read from a table can be split where the other side is skewed
    repeated = cut(keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest"))
    members = full.join(repeated, "_digest", "left_semi")
    best = F.max(F.struct(F.col("_len"), (-F.col("doc_id")).alias("_neg"), *[(-F.col(c)).alias("_neg_row") for c in own])).alias("_best")
    salted = members.groupBy("_digest", F.pmod(F.xxhash64(row or "doc_id"), F.lit(salts)).alias("_salt"), "_content").agg(best, F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_digest", "_content").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))
    keep_row = ["_keep_row" for _ in own]
    groups = merged.select("_digest", "_content", (-F.col("_best._neg")).alias("keep_id"), *[(-F.col("_best._neg_row")).alias(c) for c in keep_row], F.col("_n").alias("group_size"))

    by_digest = cut(groups.groupBy("_digest").agg(F.max("keep_id").alias("keep_id"), *[F.max(c).alias(c) for c in keep_row], F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("_contents")))
    plain = keyed.join(by_digest, "_digest", "left").where("_contents is null or _contents = 1")
    shown = F.lower(F.hex("_digest")) if digest is sha256 else F.col("_sha")
    out = plain.select(
        "doc_id",
        F.when(F.col("_contents").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        shown.alias("text_sha256"),
        *own,
        *[F.coalesce(c, row).alias(c) for c in keep_row],
    )
    clash = by_digest.where("_contents > 1").select("_digest")
    if not clash.isEmpty():  # contents that share a digest: their rows find their group by content
        apart = full.join(clash, "_digest", "left_semi").join(groups.join(clash, "_digest", "left_semi"), ["_digest", "_content"])
        out = out.unionByName(apart.select("doc_id", "keep_id", "group_size", sha.alias("text_sha256"), *own, *keep_row))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) if row is None else F.col(row) == F.col("_keep_row")
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *own)


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of equal texts, all columns: the longest, then that of the smallest doc_id."""
    keyed, key = (docs, None) if ids_are_keys(docs) else with_row_key(docs)
    gone = exact_dedup(keyed, row=key, **options).where("not kept").select(key or "doc_id")
    return keyed.join(gone, key or "doc_id", "left_anti").select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents),
g AS (
  SELECT c, count(*) AS group_size,
         first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY c)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(c) AS text_sha256
FROM d JOIN g USING (c)
"""
