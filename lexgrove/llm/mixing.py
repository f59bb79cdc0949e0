"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The mix is dealt in blocks of ``block`` words. Blocks are seats: sources get them by the highest
quotients target / (2 k + 1), a source's seats go to its shards the same way by shard size, so every
shard has an integer quota. A shard is a seeded hash class of a source's documents, of about ``shard_words``
words (more where a source would have over ``MAX_SHARDS`` of them, so that one task can rank a source's shards), laid on a ring in seeded order; its quota is a seeded run of neighbouring blocks of that ring
(whole rounds first when it exceeds one), so which words a document gives follows from its place alone.
Nothing is drawn at run time: reruns agree.

A party with exact share q of S seats among n holds between round(q (1 - n / 2S)) and
round(q (1 + n / 2S)) seats (the divisor lies between V / (S + n/2) and V / (S - n/2)), so only quotients
in that range are listed: O(n) rows in all, whatever the number of seats.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; documents of
size 0 give 0 words; rows without doc_id are dealt by their text; repeated rows, and rows that share a doc_id, are laid on
the ring one by one and stand or go one by one; an empty table gives an empty result; other columns, whatever their
names, are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut, with_row_key

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
BLOCK = 64
SHARD_WORDS = 131_072
MAX_SHARDS = 65_536
SEED = 20_240_607
#: Sources that may be sent to every executor: rows of under 100 bytes.
MAX_BROADCAST = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def _hash32(key: Column, at: int = 1) -> Column:
    return F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """parties with a column ``won``: seats of each key in its group (``seats`` is the group's number)."""
    g = W.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(g), F.sum(F.col(votes).cast("double")).over(g)
    share = parties.withColumn("_n", n).withColumn("_v", total).withColumn("_q", F.when(F.col("_v") > 0, F.col(votes) * F.col(seats) / F.col("_v")).otherwise(0.0))
    slack = F.when(F.col(seats) > 0, F.col("_q") * F.col("_n") / (2 * F.col(seats))).otherwise(0.0)
    ranged = share.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_q") - slack - 1))).withColumn("_high", F.ceil(F.col("_q") + slack + 1))
    left = F.col(seats) - F.sum("_low").over(g)
    bids = ranged.withColumn("_left", left).where(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence("_low", F.col("_high")))).withColumn("_bid", F.col(votes).cast("double") / (2 * F.col("_k") + 1))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.col("_bid").desc(), F.col(key).asc_nulls_last(), "_k"))
    won = bids.withColumn("_place", place).groupBy(*group, key, "_low").agg(F.sum((F.col("_place") <= F.col("_left")).cast("long")).alias("_more"))
    return won.select(*group, key, (F.col("_low") + F.col("_more")).alias("won"))


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """sources(source, source_size) with weight and target. One row per source: one task sorts them.

    target = min(cap * size, level * weight); the level that spends the budget is the largest of
    (budget - caps of the sources before) / (weights from here on) in order of cap * size / weight.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    a = sources.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    a = a.withColumn("_all", F.sum("source_size").over(whole) * F.lit(float(budget)))
    a = a.withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    a = a.withColumn("_from", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    a = a.withColumn("_level", F.max((F.col("_all") - F.col("_before")) / F.col("_from")).over(whole))
    return a.select("source", "source_size", "weight", F.least(F.col("_cap"), F.col("_level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, shard, taken for each row of docs(doc_id, text, source); ``row`` names a
    column of docs that goes along."""
    own = [] if row is None else [row]
    # rows without doc_id are dealt by their text
    named_by = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    # written once: every later use reads these few bytes a row instead of the texts
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.when(F.col("doc_id").isNull(), named_by).alias("_text_key"), *own))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    # a null source becomes a value of its own, so that plain equality joins it
    named = sources.withColumn("_s", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    wanted = named.withColumn("_seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    wanted = wanted.join(sainte_lague(wanted.withColumn("_one", F.lit(1)), ["_one"], "_s", "target", "_seats").select("_s", "won"), "_s", "left")
    wanted = cut(wanted.select("_s", "source_size", "target", F.coalesce("won", F.lit(0)).alias("_seats"), F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / shard_words))).alias("_shards")))
    if wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:  # else an ordinary join, whose hot sources Spark splits
        wanted = F.broadcast(wanted)

    text_id = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.col("_text_key")))
    dealt = (
        sized.withColumn("_s", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
        .join(wanted, "_s")
        .withColumn("shard", F.pmod(_hash32(text_id, 9), F.col("_shards")))
    )
    shards = dealt.groupBy("_s", "shard").agg(F.sum("size").alias("_votes"), F.first("_seats").alias("_seats"))
    quota = sainte_lague(shards, ["_s"], "shard", "_votes", "_seats")

    ring = W.partitionBy("_s", "shard")
    placed = dealt.withColumn("_ring", F.sum("size").over(ring)).withColumn(
        "_at", F.sum("size").over(ring.orderBy(F.md5(text_id), "doc_id", "size", *own).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    )
    words = F.least(F.coalesce("won", F.lit(0)) * block, F.lit(cap) * F.col("_ring"))
    salt = F.concat_ws(":", F.lit(str(seed)), F.col("shard").cast("string"), F.col("_s.s"))
    out = placed.join(quota, ["_s", "shard"], "left").withColumn("_words", words).withColumn("_len", F.greatest(F.lit(1), F.col("_ring")))
    out = out.withColumn("_rest", F.pmod("_words", "_len")).withColumn("_start", F.pmod(_hash32(salt), F.greatest(F.lit(1), F.ceil(F.col("_ring") / block))) * block)

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_at") + F.col("size"), high) - F.greatest(F.col("_at"), low))

    end = F.col("_start") + F.col("_rest")
    taken = F.floor(F.col("_words") / F.col("_len")) * F.col("size") + overlap(F.col("_start"), F.least(end, F.col("_ring"))) + overlap(F.lit(0), F.greatest(F.lit(0), end - F.col("_ring")))
    return out.select("doc_id", "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken"), *own)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix has them, each row by its own share: a row whose taken words are half its size or more stands once,
    one and a half or more twice, others not."""
    keyed, key = with_row_key(docs)
    times = mix(keyed, row=key, **options).where("size > 0").select(key, F.floor(F.col("taken") / F.col("size") + 0.5).alias(f"{key}times")).where(F.col(f"{key}times") > 0)
    out = keyed.join(times, key).withColumn(f"{key}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{key}times").cast("long"))))
    return out.select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
s3 AS (SELECT *, max((budget - before) / rest) OVER () AS level FROM s2),
s4 AS (SELECT source, source_size, least(cap, level * weight) AS target, greatest(1, least({MAX_SHARDS}, ceil(source_size / {SHARD_WORDS})))::BIGINT AS shards FROM s3),
s5 AS (SELECT *, round(sum(target) OVER () / {BLOCK})::BIGINT AS seats, sum(target) OVER () AS votes, count(*) OVER () AS n FROM s4),
bid AS (SELECT source, target / (2 * k + 1) AS bid, k FROM (SELECT *, unnest(range(0, ceil(target * seats / votes * (1 + n / (2.0 * seats)) + 2)::BIGINT)) AS k FROM s5 WHERE target > 0)),
won AS (SELECT source, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY bid DESC, source NULLS LAST, k) AS place FROM bid) WHERE place <= (SELECT max(seats) FROM s5) GROUP BY source),
src AS (SELECT s4.*, coalesce(won, 0) AS seats FROM s4 LEFT JOIN won ON s4.source IS NOT DISTINCT FROM won.source),
dealt AS (SELECT d.*, source_size, target, seats, ('0x' || substr(h, 9, 8))::BIGINT % shards AS shard FROM sized d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
sh AS (SELECT source, shard, sum(size)::BIGINT AS votes, max(seats) AS seats FROM dealt GROUP BY ALL),
sh2 AS (SELECT *, sum(votes) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM sh),
sbid AS (SELECT source, shard, seats, votes::DOUBLE / (2 * k + 1) AS bid, k FROM (SELECT *, unnest(range(0, ceil(votes * seats / total * (1 + n / (2.0 * greatest(seats, 1))) + 2)::BIGINT)) AS k FROM sh2 WHERE votes > 0)),
quota AS (SELECT source, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bid DESC, shard, k) AS place FROM sbid) WHERE place <= seats GROUP BY ALL),
ring AS (SELECT *, sum(size) OVER (PARTITION BY source, shard)::BIGINT AS len,
    (sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM dealt),
w AS (SELECT ring.*, least(coalesce(won, 0) * {BLOCK}, 2 * len) AS words,
    ('0x' || substr(md5(concat_ws(':', '{SEED}', ring.shard::VARCHAR, coalesce(ring.source, ''))), 1, 8))::BIGINT % greatest(1, ceil(len / {BLOCK}))::BIGINT * {BLOCK} AS start
  FROM ring LEFT JOIN quota q ON ring.source IS NOT DISTINCT FROM q.source AND ring.shard = q.shard),
x AS (SELECT *, words // greatest(len, 1) AS rounds, words % greatest(len, 1) AS rest FROM w)
SELECT doc_id, source, size, source_size, target, shard,
  (rounds * size + greatest(0, least(pos + size, least(start + rest, len)) - greatest(pos, start))
   + greatest(0, least(pos + size, greatest(0, start + rest - len)) - pos))::BIGINT AS taken
FROM x
"""
