"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is the bag of its five-word shingles (one shingle of all its words if it has fewer). A shingle weighs
tf * idf with idf = 1 + ln(1 / f) / ln(1 / ``RARE``), f its share of the documents, at least ``RARE``: from 1 for what
stands everywhere to 2 for what at most one document in a thousand holds. So weights depend on shares alone and are
alike at every size. Shares come from 2**20 hashed counters, less the mean load of a counter; a shingle that
matters to the factor has a thousandth of the documents and stands well above that load.

``BANDS`` x ``ROWS`` samples (shingle, level) are drawn per document such that two documents agree on one
with probability equal to their weighted Jaccard similarity; a band is the hash of ``ROWS`` samples. At 0.8
a pair misses all 20 bands with probability 2.6e-5. The random numbers of a shingle come from per-sample
tables indexed by its hash.

Copies (equal word sequences, by 128 bits of BLAKE2b) are one representative. Documents of one band bucket are compared
with one hub of it, the member with most company; linked documents form classes by connected components of the graph of
hubs. Where the documents of a hub still span several classes, those outside the largest are compared with all of
the other classes in blocks, by matrix products inside a task: no candidate link between classes is left
unverified, and no pair is a row. A link is a weighted Jaccard similarity of 0.8 or more, computed exactly.

Defined cases: null and empty texts have no shingles and are classes of their own; repeated rows are copies; rows of
several texts that share a doc_id go by that id together; a row with a null doc_id has the class of its copies and is
not kept, or without any is left alone (class_id null, kept); very long texts are whole; an empty table gives an empty
result; other columns are ignored by ``near_duplicates`` and kept by ``without_near_copies``, which decides per row: one
row of each class stays, also where doc_ids are equal or null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut, ids_are_keys, release, with_row_key
from lexgrove.llm.components import components
from lexgrove.llm.textkernel import U64, Words, mix, raw, segment_hash, slices, splitmix, texts_of, whole_windows, window_hash

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
#: Share of the documents at which a shingle counts as rare.
RARE = 1e-3
COUNTERS = 1 << 20
SLICE = 1 << 14
#: Documents of one side of a block comparison, about; and of one block of a hub's group.
BLOCK, STAR_BLOCK = 256, 128
TABLE_BITS = 14


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(row, shingle hash, tf), sorted by row and hash, and the words they come from."""
    w = Words(column)
    n = len(w.hashes)
    win = window_hash(w.hashes, k)
    ok = np.flatnonzero(whole_windows(w.first, k, n))
    row, h = w.rows()[ok], win[ok]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        row = np.concatenate([row, short])
        h = np.concatenate([h, segment_hash(w.hashes, w.first[short], w.first[short + 1], 0xD6E8FEB86659FD93)])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(row))), w


def counter(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ U64(0x5DEECE66D)) >> U64(64 - 20)).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(counters of documents by hashed shingle, documents). Bounded: 4 MB whatever the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(COUNTERS, dtype=np.int64), 0
        for b in batches:
            text = texts_of(b.column("text"))
            n += len(text)
            for i, j in slices(text):
                total += np.bincount(counter(shingles(text.slice(i, j - i))[1]), minlength=COUNTERS)
        if n:
            yield packed([*((i // SLICE, total[i : i + SLICE]) for i in range(0, COUNTERS, SLICE)), (-1, np.array([n]))])

    def packed(slices_: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        at = [np.flatnonzero(x) for _, x in slices_]
        return pa.RecordBatch.from_pydict({"slice": pa.array([k for k, _ in slices_], pa.int32()), "counts": pa.array([i.astype(np.uint16).tobytes() + x[i].tobytes() for i, (_, x) in zip(at, slices_)], pa.binary())})

    def total_of(blobs: list[bytes]) -> np.ndarray:
        total = np.zeros(SLICE, np.int64)
        for x in blobs:
            n = len(x) // 10
            total[np.frombuffer(x, np.uint16, n)] += np.frombuffer(x[2 * n :], np.int64)
        return total

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([packed([(table["slice"][0].as_py(), total_of(table["counts"].to_pylist()))])])

    # two levels, so that no task adds up the slices of all partitions
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "slice int, counts binary")
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = salted.groupBy("slice", "salt").applyInArrow(add, "slice int, counts binary")
    got = {x[0]: total_of([x[1]]) for x in some.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()}
    if -1 not in got:
        return np.zeros(COUNTERS, np.int64), 0
    return np.concatenate([got[i] for i in range(COUNTERS // SLICE)]), int(got[-1][0])


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """Weight factor of each counter."""
    share = np.maximum(df - df.sum() / COUNTERS, 1) / max(n, 1)
    return (1 + np.log(1 / np.clip(share, RARE, 1)) / np.log(1 / RARE)).astype(np.float32)


def _gamma_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per sample: r and ln c with r, c ~ Gamma(2, 1), beta ~ U(0, 1), by table index."""
    k, size = BANDS * ROWS, 1 << TABLE_BITS

    def uniform(seed: int) -> np.ndarray:
        return ((splitmix(k * size, seed) >> U64(11)).astype(np.float64) + 0.5).reshape(k, size) / 2.0**53

    r = -np.log(uniform(1) * uniform(2))
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(-np.log(uniform(3) * uniform(4))).astype(np.float32), uniform(5).astype(np.float32)


_tables = None


def bands(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their band hashes)."""
    global _tables
    if _tables is None:
        _tables = _gamma_tables()
    r, inverse, log_c, beta = _tables
    have = np.flatnonzero(np.bincount(row, minlength=rows))
    starts = np.searchsorted(row, have)
    size = np.diff(np.append(starts, len(row)))
    log_w = np.log(weight.astype(np.float32))
    picked = np.zeros((BANDS, len(have)), dtype=U64)
    odd = splitmix(BANDS * ROWS, 77) | U64(1)
    for k in range(BANDS * ROWS):
        x = ((h * odd[k]) >> U64(64 - TABLE_BITS)).astype(np.int32)
        level = np.floor(log_w * inverse[k][x] + beta[k][x])
        a = log_c[k][x] - r[k][x] * (level - beta[k][x] + np.float32(1))
        least = np.minimum.reduceat(a, starts) if len(starts) else a
        hit = np.flatnonzero(a == np.repeat(least, size))
        first = hit[np.searchsorted(hit, starts)]
        picked[k // ROWS] = mix(picked[k // ROWS] * U64(3) + mix(h[first] ^ level[first].astype(np.int64).view(U64)) + U64(k))
    return have, picked


def copy_keys(column: pa.Array) -> list[bytes | None]:
    """A digest of the word sequence of each text; none without words."""
    data, o = raw(column)
    body = data.tobytes()
    words = (body[a:b].split() for a, b in zip(o[:-1].tolist(), o[1:].tolist()))
    return [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, copy_key (of the word sequence; null without words), bands; idf is a broadcast table."""
    fields = "doc_id long, copy_key binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts_of(b.column("text"))
            for i, j in slices(text):
                part = text.slice(i, j - i)
                row, h, tf, _ = shingles(part)
                have, picked = bands(row, h, tf * idf.value[counter(h)], j - i)
                offsets = np.zeros(j - i + 1, np.int32)
                offsets[have + 1] = BANDS
                flat = pa.array(picked.T.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(copy_keys(part), pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum(offsets).astype(np.int32)), flat)], names=["doc_id", "copy_key", "bands"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, fields)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    least = float(np.minimum(x[1][i], y[1][j]).sum())
    return least / (float(x[1].sum() + y[1].sum()) - least)


def likeness(few: list[str], others: list[str], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every text of one list with every one of the other.

    Intersections of a whole block come from products of incidence matrices: the weight shared by two
    bags is the sum over levels of tf, min(tf) = sum over k of [tf >= k] [tf' >= k].
    """
    n, m = len(few), len(others)
    row, h, tf, _ = shingles(pa.array([*few, *others], pa.large_string()))
    shown, at = np.unique(h, return_inverse=True)
    weight = idf[counter(shown)].astype(np.float64)
    totals = np.bincount(row, weights=tf * weight[at], minlength=n + m)
    shared, level = np.zeros((n, m)), 1
    while len(row):
        left, right = row < n, row >= n
        common = np.intersect1d(at[left], at[right])
        if not len(common):
            break
        place = np.full(len(shown), -1)
        place[common] = np.arange(len(common))
        for i in range(0, len(common), 4096):
            size = min(4096, len(common) - i)
            x, y = np.zeros((n, size)), np.zeros((m, size))
            inside = (place[at] >= i) & (place[at] < i + 4096)
            x[row[inside & left], place[at[inside & left]] - i] = weight[at[inside & left]]
            y[row[inside & right] - n, place[at[inside & right]] - i] = 1
            shared += x @ y.T
        level += 1
        more = tf >= level
        row, at, tf = row[more], at[more], tf[more]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(shared / (totals[:n, None] + totals[None, n:] - shared))


def star(groups: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """hub, doc_id, ok of groups(hub, doc_id, blocks): whether a member is like its hub. The hub goes to every block."""
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = groups.select("hub", "doc_id", F.explode(F.when(F.col("hub") == F.col("doc_id"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        found = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
        hub = table["hub"][0].as_py()
        ids, near = np.array([i for i, _ in found]), np.zeros(len(found), dtype=bool)
        own = [t for i, t in found if i == hub]
        for i in range(0, len(found), STAR_BLOCK):
            near[i : i + STAR_BLOCK] = (likeness(own, [t for _, t in found[i : i + STAR_BLOCK]], idf.value) >= threshold - 1e-9).any(0)
        return pa.table({"hub": pa.array([hub] * len(ids), pa.int64()), "doc_id": ids, "ok": near | (ids == hub)})

    return rows.join(texts, "doc_id").groupBy("hub", "block").applyInArrow(run, "hub long, doc_id long, ok boolean")


def rest_of(state: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame | None:
    """Links (a, b) between the classes of state(hub, doc_id, root) that comparing with hubs alone would lose.

    In every hub's group that spans classes, all documents outside the largest class (few) are compared
    with all documents of other classes, block by block: rows sent grow with documents times blocks.
    """
    sizes = state.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("hub").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("every"), F.count(F.lit(1)).alias("roots")).where("roots > 1 and every > 2")
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / block)).cast("int")
    top = cut(top.select("hub", F.col("top.root").alias("top"), blocks(F.col("every")).alias("blocks"), blocks(F.col("every") - F.col("top.n")).alias("few")))
    if top.isEmpty():
        return None
    rows = state.join(top, "hub").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("fb", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("few")).cast("int"))
    # a few document meets every block of all; any document meets every block of few
    sent = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("fb"), F.col("own").alias("ob")))
    sent_few = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.lit(0).alias("side"), F.col("fb").alias("fb"), i.alias("ob")))
    rows = rows.select("hub", "doc_id", "root", F.explode(F.when(F.col("root") != F.col("top"), F.concat(sent, sent_few)).otherwise(sent)).alias("x")).select("hub", "doc_id", "root", "x.*")

    def run(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for root, side, text in zip(*(table[c].to_pylist() for c in ("root", "side", "text"))):
            sides[side].append((root, text))
        links: set[tuple[int, int]] = set()
        if sides[0] and sides[1]:
            a, b = (np.array([r for r, _ in x]) for x in sides)
            near = likeness([t for _, t in sides[0]], [t for _, t in sides[1]], idf.value) >= threshold - 1e-9
            i, j = np.nonzero(near & (a[:, None] != b[None, :]))
            links = set(zip(np.maximum(a[i], b[j]).tolist(), np.minimum(a[i], b[j]).tolist()))
        found = sorted(links)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.join(texts, "doc_id").groupBy("hub", "fb", "ob").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, copy_id, class_id, kept for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    idf = spark.sparkContext.broadcast(idf_table(*frequencies(rows)))
    signed = cut(signatures(rows, idf))
    # representatives: the smallest doc_id of each word sequence; equal sequences have equal bands
    copies = cut(signed.where("copy_key is not null and doc_id is not null").groupBy("copy_key").agg(F.min("doc_id").alias("copy_id"), F.first("bands").alias("bands")))
    posted = copies.select(F.col("copy_id").alias("doc_id"), F.explode("bands").alias("value"))
    shared = cut(posted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    mates = cut(posted.join(shared, "value").groupBy("doc_id").agg(F.sum("n").alias("company"), F.collect_set("value").alias("values")))
    # the hub of a bucket is its member with most company in all its buckets: in a group of copies, their origin
    entered = mates.select("doc_id", "company", F.explode("values").alias("value"))
    hubs = entered.groupBy("value").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("neg"))).alias("hub"))
    met = entered.select("doc_id", "value").join(hubs, "value")
    groups = cut(met.groupBy((-F.col("hub.neg")).alias("hub"), "doc_id").agg(F.max(F.ceil(F.col("hub.company") / (BANDS * STAR_BLOCK))).cast("int").alias("blocks")))
    release(spark)

    checked = cut(star(groups, rows, idf, threshold))
    good = F.when(F.col("ok"), F.col("hub"))
    linked = cut(checked.groupBy("doc_id").agg(F.min(good).alias("least"), F.collect_set(good).alias("hubs")))
    between = components(linked.where("size(hubs) > 1").select(F.col("least").alias("a"), F.explode("hubs").alias("b")))
    roots = cut(linked.join(between.withColumnRenamed("node", "least"), "least", "left").select("doc_id", F.coalesce("component", "least", "doc_id").alias("root")))
    release(spark)
    more = rest_of(checked.select("hub", "doc_id").join(roots, "doc_id"), rows, idf, threshold)
    if more is not None:
        roots = roots.join(components(more).withColumnRenamed("node", "root"), "root", "left").select("doc_id", F.coalesce("component", "root").alias("root"))
        release(spark)
    roots = cut(roots)
    least = roots.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = cut(roots.join(least, "root").select(F.col("doc_id").alias("copy_id"), "class_id"))

    out = signed.select("doc_id", "copy_key").join(copies.select("copy_key", "copy_id"), "copy_key", "left").select("doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"))
    out = out.join(classes, "copy_id", "left").select("doc_id", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of docs, all columns: that of its smallest doc_id (null last)."""
    if ids_are_keys(docs):
        gone = near_duplicates(docs, **options).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    keyed, key = with_row_key(docs)
    near = cut(near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias(key), "class_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), F.col("doc_id"), F.col(key))).alias("_first")
    stay = near.join(keyed.select(key, "doc_id"), key).groupBy("class_id").agg(first).select(F.col(f"_first.{key}").alias(key))
    gone = near.select(key).join(stay, key, "left_anti")
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
