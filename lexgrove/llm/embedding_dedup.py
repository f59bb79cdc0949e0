"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors.

A unit vector o is turned by a random rotation; its code x holds the signs, its factor f = <x, o> what they keep. For any
other vector q, <x, q> / f is an unbiased estimate of <o, q>, off by about sqrt(1 - <o, q>^2) sqrt(1 / f^2 - 1) / sqrt(d - 1).
Codes alone tell an angle, unbiased too: differing signs times pi / d. Pairs whose bound falls short are dropped; all others
are computed again from the vectors, in doubles, so no pair below the threshold is ever linked.

Which codes meet: in each of several tables a vector's bucket is the largest coordinate, with its sign, of ``m`` further random
rotations (cross-polytope hashing). m follows the number of vectors, so that unlike vectors meet rarely; the number of
tables follows from the chance, measured by simulation for the dimension, that two vectors exactly at the threshold agree:
``recall`` of such pairs share a bucket, and more of closer ones.

Large groups: the members of a bucket of over ``HOT`` vectors have a mean; vectors within half the threshold's angle of
it are a core, all of whose pairs are links by the triangle inequality. A core is counted, never expanded, and its pairs are
left out of the buckets. What a large bucket still holds is compared in tiles. A group that no core covers, wider than
the threshold all over, costs comparisons of codes with the square of its size, in tiles spread over the cluster.

Defined cases: null, zero and empty vectors and those with null or non-finite components link with nothing; vectors of
different length never link; rows that share a vec_id are rows of their own; a null vec_id takes the smallest id that it
links to, and stays where there is none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut, ids_are_keys, release
from lexgrove.llm.components import components

THRESHOLD = 0.9
RECALL = 0.98
#: Unlike vectors that a bucket may hold by chance, about: 2 ** MATES.
MATES = 4
HOT = 64
TILE = 2_048
#: Chance that a pair at the threshold is dropped for its codes, and how many deviations an estimate may be off.
CODE_MISS, DEVIATIONS = 1e-5, 4.5
SEED = 20_240_613
PAIR = "a long, b long"


@functools.lru_cache(maxsize=2_048)
def rotation(d: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, number]).normal(size=(d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def corner(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Number of the corner of the cross-polytope that each turned vector is nearest to."""
    y = x @ turn
    at = np.abs(y).argmax(1)
    return 2 * at + (y[np.arange(len(y)), at] < 0)


@functools.lru_cache(maxsize=256)
def shape(d: int, bits: int, threshold: float, recall: float) -> tuple[int, int]:
    """(hashes in a table, tables) for vectors of length d among about 2 ** bits."""
    hashes = max(1, math.ceil((bits - MATES) / math.log2(2 * d)))
    rng = np.random.default_rng([SEED, d])
    x, r = rng.normal(size=(2, 2_000, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    r -= (r * x).sum(1)[:, None] * x
    r /= np.maximum(np.linalg.norm(r, axis=1), 1e-12)[:, None]
    y = threshold * x + math.sqrt(1 - threshold**2) * r
    turns = [rotation(d, (1 << 20) + i) for i in range(8)]
    agree = np.mean([(corner(x.astype(np.float32), t) == corner(y.astype(np.float32), t)).mean() for t in turns])
    together = min(0.999, max(1e-4, float(agree) ** hashes * 0.95))
    return hashes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


@functools.lru_cache(maxsize=256)
def most_signs(d: int, threshold: float) -> int:
    """Differing signs that a pair at the threshold exceeds with a chance of ``CODE_MISS`` at most."""
    p, left = math.acos(threshold) / math.pi, 1.0
    for h in range(d + 1):
        left -= math.exp(math.lgamma(d + 1) - math.lgamma(h + 1) - math.lgamma(d - h + 1) + h * math.log(p) + (d - h) * math.log(1 - p))
        if left < CODE_MISS:
            return h
    return d


def units(lists: pa.Array, d: int) -> np.ndarray:
    """Unit vectors of d components, in doubles."""
    x = np.asarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, d)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def hashed(x: np.ndarray, tables: tuple[int, float, float]) -> np.ndarray:
    """The bucket of every unit vector in each table; ``tables`` is (bits, threshold, recall)."""
    d = x.shape[1]
    hashes, n = shape(d, *tables)
    x, out = x.astype(np.float32), np.empty((len(x), n), dtype=np.uint64)
    for t in range(n):
        key = np.full(len(x), ((d << 32) + t + 1) * 0xD6E8FEB86659FD93 % (1 << 64), dtype=np.uint64)
        for i in range(hashes):
            key = (key ^ corner(x, rotation(d, 1 + t * hashes + i)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, t] = key
    return out.view(np.int64)


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))


def _binary(a: np.ndarray) -> pa.Array:
    data, n, width = np.ascontiguousarray(a).tobytes(), len(a), a.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of one width as a table of bytes."""
    n, offsets = len(column), np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)


def _coded(tables: tuple[int, float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                b = batch.filter(pa.array(dims == d))
                x = units(b.column("vec"), d)
                turned = x @ rotation(d, 0)
                yield pa.RecordBatch.from_pydict({
                    "row": b.column("row"), "id": b.column("id"), "dim": b.column("dim"), "code": _binary(np.packbits(turned > 0, axis=1)), "factor": np.abs(turned).sum(1) / math.sqrt(d), "vec": b.column("vec"), "keys": _lists(hashed(x, tables)),
                })

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of each key in a batch."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            b = batch.filter(pa.array(dims == d))
            keys, at = np.unique(b.column("key").to_numpy(), return_inverse=True)
            total = np.zeros((len(keys), d))
            np.add.at(total, at, units(b.column("vec"), d))
            yield pa.RecordBatch.from_pydict({"key": keys, "dim": pa.array([d] * len(keys), pa.int32()), "n": np.bincount(at), "total": _lists(total)})


def _mean(tables: tuple[int, float, float]):
    def run(table: pa.Table) -> pa.Table:
        """The mean direction of a bucket, and the buckets that it lies in itself."""
        d = table["dim"][0].as_py()
        total = np.asarray(table["total"].combine_chunks().flatten()).reshape(-1, d).sum(0)
        long = float(np.sqrt(total @ total))
        if long < 1e-9:
            return HUB.empty_table()
        mean = (total / long)[None, :]
        return pa.table({"hub": table["key"][:1], "dim": table["dim"][:1], "n": [int(np.asarray(table["n"]).sum())], "centre": _lists(mean), "keys": _lists(hashed(mean, tables))}, schema=HUB)

    return run


HUB = pa.schema([("hub", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("keys", pa.list_(pa.int64()))])


def _within(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose cosine with their hub is at least so much."""
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                b = batch.filter(pa.array(dims == d))
                near = (units(b.column("vec"), d) * units(b.column("centre"), d)).sum(1) >= least
                yield pa.RecordBatch.from_pydict({"row": b.column("row"), "core": b.column("hub")}).filter(pa.array(near))

    return run


def cores(coded: DataFrame, keyed: DataFrame, hot: DataFrame, tables: tuple[int, float, float]) -> DataFrame:
    """row, core: the vectors within half the threshold's angle of the mean of a bucket in ``hot``; a row has one core at most.

    A row is tried with the largest of the means that share a bucket with it, so a group keeps to one core."""
    members = keyed.join(hot.select("key"), "key").join(coded.select("row", "dim", "vec"), "row")
    sums = members.select("key", "dim", "vec").mapInArrow(_sums, "key long, dim int, n long, total array<double>")
    hubs = cut(sums.groupBy("key", "dim").applyInArrow(_mean(tables), "hub long, dim int, n long, centre array<double>, keys array<long>"))
    largest = hubs.select("hub", "n", F.explode("keys").alias("key")).groupBy("key").agg(F.max(F.struct("n", "hub")).alias("best"))
    chosen = keyed.join(largest, "key").groupBy("row").agg(F.max("best").alias("best")).select("row", F.col("best.hub").alias("hub"))
    tried = chosen.join(coded.select("row", "dim", "vec"), "row").join(hubs.select("hub", "centre", F.col("dim").alias("_dim")), "hub").where("dim = _dim")
    return cut(tried.mapInArrow(_within(math.sqrt((1 + tables[1]) / 2) + 1e-9), "row long, core long"))


def _met(threshold: float):
    """Pairs of a sorted partition that share a tile pair and are not of one core, by their codes."""

    def pairs(b: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        d = b["dim"][0].as_py()
        row, core, side, code = b["row"].to_numpy(), b["core"].fill_null(-1).to_numpy(), b["side"].to_numpy(), _bytes(b["code"].combine_chunks())
        none, most = b["core"].is_null().to_numpy(zero_copy_only=False), most_signs(d, threshold)
        key, tiles = b["key"].to_numpy(), b["tiles"].to_numpy()
        begins = np.r_[True, (key[1:] != key[:-1]) | (tiles[1:] != tiles[:-1])]
        group, start = np.cumsum(begins), np.flatnonzero(begins)
        size = np.diff(np.r_[start, len(group)])

        def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (none[i] | none[j] | (core[i] != core[j])) & ((side[i] != side[j]) | (side[i] == 2))
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(code[i] ^ code[j]).sum(1) <= most
            return row[i[ok]], row[j[ok]]

        small = np.repeat(size <= HOT, size)
        for s in range(1, min(HOT, int(size.max(initial=0)))):
            i = np.flatnonzero(small[:-s] & (group[:-s] == group[s:]))
            yield near(i, i + s)
        for a, n in zip(start[size > HOT].tolist(), size[size > HOT].tolist()):
            free = np.arange(a, a + n)[none[a : a + n]]
            bound = np.arange(a, a + n)[~none[a : a + n]]
            # a row without a core meets all, rows of a core meet those of other cores
            parts = [(free, free), (free, bound)] + [(bound[core[bound] == c], bound[core[bound] > c]) for c in np.unique(core[bound])[:-1]]
            for mine, others in parts:
                for at in range(0, len(mine), 64):
                    few = mine[at : at + 64]
                    i, j = np.repeat(few, len(others)), np.tile(others, len(few))
                    keep = i < j if others is free else slice(None)
                    yield near(i[keep], j[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None and not len(batch):
                continue
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if held is None:
                continue
            ends = np.zeros(len(held), dtype=bool)
            if batch is None:
                ends[-1] = True
            else:
                for c in ("dim", "key", "tiles"):
                    v = held[c].to_numpy()
                    ends[:-1] |= v[1:] != v[:-1]
            if not ends.any():
                continue
            whole = int(np.flatnonzero(ends)[-1]) + 1
            now, held = held.slice(0, whole), held.slice(whole) if whole < len(held) else None
            dims = now["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                for a, b in pairs(now.filter(pa.array(dims == d))):
                    if len(a):
                        yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def meetings(coded: DataFrame, keyed: DataFrame, shared: DataFrame, core: DataFrame | None, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows, a > b, whose codes in a common bucket do not tell them apart, and that no core holds."""
    rows = keyed.join(shared.select("key"), "key")
    rows = rows.join(core, "row", "left") if core is not None else rows.withColumn("core", F.lit(None).cast("long"))
    # a bucket is cut into tiles by core; two rows of one core have no tile pair in common
    kinds = rows.groupBy("key", "core").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    wide = kinds.groupBy("key").agg(F.sum("n").alias("every"), F.count(F.lit(1)).alias("kinds"), F.sort_array(F.collect_list(F.struct("core", "tiles"))).alias("list"))
    # a bucket of one core alone has no pair left
    wide = cut(wide.where((F.col("every") > TILE) | ((F.col("kinds") == 1) & F.col("list")[0]["core"].isNotNull())))
    plain = rows.join(wide.select("key"), "key", "left_anti").withColumns({"tiles": F.lit(0).cast("long"), "side": F.lit(2)})
    first = lambda c: F.aggregate("list", F.struct(F.lit(0).alias("at"), F.lit(False).alias("met")), lambda s, x: F.struct((s["at"] + F.when(~s["met"] & ~x["core"].eqNullSafe(c), x["tiles"]).otherwise(0)).alias("at"), (s["met"] | x["core"].eqNullSafe(c)).alias("met")))["at"]
    total = F.aggregate("list", F.lit(0), lambda s, x: s + x["tiles"])
    own = F.aggregate("list", F.lit(0), lambda s, x: s + F.when(x["core"].eqNullSafe(F.col("core")), x["tiles"]).otherwise(0))
    placed = rows.join(wide.where("kinds > 1 or list[0].core is null").select("key", "list"), "key").withColumns({"_first": first(F.col("core")), "_all": total, "_own": own})
    placed = placed.withColumn("_tile", F.col("_first") + F.pmod(F.xxhash64("row", F.lit(3)), F.col("_own")).cast("int"))
    meets = F.filter(F.sequence(F.lit(0), F.col("_all") - 1), lambda t: F.col("core").isNull() | (t < F.col("_first")) | (t >= F.col("_first") + F.col("_own")))
    sent = placed.select("key", "row", "core", "_tile", F.explode(meets).alias("_other")).withColumn("tiles", F.least("_tile", "_other").cast("long") * (1 << 31) + F.greatest("_tile", "_other"))
    sent = sent.withColumn("side", F.when(F.col("_tile") == F.col("_other"), 2).otherwise((F.col("_tile") > F.col("_other")).cast("int"))).select(*plain.columns)
    told = plain.unionByName(sent).join(coded.select("row", "dim", "code"), "row")
    return told.repartition("key", "tiles").sortWithinPartitions("dim", "key", "tiles").mapInArrow(_met(threshold), PAIR).distinct()


def _estimate(threshold: float):
    """Pairs whose estimate from b's code and factor, and a's turned vector, reaches the threshold within its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                b = batch.filter(pa.array(dims == d))
                signs = np.unpackbits(_bytes(b.column("code")), axis=1, count=d) * 2.0 - 1.0
                f = b.column("factor").to_numpy()
                about = (signs * (units(b.column("vec"), d) @ rotation(d, 0))).sum(1) / math.sqrt(d) / f
                off = DEVIATIONS * math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0.0, 1 / (f * f) - 1)) / math.sqrt(max(1, d - 1))
                yield b.select(["a", "b", "dim", "vec"]).filter(pa.array(about + off + 1e-6 >= threshold))

    return run


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                b = batch.filter(pa.array(dims == d))
                yield b.select(["a", "b"]).filter(pa.array((units(b.column("vec"), d) * units(b.column("other"), d)).sum(1) >= threshold))

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of rows(vec_id, embedding)."""
    keyed_by_id = ids_are_keys(rows, "vec_id")
    key = F.col("vec_id").cast("long") if keyed_by_id else F.monotonically_increasing_id()
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    every = cut(rows.select(key.alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("vec")))
    sound = F.size("vec") > 0
    sound &= ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    sound = every.where(F.col("vec").isNotNull() & sound).withColumn("dim", F.size("vec"))
    tables = (max(1, math.ceil(math.log2(max(2, every.count())))), threshold, recall)
    coded = cut(sound.mapInArrow(_coded(tables), f"row long, id long, dim int, code binary, factor double, vec {kind}, keys array<long>"))
    keyed = coded.select("row", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = shared.where(F.col("n") > HOT)
    core = None if hot.isEmpty() else cores(coded, keyed, hot, tables)
    release(rows.sparkSession)

    met = meetings(coded, keyed, shared, core, threshold)
    told = met.join(coded.select(F.col("row").alias("a"), "dim", "vec"), "a").join(coded.select(F.col("row").alias("b"), "code", "factor", F.col("dim").alias("_dim")), "b").where("dim = _dim")
    likely = told.mapInArrow(_estimate(threshold), f"a long, b long, dim int, vec {kind}")
    links = cut(likely.join(coded.select(F.col("row").alias("b"), F.col("vec").alias("other")), "b").mapInArrow(_exact(threshold), PAIR))

    ends = links.select(F.explode(F.array("a", "b")).alias("row"))
    edges = links
    if core is not None:
        sizes = core.groupBy("core").agg((F.count(F.lit(1)) - 1).alias("_more"), F.min("row").alias("_least"))
        inside = cut(core.join(sizes, "core").select("row", "_more", "_least"))
        edges = links.unionByName(inside.select(F.col("row").alias("a"), F.col("_least").alias("b")))
    classes = components(edges)
    if not keyed_by_id:  # the smallest vec_id of a component, not its smallest row
        named = classes.join(every.select(F.col("row").alias("node"), "id"), "node")
        least = named.groupBy("component").agg(F.min("id").alias("_id"))
        classes = named.join(least, "component").select("node", F.col("_id").alias("component"))
    count = ends.groupBy("row").agg(F.count(F.lit(1)).alias("_links"))
    out = every.select("row", "id").join(count, "row", "left")
    out = out.join(inside.select("row", "_more"), "row", "left") if core is not None else out.withColumn("_more", F.lit(0))
    out = out.join(classes.withColumnRenamed("node", "row"), "row", "left")
    component = F.coalesce("component", "id")
    n_links = F.coalesce("_links", F.lit(0)) + F.coalesce("_more", F.lit(0))
    return out.select(F.col("id").alias("vec_id"), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id, coalesce(m, vec_id) >= vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
