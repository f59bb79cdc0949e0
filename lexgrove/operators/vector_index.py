"""A stored vector index: cells of k-means, a search reads the partitions of the nearest cells only.

Tables of a ``sources.store.Store``: ``vectors`` (key, serial, vector), laid out by ``cell``; ``centres`` (cell, centre), of fixed
size; ``gone`` (key, serial), vectors that were replaced or removed. Centres are fitted on at most ``SAMPLE`` vectors, chosen
by a hash; every vector is assigned. ``exact`` searches all cells; ``recall`` measures what probing loses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.operators.search import dense
from lexgrove.sources.store import Change, Store

SAMPLE, ROUNDS, MAX_CELLS = 16_384, 8, 4_096
#: Vectors and queries that meet in one task of ``recall``.
PART, SLICE = 65_536, 1_024
#: Scores that a task of ``recall`` holds at once.
SCORES = 1 << 21


def unit_rows(lists: pa.Array, d: int) -> np.ndarray:
    x = np.asarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, d)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def centres_of(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an empty cell keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        long = np.sqrt((total * total).sum(1))
        c = np.where(long[:, None] > 0, total / np.maximum(long, 1e-300)[:, None], c)
    return c


def nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the best k by inner product, a few queries at a time: all scores at once would be the
    largest thing that a task holds."""
    step, rows, tops, scores = max(1, SCORES // len(x)), [], [], []
    for at in range(0, len(q), step):
        s = q[at : at + step] @ x.T
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        rows.append(at + np.repeat(np.arange(len(s)), top.shape[1]))
        tops.append(top.ravel())
        scores.append(np.take_along_axis(s, top, 1).ravel())
    return np.concatenate(rows), np.concatenate(tops), np.concatenate(scores)


class VectorIndex:
    """Vectors of one length; null vectors and those of other lengths are not indexed."""

    def __init__(self, store: Store):
        self.store = store

    def centres(self) -> np.ndarray:
        rows = self.store.read("centres").orderBy("cell").toArrow()
        return np.array(rows["centre"].to_pylist())

    def build(self, vectors: DataFrame, key: str, vector: str = "embedding", cells: int | None = None) -> int:
        """A first version: centres from a bounded sample, every vector in its cell."""
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull())
        n = rows.count()
        share = 1 << 20
        sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(share)) < int(min(1.0, SAMPLE / max(1, n)) * share)).limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        sizes, counts = np.unique(sample.value_lengths().to_numpy(), return_counts=True)
        d = int(sizes[counts.argmax()])
        x = unit_rows(sample.filter(pa.compute.equal(sample.value_lengths(), d)), d)
        c = centres_of(x, min(cells or max(1, int(n**0.5)), MAX_CELLS, len(x)))
        table = self.store.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centre array<double>")
        return self.store.commit({"centres": Change(table), "vectors": self._placed(rows, c, 1), "gone": Change(rows.select("key", F.lit(0).alias("serial")).limit(0))}, 0)

    def _placed(self, rows: DataFrame, c: np.ndarray, serial: int, append: bool = False) -> Change:
        sent, d = self.store.spark.sparkContext.broadcast(c), c.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.append_column("cell", pa.array((unit_rows(b.column("vector"), d) @ sent.value.T).argmax(1), pa.int32()))

        fit = rows.where(F.size("vector") == d).select("key", F.lit(serial).alias("serial"), "vector")
        placed = fit.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fit.schema) + ", cell int")
        return Change(placed, append, partition=("cell",), sort=("key",))

    def put(self, vectors: DataFrame, key: str, vector: str = "embedding") -> int:
        """Adds vectors; a key that is held already is replaced. Only the new batch is written."""
        now = self.store.manifest()
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
        stale = self._live(self.store.read("vectors").select("key", "serial")).join(rows.select("key").distinct(), "key", "left_semi")
        return self.store.commit({"vectors": self._placed(rows.where(F.col("vector").isNotNull()), self.centres(), now["version"] + 1, True), "gone": Change(stale, True)}, now["version"])

    def keep_only(self, known: DataFrame, key: str) -> int:
        """Takes out vectors of keys that known(key) does not hold."""
        base = self.store.manifest()["version"]
        lost = self._live(self.store.read("vectors").select("key", "serial")).join(known.select(F.col(key).alias("key")).distinct(), "key", "left_anti")
        return self.store.commit({"gone": Change(lost, True)}, base)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.store.read("gone").select("key", "serial"), ["key", "serial"], "left_anti")

    def cells(self, cells: list[int] | None = None) -> DataFrame:
        """key, vector of the given cells (partition filters), or of all."""
        rows = self.store.read("vectors")
        return self._live((rows if cells is None else rows.where(F.col("cell").isin(cells))).select("key", "serial", "vector"))

    def search(self, query: list[float], k: int = 10, probes: int = 8) -> DataFrame:
        """key, score, rank: the best k by cosine in the ``probes`` cells whose centres are nearest."""
        near = np.argsort(-(self.centres() @ np.asarray(query, dtype=float)), kind="stable")[:probes]
        return dense(self.cells(sorted(int(c) for c in near)), query, k, "key", "vector")

    def exact(self, query: list[float], k: int = 10) -> DataFrame:
        return dense(self.cells(), query, k, "key", "vector")

    def recall(self, queries: DataFrame, key: str, vector: str, k: int, probes: int) -> DataFrame:
        """key, hits: how many of each query's exact best k lie in the cells that it would probe.

        Slices of queries meet parts of the vectors by matrix products, a task each; a task returns its best k of every query."""
        sent, d = self.store.spark.sparkContext.broadcast(self.centres()), len(self.centres()[0])

        def run(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not len(asked) or not len(held):
                return pa.table({"q": asked["q"][:0], "key": held["key"][:0], "score": pa.array([], pa.float64()), "held": pa.array([], pa.bool_())})
            q = unit_rows(asked["vector"].combine_chunks(), d)
            probed = np.zeros((len(q), len(sent.value)), dtype=bool)
            np.put_along_axis(probed, np.argsort(-(q @ sent.value.T), axis=1, kind="stable")[:, :probes], True, 1)
            x, cell = unit_rows(held["vector"].combine_chunks(), d), held["cell"].to_numpy()
            row, top, score = nearest(q, x, k)
            return pa.table({"q": asked["q"].take(pa.array(row)), "key": held["key"].take(pa.array(top)), "score": score, "held": probed[row, cell[top]]})

        live = self._live(self.store.read("vectors").select("key", "serial", "vector", "cell")).drop("serial")
        asked = queries.select(F.col(key).alias("q"), F.col(vector).alias("vector")).where(F.size("vector") == d)
        parts, slices = max(1, -(-live.count() // PART)), max(1, -(-asked.count() // SLICE))
        dealt = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("__slice", dealt("q", slices)).withColumn("__part", every(parts)).groupBy("__slice", "__part")
        right = live.withColumn("__part", dealt("key", parts)).withColumn("__slice", every(slices)).groupBy("__slice", "__part")
        found = left.cogroup(right).applyInArrow(run, f"q {dict(asked.dtypes)['q']}, key {dict(live.dtypes)['key']}, score double, held boolean")
        best = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "held"))), 1, k).alias("best"))
        return best.select(F.col("q").alias(key), F.size(F.filter("best", lambda r: r["held"])).alias("hits"))
