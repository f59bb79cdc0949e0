"""Toxicity by a factorization machine over hashed terms.

Terms of a text are the 64-bit hashes of its words (A-Z lowered, marks at either end stripped) and of the
first four to eight bytes of longer words, so that an insult is known with any ending. score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)
with x_i = 1 for a term that occurs: the pair part learns interactions (an insult beside a group mention)
that additive weights miss.

Fitting is on a bounded sample of labelled rows (``max_train``, chosen by a hash of doc_id): document
frequencies of every term by label give a two-sample z, and the ``max_terms`` largest at or beyond ``min_z``
are terms of the machine. A term may tell only beside another: so the terms are judged again within the documents
that hold a term found before (``min_pair_z``, as many more), which brings in the group mention that is as frequent
in clean texts but not beside an insult. One task fits the machine by Adam on that bounded matrix; only
places in it reach that task, not the texts' terms. Every whole text is scored.

Defined cases: null and empty texts have no terms and get the sigmoid of the bias alone; rows of labels
without a label or doc_id are left out and a doc_id labelled more than once counts as toxic if any row says
so; repeated rows get equal scores; without labels the score is 0 everywhere; a null doc_id is not held out;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut
from lexgrove.llm.textkernel import LOWER, U64, Words, mix, segment_hash, slices, texts_of

#: Labelled documents the machine is fitted on, at most (in expectation; chosen by hash).
MAX_TRAIN = 16_384
MAX_TERMS = 1_024
MIN_Z = 4.5
MIN_PAIR_Z = 5.0
PREFIXES = (4, 5, 6, 7, 8)
FACTORS = 4
THRESHOLD = 0.3

_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every occurrence, terms as signed 64-bit integers."""
    w = Words(column, hashes=False)
    s, e, row = w.starts.copy(), w.ends.copy(), w.rows()
    for _ in range(8):
        back = _EDGE[w.data[e - 1]] & (e - s > 1)
        front = _EDGE[w.data[s]] & (e - s - back > 1)
        if not (back.any() or front.any()):
            break
        e -= back
        s += front
    codes = LOWER[w.data]
    parts, rows = [segment_hash(codes, s, e)], [row]
    for k in PREFIXES:
        long = e - s > k
        parts.append(mix(segment_hash(codes, s[long], s[long] + k) ^ U64(k)))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(parts).view(np.int64)


def _distinct(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    return row[new], term[new]


def remainder(column: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text, modulo 4; null counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = 30, batch: int = 256, rate: float = 0.05, ridge: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """(b, w, v) of the machine on dense rows x of 0/1 and labels y; Adam on the mean logistic loss."""
    n, k = x.shape
    rng = np.random.default_rng(7)
    p = np.concatenate([[np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))], np.zeros(k), rng.normal(0, 0.01, k * factors)])
    m, s, t = np.zeros_like(p), np.zeros_like(p), 0
    for _ in range(max(epochs, -(-600 * batch // max(n, 1)))):  # 600 steps at least
        order = rng.permutation(n)
        for i in range(0, n, batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            w, v = p[1 : k + 1], p[k + 1 :].reshape(k, factors)
            q = xb @ v
            z = p[0] + xb @ w + 0.5 * (q**2 - xb @ (v**2)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(yb)
            gv = xb.T @ (g[:, None] * q) - v * (xb.T @ g)[:, None]
            grad = np.concatenate([[g.sum()], xb.T @ g + ridge * w, (gv + ridge * v).ravel()])
            t += 1
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad**2
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return float(p[0]), p[1 : k + 1].copy(), p[k + 1 :].reshape(k, factors).copy()


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS, min_z: float = MIN_Z, min_pair_z: float = MIN_PAIR_Z) -> dict:
    """bias, terms (sorted), w and v of the machine."""
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null").where(remainder() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, max_train / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000)) < int(share * 1_000_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts_of(b.column("text"))
            for i, j in slices(text):
                row, term = _distinct(*terms(text.slice(i, j - i)))
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                blobs = [term[a:z].tobytes() for a, z in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic").slice(i, j - i), "terms": pa.array(blobs, pa.binary())})

    # bounded by max_train, hence the broadcast
    sample = cut(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(read, "toxic int, terms binary"))
    size = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total, toxic = int(size[0]), int(size[1])
    model = {"bias": float(np.log(max(toxic, 1e-9) / (total - toxic + 1))) if total else -30.0, "terms": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    if not toxic or toxic == total:
        return model

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for y in (0, 1):
                own = [np.frombuffer(t, np.int64) for t, z in zip(b.column("terms").to_pylist(), b.column("toxic").to_pylist()) if z == y]
                sides.append(np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            for (term, count), y in zip(sides, (0, 1)):
                yield pa.RecordBatch.from_pydict({"term": term, "pos": count * y, "neg": count * (1 - y)})

    def telling(some: DataFrame, least: float) -> list[int]:
        """The terms that tell the labels of some apart, by their z."""
        n = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        every, yes = int(n[0]), int(n[1])
        if not yes or yes == every:
            return []
        p, q = F.col("pos") / float(yes), F.col("neg") / float(every - yes)
        r = (F.col("pos") + F.col("neg")) / float(every)
        z = (p - q) / F.sqrt(F.greatest(r * (1 - r), F.lit(1e-12)) * (1.0 / yes + 1.0 / (every - yes)))
        freq = some.mapInArrow(spread, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        best = freq.where("pos + neg >= 5").withColumn("z", F.abs(z)).where(F.col("z") >= least).orderBy(F.col("z").desc(), "term").limit(max_terms)
        return [x[0] for x in best.select("term").collect()]

    def holding(found: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([bool(np.isin(np.frombuffer(t, np.int64), found).any()) for t in b.column("terms").to_pylist()], pa.bool_()))

        return run

    alone = telling(sample, min_z)
    if not alone:
        return model
    beside = telling(sample.mapInArrow(holding(np.array(alone, dtype=np.int64)), "toxic int, terms binary"), min_pair_z)
    chosen_terms = np.unique(np.array([*alone, *beside], dtype=np.int64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.flatnonzero(np.isin(chosen_terms, np.frombuffer(t, np.int64))).astype(">u2").tobytes() for t in b.column("terms").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic"), "terms": pa.array(rows, pa.binary())})

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, y) for b in batches for t, y in zip(b.column("terms").to_pylist(), b.column("toxic").to_pylist()))  # the order of arrival must not matter
        x, y = np.zeros((len(rows), len(chosen_terms)), dtype=np.float32), np.array([y for _, y in rows], dtype=np.float32)
        for i, (t, _) in enumerate(rows):
            x[i, np.frombuffer(t, ">u2")] = 1
        bias, w, v = fit(x, y)
        yield pa.RecordBatch.from_pydict({"bias": pa.array([bias]), "w": pa.array([w.astype(np.float64).tobytes()]), "v": pa.array([v.astype(np.float64).tobytes()])})

    got = sample.mapInArrow(places, "toxic int, terms binary").repartition(1).mapInArrow(matrix, "bias double, w binary, v binary").first()
    return {"bias": got["bias"], "terms": chosen_terms, "w": np.frombuffer(got["w"]), "v": np.frombuffer(got["v"]).reshape(len(chosen_terms), -1)}


def score_texts(column: pa.Array, model: dict) -> np.ndarray:
    """Score of each text of a string array without nulls."""
    known, n = model["terms"], len(column)
    linear, pair = np.zeros(n), np.zeros((n, model["v"].shape[1]))
    square = np.zeros(n)
    if len(known):
        gate = np.zeros(1 << 16, dtype=bool)
        gate[known.view(U64) >> U64(48)] = True
        row, term = terms(column)
        near = gate[term.view(U64) >> U64(48)]
        row, term = row[near], term[near]
        at = np.minimum(np.searchsorted(known, term), len(known) - 1)
        hit = known[at] == term
        row, at = _distinct(row[hit], at[hit])
        linear = np.bincount(row, weights=model["w"][at], minlength=n)
        for f in range(pair.shape[1]):
            pair[:, f] = np.bincount(row, weights=model["v"][at, f], minlength=n)
        square = np.bincount(row, weights=(model["v"] ** 2).sum(1)[at], minlength=n)
    z = model["bias"] + linear + 0.5 * ((pair**2).sum(1) - square)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts_of(b.column("text"))
            for i, j in slices(text):
                s = score_texts(text.slice(i, j - i), model)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(i, j - i), "score": s, "predicted": pa.array((s >= threshold).astype(np.int32))})

    out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (remainder() == 2).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
