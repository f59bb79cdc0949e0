"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

A token (a word with A-Z lowered, or the end of a document) falls in one of 32 x 32 buckets: its class is
a hash of its first two bytes, its place in the class a hash of its last two; the end has bucket 0 to itself.

    P(token | context) = P(class | context) * P(place | class, context) * P(token | bucket)

The first two factors are softmaxes over sums of hashed feature rows: bias, the word before (n-gram), the
pair before it, and skips to the second and third word back. P(token | bucket) is c / (N_b + u), and
u / (N_b + u) for a token not seen in training (u = 0.1), so the whole sums to one.

Training passes once over every training document in ``ROUNDS`` rounds, each over the documents of its share by hash. In
each, every partition starts from the shared weights and AdaGrad sums and takes minibatch steps over its part; the new
weights and sums are the means, weighted by tokens. Weights have a fixed size (about 3 MB); what grows with the corpus, token counts, is
exchanged between chunks of documents, never gathered in one place. Scoring is numpy batches over those
sparse rows.

Tokens are counted by 54 bits of hash within their bucket. Defined cases: null and empty texts are the end
alone; a null doc_id counts as the empty string for the fold; repeated rows count each; very long texts are
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import exchange as X
from lexgrove.llm.textkernel import LOWER, U64, Words, mix, slices, texts_of

CLASSES = 32
BUCKETS = CLASSES * CLASSES
WORD_ROWS, PAIR_ROWS, PLACE_ROWS = 4096, 8192, 16384
#: Feature rows of the class softmax: word before, skips to two and three back (by bucket), pair before.
CLASS_ROWS = WORD_ROWS + 2 * BUCKETS + PAIR_ROWS
ROUNDS = 2
FOLDS = 10
UNSEEN = 0.1
STEP = 16_384
RATE = 0.3
BLOCK_ROWS = 1024
END_KEY = U64(1)
#: Numbers of the blocks that are no weights.
COUNTS, GRADIENTS = -1, -2


class Tokens:
    """Tokens of a slice of texts: bucket and key of each, an end after every text; with their context rows."""

    def __init__(self, column: pa.Array, context: bool = True):
        w = Words(column, lower=True)
        rows = len(w.counts)
        n = len(w.hashes)
        low = LOWER[w.data].astype(U64)
        size = w.ends - w.starts
        one = low[w.starts] | (low[np.minimum(w.starts + 1, len(low) - 1)] * (size > 1).astype(U64)) << U64(8) if n else np.zeros(0, U64)
        two = low[w.ends - 1] | (low[np.maximum(w.ends - 2, 0)] * (size > 1).astype(U64)) << U64(8) if n else np.zeros(0, U64)
        b = (mix(one + U64(3)) % U64(CLASSES) * U64(CLASSES) + mix(two + U64(5)) % U64(CLASSES)).astype(np.int64)
        b[b == 0] = 1
        self.first = w.first + np.arange(rows + 1)  # tokens of row i: first[i]:first[i + 1]
        at = np.arange(n) + w.rows()
        total = n + rows
        self.bucket = np.zeros(total, dtype=np.int64)
        self.bucket[at] = b
        self.hash = np.full(total, END_KEY, dtype=U64)
        self.hash[at] = w.hashes
        self.key = (self.bucket.astype(U64) << U64(54)) | (self.hash >> U64(10))
        self.counts = w.counts + 1
        if not context:
            return
        place = np.arange(total) - np.repeat(self.first[:-1], self.counts)

        def back(values: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(total, dtype=values.dtype)
            out[k:] = values[: max(0, total - k)] * (place[k:] >= k)
            return out

        b1, b2, b3 = (back(self.bucket, k) for k in (1, 2, 3))
        word = back((self.hash >> U64(17)).astype(np.int64) % WORD_ROWS, 1)
        pair = (mix((b1 * BUCKETS + b2).astype(U64)) % U64(PAIR_ROWS)).astype(np.int64)
        self.rows = np.stack([word, WORD_ROWS + b2, WORD_ROWS + BUCKETS + b3, WORD_ROWS + 2 * BUCKETS + pair])
        cls = self.bucket >> 5
        self.places = np.stack([(mix((self.rows[k] * CLASSES + cls).astype(U64) + U64(k << 40)) % U64(PLACE_ROWS)).astype(np.int64) for k in (0, 1)])


class Model:
    """Weights as one flat table of rows of 32, so that blocks of rows can travel."""

    SIZES = (1, CLASSES, CLASS_ROWS, PLACE_ROWS)

    def __init__(self, flat: np.ndarray | None = None, seen: np.ndarray | None = None):
        total = sum(self.SIZES)
        total += -total % BLOCK_ROWS
        self.empty = flat is None
        self.flat = np.zeros((total, CLASSES), dtype=np.float32) if flat is None else flat.reshape(total, CLASSES).copy()
        cut = np.cumsum((0, *self.SIZES))
        self.bias, self.place_bias, self.by_class, self.by_place = (self.flat[a:b] for a, b in zip(cut, cut[1:]))
        #: AdaGrad's mean squared gradients by table and row.
        self.seen = np.zeros((4, max(self.SIZES)), dtype=np.float32) if seen is None else seen.reshape(4, max(self.SIZES)).copy()

    def logits(self, t: Tokens, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Shifted logits (largest 0) of every class, and of every place in the true class, for tokens a:b."""
        z, y, more = (np.empty((b - a, CLASSES), np.float32) for _ in range(3))
        for out, table, rows in ((z, self.by_class, t.rows), (y, self.by_place, t.places)):
            np.take(table, rows[0, a:b], axis=0, out=out, mode="clip")
            for k in range(1, len(rows)):
                np.take(table, rows[k, a:b], axis=0, out=more, mode="clip")
                out += more
        z += self.bias
        np.take(self.place_bias, t.bucket[a:b] >> 5, axis=0, out=more, mode="clip")
        y += more
        for x in (z, y):
            x -= x.max(1, keepdims=True)
        return z, y

    def log_prob(self, t: Tokens) -> np.ndarray:
        """Natural log of P(bucket | context) of each token."""
        out = np.empty(len(t.bucket), dtype=np.float32)
        for a in range(0, len(out), STEP):
            b = min(a + STEP, len(out))
            z, y = self.logits(t, a, b)
            i = np.arange(b - a)
            out[a:b] = z[i, t.bucket[a:b] >> 5] + y[i, t.bucket[a:b] & 31]
            for x in (z, y):
                out[a:b] -= np.log(np.exp(x, out=x).sum(1))
        return out

    def _add(self, table: int, weights: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        s = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(g[order], starts)
        u = s[starts]
        self.seen[table, u] += np.einsum("ij,ij->i", total, total) / CLASSES
        total *= (RATE / np.sqrt(self.seen[table, u] + 1e-3))[:, None]
        weights[u] += total

    def learn(self, t: Tokens) -> None:
        """One pass of AdaGrad steps over the tokens."""
        if self.empty and len(t.bucket):  # a start from this slice's own frequencies
            count = np.bincount(t.bucket, minlength=BUCKETS).reshape(CLASSES, CLASSES) + 0.5
            self.bias += np.log(count.sum(1) / count.sum())
            self.place_bias += np.log(count / count.sum(1, keepdims=True))
            self.empty = False
        for a in range(0, len(t.bucket), STEP):
            b = min(a + STEP, len(t.bucket))
            g, d = self.logits(t, a, b)
            i = np.arange(b - a)
            cls, place = t.bucket[a:b] >> 5, t.bucket[a:b] & 31
            for x, true in ((g, cls), (d, place)):  # from logits to minus probabilities, plus one for the true one
                np.exp(x, out=x)
                x *= -1 / x.sum(1, keepdims=True)
                x[i, true] += 1
            total = g.sum(0)
            self.seen[0, 0] += (total * total).mean()
            self.bias += RATE * total / np.sqrt(self.seen[0, 0] + 1e-3)
            self._add(1, self.place_bias, cls, d)
            for k in range(len(t.rows)):
                self._add(2, self.by_class, t.rows[k, a:b], g)
            for k in range(len(t.places)):
                self._add(3, self.by_place, t.places[k, a:b], d)


def remainder(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray | None, np.ndarray]:
    """(weights, training tokens per bucket) of docs(doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where(remainder() != 0)
    share = F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(rounds))
    weights, gradients, counts = None, None, np.zeros(BUCKETS, dtype=np.int64)
    fields = "block int, n double, body binary"

    def mean(table: pa.Table) -> pa.Table:
        n = np.array(table["n"].to_pylist())
        block = table["block"][0].as_py()
        if block == COUNTS:
            body = sum(np.frombuffer(x, np.int64) for x in table["body"].to_pylist())
        else:
            body = (sum(np.frombuffer(x, np.float32).astype(np.float64) * k for x, k in zip(table["body"].to_pylist(), n)) / max(n.sum(), 1)).astype(np.float32)
        return pa.table({"block": pa.array([block], pa.int32()), "n": pa.array([n.sum()]), "body": pa.array([body.tobytes()], pa.binary())})

    for turn in range(rounds):
        start = spark.sparkContext.broadcast((weights, gradients))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, seen = Model(*start.value), np.zeros(BUCKETS, dtype=np.int64)
            for b in batches:
                text = texts_of(b.column("text"))
                for i, j in slices(text):
                    t = Tokens(text.slice(i, j - i))
                    seen += np.bincount(t.bucket, minlength=BUCKETS)
                    model.learn(t)
            n = float(seen.sum())
            if n:
                size = range(0, len(model.flat), BLOCK_ROWS)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([*range(len(size)), COUNTS, GRADIENTS], pa.int32()), "n": pa.array([n] * (len(size) + 2)),
                    "body": pa.array([*(model.flat[i : i + BLOCK_ROWS].tobytes() for i in size), seen.tobytes(), model.seen.tobytes()], pa.binary()),
                })

        parts = rows.where(share == turn).select("text").mapInArrow(learn, fields)
        some = parts.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).applyInArrow(mean, fields)
        got = {x["block"]: x["body"] for x in some.groupBy("block").applyInArrow(mean, fields).collect()}
        if got:
            counts += np.frombuffer(got.pop(COUNTS), np.int64)
            gradients = np.frombuffer(got.pop(GRADIENTS), np.float32)
            weights = np.concatenate([np.frombuffer(got[k], np.float32) for k in sorted(got)])
    return weights, counts


def score(docs: DataFrame, weights: np.ndarray | None, counts: np.ndarray) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    n_chunks = X.chunk_count(docs)
    parts = min(n_chunks, X.MAX_PARTS)
    chunks = X.chunked(docs, n_chunks)
    shared = spark.sparkContext.broadcast((weights, np.log10(counts + UNSEEN)))

    def pieces(texts: pa.Array, context: bool) -> list[tuple[int, int, Tokens]]:
        return [(i, j, Tokens(texts.slice(i, j - i), context)) for i, j in slices(texts)]

    def by_part(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Order of sorted keys by part, and (part, from, to)."""
        part = (mix(keys) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        return order, [(int(part[a]), int(a), int(b)) for a, b in zip(edge, [*edge[1:], len(part)])]

    def request(table: pa.Table) -> pa.Table:
        chunk, _, _, texts = X.ordered(table)
        train_rows = np.sort(table["doc_id"].fill_null(X.LAST).to_numpy())  # same order as ``ordered``
        flags = _fold(train_rows)
        seen, other = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for i, j, t in pieces(texts, False):
            mask = np.repeat(flags[i:j], t.counts)
            seen.append(t.key[mask])
            other.append(t.key[~mask])
        k, c = np.unique(np.concatenate(seen), return_counts=True)
        rest = np.setdiff1d(np.concatenate(other), k)
        k, c = np.concatenate([k, rest]), np.concatenate([c, np.zeros(len(rest), np.int64)])
        order = np.argsort(k)
        k, c = k[order], c[order].astype(np.int64)
        order, spans = by_part(k)
        k, c = k[order], c[order]
        return pa.table({
            "_part": pa.array([p for p, _, _ in spans], pa.int32()), "_chunk": pa.array([chunk] * len(spans), pa.int32()), "n": pa.array([b - a for _, a, b in spans], pa.int64()),
            "keys": pa.array([X.squeeze(np.diff(k[a:b], prepend=U64(0))) + X.squeeze(c[a:b]) for _, a, b in spans], pa.binary()), "own": pa.array([None] * len(spans), pa.binary()),
        })

    def merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        keys, c = [], []
        for body, n in zip(table["keys"].to_pylist(), table["n"].to_pylist()):
            keys.append(np.cumsum(X.expand(body, U64, n), dtype=U64))
            c.append(X.expand(body[8 * n :], np.int64, n))
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, every, np.bincount(inverse, weights=np.concatenate(c), minlength=len(every)).astype(np.int64)

    def reply(table: pa.Table) -> pa.Table:
        keys, every, total = merged(table)
        return pa.table({"_chunk": table["_chunk"], "_part": table["_part"], "answer": pa.array([X.squeeze(total[np.searchsorted(every, k)]) for k in keys], pa.binary())})

    def tally(table: pa.Table) -> pa.Table:
        _, _, total = merged(table)
        return pa.table({"tokens": pa.array([int(total.sum())], pa.int64()), "types": pa.array([int((total > 0).sum())], pa.int64())})

    fields = "doc_id long, n_tokens long, n_known long, log_counts double, score double"

    def use(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({n: pa.array([], t) for n, t in zip(("doc_id", "n_tokens", "n_known", "log_counts", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        _, ids, _, texts = X.ordered(table)
        model, log_bucket = Model(shared.value[0]), shared.value[1]
        all_pieces = pieces(texts, True)
        keys = np.unique(np.concatenate([t.key for _, _, t in all_pieces]))
        order, spans = by_part(keys)
        size = {p: (a, b) for p, a, b in spans}
        c = np.zeros(len(keys), dtype=np.int64)
        for p, body in zip(answers["_part"].to_pylist(), answers["answer"].to_pylist()):
            a, b = size[p]
            c[order[a:b]] = X.expand(body, np.int64, b - a)
        log_base = np.log10(c + 0.1)
        log_own = np.log10(np.where(c > 0, c, UNSEEN))
        out = [[], [], [], []]
        for i, j, t in all_pieces:
            at = np.searchsorted(keys, t.key)
            model_log = model.log_prob(t).astype(np.float64) / np.log(10) + log_own[at] - log_bucket[t.bucket]
            for column, x in zip(out, (t.counts, np.add.reduceat((c[at] > 0).astype(np.int64), t.first[:-1]), np.add.reduceat(log_base[at], t.first[:-1]), np.add.reduceat(model_log, t.first[:-1]))):
                column.append(x)
        return pa.table({"doc_id": ids, **{k: pa.array(np.concatenate(v)) for k, v in zip(("n_tokens", "n_known", "log_counts", "score"), out)}})

    asked = X.ask(chunks, request, parts)
    stats = asked.groupBy("_part").applyInArrow(tally, "tokens long, types long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("_types"))
    told = X.hear(chunks, X.answer(asked, reply, n_chunks), use, fields)
    return told.crossJoin(F.broadcast(stats)).select(  # stats is one row
        "doc_id", (remainder() == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("_types") + 1))).alias("base_score"), "score",
    )


def _fold(ids: np.ndarray) -> np.ndarray:
    """Flags of training documents, by doc_id (LAST stands for null)."""
    import zlib

    return np.array([zlib.crc32(b"" if i == X.LAST else str(i).encode()) % FOLDS != 0 for i in ids.tolist()], dtype=bool)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, *train(docs))
