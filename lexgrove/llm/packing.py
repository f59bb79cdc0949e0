"""Best-fit packing of whole documents into token sequences (best-two-fit).

Pieces are hashed to shards of about ``shard_tokens`` tokens and every shard is packed by itself, so the
work is parallel and at most one sequence a shard is left part-filled for want of partners. A sequence is
filled greedily: the longest unpacked piece that still fits is added until none fits. If room is left, its
smallest piece s is taken out and the two unpacked pieces a + b that fit the room + s most tightly, and more
tightly than s alone, replace it. A piece's place depends only on ids and lengths: reruns agree.

Only documents longer than a sequence are cut, into full pieces; the first piece has the remainder.

Defined cases: a null or empty text is the end id alone (length 1); repeated rows are packed each (their
pieces carry the same doc_id); very long texts are encoded whole and give as many pieces as needed; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut
from lexgrove.llm.tokens import END, encoder

ROOM = 2048
SHARD_TOKENS = 1 << 22
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, room: int = ROOM, ranks_file: str | None = None, tokenizer_file: str | None = None) -> DataFrame:
    """The pieces of docs(doc_id, text), with a checksum of each piece's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file, tokenizer_file)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, value in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = value.as_py()
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(END)).astype("<u4")
                n = len(ids)
                bounds = [0, *range(n - (n - 1) // room * room, n + 1, room)]
                for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    for column, x in zip(rows, (doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes()))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES)


def two_fit(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths are 1..room."""
    have = np.bincount(lengths, minlength=room + 1)
    by_length = np.argsort(lengths, kind="stable")
    edge = np.concatenate([[0], np.cumsum(have)])
    used = np.zeros(room + 1, dtype=np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, number = len(lengths), 0
    # at_most[x]: the largest length <= x that is still unpacked
    at_most = np.where(have > 0, np.arange(room + 1), 0)
    np.maximum.accumulate(at_most, out=at_most)

    def take(x: int) -> None:
        have[x] -= 1
        if not have[x]:
            below = at_most[x - 1]
            end = x
            while end <= room and at_most[end] == x:
                end += 1
            at_most[x:end] = below

    def give(x: int) -> None:
        have[x] += 1
        if have[x] == 1:
            end = x
            while end <= room and at_most[end] < x:
                end += 1
            at_most[x:end] = x

    while left:
        filled: list[int] = []
        gap = room
        while gap and (x := int(at_most[gap])):
            if x == room:  # full pieces stand alone
                filled, gap = [x], 0
                take(x)
                break
            filled.append(x)
            take(x)
            gap -= x
        if gap and len(filled) > 1:
            small = filled[-1]
            want = gap + small
            low = np.arange(1, want // 2 + 1)
            low = low[have[low] > 0]
            if len(low):
                high = at_most[want - low]
                total = np.where((high > low) | ((high == low) & (have[low] > 1)), low + high, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    filled.pop()
                    a, b = int(low[best]), int(high[best])
                    take(a)
                    take(b)
                    give(small)
                    filled += [b, a]
        at = 0
        for x in filled:
            p = by_length[edge[x] + used[x]]
            used[x] += 1
            sequence[p], offset[p] = number, at
            at += x
        left -= len(filled)
        number += 1
    return sequence, offset


def pack(pieces_: DataFrame, shards: int, room: int = ROOM) -> DataFrame:
    """pieces_ with sequence_id and offset."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = two_fit(table["length"].to_numpy(), room)
        shard = table["_shard"].to_numpy()
        table = table.drop_columns(["_shard"])
        return table.append_column("sequence_id", pa.array(sequence * shards + shard)).append_column("offset", pa.array(offset))

    # without a doc_id, the content deals
    dealt = pieces_.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", F.when(F.col("doc_id").isNull(), F.col("ids_crc32"))), F.lit(shards).cast("long")))
    return dealt.groupBy("_shard").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, room: int = ROOM, shard_tokens: int = SHARD_TOKENS, **files) -> DataFrame:
    """Every piece of docs(doc_id, text) and its place. The texts are read and encoded once."""
    cutted = cut(pieces(docs, room, **files))
    total = cutted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return pack(cutted, max(1, -(-total // shard_tokens)), room)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
