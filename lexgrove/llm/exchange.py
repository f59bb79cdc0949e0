"""Chunks of documents that ask each other about keys.

Documents are dealt once by a hash of doc_id into chunks, one to a task (one shuffle of the texts, read again by every
later step). Chunks grow with the square root of the table, up to ``MOST_BYTES``, so that chunks and what each of
them receives grow alike. A chunk sends every distinct key once, packed per key range (``part``), so a key that a third
of all rows share arrives at most once per chunk. The part's task answers each chunk in the order asked;
the answer needs no keys. A chunk's rows are sorted, so its keys come out the same however often it runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.cluster import scan_partitions, shuffle_partitions

#: Bytes of a table's files that a chunk is to hold, about: of a table of 1 GiB or less, and at most.
CHUNK_BYTES, MOST_BYTES = 8 << 20, 128 << 20
MAX_PARTS = 32_768
#: Where a null doc_id stands in the order of documents: last.
LAST = np.iinfo(np.int64).max
REQUEST = "_part int, _chunk int, n long, keys binary, own binary"
ANSWER = "_chunk int, _part int, answer binary"


def squeeze(a: np.ndarray) -> bytes:
    """Byte planes of an array: leading zero bytes lie together, for the shuffle's codec."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def expand(b: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * size).reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def chunk_count(docs: DataFrame) -> int:
    spark = docs.sparkSession
    read = str(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    size = scan_partitions(docs) * int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(read))
    chunk = min(MOST_BYTES, int(CHUNK_BYTES * max(1.0, size / (1 << 30)) ** 0.5))
    return max(1, shuffle_partitions(spark), -(-size // chunk))


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """docs(doc_id, text) dealt by doc_id, with the chunk's number."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")).repartitionById(chunks, "_chunk")


def ordered(table: pa.Table) -> tuple[int, pa.Array, np.ndarray, pa.Array]:
    """(chunk, doc_ids, doc_ids with null last, texts) of a chunk in the order of documents."""
    key = pa.array(table["doc_id"].fill_null(LAST).to_numpy())
    text = table["text"].cast(pa.large_string())
    text = text.combine_chunks().fill_null("") if text.null_count else text.combine_chunks()
    text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks or [pa.array([], pa.large_string())])
    ids = key.to_numpy()
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    if len(s) > 1 and (s[1:] == s[:-1]).any():  # repeated doc_ids: their texts decide
        order = pa.compute.sort_indices(pa.table({"k": key, "t": text}), sort_keys=[("k", "ascending"), ("t", "ascending")]).to_numpy()
    take = pa.array(order)
    return int(table["_chunk"][0].as_py()), table["doc_id"].combine_chunks().take(take), ids[order], text.take(take)


def ask(chunks: DataFrame, request: Callable[[pa.Table], pa.Table], parts: int) -> DataFrame:
    """One request row per chunk and part, at its part; ``own`` rows are echoed to their chunk."""
    return chunks.groupBy("_chunk").applyInArrow(request, REQUEST).repartitionById(parts, "_part")


def answer(requests: DataFrame, reply: Callable[[pa.Table], pa.Table], chunks: int) -> DataFrame:
    return requests.groupBy("_part").applyInArrow(reply, ANSWER).repartitionById(chunks, "_chunk")


def hear(chunks: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(use, schema)
