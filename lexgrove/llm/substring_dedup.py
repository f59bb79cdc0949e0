"""Substring dedup with difference-cover anchors.

Any two positions i and j have an offset d < ``PERIOD`` at which both i + d and j + d are cover positions
(their residues are in the difference cover), so two equal windows of ``window`` words share an aligned
anchor of window - PERIOD + 1 words that starts at a cover position of both documents. Only anchors are
hashed and exchanged (4 of 13 positions, 4 bytes each). Matches extend from them: windows that hold an
anchor which occurs elsewhere are compared by 96 bits over the sequence of 64-bit word hashes, and all
windows but the first of equal ones (smallest doc_id, then start) cover words that go.

Per chunk of documents every distinct anchor and every distinct candidate window is sent once, so common
passages do not gather in one task.

Defined cases: null and empty texts have no words; repeated rows and rows of one doc_id are ordered by
their text, the later ones repeat the first; a null doc_id comes last; very long texts are whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import exchange as X
from lexgrove.llm.textkernel import U64, Words, slices, whole_windows, window_hash

WINDOW = 20
PERIOD = 13
#: A perfect difference set: every residue modulo 13 is a difference of two of these.
COVER = (0, 1, 3, 9)
SECOND_BASE = 0xA24BAED4963EE407


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and the end)."""
    hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j in slices(texts):
        w = Words(texts.slice(i, j - i))
        hashes.append(w.hashes)
        counts.append(w.counts)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def _anchors(h: np.ndarray, first: np.ndarray, window: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, code) of every anchor; a code is the part in its upper, 32 bits of hash in its lower half."""
    size = window - PERIOD + 1
    ok = whole_windows(first, size, len(h))
    residue = (np.arange(len(ok)) - np.repeat(first[:-1], np.diff(first))[: len(ok)]) % PERIOD
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    at = np.flatnonzero(ok & cover[residue])
    a = window_hash(h, size)[at]
    return at, (a % U64(parts)) << U64(32) | (a >> U64(32))


def _bits(answers: pa.Table, counts: dict[int, int]) -> dict[int, np.ndarray]:
    return {p: np.unpackbits(np.frombuffer(b, np.uint8), count=counts[p]).astype(bool) for p, b in zip(answers["_part"].to_pylist(), answers["answer"].to_pylist()) if p in counts}


def _by_part(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted codes."""
    part = (codes >> U64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return [(int(part[a]), int(a), int(b)) for a, b in zip(edge, [*edge[1:], len(part)])]


def _rows(chunk: int, rows: list[tuple[int, int, bytes, bytes | None]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table({"_part": pa.array(cols[0], pa.int32()), "_chunk": pa.array([chunk] * len(rows), pa.int32()), "n": pa.array(cols[1], pa.int64()), "keys": pa.array(cols[2], pa.binary()), "own": pa.array(cols[3], pa.binary())})


def _replies(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.table({"_chunk": pa.array(cols[0], pa.int32()), "_part": pa.array(cols[1], pa.int32()), "answer": pa.array(cols[2], pa.binary())})


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by a space) for each row of docs(doc_id, text)."""
    if window < PERIOD + 2:
        raise ValueError(f"window must be {PERIOD + 2} words or more")
    n_chunks = X.chunk_count(docs)
    parts = min(n_chunks, X.MAX_PARTS)
    chunks = X.chunked(docs, n_chunks)

    def send_anchors(table: pa.Table) -> pa.Table:
        chunk, _, _, texts = X.ordered(table)
        codes = np.unique(_anchors(*_words(texts), window, parts)[1])
        return _rows(chunk, [(p, b - a, X.squeeze(np.diff(codes[a:b].astype(np.uint32), prepend=np.uint32(0))), None) for p, a, b in _by_part(codes)])

    def repeated(table: pa.Table) -> pa.Table:
        part, ns = int(table["_part"][0].as_py()), table["n"].to_pylist()
        keys = [np.cumsum(X.expand(k, np.uint32, n), dtype=np.uint32) for k, n in zip(table["keys"].to_pylist(), ns)]
        every = np.concatenate(keys)
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for c, k in zip(table["_chunk"].to_pylist(), keys):
            at = np.minimum(np.searchsorted(twice, k), max(0, len(twice) - 1))
            out.append((c, part, np.packbits(twice[at] == k if len(twice) else np.zeros(len(k), bool)).tobytes()))
        return _replies(out)

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _rows(0, [])
        chunk, _, ids, texts = X.ordered(table)
        h, first = _words(texts)
        at, code = _anchors(h, first, window, parts)
        codes, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        spans = _by_part(codes)
        far = np.zeros(len(codes), dtype=bool)
        where = {p: slice(a, b) for p, a, b in spans}
        for p, bits in _bits(answers, {p: b - a for p, a, b in spans}).items():
            far[where[p]] = bits
        ok = whole_windows(first, window, len(h))

        def holding(flags: np.ndarray) -> np.ndarray:
            """Windows with a flagged anchor among their first PERIOD positions."""
            c = np.zeros(len(h) + 1, dtype=np.int64)
            c[at[flags[inverse]] + 1] = 1
            np.cumsum(c, out=c)
            return ok & (c[PERIOD : PERIOD + len(ok)] > c[: len(ok)])

        cand = np.flatnonzero(holding(far | (count > 1)))
        cross = holding(far)[cand]
        h1 = window_hash(h, window)[cand]
        h2 = window_hash(h, window, SECOND_BASE)[cand] >> U64(32)
        order = np.lexsort((cand, h2, h1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        here = np.sort(cand[order[~new]])
        lead = order[new]
        lead = lead[cross[lead]]
        part = (h1[lead] % U64(parts)).astype(np.int64)
        lead = lead[np.argsort(part, kind="stable")]  # by part, then h1, h2
        part = np.sort(part)
        doc = np.searchsorted(first, cand[lead], side="right") - 1
        rows = []
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(edge, [*edge[1:], len(part)]):
            k = lead[a:b]
            rows.append((int(part[a]), int(b - a), X.squeeze(np.diff(h1[k], prepend=U64(0))) + X.squeeze(h2[k].astype(np.uint32)) + X.squeeze(ids[doc[a:b]]), None))
        own = np.array([len(here), len(lead)], np.int64).tobytes() + X.squeeze(np.diff(here, prepend=0)) + X.squeeze(cand[lead]) + X.squeeze(part.astype(np.int32))
        rows.append((parts + chunk, 0, b"", own))
        return _rows(chunk, rows)

    def later(table: pa.Table) -> pa.Table:
        part = int(table["_part"][0].as_py())
        if part >= parts:
            return _replies([(c, part, o) for c, o in zip(table["_chunk"].to_pylist(), table["own"].to_pylist())])
        ns = table["n"].to_pylist()
        h1, h2, ids = [], [], []
        for k, n in zip(table["keys"].to_pylist(), ns):
            h1.append(np.cumsum(X.expand(k, U64, n), dtype=U64))
            h2.append(X.expand(k[8 * n :], np.uint32, n))
            ids.append(X.expand(k[12 * n :], np.int64, n))
        h1, h2, ids = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
        order = np.lexsort((ids, h2, h1))
        again = np.zeros(len(order), dtype=bool)
        again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        ends = np.cumsum(ns)
        return _replies([(c, part, np.packbits(again[e - n : e]).tobytes()) for c, n, e in zip(table["_chunk"].to_pylist(), ns, ends)])

    def drop(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        if not len(table):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string()))})
        chunk, doc_ids, _, texts = X.ordered(table)
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(Words(texts.slice(i, j - i), hashes=False).counts for i, j in slices(texts))]))]).astype(np.int64)
        own = next(b for p, b in zip(answers["_part"].to_pylist(), answers["answer"].to_pylist()) if p == parts + chunk)
        n_here, n_lead = np.frombuffer(own, np.int64, 2)
        body = own[16:]
        here = np.cumsum(X.expand(body, np.int64, n_here))
        lead = X.expand(body[8 * n_here :], np.int64, n_lead)
        part = X.expand(body[8 * n_here + 8 * n_lead :], np.int32, n_lead)
        flag = np.zeros(n_lead, dtype=bool)
        edge = {int(p): (int(np.searchsorted(part, p)), int(np.searchsorted(part, p, side="right"))) for p in np.unique(part)}
        for p, bits in _bits(answers, {p: b - a for p, (a, b) in edge.items()}).items():
            flag[slice(*edge[p])] = bits
        starts = np.concatenate([here, lead[flag]])
        change = np.zeros(int(first[-1]) + window + 1, dtype=np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        keep = np.cumsum(change)[: int(first[-1])] == 0
        removed = np.zeros(len(keep) + 1, dtype=np.int64)
        np.cumsum(~keep, out=removed[1:])
        removed = removed[first[1:]] - removed[first[:-1]]
        kept = [b" ".join(t.as_py().encode().split() if not r else list(itertools.compress(t.as_py().encode().split(), keep[a:b]))).decode() for t, r, a, b in zip(texts, removed, first, first[1:])]
        return pa.table({"doc_id": doc_ids, "n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.string())})

    seen = X.answer(X.ask(chunks, send_anchors, parts), repeated, n_chunks)
    # a chunk's own row comes back to it by a part of its own
    asked = X.hear(chunks, seen, send_windows, X.REQUEST).repartitionById(parts + n_chunks, "_part")
    return X.hear(chunks, X.answer(asked, later, n_chunks), drop, "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM d WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE nth > 1),
g AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
p AS (SELECT d.doc_id, len(ws) AS n, coalesce(js, []) AS js, ws FROM d LEFT JOIN g USING (doc_id)),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.j = c.j GROUP BY u.doc_id)
SELECT p.doc_id, n::BIGINT AS n_words, len(js)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM p LEFT JOIN k USING (doc_id)
"""
