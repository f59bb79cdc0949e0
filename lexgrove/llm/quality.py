"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much text.

A line (split at \\n, with at least one word) fails when
  * punctuation: at least ``noisy_share`` of its words carry two or more marks of ``[#*$%&|<>!?]`` at
    their end, or it has fewer than ``short_words`` words and no sentence mark ``[.!?:;]`` at all;
  * navigation: at least ``menu_share`` of its words are a lone separator ``| > < / -``;
  * boilerplate: it equals an earlier line of the document, or at least ``stutter_share`` of its words
    repeat the word before them, or it holds a stock phrase (``STOCK_PHRASES``).
A document is kept when its base checks hold and at most ``max_loss`` of its words stood in failing lines.
Its cleaned text is what ``clean`` passes on: the lines that do not fail, byte for byte, joined by \\n (lines
without words do not fail). Counts and verdicts are of the text as given.

Defined cases: null and empty texts have no words and fail the base check; repeated rows are judged each
by itself; very long texts are read whole; ties do not arise, every row has a verdict of its own; an empty table gives
an empty result; other columns are ignored by ``quality`` and passed on by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm.textkernel import U64, Words, mix, raw, segment_hash, slices, texts_of, whole_windows, window_hash

#: Lower-case ASCII phrases that mark a line as boilerplate.
STOCK_PHRASES = (
    "cookie policy",
    "accept cookies",
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "click here",
    "sign up for our newsletter",
    "enable javascript",
    "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are of a line's words. All comparisons are in integers (percent)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    noisy_percent: int = 40
    menu_percent: int = 20
    stutter_percent: int = 50
    short_words: int = 3
    max_loss_percent: int = 50


RULES = Rules()
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bad_lines long, n_lost_words long, base_failed boolean, kept boolean"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


SYMBOL, MARK, STOP, MENU = _table("#*$%&|<>"), _table("#*$%&|<>!?"), _table(".!?:;"), _table("|></-")


def _count(at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Set flags between neighbouring entries of ``at``."""
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[at])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the entries whose value occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(keys), dtype=bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def surviving(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, stop: np.ndarray, of_row: np.ndarray, bad: np.ndarray) -> pa.Array:
    """The lines of each row that are not bad, joined by newlines."""
    live = np.flatnonzero(~bad)
    later = np.zeros(len(live), dtype=bool)
    later[1:] = of_row[live[1:]] == of_row[live[:-1]]
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, begin[live] - later, 1)  # a later line brings the newline before it
    np.add.at(edge, stop[live], -1)
    stay = np.cumsum(edge)[:-1] > 0
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(stay, out=before[1:])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(before[offsets]), pa.py_buffer(data[stay]))


def judge(column: pa.Array, rules: Rules = RULES) -> tuple[dict[str, np.ndarray], pa.Array]:
    """(counts and verdicts, surviving lines) of each text of a string array without nulls."""
    w = Words(column)
    d, o, rows = w.data, w.offsets, len(w.counts)
    n_words = w.counts
    chars = w.per_row(~w.space & ((d & 0xC0) != 0x80))
    symbols = w.per_row(SYMBOL[d])

    # repeated windows of three words
    n = len(w.hashes)
    row = w.rows()
    salt = mix(np.arange(1, rows + 1, dtype=U64))
    win = window_hash(w.hashes, 3)
    ok = np.flatnonzero(whole_windows(w.first, 3, n))
    at = ok[_repeated(win[ok] ^ salt[row[ok]])] if len(ok) else ok
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[at + k] = True
    n_repeat = _count(w.first, covered)

    # lines: bounds are row edges and newlines
    is_nl = d == 10
    nl = np.flatnonzero(is_nl)
    begin = np.sort(np.concatenate([o[:-1], nl + 1]))
    line_row = np.searchsorted(nl, o[:-1]) + np.arange(rows)  # first line of each row
    count = np.diff(np.append(line_row, len(begin)))
    of_row = np.repeat(np.arange(rows), count)
    stop = np.empty(len(begin), dtype=np.int64)
    stop[:-1] = begin[1:] - 1
    last = np.append(line_row[1:], len(begin)) - 1
    if rows:
        stop[last] = o[1:]
    word_at = np.searchsorted(w.starts, begin)
    word_to = np.searchsorted(w.starts, stop)
    in_line = word_to - word_at
    has = in_line > 0
    key = segment_hash(d, begin, stop) ^ salt[of_row] if rows else np.zeros(0, U64)
    dup = np.zeros(len(begin), dtype=bool)
    live = np.flatnonzero(has)
    if len(live):
        order = live[np.argsort(key[live], kind="stable")]
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        dup[order[again + 1]] = True
        line = lambda k: (of_row[k], d[begin[k] : stop[k]].tobytes())
        if any(line(order[k]) != line(order[k + 1]) for k in again):  # lines that only share a hash: by their bytes
            seen: set[tuple] = set()
            dup[:] = False
            for k in live:
                dup[k] = line(k) in seen
                seen.add(line(k))
    n_dup = np.bincount(of_row, weights=dup, minlength=rows).astype(np.int64)

    size = w.ends - w.starts
    tail1 = MARK[d[w.ends - 1]]
    tail2 = MARK[d[np.maximum(w.ends - 2, 0)]] & (size > 1)
    lone = (size == 1) & MENU[d[w.starts]]
    same = np.zeros(n, dtype=bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    def tally(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(flags, out=c[1:])
        return c[word_to] - c[word_at]
    stutter = tally(same)
    head = word_at[has]
    stutter[has] -= same[head]  # a line's first word has no word before it in the line
    stops = np.zeros(len(d) + 1, dtype=np.int64)
    np.cumsum(STOP[d], out=stops[1:])
    bad = (tally(tail1 & tail2) * 100 >= rules.noisy_percent * in_line) & has
    bad |= has & (in_line < rules.short_words) & (stops[stop] == stops[begin])
    bad |= has & (tally(lone) * 100 >= rules.menu_percent * in_line)
    bad |= dup
    bad |= has & (stutter * 100 >= rules.stutter_percent * in_line)
    low = bytes(d).lower()
    for phrase in STOCK_PHRASES:
        p = phrase.encode()
        i = low.find(p)
        while i >= 0:
            k = int(np.searchsorted(begin, i, side="right")) - 1
            if i + len(p) <= stop[k]:
                bad[k] = True
            i = low.find(p, i + 1)
    lost = np.bincount(of_row, weights=in_line * bad, minlength=rows).astype(np.int64)
    base = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    return ({
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "n_lines": np.bincount(of_row, weights=has, minlength=rows).astype(np.int64), "n_bad_lines": np.bincount(of_row, weights=bad, minlength=rows).astype(np.int64),
        "n_lost_words": lost, "base_failed": base, "kept": ~base & (100 * lost <= rules.max_loss_percent * n_words),
    }, surviving(d, o, begin, stop, of_row, bad))


def quality(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Counts and verdict of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column("doc_id"), texts_of(b.column("text"))
            for i, j in slices(text):
                out, _ = judge(text.slice(i, j - i), rules)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(i, j - i).cast(pa.int64()), **out})

    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The rows of docs that pass with their cleaned text, all columns, in one pass: nothing is joined.

    Where lines went, an integer column ``n_chars`` is counted anew.
    """
    names = docs.columns
    size = names.index("n_chars") if "n_chars" in names and docs.schema["n_chars"].dataType.typeName() in ("integer", "long") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index("text")
            text = texts_of(b.column(at))
            for i, j in slices(text):
                out, lines = judge(text.slice(i, j - i), rules)
                part, cleaned = b.slice(i, j - i), pa.array(out["n_bad_lines"] > 0)
                columns = part.columns
                columns[at] = pc.if_else(cleaned, lines.cast(part.column(at).type), part.column(at))
                if size is not None:
                    columns[size] = pc.if_else(cleaned, pc.utf8_length(lines).cast(part.column(size).type), part.column(size))
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(out["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, len(ws) AS n_words, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM t WHERE win IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM d),
l1 AS (SELECT rid, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY k) AS nth FROM l1 WHERE len(ws) > 0),
l3 AS (SELECT rid, len(ws) AS n, nth > 1 AS dup,
    (len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>!?]{2}$'))) * 100 >= 40 * len(ws)
     OR (len(ws) < 3 AND NOT regexp_matches(line, '[.!?:;]'))
     OR len(list_filter(ws, lambda x: regexp_matches(x, '^[|></-]$'))) * 100 >= 20 * len(ws)
     OR nth > 1
     OR len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) * 100 >= 50 * len(ws)
     OR regexp_matches(line, '(?i:"""
    + "|".join(STOCK_PHRASES)
    + r""")')) AS bad FROM l2),
l4 AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (dup) AS dups, count(*) FILTER (bad) AS n_bad, coalesce(sum(n) FILTER (bad), 0) AS lost FROM l3 GROUP BY rid),
b AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, list_sum(list_transform(w.ws, lambda x: length(x)))::BIGINT AS chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l4.dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(l4.n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_bad_lines, coalesce(lost, 0)::BIGINT AS n_lost_words
  FROM d JOIN w USING (rid) LEFT JOIN l4 USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines, n_lost_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept
FROM b
"""
)
