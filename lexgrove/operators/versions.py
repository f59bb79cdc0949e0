"""Dated texts: aligned diffs of two days, laws that splice new versions in, digests that find what differs."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.hierarchy import ancestors
from lexgrove.functions.temporal import as_of
from lexgrove.operators import patch

#: Digests add row words modulo this prime, so neither order nor partitioning shows.
PRIME = 2_305_843_009_213_693_951
WORDS = 4
DIFF = "op string, line_before int, line_after int, line string"


# diffs


def align(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None, str]]:
    """(op, place in a, place in b, line) from 1: a longest common subsequence keeps its lines ("="), the rest of a goes
    ("-") before the rest of b comes ("+"). Common ends are trimmed, then the furthest reaching paths of d edits are
    followed, so the work grows with the lines that differ."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[low : len(a) - end], b[low : len(b) - end]
    kept = [(low + i, low + j) for i, j in _common(x, y)]
    out: list[tuple[str, int | None, int | None, str]] = []
    i = j = 0
    for p, q in [*((n, n) for n in range(low)), *kept, *((len(a) - end + n, len(b) - end + n) for n in range(end)), (len(a), len(b))]:
        out += [("-", n + 1, None, a[n]) for n in range(i, p)] + [("+", None, n + 1, b[n]) for n in range(j, q)]
        if p < len(a) and q < len(b):
            out.append(("=", p + 1, q + 1, a[p]))
        i, j = p + 1, q + 1
    return out


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence: after d edits, the furthest i on each diagonal k = i - j."""
    if not x or not y:
        return []
    steps: list[array] = []  # of every d the furthest i by (k + d) // 2: half of d squared numbers
    for d in range(len(x) + len(y) + 1):
        now = array("q")
        for k in range(-d, d + 1, 2):
            i = 0 if d == 0 else _entered(steps[d - 1], d, k)[0]
            while i < len(x) and i - k < len(y) and x[i] == y[i - k]:
                i += 1
            now.append(i)
            if i >= len(x) and i - k >= len(y):
                return _back(steps, d, len(x), len(y))
        steps.append(now)
    return []


def _entered(before: array, d: int, k: int) -> tuple[int, int]:
    """(i, diagonal it comes from) where edit d reaches diagonal k: a line added, from k + 1, or removed, from k - 1."""
    at = (k + d) // 2  # of k + 1 in the step before; k - 1 lies one lower
    if at == 0 or (at < d and before[at - 1] < before[at]):
        return before[at], k + 1
    return before[at - 1] + 1, k - 1


def _back(steps: list[array], d: int, i: int, j: int) -> list[tuple[int, int]]:
    pairs = []
    for d in range(d, -1, -1):
        k = i - j
        begin, source = _entered(steps[d - 1], d, k) if d else (0, 0)
        while i > begin:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        i = begin - (source < k)
        j = i - source
    return pairs[::-1]


def diff_lines(pairs: DataFrame, key: str, before: str = "before", after: str = "after", context: int | None = None) -> DataFrame:
    """key, nth, op, line_before, line_after, line of each row of pairs(key, before, after); null is a text without lines.

    Removed and added lines in the order that replays the change; of the kept ones those within ``context`` lines of a
    change, all by default."""
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for at, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = align(*(t.split("\n") if t is not None else [] for t in (a, b)))
                near = {n + s for n, r in enumerate(found) if r[0] != "=" for s in range(-context, context + 1)} if context is not None else None
                shown = [(n, *r) for n, r in enumerate(found) if near is None or n in near]
                keys += [at] * len(shown)
                rows += shown
            nth, op, one, two, line = ([r[i] for r in rows] for i in range(5))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(nth, pa.int32()), pa.array(op, pa.string()), pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(line, pa.string())], names=[key, "nth", "op", "line_before", "line_after", "line"])

    return pairs.select(key, F.col(before).cast("string"), F.col(after).cast("string")).mapInArrow(run, f"{key} {kind}, nth int, {DIFF}")


def replayed(diff: DataFrame, key: str, side: str = "after") -> DataFrame:
    """key, text that a full diff leads to, or, with side "before", came from."""
    at = f"line_{side}"
    rows = diff.where(F.col(at).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, "line"))).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("text"))


def on_days(texts: DataFrame, before: str, after: str, key: str = "unit_id", text: str = "text") -> DataFrame:
    """key, before, after: the texts in force on two days, where they differ; a side that is not in force is null."""
    side = lambda day, name: as_of(texts, day, [key]).select(key, F.col(text).alias(name))
    both = side(before, "before").join(side(after, "after"), key, "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def version_diff(texts: DataFrame, before: str, after: str, key: str = "unit_id", text: str = "text", context: int | None = None) -> DataFrame:
    """Aligned lines of every unit whose text on two days differs."""
    return diff_lines(on_days(texts, before, after, key, text), key, context=context)


def changed_since(texts: DataFrame, edges: DataFrame, documents: DataFrame, before: str, after: str) -> DataFrame:
    """unit_id, removed, added (lines), documents: changed units with the documents on them, or on a unit above, dated after
    the first day up to the second."""
    lines = version_diff(texts, before, after).groupBy("unit_id").agg(F.count_if(F.col("op") == "-").alias("removed"), F.count_if(F.col("op") == "+").alias("added"))
    recent = documents.where((F.col("date") > F.to_date(F.lit(before))) & (F.col("date") <= F.to_date(F.lit(after)))).select("doc_id")
    about = edges.join(recent, "doc_id").select("doc_id", F.col("unit_id").alias("__about")).distinct()
    told = lines.select("unit_id", F.explode(ancestors("unit_id")).alias("__about")).join(about, "__about").groupBy("unit_id").agg(F.count_distinct("doc_id").alias("documents"))
    return lines.join(told, "unit_id", "left").na.fill(0, ["documents"])


# laws on dated texts


def splice(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old(keys, .., valid_from, valid_to) with the versions of new(keys, .., valid_from) put in.

    A version that is in force when a new one begins ends there; the new one takes over its end, or ends where the next
    version of its key begins; one of the same start is replaced. One window over the union."""
    stacked = old.withColumn("__new", F.lit(False)).unionByName(new.withColumns({"valid_to": F.lit(None).cast("date"), "__new": F.lit(True)}), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(F.col("valid_from").asc_nulls_first(), "__new")
    # the end of the last old version up to here: also that of a replaced one of the same start
    over = F.last(F.when(~F.col("__new"), F.struct(F.col("valid_to").alias("end"))), True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    twin = F.lead(F.struct("valid_from")).over(order).eqNullSafe(F.struct("valid_from")) & ~F.col("__new") & F.lead("__new").over(order)
    kept = stacked.withColumns({"__over": over["end"], "__twin": F.coalesce(twin, F.lit(False))}).where("not __twin")
    following = F.lead("valid_from").over(order)
    end = F.when(F.col("__new") & (F.col("__over") <= F.col("valid_from")), F.lit(None).cast("date")).otherwise(F.when(F.col("__new"), F.col("__over")).otherwise(F.col("valid_to")))
    return kept.withColumn("valid_to", F.least(end, following)).drop("__new", "__over", "__twin")


def apply_law_versions(units: DataFrame, texts: DataFrame, laws: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts after the laws, outcome of every instruction).

    texts(unit_id, text, valid_from, valid_to) gain ``law`` and ``change``: "own" for a unit that an instruction changed, "ancestor"
    for the units above one, which get a version of their own from the same day. A repeal ends the unit and all below it
    on the day. laws(act, law, text, effective) take effect by day, then law; each reads the texts that the ones before
    it left, from those in force on its act's first day. Outcomes: ok, failed, or queued where a law has no day; queued
    and failed ones change nothing. A dry run returns texts as they are."""
    dated = laws.where("effective is not null")
    first = dated.groupBy("act").agg(F.min("effective").alias("__first"))
    live = texts.join(units.where("duplicate_of is null and kind <> 'paragraph'").select("unit_id", "act", "kind", "duplicate_of"), "unit_id")
    begun = live.join(first, "act").where((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("__first"))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("__first"))))
    ordered = dated.select("act", F.concat_ws("|", F.col("effective").cast("string"), F.col("law")).alias("law"), "text")
    told = patch.apply_laws(begun, ordered).withColumns({"effective": F.substring_index("law", "|", 1).cast("date"), "law": F.expr("substring(law, instr(law, '|') + 1)")})
    queued = patch.instructions(laws.where("effective is null")).select("act", "law", "nth", "operation", F.lit("queued").alias("status"), F.lit("no day of entry into force").alias("reason"))
    outcomes = told.unionByName(queued, allowMissingColumns=True)
    if dry_run:
        return texts.withColumns({"law": F.lit(None).cast("string"), "change": F.lit(None).cast("string")}), outcomes

    done = told.where("status = 'ok'")
    last = done.groupBy("unit_id", "effective").agg(F.max_by(F.struct("new_text", "operation", "law"), F.struct("law", "nth")).alias("__r"))
    own = last.where("__r.operation <> 'repeal'").select("unit_id", "effective", F.col("__r.new_text").alias("text"), F.col("__r.law").alias("law"))
    ended = last.where("__r.operation = 'repeal'").select(F.col("unit_id").alias("__root"), F.col("effective").alias("__end"))
    # the versions that instructions make, then those of the units above
    base = texts.withColumns({"law": F.lit(None).cast("string"), "change": F.lit(None).cast("string")})
    spliced = splice(base, own.select("unit_id", "text", F.col("effective").alias("valid_from"), "law", F.lit("own").alias("change")), ["unit_id"])
    touched = last.select("unit_id", "effective", F.col("__r.law").alias("law"), F.explode(F.slice(F.reverse(ancestors("unit_id")), 2, 1_000)).alias("__up"))
    up = touched.groupBy(F.col("__up").alias("unit_id"), "effective").agg(F.max("law").alias("law")).join(last.select("unit_id", "effective"), ["unit_id", "effective"], "left_anti")
    held = spliced.select("unit_id", "text", "valid_from", "valid_to").join(up, "unit_id").where((F.col("valid_from").isNull() | (F.col("valid_from") < F.col("effective"))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("effective"))))
    spliced = splice(spliced, held.select("unit_id", "text", F.col("effective").alias("valid_from"), "law", F.lit("ancestor").alias("change")), ["unit_id"])
    below = spliced.select("unit_id", F.explode(ancestors("unit_id")).alias("__root")).distinct().join(ended, "__root").groupBy("unit_id").agg(F.min("__end").alias("__end"))
    cut = spliced.join(below, "unit_id", "left").where(F.col("__end").isNull() | F.col("valid_from").isNull() | (F.col("valid_from") < F.col("__end")))
    return cut.withColumn("valid_to", F.least("valid_to", "__end")).drop("__end"), outcomes


# digests


def row_words(df: DataFrame) -> Column:
    """Four 32-bit numbers of a row: its MD5 over the columns in order of their names, as text; null differs from empty."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in sorted(df.columns)]
    code = F.md5(F.concat_ws("\x1f", *cells))
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.conv(F.substring(code, 8 * i + 1, F.lit(8)), 16, 10).cast("long"))


def digest(df: DataFrame, by: Column | None = None) -> DataFrame:
    """part, n, sum0.., xor0..: an order-free digest of every part of a table (one part without ``by``).

    Sums are taken modulo a prime and xors word by word, so digests of parts add up to that of the whole, and equal
    tables have equal digests however they are laid out."""
    words = df.select((F.lit("") if by is None else by.cast("string")).alias("part"), row_words(df).alias("w"))
    total = [(F.sum(F.col("w")[i].cast("decimal(38,0)")) % PRIME).cast("long").alias(f"sum{i}") for i in range(WORDS)]
    return words.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *total, *[F.bit_xor(F.col("w")[i]).alias(f"xor{i}") for i in range(WORDS)])


def rolled_up(digests: DataFrame) -> DataFrame:
    """The digest of the whole from those of its parts."""
    total = [(F.sum(F.col(f"sum{i}").cast("decimal(38,0)")) % PRIME).cast("long").alias(f"sum{i}") for i in range(WORDS)]
    return digests.agg(F.sum("n").alias("n"), *total, *[F.bit_xor(f"xor{i}").alias(f"xor{i}") for i in range(WORDS)])


def differing_parts(a: DataFrame, b: DataFrame) -> DataFrame:
    """part, n_before, n_after of the parts whose digests differ; a part that one side lacks differs."""
    cells = [f"{k}{i}" for k in ("sum", "xor") for i in range(WORDS)]
    joined = a.select("part", F.col("n").alias("n_before"), F.struct("n", *cells).alias("__a")).join(b.select("part", F.col("n").alias("n_after"), F.struct("n", *cells).alias("__b")), "part", "full_outer")
    return joined.where(~F.col("__a").eqNullSafe(F.col("__b"))).select("part", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def changed_rows(a: DataFrame, b: DataFrame, by: Column, key: str) -> DataFrame:
    """key, kind (added, removed, changed): rows are compared only in the parts whose digests differ."""
    parts = differing_parts(digest(a, by), digest(b, by)).select("part")
    side = lambda d, name: d.withColumn("part", by.cast("string")).join(parts, "part", "left_semi").select(key, row_words(d).alias(name))
    both = side(a, "__a").join(side(b, "__b"), key, "full_outer")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(key, kind.alias("kind")).where("kind is not null")
