"""Repair of conversation structure: a backward cost-to-go programme, then a greedy forward walk.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles. The grammar has four states: nothing yet,
after a system turn, after a user turn, after an assistant turn; it may end in the first and the last. Backward over the
turns, ``step`` gives the least cost from every state to the end; forward, the walk takes the ASCII-least edit (Delete,
Insert, Keep, Rerole) among those that are tight. Every edit leads to one state only, so the least string of initials is
found letter by letter, and it fixes the repaired turns. Costs count relative to their least, so few distinct steps
exist, each solved once.

A conversation of up to ``MOST_ROWS`` turns and ``MOST_BYTES`` is repaired in one pass of a sorted partition. A longer one is
cut into segments by range partitioning: a segment's costs are a min-plus matrix over the states, the matrices of a
conversation are folded backward, then each segment walks from the state where the one before it ended. No task
holds more than a segment; the digest of a long conversation is streamed, as SHA-256 admits no other order.

Defined cases: null role, text, conv_id and turn are one space where a string is made; rows of one conversation come by
turn (null first), then role and text; repeated rows are duplicates; rows without conv_id are one conversation; roles
other than by initial s, u, a must be reroled or deleted; a conversation without rows after damage has zeros, an empty
audit and the digest of nothing; a span of turns beyond 64 bits gives null gaps; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut, shuffle_partitions

MOST_ROWS, MOST_BYTES = 65_536, 64 << 20
SEGMENT_BYTES = 32 << 20
SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Cost to the end when no turn is left.
END = (0, 4, 2, 0)
INSERTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, CUT_SHORT = 3, 2, 2, 1
#: No conversation yet: null is one.
FRESH = object()
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
#: Stands for "not reachable" in relative costs.
FAR = 10**15


@functools.lru_cache(maxsize=65_536)
def _solved(kind: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, tuple[int, ...], int], ...]]:
    """(least cost from every state, the walk of every state) of one turn; kind is "" (to be deleted) or initial and "+" or "." ."""
    options: list[dict[str, tuple[int, int]]] = []
    for s in range(4):
        way = {"D": (DELETE + after[s], s)}
        if kind:
            more = CUT_SHORT * (kind[-1] == "+")
            if (to := KEPT.get((s, kind[0]))) is not None:
                way["K"] = (more + after[to], to)
            way["R"] = (REROLE + more + after[INSERTED[s]], INSERTED[s])
        options.append(way)
    least = [min(c for c, _ in way.values()) for way in options]
    for _ in range(3):
        least = [min(least[s], INSERT + least[INSERTED[s]]) for s in range(4)]
    walks = []
    for s in range(4):
        said, added, at = "", [], s
        while True:
            options[at]["I"] = (INSERT + least[INSERTED[at]], INSERTED[at])
            edit = min(e for e, (c, _) in options[at].items() if c == least[at])
            said, at = said + edit, options[at][edit][1]
            if edit != "I":
                break
            added.append(at)
        walks.append((said, tuple(added), at))
    return tuple(least), tuple(walks)


def step(kind: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple]:
    low = min(after)
    least, walks = _solved(kind, tuple(min(c - low, FAR) for c in after))
    return tuple(c + low for c in least), walks


def cost_matrix(kinds: list[str]) -> list[tuple[int, ...]]:
    """Least costs over the turns: from every state (row) to every state (column)."""
    columns = []
    for to in range(4):
        costs = tuple(0 if s == to else FAR for s in range(4))
        for kind in reversed(kinds):
            costs, _ = step(kind, costs)
        columns.append(costs)
    return [tuple(columns[to][s] for to in range(4)) for s in range(4)]


def walk(kinds: list[str], state: int = NOTHING, after: tuple[int, ...] = END, last: bool = True) -> tuple[int, list[tuple[str, tuple[int, ...], int]], int]:
    """(cost, one walk a turn and, at the end of a conversation, one for what is inserted there, state reached)."""
    plans, costs = [], after
    for kind in reversed(kinds):
        costs, walks = step(kind, costs)
        plans.append(walks)
    cost, taken = costs[state], []
    for walks in reversed(plans):
        taken.append(walks[state])
        state = walks[state][2]
    if last and END[state]:
        added = []
        while END[state]:
            state = INSERTED[state]
            added.append(state)
        taken.append(("I" * len(added), tuple(added), state))
    return cost, taken, state


def lines(taken: list, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The repaired turns as role:text."""
    for i, (said, added, state) in enumerate(taken):
        for s in added:
            yield f"{ROLE[s]}:"
        if said[-1] == "K":
            yield f"{roles[i]}:{texts[i]}"
        elif said[-1] == "R":
            yield f"{ROLE[state]}:{texts[i]}"


def fault(text: str, again: bool) -> str:
    core = text.rstrip(SPACE)
    return "blank" if not core else "duplicate" if again else "truncated" if core[-1] not in ".!?" else ""


def kind_of(role: str, fault: str) -> str:
    """What step needs to know of a turn; an initial outside the grammar is "?" ."""
    return "" if fault in ("blank", "duplicate") else (role[:1] if role[:1] in ("s", "u", "a") else "?") + ("+" if fault == "truncated" else ".")


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def repair(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """The figures of one conversation, its rows in order."""
    seen, faults = set(), []
    for said in zip(roles, texts):
        faults.append(fault(said[1], said in seen))
        seen.add(said)
    cost, taken, _ = walk([kind_of(r, f) for r, f in zip(roles, faults)])
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": illegal([r[:1] for r in roles]), "cost": cost, "audit": "".join(t[0] for t in taken), "repaired_sha256": hashlib.sha256("\n".join(lines(taken, roles, texts)).encode()).hexdigest(),
    }


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage; a dropped row stays as a mark (``gone``) of its conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("_way"))
    text = F.when(F.col("_way") <= 1, F.lit("")).when(F.col("_way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_way") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_way") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("_way") == 3, 2).otherwise(1))).alias("_nth"))
    return rows.drop("_nth")


def _result(kind: str) -> str:
    return f"conv_id {kind}, gaps long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _short(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        now, held, out = FRESH, ([], [], []), []
        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), ("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for conv, turn, role, text, gone in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
                if conv != now:
                    if now is not FRESH:
                        out.append({"conv_id": now, **repair(*held)})
                    now, held = conv, ([], [], [])
                if not gone:
                    for to, v in zip(held, (turn, role, text)):
                        to.append(v)
            if len(out) >= 4_096:
                yield from pa.Table.from_pylist(fit(out), schema).to_batches()
                out.clear()
        if now is not FRESH:
            out.append({"conv_id": now, **repair(*held)})
            yield from pa.Table.from_pylist(fit(out), schema).to_batches()

    return run


def fit(rows: list[dict]) -> list[dict]:
    for r in rows:
        if r["gaps"] > 2**63 - 1:
            r["gaps"] = None
    return rows


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a joined with b by conv_id, null equal to null; b's is dropped."""
    return a.join(b.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), how).drop("_conv")


def _segment_facts(table: pa.Table) -> pa.Table:
    rows = table.select(["_seg", "_at", "role", "fault", "gone"]).sort_by("_at").to_pylist()
    rows = [r for r in rows if not r["gone"]]
    faults = [r["fault"] for r in rows]
    kinds = [kind_of(r["role"], r["fault"]) for r in rows]
    initials = [r["role"][:1] for r in rows]
    out = {"conv_id": table["conv_id"][:1], "_seg": table["_seg"][:1], **{f: [faults.count(f)] for f in ("blank", "duplicate", "truncated")}}
    out |= {"illegal": [illegal(initials)], "matrix": [[c for row in cost_matrix(kinds) for c in row]], "ends": [[initials[0], initials[-1]] if rows else []]}
    return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, FACTS.get(k, pa.int64())) for k, v in out.items()})


FACTS = {"matrix": pa.list_(pa.int64()), "ends": pa.list_(pa.string())}


def _fold(table: pa.Table) -> pa.Table:
    """Cost to the end behind every segment of a conversation, backward; sums of its counts."""
    rows = table.select(["_seg", "blank", "duplicate", "truncated", "illegal", "matrix", "ends"]).sort_by("_seg").to_pylist()
    after, behind = END, []
    for r in reversed(rows):
        behind.append(list(after))
        after = tuple(min(r["matrix"][4 * s + to] + after[to] for to in range(4)) for s in range(4))
    ends = [r["ends"] for r in rows if r["ends"]]
    seams = sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(ends, ends[1:]))
    n = len(rows)
    total = {f: sum(r[f] for r in rows) for f in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += seams
    out = {"conv_id": table["conv_id"][:1].combine_chunks().take(pa.array([0] * n)), "_seg": pa.array([r["_seg"] for r in rows], pa.int32()), "_after": pa.array(behind[::-1], pa.list_(pa.int64())), "_last": pa.array([i == n - 1 for i in range(n)])}
    return pa.table(out | {f: pa.array([v] * n, pa.int64()) for f, v in total.items()} | {"cost": pa.array([after[NOTHING]] * n, pa.int64())})


def _reached(table: pa.Table) -> pa.Table:
    """The state that a segment ends in, for each state that it may begin in."""
    rows = [r for r in table.select(["_at", "role", "fault", "gone"]).sort_by("_at").to_pylist() if not r["gone"]]
    kinds = [kind_of(r["role"], r["fault"]) for r in rows]
    after, last = tuple(table["_after"][0].as_py()), table["_last"][0].as_py()
    return pa.table({"conv_id": table["conv_id"][:1], "_seg": table["_seg"][:1], "_to": pa.array([[walk(kinds, s, after, last)[2] for s in range(4)]], pa.list_(pa.int32()))})


def _begun(table: pa.Table) -> pa.Table:
    rows, state, out = table.select(["_seg", "_to"]).sort_by("_seg").to_pylist(), NOTHING, []
    for r in rows:
        out.append(state)
        state = r["_to"][state]
    return pa.table({"conv_id": table["conv_id"][:1].combine_chunks().take(pa.array([0] * len(out))), "_seg": pa.array([r["_seg"] for r in rows], pa.int32()), "_state": pa.array(out, pa.int32())})


def _walked(table: pa.Table) -> pa.Table:
    """The audit of every row of a segment and what it leaves: edits and lines."""
    table = table.sort_by("_at")
    rows = [r for r in table.select(["_at", "role", "text", "fault", "gone"]).to_pylist() if not r["gone"]]
    after, last, state = tuple(table["_after"][0].as_py()), table["_last"][0].as_py(), table["_state"][0].as_py()
    _, taken, _ = walk([kind_of(r["role"], r["fault"]) for r in rows], state, after, last)
    kept = list(lines(taken, [r["role"] for r in rows], [r["text"] for r in rows]))
    return pa.table({"conv_id": table["conv_id"][:1], "_seg": table["_seg"][:1], "_audit": ["".join(t[0] for t in taken)], "_any": [bool(kept)], "_lines": pa.array(["\n".join(kept)], pa.large_string()).cast(pa.string())})


def _hashed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One digest a conversation from its segments in order."""
        now, digest, begun = FRESH, None, False
        for b in batches:
            for i, (conv, text, some) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("_lines"), b.column("_any").to_pylist())):
                if conv != now:
                    if digest is not None:
                        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([now], b.schema.field("conv_id").type), "repaired_sha256": [digest.hexdigest()]})
                    now, digest, begun = conv, hashlib.sha256(), False
                if some:
                    digest.update(b"\n" * begun + text.as_buffer().to_pybytes())
                    begun = True
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([now], b.schema.field("conv_id").type), "repaired_sha256": [digest.hexdigest()]})

    return run


def _long(rows: DataFrame, kind: str, size: int, segment: int) -> DataFrame:
    spark = rows.sparkSession
    n = max(shuffle_partitions(spark), -(-size // segment))
    ranged = rows.withColumn("_rid", F.monotonically_increasing_id()).repartitionByRange(n, *_order(), "_rid").sortWithinPartitions(*_order(), "_rid")
    ranged = cut(ranged.select("*", F.spark_partition_id().alias("_seg"), F.monotonically_increasing_id().alias("_at"), F.sha2("text", 256).alias("_digest")).drop("_rid"))
    # a row's place is its number: the first of equal rows is the least, found by partial aggregation
    key = ["conv_id", "role", "_digest"]
    first = ranged.where("not gone").groupBy(*key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_first")
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    again = ranged.where("not gone").select(*key, "_at").join(first, on).where("_at > _first").select("_at").withColumn("_again", F.lit(True))
    core = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    found = F.when(core == "", "blank").when(F.coalesce("_again", F.lit(False)), "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    state = cut(ranged.join(again, "_at", "left").select("conv_id", "turn", "_seg", "_at", "role", "text", "gone", found.alias("fault")))

    by = ["conv_id", "_seg"]
    facts = state.drop("text", "turn").groupBy(*by).applyInArrow(_segment_facts, f"conv_id {kind}, _seg int, blank long, duplicate long, truncated long, illegal long, matrix array<long>, ends array<string>")
    folded = cut(facts.groupBy("conv_id").applyInArrow(_fold, f"conv_id {kind}, _seg int, _after array<long>, _last boolean, blank long, duplicate long, truncated long, illegal long, cost long"))
    on_segment = lambda a, b: a.join(b.withColumnsRenamed({"conv_id": "_conv", "_seg": "_s"}), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_seg") == F.col("_s"))).drop("_conv", "_s")
    told = on_segment(state.drop("turn"), folded.select(*by, "_after", "_last"))
    reached = told.drop("text").groupBy(*by).applyInArrow(_reached, f"conv_id {kind}, _seg int, _to array<int>")
    begun = cut(reached.groupBy("conv_id").applyInArrow(_begun, f"conv_id {kind}, _seg int, _state int"))
    walked = cut(on_segment(told, begun).groupBy(*by).applyInArrow(_walked, f"conv_id {kind}, _seg int, _audit string, _any boolean, _lines string"))
    ordered = walked.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "_seg")
    digests = ordered.mapInArrow(_hashed(kind), f"conv_id {kind}, repaired_sha256 string")
    audits = walked.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seg", "_audit"))), lambda x: x["_audit"]), "").alias("audit"))
    turns = state.where("not gone and turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("_one"))
    span = turns.groupBy("conv_id").agg(F.expr("try_subtract(try_add(try_subtract(max(turn), min(turn)), 1L), count(1))").alias("_span"), F.lit(True).alias("_any_turn"))
    out = _same(_same(_same(folded.where("_last"), audits, "left"), digests, "left"), span, "left")
    return out.select("conv_id", F.when(F.col("_any_turn"), F.col("_span")).otherwise(F.lit(0)).alias("gaps"), *COUNTS, "audit", "repaired_sha256")


def repaired(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, segment: int = SEGMENT_BYTES) -> DataFrame:
    """One row a conversation of rows(conv_id, turn, role, text, gone): its figures, audit and digest of the repaired turns."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    size = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("_bytes"))
    big = cut(size.where((F.col("_rows") > most_rows) | (F.col("_bytes") > most_bytes)))
    total = big.agg(F.sum("_bytes")).first()[0]
    few = rows if total is None else _same(rows, big.select("conv_id"), "left_anti")
    out = few.repartition("conv_id").sortWithinPartitions(*_order()).mapInArrow(_short(kind), _result(kind))
    return out if total is None else out.unionByName(_long(_same(rows, big.select("conv_id"), "left_semi"), kind, total, segment))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
