"""Conversation repair against a brute-force version: all orders of edits, shortest strings first."""

import collections
import hashlib
import random
import zlib

import pytest

from lexgrove.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def brute_repair(faults, roles, texts):
    """Least (cost, audit) over all edits, from the last turn back, by comparing whole strings."""
    n = len(roles)
    best = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        found = {s: [] for s in GRAMMAR}
        for s in GRAMMAR:
            if i == n:
                if s in ("", "a"):
                    found[s].append((0, "", ()))
                continue
            after, more = best[i + 1], faults[i] == "truncated"
            put = lambda s, cost, e, to, line: to in after and found[s].append((cost + after[to][0], e + after[to][1], line + after[to][2]))  # noqa: E731, B023
            put(s, 3, "D", s, ())
            if faults[i] not in ("blank", "duplicate"):
                if (to := GRAMMAR[s].get(roles[i][:1])) is not None:
                    put(s, more, "K", to, (f"{roles[i]}:{texts[i]}",))
                for r in ("user", "assistant"):
                    if r[0] in GRAMMAR[s] and GRAMMAR[s][r[0]] == r[0]:
                        put(s, 2 + more, "R", r[0], (f"{r}:{texts[i]}",))
        for _ in range(4):
            for s in GRAMMAR:
                for r in ("user", "assistant"):
                    if r[0] in GRAMMAR[s] and found[r[0]]:
                        c, a, t = min(found[r[0]])
                        found[s].append((c + 2, "I" + a, (f"{r}:", *t)))
            found = {s: [min(v)] if v else [] for s, v in found.items()}
        best[i] = {s: v[0] for s, v in found.items() if v}
    return best[0][""]


def brute(rows):
    convs = collections.defaultdict(list)
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if way == 4 else said(role), said(text)
        text = "" if way == 1 else "".join(c for c in text if c not in ".!?") if way == 2 else text
        convs[conv] += [] if way == 0 else [(turn, role, text)] * (1 + (way == 3))
    out = {}
    for conv, x in convs.items():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], []
        for _, role, text in x:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.append((role, text))
        roles, turns = [r for _, r, _ in x], {t for t, _, _ in x if t is not None}
        cost, audit, kept = brute_repair(faults, roles, [t for _, _, t in x])
        bad = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps if gaps < 2**63 else None, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def odd_rows(seed=4):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "assist", "User"]
    texts = ["Hi.", "Why?", "no end", " \t", "", None, "a\nb!", "same.", "same.", "é ... ü", "\xa0", "end.\x0b\n"]
    rows = []
    for conv in range(120):
        start = "system" if rng.random() < 0.3 else None
        for turn in range(rng.randrange(0, 14)):
            clean = rng.random() < 0.7
            role = (start if turn == 0 and start else ("user", "assistant")[(turn + (start is not None)) % 2]) if clean else rng.choice(roles)
            text = f"{rng.randrange(10**6)} words." if clean else rng.choice(texts)
            rows.append((conv, turn if rng.random() < 0.95 else rng.choice([None, 0, 40, turn]), role, text))
    rows += [(None, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in [*range(8), None]]
    rows += [(500, t, ("user", "assistant")[t % 2], "word " * 30_000 + ".") for t in range(6)]
    rows += [(501, 3, "user", "again.")] * 5 + [(502, t, "user", None) for t in (-(2**63), 2**63 - 1)]
    rows += [(next(c for c in range(600, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "dropped.")]
    rows += [(900, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"line {rng.randrange(90)}") for t in range(900)]
    rng.shuffle(rows)
    return rows


def got(df):
    cols = ["gaps", *cr.COUNTS, "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in cols) for r in rows}


@pytest.fixture(scope="module")
def table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    return df.select("*", *[F.lit(1).alias(c) for c in ("gone", "fault", "_seg", "_at", "audit", "gaps", "_conv", "cost", "_way")])


def test_repair_equals_brute_force(table):
    assert got(cr.repaired(cr.damaged(table))) == brute(odd_rows())


def test_long_conversations_are_cut_into_segments(table):
    want = brute(odd_rows())
    assert got(cr.repaired(cr.damaged(table), most_rows=4, segment=2_000)) == want
    assert got(cr.repaired(cr.damaged(table), most_bytes=100_000, segment=200_000)) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repaired(cr.damaged(empty)).count() == 0
    assert cr.repaired(cr.damaged(empty), most_rows=0).count() == 0


def test_edits_by_hand():
    audit = lambda *rows: cr.repair(list(range(len(rows))), [r for r, _ in rows], [t for _, t in rows])
    assert audit(("user", "a."), ("assistant", "b."))["audit"] == "KK"
    assert (audit(("assistant", "b."))["audit"], audit(("assistant", "b."))["cost"]) == ("IK", 2)
    assert (audit(("system", "b."))["audit"], audit(("system", "b."))["cost"]) == ("D", 3)
    assert (audit(("user", "a"))["audit"], audit(("user", "a"))["cost"]) == ("D", 3)  # of D and KI, both 3
    assert audit(("user", " "), ("user", "x."), ("user", "x."), ("assistant", "y."))["audit"] == "DKDK"
