"""Hard negatives and embedding near-dedup against brute-force versions."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import embedding_dedup as ed
from lexgrove.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=7, n=420, dim=12, groups=6):
    """Random unit vectors, groups of near copies and of exact copies, odd rows of every kind."""
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.normal(size=(groups, dim))
    for i in range(n):
        v = rng.normal(size=dim) if i % 3 else centres[i % groups] + 0.15 * rng.normal(size=dim)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(10))))
    copy = rows[11][1]
    rows += [(n + i, copy, i % 3) for i in range(150)]  # one vector, many rows
    rows += [(1000, None, 1), (1050, copy, None), (1100, [*copy[:-1], None], 2), (1150, [*copy[:-1], float("nan")], 2), (1200, [float("inf"), *copy[1:]], 2), (None, copy, 3), (None, rows[30][1], 3)]
    rows += [(1250, [], 1), (1300, [], 1), (1301, [], 2), (1350, copy[:5], 1), (1351, copy[:5], 1), (1353, [0.5 * x for x in copy[:5]], 4)]
    rows += [(1400, [0.0] * dim, 5), (1401, [0.0] * dim, 5), (1402, [0.0] * dim, 6), (50, rows[50][1], 2), rows[100], rows[100]]
    rows += [(1450, [1e30] * dim, 1), (1451, [1e30] * dim, 1), (1452, [7e29] * dim, 3), (1453, [-1e30] * dim, 3), (-50, rows[3][1], -3), (-49, rows[4][1], -3)]
    random.Random(seed).shuffle(rows)
    return rows


def table(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.select("*", *[F.lit(1).alias(c) for c in ("key", "id", "dim", "cell", "score", "rank", "low", "_block", "kept", "n_links")])


# hard negatives


def brute_negatives(rows):
    sound = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        shifted = i is not None and i % 7 == 0
        label = int(math.fmod(label + 1, 10)) if shifted else label
        sound.append((i, [math.floor(256.0 * float(np.float32(x))) for x in v], label))
    hold = lambda s: min(max(s, hn.LOW), hn.HIGH)
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, v, label in sound:
        if a is None or a % 50:
            continue
        others = [(hold(sum(x * y for x, y in zip(v, w))), i, other) for i, w, other in sound if i != a and len(w) == len(v)]
        for sp, p, _ in sorted((x for x in others if x[2] == label), key=by)[:5]:
            fit = sorted((x for x in others if x[2] != label and 50 * sp <= 100 * x[0] <= 95 * sp), key=by)[:3]
            out += [(a, p, k, i, sp, s) for k, (s, i, _) in enumerate(fit, 1)]
    return collections.Counter(out)


def found(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block, most", [(8_192, 65_536), (40, 40)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, most):
    rows = vectors()
    for name, v in (("BLOCK", block), ("MOST_BLOCK", most), ("SLICE", 5 if block == 40 else 8_192), ("GROUP", 2), ("LEAF", 8), ("QUERY_LEAF", 2)):
        monkeypatch.setattr(hn, name, v)
    assert found(hn.hard_negatives(table(spark, rows))) == brute_negatives(rows)


def test_repeated_anchors_are_each_mined(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.5, 0.0], 1), (2, [0.3, 0.0], 3)]
    assert found(hn.hard_negatives(table(spark, rows))) == {(0, 1, 1, 2, 256 * 128, 256 * 76): 2}


def test_no_vectors(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(0, None, 1), (1, [1.0], 1)], SCHEMA)).count() == 0


def test_node_pairs_are_pruned(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 8)) * 60
    y = np.floor(centres[rng.integers(16, size=8_000)] + rng.normal(size=(8_000, 8)))
    x, n = y[:2_000], np.zeros(2_000, dtype=np.int64)
    calls = []
    real = hn.scores
    monkeypatch.setattr(hn, "scores", lambda a, b: calls.append(len(a) * len(b)) or real(a, b))
    hn.dual_tree(x, n - 1, n, n + hn.LOW, n + hn.HIGH, y, np.arange(8_000), np.zeros(8_000, dtype=np.int64), 5, True)
    assert sum(calls) < 0.4 * 2_000 * 8_000


# embedding near-dedup


def brute_links(rows, threshold=0.9):
    """vec_id, number of links, smallest vec_id reachable, for every row."""
    sound = {}
    for k, (i, v, _) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            sound[k] = x / np.sqrt(x @ x)
    links = {k: [j for j in sound if j != k and len(sound[j]) == len(x) and sound[j] @ x >= threshold] for k, x in sound.items()}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((i, len(links.get(k, [])), min(ids, default=None), i == min(ids, default=None)))
    return collections.Counter(out)


def spread(seed=3, n=260, dim=16):
    """A group wider than the threshold: neighbours link, its ends do not."""
    rng = np.random.default_rng(seed)
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    t = np.sort(rng.uniform(0, 1.5, n))
    x = np.cos(t)[:, None] * a + np.sin(t)[:, None] * b + 0.02 * rng.normal(size=(n, dim))
    return [(5_000 + i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("hot, tile", [(64, 2_048), (6, 10)])
def test_links_equal_brute_force_with_many_tables(spark, monkeypatch, hot, tile):
    rows = vectors() + spread()
    monkeypatch.setattr(ed, "HOT", hot)
    monkeypatch.setattr(ed, "TILE", tile)
    assert found(ed.near_vectors(table(spark, rows), recall=1 - 1e-9)) == brute_links(rows)


def test_recall_and_no_false_link(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(150):  # pairs from just above the threshold to close copies, amid unlike vectors
        x, r = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        r -= (r @ x) * x
        c = 0.901 + 0.09 * g / 150
        rows += [(10 * g, x.tolist(), 0), (10 * g + 1, (c * x + math.sqrt(1 - c * c) * r / np.linalg.norm(r)).tolist(), 0)]
    rows += [(10_000 + i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(3_000, 64)))]
    want = {r[0]: r[1:] for r in brute_links(rows)}
    got = {r["vec_id"]: r for r in ed.near_vectors(table(spark, rows)).collect()}
    assert len(got) == len(rows) and all(r["n_links"] <= want[i][0] for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(w[0] for w in want.values())


def test_estimates_are_unbiased_and_within_bounds():
    rng = np.random.default_rng(4)
    d, n = 64, 4_000
    x, r = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    r -= (r * x).sum(1)[:, None] * x
    r /= np.linalg.norm(r, axis=1)[:, None]
    y = 0.9 * x + math.sqrt(0.19) * r
    a, b = x @ ed.rotation(d, 0), y @ ed.rotation(d, 0)
    f = np.abs(a).sum(1) / math.sqrt(d)
    about = (np.sign(a) * b).sum(1) / math.sqrt(d) / f
    assert abs(about.mean() - 0.9) < 4 * about.std() / math.sqrt(n)
    off = ed.DEVIATIONS * math.sqrt(0.19) * np.sqrt(1 / f**2 - 1) / math.sqrt(d - 1)
    assert (about + off >= 0.9).all()
    assert ((np.sign(a) != np.sign(b)).sum(1) <= ed.most_signs(d, 0.9)).all()


def test_no_embeddings(spark):
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, 0), (2, [], 0), (None, [0.0], 0), (4, [1.0], 0)]
    assert found(ed.near_vectors(spark.createDataFrame(rows, SCHEMA))) == collections.Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True), (4, 0, 4, True)])
