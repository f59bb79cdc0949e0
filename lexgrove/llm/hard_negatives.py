"""Hard negatives by dual-tree search: a tree over the queries and a tree over the candidates, walked in pairs.

A pair of nodes with centres a, b and radii r, s holds inner products within a.b +- (|a| s + |b| r + r s). Where that
interval lies below what every query of the node already has, or above what its queries admit, the pair goes at once with
all it holds; pairs of leaves are scored exactly, in integers. The same interval routes whole groups of queries to
blocks of candidates before anything is sent.

Candidates lie in blocks: cells of a k-d tree, fitted on a hashed sample of at most ``SAMPLE`` rows, split by a hash where a
cell is large, so copies of one vector never meet in one task. Queries lie in slices of at most ``SLICE``. A task
walks one slice against one block and returns the best of each query there; the best of all blocks are ranked by query.
Positives are searched in the block nearest to their group first; what is found bounds the second search.

Defined cases: rows with a null label or vector, or a null or non-finite component take no part; a null vec_id is no anchor
and comes last among ties; rows that share the anchor's vec_id are the anchor itself, and each of them is mined; vectors
of different length have no inner product and never meet; scores beyond 64 bits are held at its ends; fewer than five
positives or three negatives are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut, ids_are_keys

POSITIVES, NEGATIVES, ANCHOR_EVERY, SHIFT_EVERY, LABELS, SCALE = 5, 3, 50, 7, 10, 256.0
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Rows in a block: at least, as a rule at most, and how many blocks there may be before they grow.
BLOCK, MOST_BLOCK, MAX_BLOCKS = 8_192, 65_536, 8_192
SLICE, GROUP = 8_192, 512
LEAF, QUERY_LEAF = 256, 64
#: A split that leaves less than one in so many on a side is made at the median.
SMALL = 10
SAMPLE, PER_CELL = 32_768, 8
LOW, HIGH = -(2**63), 2**63 - 1
FOUND = "qid long, slot int, id long, score long"
ROUTE = "_slice long, _group int, _block long"


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers floor(256 x) as doubles; all lists have one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    flat = np.asarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * flat)).reshape(n, -1 if flat.size else 0)


class Tree:
    """Rows in order of a ball tree; node i covers rows lo[i]:hi[i]."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        lo, hi, left, right, centre, radius, up = [], [], [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            at, i = self.order[a:b], len(lo)
            if parent >= 0:
                (left if left[parent] < 0 else right)[parent] = i
            part = x[at]
            c = part.mean(0)
            away = part - c
            lo.append(a), hi.append(b), left.append(-1), right.append(-1), up.append(parent)
            centre.append(c), radius.append(float(np.sqrt((away * away).sum(1).max(initial=0.0))))
            if b - a > leaf:
                # between the row farthest from the centre and the row farthest from that; in halves where one side is small
                one = part[np.argmax((away * away).sum(1))]
                other = part[np.argmax(((part - one) ** 2).sum(1))]
                along = away @ (other - one)
                mid = int((along < (one + other - 2 * c) @ (other - one) / 2).sum())
                if min(mid, b - a - mid) * SMALL < b - a:
                    mid = (b - a) // 2
                self.order[a:b] = at[np.argpartition(along, mid)]
                todo += [(a + mid, b, i), (a, a + mid, i)]
        self.lo, self.hi, self.left, self.right, self.up = lo, hi, left, right, up
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(1))


def interval(a: np.ndarray, a_norm, a_radius, b: np.ndarray, b_norm, b_radius):
    """Bounds of the inner products between two balls, widened by what doubles may round."""
    mid = b @ a
    wide = a_norm * b_radius + b_norm * a_radius + a_radius * b_radius + 1e-9 * (a_norm + a_radius) * (b_norm + b_radius) + 1e-6
    return mid - wide, mid + wide


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products as int64: in doubles where every sum stays exact, else in whole numbers."""
    most = np.sqrt((a * a).sum(1).max(initial=0.0)) * np.sqrt((b * b).sum(1).max(initial=0.0))
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    exact = whole(a) @ whole(b).T
    return np.array([[min(max(int(v), LOW), HIGH) for v in r] for r in exact], dtype=np.int64).reshape(len(a), len(b))


def dual_tree(x: np.ndarray, own, label, low, high, y: np.ndarray, ids, labels, k: int, same: bool):
    """(query row, id, score) of the k best candidates of each query whose score is in low..high."""
    queries, found = Tree(x, QUERY_LEAF), Tree(y, LEAF)
    x, own, label, low, high = (v[queries.order] for v in (x, own, label, low, high))
    y, ids, labels = (v[found.order] for v in (y, ids, labels))
    floor = low.copy()  # a query's k-th best so far
    best, best_id = np.full((len(x), k), LOW), np.full((len(x), k), HIGH)
    have = np.zeros(len(x), dtype=np.int64)
    node_floor = np.array([floor[a:b].min() for a, b in zip(queries.lo, queries.hi)])
    node_high = np.array([high[a:b].max() for a, b in zip(queries.lo, queries.hi)])
    bounds = lambda q, c: interval(queries.centre[q], queries.norm[q], queries.radius[q], found.centre[c], found.norm[c], found.radius[c])
    todo = [(0, 0, *bounds(0, 0))]
    while todo:
        q, c, least, most = todo.pop()
        if most < node_floor[q] or least > node_high[q]:
            continue
        q_leaf, c_leaf = queries.left[q] < 0, found.left[c] < 0
        if not (q_leaf and c_leaf):
            split_q = not q_leaf and (c_leaf or queries.radius[q] > found.radius[c])
            pairs = [(queries.left[q], c), (queries.right[q], c)] if split_q else [(q, found.left[c]), (q, found.right[c])]
            todo += sorted(((*p, *bounds(*p)) for p in pairs), key=lambda t: t[3])
            continue
        a, b, u, v = queries.lo[q], queries.hi[q], found.lo[c], found.hi[c]
        s = scores(x[a:b], y[u:v])
        ok = ((label[a:b, None] == labels[None, u:v]) == same) & (own[a:b, None] != ids[None, u:v]) & (s >= floor[a:b, None]) & (s <= high[a:b, None])
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            continue
        ok, at = ok[some], a + some
        more, more_id = np.where(ok, s[some], LOW), np.where(ok, ids[None, u:v], HIGH)
        every, every_id = np.concatenate([best[at], more], 1), np.concatenate([best_id[at], more_id], 1)
        real = np.concatenate([np.arange(k)[None, :] < have[at, None], ok], 1)
        # -1 - s, as the negative of the least integer is no integer; rows that are none come last
        first = np.lexsort((every_id, -1 - every, ~real), axis=1)[:, :k]
        best[at], best_id[at] = np.take_along_axis(every, first, 1), np.take_along_axis(every_id, first, 1)
        have[at] = np.minimum(k, real.sum(1))
        floor[at] = np.where(have[at] == k, np.maximum(floor[at], best[at, k - 1]), floor[at])
        while q >= 0:
            node_floor[q] = floor[queries.lo[q] : queries.hi[q]].min()
            q = queries.up[q]
    row, place = np.nonzero(np.arange(k)[None, :] < have[:, None])
    return queries.order[row], best_id[row, place], best[row, place]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(HIGH).to_numpy()


def _search(k: int, same: bool):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({n: pa.array([], t) for n, t in (("qid", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64()))})
        given = [queries[c].to_numpy() for c in ("label", "low", "high")]
        at, ids, s = dual_tree(matrix(queries["vec"]), _ids(queries["own"]), *given, matrix(rows["vec"]), _ids(rows["id"]), rows["label"].to_numpy(), k, same)
        return pa.table({"qid": queries["qid"].to_numpy()[at], "slot": queries["slot"].to_numpy()[at], "id": pa.array(ids, mask=ids == HIGH), "score": s})

    return run


def usable(rows: DataFrame) -> DataFrame:
    """key, id, label, dim, vec of the rows that take part, written once; key is a number of its own for each row."""
    keyed = ids_are_keys(rows, "vec_id")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, F.coalesce(F.try_add(label, F.lit(1)), F.lit(8)) % LABELS).otherwise(label)
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    key = F.col("vec_id").cast("long") if keyed else F.monotonically_increasing_id()
    return cut(sound.select(key.alias("key"), F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.size("embedding").alias("dim"), F.col("embedding").alias("vec")))


def planes(x: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Median splits of a sample in heap order, 2 ** depth - 1 of them."""
    out, parts = [], [x]
    for _ in range(depth):
        deeper = []
        for p in parts:
            axis = int(np.argmax(p.var(0))) if len(p) else 0
            at = float(np.median(p[:, axis])) if len(p) else 0.0
            out.append((axis, at))
            deeper += [p[p[:, axis] < at], p[p[:, axis] >= at]]
        parts = deeper
    return out


def _cell(dim: int, cuts: list[tuple[int, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axis, at = np.array([a for a, _ in cuts]), np.array([t for _, t in cuts])
        for b in batches:
            fits = b.column("dim").to_numpy() == dim
            node = np.zeros(len(b), dtype=np.int64)
            if fits.any():
                x = matrix(b.column("vec").filter(pa.array(fits)))
                at_node = np.zeros(len(x), dtype=np.int64)
                while len(x) and at_node[0] < len(cuts):
                    at_node = 2 * at_node + 1 + (x[np.arange(len(x)), axis[at_node]] >= at[at_node])
                node[fits] = at_node - len(cuts)
            yield b.append_column("cell", pa.array(node))

    return run


def in_cells(rows: DataFrame, n: int, block: int) -> DataFrame:
    """rows with the cell of a tree over the most frequent vector length; those of other lengths share cell 0."""
    main = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    depth = 0 if not main else min(int(np.ceil(np.log2(max(1, main[0]["count"] / block)))), int(np.log2(SAMPLE / PER_CELL)))
    if depth == 0:
        return rows.withColumn("cell", F.lit(0).cast("long"))
    dim, share = main[0]["dim"], 1 << 20
    sample = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("key", F.lit(11)), F.lit(share)) < int(min(1.0, SAMPLE / n) * share))).select("vec").limit(SAMPLE).toArrow()
    cuts = planes(matrix(sample["vec"]), depth)
    return rows.mapInArrow(_cell(dim, cuts), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell long")


def dealt(rows: DataFrame, by: list[str], most: int, key: list[str], name: str) -> DataFrame:
    """rows with a part of at most about ``most`` of the rows that agree on ``by`` = (dim, cell)."""
    parts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_n"))
    sub = F.pmod(F.xxhash64(*key), F.col("_n"))
    return rows.join(parts, by).withColumn(name, F.shiftleft(F.col("dim").cast("long"), 40) + F.shiftleft("cell", 24) + sub).drop("_n")


def _ball(table: pa.Table) -> pa.Table:
    x = matrix(table["vec"])
    c = x.mean(0)
    return pa.table({"_block": table["_block"][:1], "dim": table["dim"][:1], "centre": pa.array([c], pa.list_(pa.float64())), "radius": [float(np.sqrt(((x - c) ** 2).sum(1).max()))]})


def _route(balls, nearest: bool | None, done: bool):
    """Which blocks a group of queries has to see. nearest: its best block only; done: not that one."""

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        blocks, centre, norm, radius = balls.value.get(dim, (np.array([dim << 40]), None, None, None))
        out = []
        group = table["_group"].to_numpy()
        low, high = table["low"].to_numpy(), table["high"].to_numpy()
        x = None if centre is None else matrix(table["vec"])
        for g in np.unique(group):
            mine = group == g
            if centre is None:
                out += [] if done else [(g, blocks[0])]
                continue
            c = x[mine].mean(0)
            r = float(np.sqrt(((x[mine] - c) ** 2).sum(1).max()))
            least, most = interval(c, float(np.sqrt(c @ c)), r, centre, norm, radius)
            best = int(np.argmax(centre @ c))
            want = (most >= low[mine].min()) & (least <= high[mine].max())
            if nearest:
                want[:] = False
                want[best] = True
            elif done:
                want[best] = False
            out += [(g, b) for b in blocks[want]]
        return pa.table({"_slice": pa.array([table["_slice"][0].as_py()] * len(out), pa.int64()), "_group": pa.array([g for g, _ in out], pa.int32()), "_block": pa.array([b for _, b in out], pa.int64())})

    return run


def _grouped(table: pa.Table) -> pa.Table:
    """A slice's queries with the node of a tree of ``GROUP`` queries that each lies in."""
    tree = Tree(matrix(table["vec"]), GROUP)
    group = np.zeros(len(table), dtype=np.int32)
    for i, (a, b) in enumerate(zip(tree.lo, tree.hi)):
        if tree.left[i] < 0:
            group[tree.order[a:b]] = i
    return table.append_column("_group", pa.array(group))


class Index:
    """Candidate rows in blocks, with the ball of every block of a length that has several: 8 bytes a component, at most
    about ``MAX_BLOCKS`` twice over, whatever the table's size."""

    def __init__(self, rows: DataFrame):
        self.n = rows.count()
        self.block = max(BLOCK, min(MOST_BLOCK, self.n // 256), self.n // MAX_BLOCKS)
        self.cells = in_cells(rows, max(1, self.n), self.block)
        self.rows = cut(dealt(self.cells, ["dim", "cell"], self.block, ["key"], "_block"))
        several = self.rows.select("dim", "_block").distinct().groupBy("dim").count().where("count > 1").select("dim")
        balls: dict = {}
        for dim, block, centre, radius in self.rows.join(several, "dim").groupBy("_block").applyInArrow(_ball, "_block long, dim int, centre array<double>, radius double").select("dim", "_block", "centre", "radius").toLocalIterator():
            for to, v in zip(balls.setdefault(dim, ([], [], [])), (block, centre, radius)):
                to.append(v)
        shaped = {}
        for dim, (block, centre, radius) in balls.items():
            order = np.argsort(block)
            c = np.array(centre)[order]
            shaped[dim] = (np.array(block)[order], c, np.sqrt((c**2).sum(1)), np.array(radius)[order])
        self.balls = rows.sparkSession.sparkContext.broadcast(shaped)

    def grouped(self, queries: DataFrame) -> DataFrame:
        """queries(qid, slot, own, label, dim, cell, low, high, vec) in slices and groups."""
        sliced = dealt(queries.withColumn("cell", F.shiftright("cell", 6)), ["dim", "cell"], SLICE, ["qid", "slot"], "_slice")
        return cut(sliced.groupBy("_slice").applyInArrow(_grouped, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sliced.schema) + ", _group int"))

    def search(self, queries: DataFrame, k: int, same: bool, nearest: bool | None = None, done: bool = False) -> DataFrame:
        """qid, slot, id, score: the best k of each block that the queries' groups have to see."""
        routes = cut(queries.groupBy("_slice").applyInArrow(_route(self.balls, nearest, done), ROUTE))
        sent = queries.join(routes, ["_slice", "_group"])
        rows = self.rows.join(routes.select("_slice", "_block").distinct(), "_block")
        return sent.groupBy("_slice", "_block").cogroup(rows.groupBy("_slice", "_block")).applyInArrow(_search(k, same), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1; at most k a block are compared."""
    order = W.partitionBy("qid", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id, embedding, label)."""
    index = Index(usable(rows))
    anchor = F.coalesce(F.col("id") % ANCHOR_EVERY == 0, F.lit(False)) if anchor is None else anchor
    anchors = index.rows.where(anchor).select(F.col("key").alias("qid"), F.lit(0).alias("slot"), F.col("id").alias("own"), "label", "dim", "cell", F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"), "vec")
    asked = index.grouped(anchors)
    near = cut(index.search(asked, POSITIVES, True, nearest=True))
    # the fifth so far bounds what another block has to offer
    so_far = best(near, POSITIVES).where(F.col("rank") == POSITIVES).select("qid", F.col("score").alias("_so_far"))
    bounded = cut(asked.join(so_far, "qid", "left").withColumn("low", F.coalesce("_so_far", "low")).drop("_so_far"))
    positives = best(near.unionByName(index.search(bounded, POSITIVES, True, done=True)), POSITIVES)
    positives = cut(positives.select("qid", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    wide = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(wide * LEAST_PERCENT / 100), F.floor(wide * MOST_PERCENT / 100)
    pairs = anchors.drop("slot", "low", "high").join(positives, "qid").withColumns({"low": low.cast("long"), "high": high.cast("long")}).where("low <= high")
    negatives = best(index.search(index.grouped(pairs.drop("positive_id", "positive_score")), NEGATIVES, False), NEGATIVES)
    named = anchors.select("qid", F.col("own").alias("anchor_id")).join(positives, "qid")
    return negatives.join(named, ["qid", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE_SQL = f"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE:.0f} * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.id % {ANCHOR_EVERY} = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor AS anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND {LEAST_PERCENT} * p.score <= 100 * s.score AND 100 * s.score <= {MOST_PERCENT} * p.score
WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
