import collections
import random

import corpus_pipeline
from pyspark.sql import functions as F

from lexgrove.llm import packing, queries
from tests.llm import data


def table(spark):
    rng = random.Random(6)
    rows = []
    for i in range(50):
        text = "\n".join(" ".join(f"t{rng.randrange(9000)}" for _ in range(14)) + "." for _ in range(rng.randrange(5, 12)))
        rows.append((i, text, "en", f"s{i % 3}", 0))
    near = rows[4][1].split(" ")
    near[20] = "edited"
    rows += [(100, rows[3][1] + " ", "en", "s0", 0), (101, " ".join(near), "en", "s1", 0), (102, "junk | junk | junk | junk", "en", "s1", 0), (103, None, None, None, None), (104, "", "en", None, 0)]
    return spark.createDataFrame(rows, data.SCHEMA).withColumn("kept", F.lit("x")).withColumn("_copy", F.lit(1))


def test_stages_take_effect(spark):
    docs = table(spark)
    ids = lambda d: [r[0] for r in d.select("doc_id").collect()]
    after = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert now.columns == docs.columns
        after[name] = ids(now)
    assert sorted(after["quality rules"]) == [*range(50), 100, 101]
    # of two equal texts the longer original stays
    assert sorted(after["exact dedup"]) == [*(i for i in range(50) if i != 3), 100, 101]
    assert sorted(after["MinHash near dedup"]) == [*(i for i in range(50) if i != 3), 100]
    times = collections.Counter(after["mixing sources"])
    assert set(times) <= set(after["MinHash near dedup"]) and max(times.values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert {r["doc_id"] for r in packed} == set(times)
    filled = collections.Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= packing.ROOM


def test_dedup_decides_per_row(spark):
    rng = random.Random(9)
    unique = [" ".join(f"t{rng.randrange(9000)}" for _ in range(80)) for _ in range(6)]
    near = unique[5].split(" ")
    near[40] = "edited"
    rows = [
        (3, unique[0]), (7, unique[0]), (7, unique[1]),  # a copy and a unique text under one doc_id
        (8, unique[2]), (8, unique[2]), (8, unique[2]),  # repeated rows
        (None, unique[3]), (None, unique[3]), (None, unique[4]), (None, unique[0]),
        (9, unique[5]), (None, " ".join(near)), (3, " ".join(near[:-1])),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], data.SCHEMA).repartition(3).withColumn("__row__", F.lit(1))
    want = [(3, unique[0]), (7, unique[1]), (8, unique[2]), (None, unique[3]), (None, unique[4])]
    got = lambda d: collections.Counter((r["doc_id"], r["text"]) for r in d.collect())
    exact = corpus_pipeline.exact_stage(spark, docs, "")
    assert exact.columns == docs.columns and got(exact) == collections.Counter(want + rows[-3:])
    # near dedup alone meets the copies, too
    for before in (docs, exact):
        assert got(corpus_pipeline.near_stage(spark, before, "")) == collections.Counter([*want, rows[-1]])


def test_run_equals_the_stages(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert collections.Counter(map(key, out)) == collections.Counter(map(key, docs.collect()))


def test_empty_documents(spark, tmp_path):
    data.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.QUERIES)
