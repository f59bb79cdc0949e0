"""Versioned store, stored indexes, dated versions and digests."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrove.functions import stemming
from lexgrove.operators import corpus, index, search, vector_index, versions
from lexgrove.sources.store import Change, Conflict, Store

day = datetime.date.fromisoformat


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# the store


def test_a_commit_that_dies_midway_leaves_the_old_version(spark, store):
    store.commit({"a": spark.range(3), "b": spark.range(4)})
    dies = spark.range(2).select(F.raise_error(F.lit("executor lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="executor lost"):
        store.commit({"a": spark.range(30), "b": dies})
    assert store.versions() == [1]
    assert (store.read("a").count(), store.read("b").count()) == (3, 4)
    store.commit({"a": spark.range(30)})
    assert (store.read("a").count(), store.read("b").count(), store.read("a", 1).count()) == (30, 4, 3)


def test_of_two_writers_the_second_fails(spark, store):
    store.commit({"a": spark.range(3)})
    store.commit({"a": Change(spark.range(2), append=True)}, base=1)
    with pytest.raises(Conflict):
        store.commit({"a": spark.range(9)}, base=1)
    assert store.read("a").count() == 5 and store.versions() == [1, 2]
    assert store.manifest(1)["version"] == 1 and not store.has("b")


def test_tags_replace_their_own_rows(spark, store):
    for tag, n in (("x", 3), ("y", 4), ("x", 5)):
        store.commit({"t": Change(spark.range(n).withColumn("tag", F.lit(tag)), tag=tag)})
    assert {r["tag"]: r["count"] for r in store.read("t").groupBy("tag").count().collect()} == {"x": 5, "y": 4}


# stems


@pytest.mark.parametrize("word, stem", [
    ("важнейшие", "важн"), ("важность", "важност"), ("вестовой", "вестов"), ("весельчаки", "весельчак"), ("возмущённый", "возмущен"), ("налоговый", "налогов"), ("налогоплательщиками", "налогоплательщик"), ("прочитавши", "прочита"),
    ("возвращаться", "возвраща"), ("обязанность", "обязан"), ("стоимостью", "стоимост"), ("организаций", "организац"), ("в", "в"), ("tax", "tax"), ("", ""), ("нк1", "нк1"),
])
def test_stems(spark, word, stem):
    assert spark.createDataFrame([(word,)], "w string").select(stemming.stem(F.col("w"))).first()[0] == stem


def test_terms_leave_stop_words_out(spark):
    got = spark.createDataFrame([("Налоги и Ещё о льготах",), (None,)], "t string").select(stemming.terms("t").alias("t"), stemming.positions("t").alias("p")).collect()
    assert got[0]["t"] == ["налог", "льгот"] and [tuple(p) for p in got[0]["p"]] == [("налог", 0), ("льгот", 4)] and got[1]["t"] is None


# the inverted index

TEXTS = [(1, "The tax of the year"), (2, "a tax, and a tax again"), (3, None), (4, ""), (5, "nothing here"), (6, "year of the tax year")]


def rows(df):
    return sorted((r["key"], round(r["score"], 9), r["matched"]) for r in df.collect())


def fresh(spark, texts, terms):
    return rows(search.bm25(spark.createDataFrame(texts, "key long, text string"), terms, "key"))


def test_index_equals_scan_through_changes(spark, store):
    found, docs = index.InvertedIndex(store, buckets=4), lambda t: spark.createDataFrame(t, "k long, text string")
    terms = ["tax", "year", "of"]
    some = [(k, t or "") for k, t in TEXTS]
    found.add(docs(TEXTS), "k")
    assert rows(found.bm25(terms)) == fresh(spark, some, terms)
    found.add(docs([(2, "year"), (7, "tax of tax")]), "k")
    now = [t for t in some if t[0] != 2] + [(2, "year"), (7, "tax of tax")]
    assert rows(found.bm25(terms)) == fresh(spark, now, terms)
    found.remove(docs([(1, ""), (99, "")]), "k")
    found.add(docs([(7, "again tax")]), "k")
    now = [t for t in now if t[0] not in (1, 7)] + [(7, "again tax")]
    assert rows(found.bm25(terms)) == fresh(spark, now, terms)
    found.compact()
    assert rows(found.bm25(terms)) == fresh(spark, now, terms)
    assert found.bm25([]).count() == 0 and found.bm25(["unknown"]).count() == 0


def test_search_reads_the_buckets_of_its_terms(spark, store):
    found = index.InvertedIndex(store)
    found.add(spark.createDataFrame(TEXTS, "k long, text string"), "k")
    text = plan(found.postings(["tax"]))
    read = text[text.index("PartitionFilters") : text.index("ReadSchema")]
    assert "bucket" in read.split("PushedFilters")[0] and "term,tax" in read.split("PushedFilters")[1].replace("(term, [tax])", "term,tax")
    assert found.store.read("postings").where(F.col("term") == "tax").select("bucket").distinct().count() == 1


def test_phrases_and_passes(spark, store):
    found = index.InvertedIndex(store, index.stemmed)
    found.add(spark.createDataFrame([(1, "налоговый вычет и налоговые вычеты"), (2, "вычет налоговый"), (3, "налоговый и вычет")], "k long, text string"), "k")
    assert {(r["key"], r["occurrences"]) for r in found.phrase("налоговым вычетом").collect()} == {(1, 2)}
    assert {(r["key"], r["occurrences"]) for r in found.phrase("налоговый с вычетом").collect()} == {(3, 1)}
    assert found.phrase("и о").count() == 0
    assert [(r["key"], r["pass"]) for r in found.two_pass("вычеты по налоговым ставкам", 2).orderBy("rank").collect()][0][1] == "loose"
    assert {r["pass"] for r in found.two_pass("налоговый вычет").collect()} == {"strict"}


# the vector index


def test_vector_index_probes_cells_and_finds_neighbours(spark, store):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(20, size=1_500)] + 0.3 * rng.normal(size=(1_500, 16))).tolist()
    vectors = spark.createDataFrame([*enumerate(x), (9_000, None), (9_001, [1.0])], "id long, v array<double>")
    found = vector_index.VectorIndex(store)
    found.build(vectors, "id", "v", cells=20)
    hits = found.recall(vectors.where("id % 100 = 0 and id < 9000"), "id", "v", 10, 3).collect()
    assert len(hits) == 15 and sum(r["hits"] for r in hits) >= 0.9 * 150
    asked = found.search(x[7], 5, 2)
    assert asked.where("rank = 1").first()["key"] == 7 and "cell" in plan(found.cells([1, 2])).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert [r["key"] for r in found.search(x[7], 5, 20).orderBy("rank").collect()] == [r["key"] for r in found.exact(x[7], 5).orderBy("rank").collect()]
    found.put(spark.createDataFrame([(7, [-v for v in x[7]]), (5_000, x[7])], "id long, v array<double>"), "id", "v")
    found.keep_only(spark.createDataFrame([(i,) for i in range(6_000) if i != 8], "id long"), "id")
    best = [(r["key"], round(r["score"], 6)) for r in found.exact(x[7], 1_600).orderBy("rank").collect()]
    assert best[0] == (5_000, 1.0) and best[-1] == (7, -1.0) and len(best) == 1_500 and 8 not in dict(best)


# dated versions


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_alignment_is_longest_and_replays(a, b):
    got = versions.align(a, b)
    assert [r[3] for r in got if r[0] != "+"] == a and [r[3] for r in got if r[0] != "-"] == b
    assert [r[1] for r in got if r[1]] == list(range(1, len(a) + 1)) and [r[2] for r in got if r[2]] == list(range(1, len(b) + 1))
    assert sum(r[0] == "=" for r in got) == longest(a, b)


def test_diff_of_dates_with_context(spark):
    texts = spark.createDataFrame([("u", "a\nb\nc\nd\ne", day("2000-01-01"), day("2010-01-01")), ("u", "a\nb\nC\nd\ne", day("2010-01-01"), None), ("new", "x", day("2005-01-01"), None), ("old", "y", None, day("2005-01-01")), ("same", "z", None, None)], "unit_id string, text string, valid_from date, valid_to date")
    got = versions.version_diff(texts, "2003-01-01", "2012-01-01", context=1).orderBy("unit_id", "nth").collect()
    assert [(r["unit_id"], r["op"], r["line_before"], r["line_after"], r["line"]) for r in got] == [
        ("new", "+", None, 1, "x"), ("old", "-", 1, None, "y"), ("u", "=", 2, 2, "b"), ("u", "-", 3, None, "c"), ("u", "+", None, 3, "C"), ("u", "=", 4, 4, "d"),
    ]


def test_splicing_keeps_later_versions(spark):
    schema = "u string, t string, valid_from date, valid_to date"
    old = spark.createDataFrame([("a", "1", None, day("2010-01-01")), ("a", "2", day("2010-01-01"), day("2020-01-01")), ("a", "3", day("2020-01-01"), None), ("b", "1", day("2000-01-01"), day("2005-01-01"))], schema)
    new = spark.createDataFrame([("a", "n1", day("2012-01-01")), ("a", "n2", day("2015-01-01")), ("a", "n3", day("2020-01-01")), ("b", "n", day("2008-01-01")), ("c", "n", day("2001-01-01"))], "u string, t string, valid_from date")
    got = {(r["u"], r["t"]): (str(r["valid_from"]), str(r["valid_to"])) for r in versions.splice(old, new, ["u"]).collect()}
    assert got == {
        ("a", "1"): ("None", "2010-01-01"), ("a", "2"): ("2010-01-01", "2012-01-01"), ("a", "n1"): ("2012-01-01", "2015-01-01"), ("a", "n2"): ("2015-01-01", "2020-01-01"), ("a", "n3"): ("2020-01-01", "None"),
        ("b", "1"): ("2000-01-01", "2005-01-01"), ("b", "n"): ("2008-01-01", "None"), ("c", "n"): ("2001-01-01", "None"),
    }


# digests


def test_one_changed_row_shows_in_its_part(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("abc"), None if i % 7 == 0 else "") for i in range(500)]
    a = spark.createDataFrame(data, "k long, s string, n string")
    b = spark.createDataFrame([(k, s, "" if k == 14 else n) for k, s, n in data], "k long, s string, n string").select("n", "k", "s").repartition(3)
    part = F.col("k") % 16
    assert [tuple(r) for r in versions.differing_parts(versions.digest(a, part), versions.digest(b, part)).collect()] == [("14", 31, 31)]
    assert [tuple(r) for r in versions.changed_rows(a, b, part, "k").collect()] == [(14, "changed")]
    whole = lambda d: tuple(versions.rolled_up(versions.digest(d, part)).first())
    assert whole(a) == tuple(versions.digest(a).drop("part").first()) == whole(a.repartition(7)) != whole(b)


# a reload


def test_reload_of_an_act_is_one_version(spark, store):
    def state(texts, links):
        units = spark.createDataFrame([(u,) for u in texts], "unit_id string")
        hashed = spark.createDataFrame([*texts.items()], "unit_id string, text string").withColumn("text_hash", F.sha2("text", 256))
        return units, hashed, spark.createDataFrame(links, "from_unit_id string, to_unit_id string, pending string")

    corpus.reload_act(store, "A", *state({"A.art1": "one", "A.art2": "two"}, [("A.art1", None, "B.art1")]), "2024-01-01")
    assert not store.has("corpus_event") and store.read("reference").first()["to_unit_id"] is None
    corpus.reload_act(store, "B", *state({"B.art1": "b"}, [("B.art1", None, "A.art2")]), "2024-02-01")
    links = lambda v=None: {(r["from_unit_id"], r["to_unit_id"], r["pending"]) for r in store.read("reference", v).collect()}
    assert {x[:2] for x in links()} == {("A.art1", "B.art1"), ("B.art1", "A.art2")}
    corpus.reload_act(store, "A", *state({"A.art1": "one!"}, [("A.art1", None, "B.art1")]), "2025-01-01")
    assert {x[:2] for x in links()} == {("A.art1", "B.art1"), ("B.art1", None)} and {x[:2] for x in links(2)} == {("A.art1", "B.art1"), ("B.art1", "A.art2")}
    assert {(r["unit_id"], r["text"]) for r in store.read("unit_text_archive").collect()} == {("A.art1", "one"), ("A.art2", "two")}
    assert {(r["kind"], r["unit_id"]) for r in store.read("corpus_event").collect()} == {("unit_text_changed", "A.art1"), ("unit_repealed", "A.art2")}
    corpus.reload_act(store, "A", *state({"A.art1": "one!", "A.art2": "back"}, []), "2025-02-01")
    assert ("B.art1", "A.art2") in {x[:2] for x in links()}
