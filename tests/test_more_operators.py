import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import hierarchy as H
from lexgrove.functions import temporal as T
from lexgrove.functions import text as X
from lexgrove.operators import corpus, evaluate, facts, interpret, monitor, resolve, search
from lexgrove.sources import readers


def d(s):
    return s and dt.date.fromisoformat(s)


def test_full_text(spark):
    rows = [("x.art1", "article", "1", "Ввод", 0), ("x.art1.ab1", "paragraph", "1", "Ввод", 1), ("x.art1.p1", "point", "1", "Пункт", 2), ("x.art1.p1.sp1", "subpoint", "1", "Под", 3), ("x.art1.p2", "point", "2", "", 4)]
    got = {r["unit_id"]: r["full_text"] for r in H.full_text(spark.createDataFrame(rows, "unit_id string, kind string, number string, text string, ord int")).collect()}
    assert got["x.art1"] == "Ввод\n\n1. Пункт\n\n1) Под\n\n2. " or got["x.art1"] == "Ввод\n\n1. Пункт\n\n1) Под"
    assert got["x.art1.p1"] == "Пункт\n\n1) Под" and got["x.art1.p1.sp1"] == "Под"


def test_history_and_current_version(spark):
    df = spark.createDataFrame([("a", d("2020-01-01"), d("2021-01-01")), ("a", d("2021-01-01"), None)], "u string, valid_from date, valid_to date")
    assert [(r["version"], r["current"]) for r in T.history(df, ["u"], "2021-05-05").orderBy("version").collect()] == [(1, False), (2, True)]


def test_archive_and_what_changed(spark):
    old = spark.createDataFrame([("u1", "h1", "старый"), ("u2", "h2", "тот же")], "unit_id string, text_hash string, text string")
    new = spark.createDataFrame([("u1", "h3", "новый"), ("u2", "h2", "тот же")], old.schema)
    none = old.where("false")
    kept = monitor.archive(none, old, new)
    assert [r["unit_id"] for r in kept.collect()] == ["u1"] and monitor.archive(kept, old, new).count() == 1
    laws = spark.createDataFrame([("u1", "5-ФЗ"), ("u1", "5-ФЗ")], "target_unit_id string, amending_act_number string")
    r = monitor.what_changed(kept.withColumn("archived_at", F.lit(1)), new, laws).first()
    assert (r["before"], r["after"], r["amendments"]) == ("старый", "новый", ["5-ФЗ"])


def test_parameter_changes_and_loads(spark):
    schema = "name string, region string, value double, valid_from date"
    old = spark.createDataFrame([("a", None, 1.0, d("2020-01-01")), ("a", "77", 2.0, d("2020-01-01")), ("b", None, 3.0, None)], schema)
    new = spark.createDataFrame([("a", None, 5.0, d("2021-01-01")), ("b", None, 3.0, None)], schema)
    loaded = readers.load_parameters(old, new)
    assert {(r["name"], r["region"], r["value"]) for r in loaded.collect()} == {("a", None, 5.0), ("a", "77", 2.0), ("b", None, 3.0)}
    assert [(r["name"], r["before"], r["after"]) for r in monitor.parameter_changes(old, loaded).collect()] == [("a", "1.0", "5.0")]
    regional = spark.createDataFrame([("a", "77", 9.0, d("2020-01-01"))], schema)
    assert {r["value"] for r in readers.load_regional(loaded, regional).collect()} == {5.0, 9.0, 3.0}


def test_links_and_pending_and_reports(spark):
    refs = spark.createDataFrame([("L1", "u1", "resolved", "ст. 1", None), ("L1", "u1", "resolved", "ст. 1", None), ("L2", "u2", "partial", "п. 9", "point not found"), ("L9", "u2", "resolved", "x", None)], "from_unit_id string, to_unit_id string, status string, raw_citation string, note string")
    docs = spark.createDataFrame([("L1",), ("L2",)], "doc_id string")
    got = {(r["doc_id"], r["unit_id"], r["confidence"]) for r in interpret.link(docs, refs, spark.createDataFrame([("L1", "u7")], "doc_id string, unit_id string")).collect()}
    assert got == {("L1", "u1", 1.0), ("L2", "u2", 0.7), ("L1", "u7", 0.9)}
    rep = resolve.partial_report(refs).first()
    assert (rep["cause"], rep["n"], rep["sample"]) == ("point not found", 1, ["п. 9"])
    pending = spark.createDataFrame([("u1", None), ("zz", None), (None, "u5")], "pending string, to_unit_id string")
    units = spark.createDataFrame([("u1",)], "unit_id string")
    assert {r["to_unit_id"] for r in resolve.link_pending(pending, units).collect()} == {"u1", None, "u5"}


def test_card_and_parameters_of_a_unit(spark):
    units = spark.createDataFrame([("x.ch1.art1", "article", "статья 1", "c"), ("x.ch1.art1.p1", "point", "пункт 1", "c")], "unit_id string, kind string, label string, context string")
    text = spark.createDataFrame([("x.ch1.art1", "т", d("2020-01-01"), None)], "unit_id string, text string, valid_from date, valid_to date")
    changes = spark.createDataFrame([("x.ch1.art1", "5-ФЗ")], "target_unit_id string, amending_act_number string")
    docs = spark.createDataFrame([("L1", "letter", True, d("2021-01-01"))], "doc_id string, kind string, mandatory boolean, date date")
    edges = spark.createDataFrame([("L1", "x.ch1.art1.p1", "п. 1 ст. 1")], "doc_id string, unit_id string, raw_citation string")
    positions = spark.createDataFrame([("L1", "x.ch1.art1", "neutral")], "doc_id string, unit_id string, stance string")
    r = corpus.card(units, text, changes, edges, docs, positions, "x.ch1.art1", "2022-01-01").first()
    assert (r["label"], r["amendments"], r["interpretations"], r["positions"]) == ("статья 1", ["5-ФЗ"], 1, 1)
    p = spark.createDataFrame([("a", "x.ch1.art1.p1", None, None), ("b", "x.ch1.art11", None, None)], "name string, source_unit_id string, valid_from date, valid_to date")
    assert [r["name"] for r in corpus.parameters_for(p, "x.ch1.art1", "2022-01-01").collect()] == ["a"]


def test_document_search_and_activity(spark):
    docs = spark.createDataFrame([("1", "Камеральная проверка", "x", d("2020-01-01")), ("2", "Иное", "камеральная", d("2020-01-01")), ("3", "Камеральная", "x", d("2030-01-01"))], "doc_id string, title string, text string, date date")
    assert [r["doc_id"] for r in search.documents(docs, "камеральная проверка", "2026-01-01").orderBy("rank").collect()] == ["1", "2"]
    log = spark.createDataFrame([("s", "a", "k", "t", 1), ("s", "a", "k", "t", 1), ("s", "a", "k", "u", 2)], "slug string, actor string, kind string, target string, at int")
    assert [r["at"] for r in facts.recent(log, 5).collect()] == [2, 1]
    assert spark.createDataFrame([(1234567.5,)], "v double").select(X.money("v")).first()[0] == "1 234 567,50"


def test_search_accuracy(spark):
    golden = spark.createDataFrame([("q1", "t", ["x.ch1.art1.p1"]), ("q2", "t", ["x.ch1.art5"])], "id string, topic string, expected array<string>")
    hits = spark.createDataFrame([("lex", "q1", "x.ch1.art1", 1), ("lex", "q2", "x.ch1.art6", 1), ("lex", "q2", "x.ch1.art5.p1", 9), ("dense", "q1", "x.ch1.art1.p2", 1)], "variant string, id string, unit_id string, rank int")
    got = {r["variant"]: (r["n"], r["unit_at_k"], r["article_at_k"]) for r in evaluate.search_accuracy(hits, golden).collect()}
    assert got["lex"] == (2, 1, 1) and got["dense"][0] == 2 and got["dense"][2] == 1


@pytest.mark.parametrize("name,call", [
    ("range", lambda s: T.range_join(s.createDataFrame([], "day date, k int"), s.createDataFrame([], "valid_from date, valid_to date, rate double"), "day")),
    ("reload", lambda s: T.reload_diff(s.createDataFrame([], "k int, v int"), s.createDataFrame([], "k int, v int"), "k", "v")),
    ("match", lambda s: monitor.match_events(s.createDataFrame([], "event_id long, kind string, unit_id string, doc_id string"), s.createDataFrame([], "workspace_id long, unit_id string, doc_id string"))),
])
def test_empty_tables(spark, name, call):
    assert call(spark).count() == 0
