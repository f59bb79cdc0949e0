"""Search, monitoring, evaluation, facts, interpretations, sources and streams on small tables."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import hierarchy as H
from lexgrove.functions import temporal as T
from lexgrove.functions import text as X
from lexgrove.operators import corpus, evaluate, facts, interpret, monitor, search
from lexgrove.sources import readers
from lexgrove.streaming import monitor as streams


def d(s):
    return s and dt.date.fromisoformat(s)


# temporal


def test_as_of_and_closing(spark):
    rows = [("a", None, "2020-01-01", 1), ("a", "2020-01-01", None, 2), ("b", "2021-01-01", "2021-06-01", 3)]
    df = spark.createDataFrame([(u, d(f), d(t), v) for u, f, t, v in rows], "unit string, valid_from date, valid_to date, v int")
    assert {(r["unit"], r["v"]) for r in T.as_of(df, "2019-05-05", ["unit"]).collect()} == {("a", 1)}
    assert {(r["unit"], r["v"]) for r in T.as_of(df, "2021-02-02", ["unit"]).collect()} == {("a", 2), ("b", 3)}
    new = spark.createDataFrame([("a", d("2022-01-01"), None, 9), ("b", d("2021-01-01"), None, 8)], df.schema)
    got = {(r["unit"], str(r["valid_from"]), str(r["valid_to"]), r["v"]) for r in T.add_versions(df, new, ["unit"]).collect()}
    assert got == {("a", "None", "2020-01-01", 1), ("a", "2020-01-01", "2022-01-01", 2), ("a", "2022-01-01", "None", 9), ("b", "2021-01-01", "None", 8)}


def test_compress_and_reload(spark):
    df = spark.createDataFrame([("k", d(f"2024-01-0{i}"), r) for i, r in ((1, 5), (2, 5), (3, 6), (4, None), (5, None), (6, 5))], "key string, day date, rate int")
    got = [(r["rate"], str(r["valid_from"]), str(r["valid_to"])) for r in T.compress(df, ["key"], "day", "rate").orderBy("valid_from").collect()]
    assert got == [(5, "2024-01-01", "2024-01-03"), (6, "2024-01-03", "2024-01-04"), (None, "2024-01-04", "2024-01-06"), (5, "2024-01-06", "None")]


# hierarchy


def test_paths(spark):
    df = spark.createDataFrame([("x.ch1.art2.p3",), ("x.ch1.art2",), ("x.ch1.art21",), ("x",)], "u string")
    assert df.where("u = 'x.ch1.art2.p3'").select(H.ancestors("u")).first()[0] == ["x", "x.ch1", "x.ch1.art2", "x.ch1.art2.p3"]
    other = spark.createDataFrame([("x.ch1.art2.p9",), ("x.ch1",)], "v string")
    got = {tuple(r) for r in H.related_join(df, other, "u", "v").collect()}
    assert got == {("x.ch1.art2.p3", "x.ch1.art2.p9"), ("x.ch1.art2", "x.ch1.art2.p9"), ("x", "x.ch1.art2.p9"), ("x.ch1.art2.p3", "x.ch1"), ("x.ch1.art2", "x.ch1"), ("x.ch1.art21", "x.ch1"), ("x", "x.ch1")}
    keys = [r[0] for r in spark.createDataFrame([("105.17",), ("105.16-6",), ("105.16",), ("9",), ("X",)], "n string").select(H.number_key("n").alias("k")).orderBy("k").collect()]
    assert keys == [[], [9], [105, 16], [105, 16, 6], [105, 17]]


# scalars


@pytest.mark.parametrize("f,text,want", [
    (X.fact_date, "20 марта 2026 г.", d("2026-03-20")), (X.fact_date, "20.03.26", d("2026-03-20")), (X.fact_date, "31.07.98", d("1998-07-31")), (X.fact_date, "2026-03-20", d("2026-03-20")), (X.fact_date, "31.02.2026", None), (X.fact_date, "нет", None),
    (X.amount, "1 200 000,50 руб.", 1200000.5), (X.amount, "1,5 млн", 1500000.0), (X.amount, "3 тыс. руб.", 3000.0), (X.amount, "нет", None), (X.effective_date, "утратил силу со 2 августа 2021 г.", d("2021-08-02")),
])
def test_scalars(spark, f, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(f("t")).first()[0] == want


def test_periods_quotes_and_pii(spark):
    p = spark.createDataFrame([("1 квартал 2025",), ("2024",), ("2024-01-05..2024-02-06",)], "t string").select(X.period("t").alias("p")).collect()
    assert [(str(r["p"]["start"]), str(r["p"]["end"])) for r in p] == [("2025-01-01", "2025-03-31"), ("2024-01-01", "2024-12-31"), ("2024-01-05", "2024-02-06")]
    q = spark.createDataFrame([("Он сказал: «да  — нет».", 'СКАЗАЛ: "да - нет"'), ("текст", ""), ("текст", "иное")], "t string, q string").select(X.holds_quote("t", "q")).collect()
    assert [r[0] for r in q] == [True, False, False]
    text = "Иванов И.И., ИНН 7701234567, тел. +7 (495) 123-45-67, a.b@c.ru, сумма 100 000 руб. 01.02.2024, снова 7701234567"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    red = facts.redact(df)
    out = red.first()
    assert out["text"] == "[ФИО-1], ИНН [ИНН-1], тел. [ТЕЛ-1], [EMAIL-1], сумма 100 000 руб. 01.02.2024, снова [ИНН-1]"
    assert facts.restore(red).first()["text"] == text
    assert df.select(X.pii_counts("text")["ИНН"]).first()[0] == 2


# search


def test_search_passes_and_fusion(spark):
    docs = spark.createDataFrame([("a", "камеральная налоговая проверка"), ("b", "выездная проверка"), ("c", "налоговая декларация и камеральная проверка дополнительно"), ("d", "прочее")], "unit_id string, text string")
    two = search.two_pass(docs, "камеральная проверка", 3).orderBy("rank").collect()
    assert [(r["unit_id"], r["pass"]) for r in two] == [("a", "strict"), ("c", "strict"), ("b", "loose")]
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "unit_id string, rank int")
    b = spark.createDataFrame([("c", 1), ("d", 2), ("a", 3)], "unit_id string, rank int")
    fused = search.fuse({"x": a, "y": b}).orderBy("rank").collect()
    assert [r["unit_id"] for r in fused][:2] == ["a", "c"] and fused[0]["score"] == pytest.approx(1 / 61 + 1 / 63)
    assert "налог на добавленную стоимость" in search.expand_query("ставка НДС")
    hit = search.explain(search.lexical(docs, "проверка налоговая"), docs, "проверка налоговая").where("unit_id = 'a'").first()
    assert hit["matched_terms"] == ["прове", "налог"]
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "unit_id string, embedding array<float>")
    assert [r["unit_id"] for r in search.dense(vec, [1.0, 0.1], 2).orderBy("rank").collect()] == ["a", "c"]
    assert docs.select(search.headline(F.col("text"), "декларация", 20).alias("h")).where("h is not null").count() == 1
    terms = spark.createDataFrame([("Счёт", "article"), ("Счёт-фактура", "code"), ("Иное", "code")], "term string, scope string")
    assert [r["term"] for r in search.find_terms(terms, "счет").collect()] == ["Счёт-фактура", "Счёт"]


# monitoring


def test_changes_events_and_notifications(spark):
    state = "unit_id string, text_hash string, in_force boolean"
    old = spark.createDataFrame([("u1", "a", True), ("u2", "b", True), ("u3", "c", True)], state)
    new = spark.createDataFrame([("u1", "z", True), ("u3", "c", False), ("u4", "d", True)], state)
    assert {(r["kind"], r["unit_id"]) for r in monitor.unit_changes(old, new).collect()} == {("unit_text_changed", "u1"), ("unit_repealed", "u2"), ("unit_repealed", "u3"), ("unit_added", "u4")}
    assert monitor.unit_changes(old.where("false"), new).count() == 0
    ev = spark.createDataFrame([(1, "unit_text_changed", "x.ch1.art2.p1", None), (2, "document_added", None, "L1"), (3, "edition_available", "x.ch1.art2", None), (4, "unit_added", "x.ch9.art9", None)], "event_id long, kind string, unit_id string, doc_id string")
    subs = spark.createDataFrame([(7, "x.ch1.art2.p5", None), (8, "x.ch1", None), (9, None, "L1"), (7, "x.ch1.art2", None)], "workspace_id long, unit_id string, doc_id string")
    none = spark.createDataFrame([], "workspace_id long, event_id long, matched_by array<string>, status string")
    first = monitor.new_notifications(none, ev, subs, 0)
    assert {(r["workspace_id"], r["event_id"]) for r in first.collect()} == {(7, 1), (8, 1), (9, 2)}
    assert monitor.new_notifications(first.select(none.columns), ev, subs, 0).count() == 0 and monitor.new_notifications(none, ev, subs, 1).count() == 1
    marks = spark.createDataFrame([(7, 1, "applied"), (7, 1, "seen")], "workspace_id long, event_id long, status string")
    assert {(r["workspace_id"], r["status"]) for r in monitor.advance(first, marks).collect()} == {(7, "applied"), (8, "open"), (9, "open")}


def test_stream_continues_after_a_restart(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("event_id"), F.lit("unit_added").alias("kind"), F.lit("x").alias("act_code"), F.concat(F.lit("x.ch"), F.col("id") % 3).alias("unit_id"), F.lit(None).cast("string").alias("doc_id"), F.current_timestamp().alias("detected_at"))
    subs = spark.createDataFrame([(1, "x.ch1", None)], "workspace_id long, unit_id string, doc_id string")
    log, target, check = (str(tmp_path / x) for x in ("log", "target", "check"))
    rows(0, 30).write.mode("append").parquet(log)
    for _ in range(2):
        streams.notify(spark, log, subs, target, check).awaitTermination()
        assert spark.read.parquet(target).count() == 10
    rows(30, 60).write.mode("append").parquet(log)
    streams.notify(spark, log, subs, target, check).awaitTermination()
    assert spark.read.parquet(target).count() == 20


# interpretations, evaluation


def test_position_map_and_documents(spark):
    docs = spark.createDataFrame([("L1", "letter", True, d("2024-03-11"), "03-01/1", "actual"), ("P1", "plenum", False, d("2013-07-30"), "57", "actual"), ("L2", "letter", False, d("2027-01-15"), "03-02/2", "actual")], "doc_id string, kind string, mandatory boolean, date date, number string, status string")
    edges = spark.createDataFrame([("L1", "x.ch1.art2.p1", "п. 1 ст. 2"), ("P1", "x.ch1.art2", "ст. 2"), ("L2", "x.ch1.art2", "ст. 2")], "doc_id string, unit_id string, raw_citation string")
    asked = spark.createDataFrame([("x.ch1.art2",)], "unit_id string")
    assert [r["doc_id"] for r in interpret.interpretations(asked, edges, docs, "2026-09-10").orderBy("rank").collect()] == ["P1", "L1"]
    positions = spark.createDataFrame([("L1", "x.ch1.art2", "for_authority"), ("P1", "x.ch1.art2", "for_taxpayer"), ("L2", "x.ch1.art2", "neutral")], "doc_id string, unit_id string, stance string")
    changes = spark.createDataFrame([("x.ch1.art2", d("2020-01-01"))], "unit_id string, effective_date date")
    r = interpret.position_map(positions, docs, changes, "2026-09-10").first()
    assert r["conflict"] and r["leading"] == "for_taxpayer" and r["older"] == 1 and r["neutral"] == 0
    cited = interpret.cited_documents(spark.createDataFrame([("q", "Письмо Минфина от 11.03.2024 № 03-01/1 и письмо от 01.01.2020 № 57, письмо от 01.01.2001 № 9")], "doc_id string, text string"), docs)
    assert {(x["number"], x["found"]) for x in cited.collect()} == {("03-01/1", "L1"), ("57", "P1"), ("9", None)}


def test_scores(spark):
    questions = spark.createDataFrame([("q1", "t", ["x.ch1.art2.p1"], False), ("q2", None, [], True)], "id string, topic string, expected array<string>, abstain boolean")
    answers = spark.createDataFrame([("q1", 1, "ответ"), ("q2", 1, "Такой нормы не найдено")], "id string, rep int, text string")
    cites = spark.createDataFrame([("q1", 1, "x.ch1.art2", "OK"), ("q1", 1, "x.ch5.art7", "OK"), ("q1", 1, None, "MISS"), ("q1", 1, "x.ch5.art8", "STALE")], "id string, rep int, unit_id string, verdict string")
    got = {r["id"]: r for r in evaluate.score_answers(questions, cites, answers).collect()}
    assert got["q1"]["recall_unit"] == 1.0 and got["q1"]["precision_unit"] == pytest.approx(1 / 3) and got["q1"]["hallucinated"] == 2
    assert got["q1"]["temporal"] == pytest.approx(2 / 3) and got["q2"]["precision_unit"] is None and got["q2"]["abstained"] == 1
    total = evaluate.summary(evaluate.score_answers(questions, cites, answers)).where("topic is null and rep is null").first()
    assert total["hallucination_rate"] == 0.5 and total["n"] == 2


# facts, access, files


def test_facts_and_templates(spark):
    rows = [(1, "date", "20 марта 2026", "agent", "s", "срок 20 марта"), (2, "amount", "сто", "user", None, None), (3, "date", "2026-01-01", "agent", "s", "не было"), (4, "period", "1 кв 2025", "user", None, None)]
    f = spark.createDataFrame(rows, "fact_id int, kind string, text string, extracted_by string, source_path string, quote string")
    got = {r["fact_id"]: (r["value"], r["accepted"]) for r in facts.admit(f, spark.createDataFrame([("s", "Срок  20 марта указан")], "source_path string, text string")).collect()}
    assert got == {1: ("2026-03-20", True), 2: (None, False), 3: ("2026-01-01", False), 4: ("2025-01-01..2025-03-31", True)}
    assert facts.render("{{a}} {{b|нет}} {{c}}", {"a": "1"}) == ("1 нет [[нет: c]]", ["c"])
    assert facts.front_matter('---\nt: "x"\nn: [1]\n---\nbody') == ({"t": "x", "n": [1]}, "body")
    assert facts.highlight("a<b>c", [(0, 1, "k"), (0, 2, "z"), (2, 3, "m")]) == '<mark class="k">a</mark>&lt;<mark class="m">b</mark>&gt;c'
    drafts = spark.createDataFrame([("d", "{{x}}!", {"x": "y"})], "draft_id string, body string, values map<string,string>")
    assert facts.render_all(drafts).first()["text"] == "y!"


def test_access_and_files(spark):
    rows = spark.createDataFrame([(1, "w1"), (2, "w2")], "id int, slug string")
    members = spark.createDataFrame([("w1", "a", "viewer"), ("w2", "a", "owner"), (None, "root", "admin")], "slug string, email string, role string")
    see = lambda who, need: {r["id"] for r in facts.visible(rows, members, who, need).collect()}
    assert see("a", "viewer") == {1, 2} and see("a", "editor") == {2} and see("root", "owner") == {1, 2} and see("z", "viewer") == set()
    old = spark.createDataFrame([("s", "p", 1, "x")], "slug string, path string, version int, content string")
    new = spark.createDataFrame([("s", "p", "y"), ("s", "q", "z")], "slug string, path string, content string")
    assert {(r["path"], r["version"]) for r in facts.file_versions(old, new).collect()} == {("p", 1), ("p", 2), ("q", 1)}


def test_regional_parameters(spark):
    rows = [("rate", None, 20.0, None, "2026-01-01"), ("rate", None, 22.0, "2026-01-01", None), ("rate", "77", 5.0, "2020-01-01", None), ("cap", None, 1.0, None, None)]
    p = spark.createDataFrame([(n, r, v, d(a), d(b), "u") for n, r, v, a, b in rows], "name string, region string, value double, valid_from date, valid_to date, source_unit_id string")
    units = spark.createDataFrame([("u", "пункт")], "unit_id string, label string")
    value = lambda day, region=None: corpus.get_parameter(p, units, "rate", day, region).first()["value"]
    assert value("2026-05-01") == 22.0 and value("2025-06-01") == 20.0 and value("2026-05-01", "77") == 5.0 and value("2026-05-01", "50") == 22.0
    regions = spark.createDataFrame([("77",), ("50",)], "region string")
    got = {(r["region"], r["name"]): (r["value"], r["federal"]) for r in corpus.regional_preference(p, regions, "2026-05-01").collect()}
    assert got == {("77", "rate"): (5.0, False), ("50", "rate"): (22.0, True), ("77", "cap"): (1.0, True), ("50", "cap"): (1.0, True)}


def test_jobs(spark, tmp_path):
    corpus.job("good")(lambda s: {"n": s.range(3).count()})
    corpus.job("bad")(lambda s: 1 / 0)
    log = str(tmp_path / "log")
    assert corpus.run_job(spark, "good", log)["stats"] == '{"n": 3}' and corpus.run_job(spark, "bad", log)["status"] == "failed"
    assert spark.read.parquet(log).count() == 2


# sources


def test_readers(spark, tmp_path):
    (tmp_path / "nk1_units.jsonl").write_text('{"unit_id": "nk1", "act": "nk1", "odd": 1}\n\n{"unit_id": "nk1.ch1", "act": "nk1"}\n', encoding="utf-8")
    (tmp_path / "nk2_units.jsonl").write_text('{"unit_id": "nk2", "act": "nk2"}\n', encoding="utf-8")
    assert readers.units(spark, str(tmp_path)).count() == 3 and readers.units(spark, str(tmp_path), "nk2").count() == 2
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "letters.jsonl").write_text(json.dumps({"doc_id": "1", "kind": "letter", "text": "т"}, ensure_ascii=False), encoding="utf-8")
    assert len(readers.documents(spark, str(docs)).first()["sha256"]) == 64
    (docs / "more.jsonl").write_text('{"doc_id": "2", "kind": "gossip"}')
    with pytest.raises(Exception, match="unknown document kind"):
        readers.documents(spark, str(docs)).collect()
    cal = tmp_path / "cal"
    cal.mkdir()
    (cal / "2025.json").write_text('{"holidays": ["2025-05-02"], "workdays": ["2025-11-01"]}')
    assert {(str(r["day"]), r["working"], r["year"]) for r in readers.calendar_overrides(spark, str(cal)).collect()} == {("2025-05-02", False, 2025), ("2025-11-01", True, 2025)}
    (tmp_path / "p.json").write_text(json.dumps({"parameters": [{"name": "a", "value": 1, "source_unit_id": "nk1"}, {"name": "b", "value": 2, "source_unit_id": "zz"}]}))
    ok, skipped = readers.parameters(spark, str(tmp_path / "p.json"), readers.units(spark, str(tmp_path)))
    assert [r["name"] for r in ok.collect()] == ["a"] and [r["name"] for r in skipped.collect()] == ["b"]


def test_office_files_and_html(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>Раз</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Два</w:t></w:r></w:p></w:body></w:document>')
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.docx").write_bytes(buffer.getvalue())
    (folder / "b.txt").write_text("текст", encoding="utf-8")
    (folder / "c.html").write_text("<p>a&amp;b</p><script>x</script><p>c</p>")
    (folder / "d.exe").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in readers.file_texts(spark, str(folder)).collect()}
    assert got["a.docx"][0] == "Раз\n\nДва" and got["b.txt"][0] == "текст" and got["c.html"][0].split() == ["a&b", "c"] and "unsupported" in got["d.exe"][1]
    page = '<p align="center">Глава 1</p><p align="center">Название</p><p align="center">Статья 1</p><p>&lt;В ред.</p><p>закона&gt;</p><p>Текст<br>дальше</p>'
    blocks = readers.statute_blocks(readers.html_blocks(spark.createDataFrame([(1, page)], "id int, html string"), "id"), "id").orderBy("n").collect()
    assert [b["block"] for b in blocks] == ["Глава 1 Название", "Статья 1", "<В ред. закона>", "Текст дальше"]


def test_windows_and_sessions(spark):
    rows = [(1, dt.datetime(2024, 1, 1, h, 0), float(h)) for h in (1, 2, 9)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, value double")
    assert [r["n"] for r in streams.sessions(df, "ts", ["user_id"], "2 hours").orderBy("start").collect()] == [2, 1]
    assert streams.windowed(df, "ts", ["user_id"], "1 day").first()["total"] == 12.0


def test_a_resolution_reads_references_once(spark):
    units = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in ("act", "unit_id", "parent_unit_id", "kind", "number", "duplicate_of", "section_id", "chapter_id", "article_id", "point_id", "subpoint_id")], F.lit(1).alias("ord"))
    from lexgrove.operators import resolve

    refs = spark.range(7).select(F.concat(F.lit("r"), "id").alias("from_unit_id"), F.lit("internal_citation").alias("kind"), *[F.col("id").cast("string").alias(c) for c in ("section", "chapter", "article", "point", "subpoint")], F.col("id").cast("int").alias("paragraph_ordinal"), F.when(F.col("id") > 2, "article").alias("relative_to"))
    plan = resolve.resolve(refs, units)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 7") == 1 and plan.count("Range (0, 3") <= 9


def test_closure_has_no_depth_of_its_own(spark):
    from lexgrove.functions import hierarchy as H

    chain = spark.range(40).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = H.parent_closure(chain, "node", "parent")
    assert got.count() == 40 * 39 // 2 and got.agg(F.max("distance")).first()[0] == 39
    assert H.parent_closure(chain, "node", "parent", 5).agg(F.max("distance")).first()[0] == 5
    with pytest.raises(ValueError):
        H.parent_closure(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"), "node", "parent")


def test_personal_values_by_their_writing(spark):
    rows = {
        "счёт 40702810000000000001": "СЧЁТ", "ОГРНИП 304770000012345": "ОГРН", "паспорт 4510123456": "ИНН", "паспорт 4510 123456": "ПАСПОРТ", "45 10 №123456": "ПАСПОРТ", "тел. 89161234567": "ТЕЛ", "тел. +7-916-123-45-67": "ТЕЛ",
        "КПП:770001001": "КПП", "770001001": None, "№ 12345678901234": None, "СНИЛС 111-222-333 44": "СНИЛС", "Иванова И. И.": "ФИО", "И.И. Иванов": "ФИО", "Иванову Ивану Ивановичу": "ФИО", "Москва Тверская Улица": None, "a.b+c@mail.example.ru.": "EMAIL", "a@b": None, "01.02.2024": None, "100 000 000": None,
    }
    out = spark.createDataFrame([(k,) for k in rows], "text string").select("text", X.personal("text").alias("p")).collect()
    assert {r["text"]: (r["p"][0]["kind"] if r["p"] else None) for r in out} == rows
    assert spark.createDataFrame([("a.b@c.ru и a.b@c.ru",)], "text string").select(X.mask("text")).first()[0] == "[EMAIL] и [EMAIL]"


def test_penalties_by_pieces_equal_days(spark):
    from lexgrove.operators import calculators

    d = dt.date
    cases = spark.createDataFrame([(1, 1000.0, d(2021, 12, 1), d(2022, 5, 1), "organization"), (2, 5000.0, d(2024, 11, 1), d(2025, 4, 20), "organization"), (3, 700.0, d(2021, 12, 1), d(2022, 5, 1), "individual"), (4, 10.0, d(2019, 12, 1), d(2020, 5, 1), "organization"), (5, 10.0, d(2023, 1, 1), d(2023, 1, 1), "individual")], "case_id int, amount double, due date, paid date, taxpayer string")
    rates = spark.createDataFrame([(d(2020, 1, 1), d(2022, 2, 1), 8.5), (d(2022, 2, 1), d(2022, 4, 1), 20.0), (d(2022, 4, 5), d(2025, 1, 15), 16.0), (d(2025, 1, 15), None, 21.0)], "valid_from date, valid_to date, rate double")
    days = calculators.penalty_days(cases, rates)
    want = {r["case_id"]: (r["v"], r["n"], r["r"]) for r in days.groupBy("case_id").agg(F.round(F.sum("daily"), 2).alias("v"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("rule")).alias("r")).collect()}
    got = {r["case_id"]: (r["value"], r["days"], r["applied"][1:]) for r in calculators.penalties(cases, rates).collect()}
    assert got == {i: want.get(i, (0.0, 0, [])) for i in range(1, 6)}
    assert calculators.penalty_segments(cases, rates).groupBy("case_id").agg(F.sum("n").alias("n")).where("case_id = 2").first()["n"] == want[2][1]
