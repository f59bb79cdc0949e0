"""What may not grow faster than the tables: broadcasts, walks over whole acts, ties of scores."""

from pyspark.sql import functions as F

from lexgrove.operators import evaluate, index, patch, search, statute


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_are_scored_without_broadcasts(spark):
    questions = spark.createDataFrame([("q", "t", ["x.art1.p1"], False)], "id string, topic string, expected array<string>, abstain boolean")
    citations = spark.createDataFrame([("q", 1, "x.art1", "OK")], "id string, rep int, unit_id string, verdict string")
    answers = spark.createDataFrame([("q", 1, "Да.")], "id string, rep int, text string")
    assert "Broadcast" not in plan(evaluate.score_answers(questions, citations, answers))


def test_search_accuracy_broadcasts_variants_only(spark):
    golden = spark.createDataFrame([("q", "t", ["x.art1.p1"])], "id string, topic string, expected array<string>")
    hits = spark.createDataFrame([("lex", "q", "x.art1", 1)], "variant string, id string, unit_id string, rank int")
    assert "BroadcastHashJoin" not in plan(evaluate.search_accuracy(hits, golden))


class Walked(dict):
    walks = 0

    def __iter__(self):
        self.walks += 1
        return super().__iter__()


def test_an_instruction_does_not_walk_the_act():
    act = patch.Act("a", Walked({f"a.ch1.art{k}{tail}": "one of" for k in range(200) for tail in ("", ".p1", ".p1.sp1")}))
    told = {"point": "1", "subpoint": None, "paragraph": None, "old": None, "new": None, "new_kind": None, "new_number": None}
    before = act.texts.walks
    for k in range(200):
        act.apply({**told, "article": str(k), "operation": "repeal"})
    assert act.texts.walks - before < 5
    assert len(act.repealed) == 400 and act.texts["a.ch1.art7.p1"] == ""


def test_inserted_articles_are_changed_by_later_instructions(spark):
    units = spark.createDataFrame([("a", f"a.ch1.art{k}{p}", kind, f"text {k}", None) for k in range(40) for p, kind in (("", "article"), (".p1", "point"))], "act string, unit_id string, kind string, text string, duplicate_of string")
    items = ['статью 5 дополнить статьей 77 следующего содержания:\n"Text one."', 'в статье 77 слова "one" заменить словами "two"', *(f'в пункте 1 статьи {k} слова "text" заменить словами "words"' for k in range(40))]
    law = "Внести следующие изменения:\n\n" + "\n\n".join(f"{n}) {x};" for n, x in enumerate(items, 1))
    out = {r["nth"]: r for r in patch.apply_laws(units, spark.createDataFrame([("a", "1", law)], "act string, law string, text string")).collect()}
    assert len(out) == 42 and {r["status"] for r in out.values()} == {"ok"}
    assert (out[1]["unit_id"], out[1]["new_text"]) == ("a.ch1.art77", "Text two.") and out[41]["new_text"] == "words 39"


def test_an_acts_articles_meet_in_several_groups(spark):
    units = spark.createDataFrame([("a", f"a.art{k}", "article", "x", None) for k in range(50)], "act string, unit_id string, kind string, text string, duplicate_of string")
    assert "__part" in plan(patch.apply_laws(units, spark.createDataFrame([("a", "1", "")], "act string, law string, text string")))


class Units(list):
    walks = 0

    def __iter__(self):
        self.walks += 1
        return super().__iter__()


def test_lost_points_are_found_in_one_walk():
    scan = statute.Scan("a")
    scan.run([x for k in range(1, 101) for x in (f"Статья {k}. T", "Ввод:", "1) один;", "2) два.", "2. Второй.")])
    scan.units = Units(scan.units)
    held = scan.units
    scan.lost_first_points()
    assert held.walks < 5
    assert [u["number"] for u in scan.units if u["inferred"]] == ["1"] * 100
    assert [(u["kind"], u["number"]) for u in scan.units[1:6]] == [("article", "1"), ("point", "1"), ("subpoint", "1"), ("subpoint", "2"), ("point", "2")]


def test_last_bits_of_scores_settle_no_ties(spark, monkeypatch):
    rows = spark.createDataFrame([(2, 1.0000000000000002, 1), (1, 1.0, 1), (3, 0.3, 2)], "key int, score double, matched int")
    monkeypatch.setattr(search, "bm25", lambda *a: rows)
    found = search.two_pass(rows.select("key", F.lit("").alias("text")), "a b", 3, "key")
    assert [r["key"] for r in found.orderBy("rank").collect()] == [3, 1, 2]
    monkeypatch.setattr(index.InvertedIndex, "bm25", lambda *a: rows)
    monkeypatch.setattr(index.InvertedIndex, "analysed", lambda *a: ["a", "b"])
    assert [r["key"] for r in index.InvertedIndex(None).two_pass("a b", 3).orderBy("rank").collect()] == [3, 1, 2]


def test_costly_row_work_is_dealt_to_all_tasks(spark):
    from lexgrove.operators import citations, facts

    rows = spark.createDataFrame([(k, f"ИНН 77{k:08d} в пункте 1 статьи {k}") for k in range(400)], "id int, text string").coalesce(1)
    assert "Exchange hashpartitioning(id" in plan(facts.redact(rows, "id"))
    assert "Exchange hashpartitioning(id" in plan(citations.extract_internal(rows, "id"))
    back = facts.restore(facts.redact(rows, "id")).orderBy("id").collect()
    assert [r["text"] for r in back] == [r["text"] for r in rows.orderBy("id").collect()]


def test_recall_holds_a_few_scores_at_a_time():
    import tracemalloc

    import numpy as np

    from lexgrove.operators.vector_index import nearest

    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((1_024, 8)), rng.standard_normal((16_384, 8))
    tracemalloc.start()
    row, top, score = nearest(q, x, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = q @ x.T
    want = np.argsort(-s, axis=1, kind="stable")[:, :10]
    assert (top.reshape(1_024, 10) == want).all() and np.allclose(score.reshape(1_024, 10), np.take_along_axis(s, want, 1)) and (row == np.repeat(np.arange(1_024), 10)).all()
    assert peak < 8 * 1_024 * 16_384  # all scores once


def test_postings_are_blocks_and_lost_documents_leave_them(spark, tmp_path):
    from lexgrove.sources.store import Store

    text = F.concat(F.lit("tax rate "), F.repeat(F.lit("tax "), (F.col("id") % 3).cast("int")), F.when(F.col("id") % 5 == 0, "due").otherwise(F.col("id").cast("string")))
    docs = spark.range(200).select("id", F.when(F.col("id") != 7, text).alias("text"))
    found = index.InvertedIndex(Store(spark, str(tmp_path / "i")), buckets=4)
    found.add(docs, "id")
    assert found.store.read("postings").where("term = 'tax'").count() == 1
    found.add(docs.where("id % 10 = 3").withColumn("text", F.lit("due tax due")), "id")
    found.remove(docs.where("id % 10 = 4"), "id")
    now = docs.where("id % 10 <> 4").withColumn("text", F.when(F.col("id") % 10 == 3, "due tax due").otherwise(F.col("text")))
    rows = lambda d, key: sorted((r[key], round(r["score"], 9), r["matched"]) for r in d.collect())
    want = rows(search.bm25(now.na.fill("", ["text"]), ["tax", "due", "11"], "id"), "id")
    assert rows(found.bm25(["tax", "due", "11"]), "key") == want
    found.compact()
    assert rows(found.bm25(["tax", "due", "11"]), "key") == want
    assert {r["key"]: r["places"] for r in found.postings(["due"]).collect()}[3] == [0, 2]
    assert found.store.read("postings").where(F.exists("keys", lambda k: k % 10 == 4)).count() == 0


def test_references_meet_units_without_broadcasts(spark):
    from lexgrove.operators import resolve

    units = spark.createDataFrame([], statute.UNIT_SCHEMA)
    refs = spark.createDataFrame([], "kind string, from_unit_id string, section string, chapter string, article string, point string, subpoint string, paragraph_ordinal int, relative_to string")
    assert "BroadcastHashJoin" not in plan(resolve.resolve(refs, units))
