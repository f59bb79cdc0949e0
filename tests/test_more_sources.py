from lexgrove.operators import evaluate, interpret
from lexgrove.sources import readers, writers


def test_markdown_round_trips_through_word(spark):
    text = "# Title\n\nPlain **bold** text\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> quoted"
    content = writers.as_docx(spark.createDataFrame([("x.docx", text)], "path string, text string")).first()["content"]
    back = readers.docx_text(bytes(content))
    assert back.split("\n\n") == ["Title", "Plain bold text", "one", "two", "a", "b", "1", "2", "quoted"]
    assert "page" not in back and b"PK" == bytes(content)[:2]


def test_letter_and_ministry_pages(spark):
    listing = '<ul><li><a href="/l/1">Письмо от 11.03.2024 № 03-01/1@</a></li><li><a href="/x">прочее</a></li></ul>'
    got = readers.letter_listing(spark.createDataFrame([(1, listing)], "id int, html string"), "id").collect()
    assert [(r["link"], r["number"], str(r["date"])) for r in got] == [("/l/1", "03-01/1@", "2024-03-11")]
    page = '<nav>menu</nav><span class="crumb"><a href="/">Дом</a></span><span class="crumb">НДС</span><p>Вопрос о ставке</p><p>Ответ</p><p>Ставка 20</p><a href="/tag/1">ставка</a>'
    r = readers.letter_page(spark.createDataFrame([(1, page)], "id int, html string"), "id").first()
    assert r["category"] == "НДС" and r["tags"] == ["ставка"] and "menu" not in r["text"] and r["question"].endswith("Вопрос о ставке")
    body = "т" * 300
    pages = [(1, f"<h1>Письмо от 5 мая 2023 г. № 12-3</h1><article><p>{body}</p></article>"), (2, f"<h1>№ 7 от 01.02.2020</h1><article><p>{body}</p></article>"), (3, "<h1>№ 8 от 01.02.2020</h1><article>мало</article>")]
    rows = readers.ministry_page(spark.createDataFrame(pages, "id int, html string"), "id").collect()
    assert [(r["id"], r["number"], str(r["date"])) for r in rows] == [(1, "12-3", "2023-05-05"), (2, "7", "2020-02-01")]


def test_court_acts(spark):
    blocks = [(1, i, t, False) for i, t in enumerate(["Шапка", "Пленум постановляет:", "раз", "два", "три", "четыре", "Председатель И. Иванов", "хвост"])] + [(2, 0, "постановляет:", False), (2, 1, "одно", False)]
    rows = readers.court_act(spark.createDataFrame(blocks, "id int, n int, block string, centred boolean"), "id").collect()
    assert [(r["id"], r["text"].split("\n\n")) for r in rows] == [(1, ["раз", "два", "три", "четыре"])]


def test_positions_are_gated_and_remembered(spark):
    docs = spark.createDataFrame([("L1", "Налог платится всегда."), ("L2", "Иное.")], "doc_id string, text string")
    edges = spark.createDataFrame([("L1", "u1"), ("L2", "u1"), ("L1", "u2")], "doc_id string, unit_id string")
    done = spark.createDataFrame([("L1", "u2")], "doc_id string, unit_id string")
    answer = lambda text, unit: {"stance": "for_authority", "summary": "s", "quote": "налог  платится", "confidence": 0.9}
    got = {(r["doc_id"], r["unit_id"]): (r["stance"], r["accepted"]) for r in interpret.extract_positions(edges, docs, done, answer).collect()}
    assert got == {("L1", "u1"): ("for_authority", True), ("L2", "u1"): ("none", False)}
    assert interpret.extract_positions(edges, docs, done, answer, budget=1).count() == 1


def test_golden_run(spark):
    rows = [("search", ["a"], ["b", "a"]), ("search", ["a"], ["b"]), ("as_of_absent", [], []), ("resolve", ["x"], ["x"])]
    got = {r["kind"]: (r["ok"], r["n"]) for r in evaluate.golden_run(spark.createDataFrame(rows, "kind string, expected array<string>, got array<string>")).collect()}
    assert got == {"search": (1, 2), "as_of_absent": (1, 1), "resolve": (1, 1)}


def test_every_document_file_but_positions_is_read(spark, tmp_path):
    import json

    for name in ("letters", "plenums", "positions_x"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"doc_id": name, "kind": "plenum", "text": "t"}) + "\n")
    assert sorted(r["doc_id"] for r in readers.documents(spark, str(tmp_path)).collect()) == ["letters", "plenums"]


def test_subsection_in_capitals_starts_a_block(spark):
    rows = [("a", 0, "ГЛАВА 1", True), ("a", 1, "ОБЩЕЕ", True), ("a", 2, "ПОДРАЗДЕЛ 2. ИНОЕ", True)]
    got = readers.statute_blocks(spark.createDataFrame(rows, "k string, n int, block string, centred boolean"), "k").orderBy("n").collect()
    assert [r["block"] for r in got] == ["ГЛАВА 1 ОБЩЕЕ", "ПОДРАЗДЕЛ 2. ИНОЕ"]
