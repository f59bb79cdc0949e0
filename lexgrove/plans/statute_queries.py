"""Registered queries of the statute grammar, the resolver, patches, redaction and streams.

Acts are made of the tables' keys: a nation is an act, its suppliers are articles in three chapters. Every seventh
article is repealed, every fifth has a successor whose number lost its dot, every fourth a dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.operators import amendments, evaluate, facts, patch, resolve, statute
from lexgrove.plans.queries import query, table
from lexgrove.sources import shared
from lexgrove.streaming import monitor as streams


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """act, c (chapter), k (article) of every supplier."""
    s = table(spark, sf, "supplier")
    order = W.partitionBy("s_nationkey").orderBy(F.col("s_suppkey") % 3, "s_suppkey")
    return s.select(F.concat(F.lit("act"), "s_nationkey").alias("act"), (F.col("s_suppkey") % 3 + 1).alias("c"), F.row_number().over(order).alias("k"))


def acts(spark: SparkSession, sf: str) -> DataFrame:
    """act, text: the acts as they are published."""
    a = articles(spark, sf)
    first = F.row_number().over(W.partitionBy("act", "c").orderBy("k")) == 1
    k = F.col("k").cast("string")
    chapter = F.when(first, F.concat(F.lit("ГЛАВА "), F.col("c").cast("string"), F.lit(".\n\nChapter "), F.col("c").cast("string"), F.lit("\n\n"))).otherwise("")
    dictionary = F.when(F.col("k") % 4 == 1, F.concat(F.lit("\n\n3. Для целей настоящего пункта понятия:\n\n1) term "), k, F.lit(" — meaning of "), k, F.lit(";"))).otherwise("")
    body = F.concat(F.lit(". Title "), k, F.lit("\n\n1. Point one of "), k, F.lit(".\n\n1) first sub "), k, F.lit(";\n2) second sub "), k, F.lit(".\n----\n12\n\n2.  Point two of "), k, F.lit(",\nsecond line.\n\n(в ред. Федерального закона от 01.02.2020 № "), k, F.lit("-ФЗ)"), dictionary)
    flat = F.when(F.col("k") % 5 == 0, F.concat(F.lit("\n\nСтатья "), k, F.lit("1. Flattened "), k, F.lit("\n\nOnly paragraph "), k, F.lit("."))).otherwise("")
    block = F.concat(chapter, F.lit("Статья "), k, F.when(F.col("k") % 7 == 0, ". Утратила силу.").otherwise(F.concat(body, flat)))
    listed = a.withColumn("block", block).groupBy("act").agg(F.sort_array(F.collect_list(F.struct("k", "block"))).alias("l"))  # an act's articles
    return listed.select("act", F.array_join(F.transform("l", lambda x: x["block"]), "\n\n").alias("text"))


UNITS = """a AS (SELECT 'act' || s_nationkey AS act, s_suppkey % 3 + 1 AS c, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_suppkey) AS k FROM supplier),
w AS (SELECT *, act || '.ch' || c AS ch, act || '.ch' || c || '.art' || k AS art, 'НК РФ, часть 1, глава ' || c || ' «Chapter ' || c || '»' AS ctx, ' статьи ' || k || ' НК РФ' AS of_art, ', статья ' || k || ' «Title ' || k || '»' AS head FROM a),
f AS (SELECT * FROM w WHERE k % 7 <> 0), t AS (SELECT * FROM f WHERE k % 4 = 1), z AS (SELECT * FROM f WHERE k % 5 = 0), r AS (SELECT * FROM w WHERE k % 7 = 0),
u AS (
SELECT DISTINCT act, act AS unit_id, 'part' AS kind, NULL::VARCHAR AS parent_unit_id, '1' AS number, NULL::VARCHAR AS title, 'НК РФ, часть 1' AS label, 'НК РФ, часть 1' AS context, '' AS text, false AS is_chunk, NULL::VARCHAR AS edit_note FROM w
UNION ALL SELECT DISTINCT act, ch, 'chapter', act, c::VARCHAR, 'Chapter ' || c, 'глава ' || c || ' НК РФ', ctx, '', false, NULL FROM w
UNION ALL SELECT act, art, 'article', ch, k::VARCHAR, 'Title ' || k, 'статья ' || k || ' НК РФ', ctx || head, '', false, NULL FROM f
UNION ALL SELECT act, art || '.p1', 'point', art, '1', NULL, 'пункт 1' || of_art, ctx || head, 'Point one of ' || k || '.', true, NULL FROM f
UNION ALL SELECT act, art || '.p1.ab1', 'paragraph', art || '.p1', '1', NULL, 'абзац первый пункта 1' || of_art, ctx || head, 'Point one of ' || k || '.', false, NULL FROM f
UNION ALL SELECT act, art || '.p1.sp1', 'subpoint', art || '.p1', '1', NULL, 'подпункт 1 пункта 1' || of_art, ctx || head, 'first sub ' || k || ';', true, NULL FROM f
UNION ALL SELECT act, art || '.p1.sp1.ab1', 'paragraph', art || '.p1.sp1', '1', NULL, 'абзац первый подпункта 1 пункта 1' || of_art, ctx || head, 'first sub ' || k || ';', false, NULL FROM f
UNION ALL SELECT act, art || '.p1.sp2', 'subpoint', art || '.p1', '2', NULL, 'подпункт 2 пункта 1' || of_art, ctx || head, 'second sub ' || k || '.', true, NULL FROM f
UNION ALL SELECT act, art || '.p1.sp2.ab1', 'paragraph', art || '.p1.sp2', '1', NULL, 'абзац первый подпункта 2 пункта 1' || of_art, ctx || head, 'second sub ' || k || '.', false, NULL FROM f
UNION ALL SELECT act, art || '.p2', 'point', art, '2', NULL, 'пункт 2' || of_art, ctx || head, 'Point two of ' || k || ', second line.', true, '(в ред. Федерального закона от 01.02.2020 № ' || k || '-ФЗ)' FROM f
UNION ALL SELECT act, art || '.p2.ab1', 'paragraph', art || '.p2', '1', NULL, 'абзац первый пункта 2' || of_art, ctx || head, 'Point two of ' || k || ', second line.', false, NULL FROM f
UNION ALL SELECT act, art || '.p3', 'point', art, '3', NULL, 'пункт 3' || of_art, ctx || head, 'Для целей настоящего пункта понятия:', true, NULL FROM t
UNION ALL SELECT act, art || '.p3.ab1', 'paragraph', art || '.p3', '1', NULL, 'абзац первый пункта 3' || of_art, ctx || head, 'Для целей настоящего пункта понятия:', false, NULL FROM t
UNION ALL SELECT act, art || '.p3.sp1', 'subpoint', art || '.p3', '1', NULL, 'подпункт 1 пункта 3' || of_art, ctx || head, 'term ' || k || ' — meaning of ' || k || ';', true, NULL FROM t
UNION ALL SELECT act, art || '.p3.sp1.ab1', 'paragraph', art || '.p3.sp1', '1', NULL, 'абзац первый подпункта 1 пункта 3' || of_art, ctx || head, 'term ' || k || ' — meaning of ' || k || ';', false, NULL FROM t
UNION ALL SELECT act, art || '-1', 'article', ch, k || '.1', 'Flattened ' || k, 'статья ' || k || '.1 НК РФ', ctx || ', статья ' || k || '.1 «Flattened ' || k || '»', 'Only paragraph ' || k || '.', true, NULL FROM z
UNION ALL SELECT act, art || '-1.ab1', 'paragraph', art || '-1', '1', NULL, 'абзац первый статьи ' || k || '.1 НК РФ', ctx || ', статья ' || k || '.1 «Flattened ' || k || '»', 'Only paragraph ' || k || '.', false, NULL FROM z
UNION ALL SELECT act, art, 'article', ch, k::VARCHAR, NULL, 'статья ' || k || ' НК РФ', ctx || ', статья ' || k, 'Утратила силу.', true, NULL FROM r
UNION ALL SELECT act, art || '.ab1', 'paragraph', art, '1', NULL, 'абзац первый' || of_art, ctx || ', статья ' || k, 'Утратила силу.', false, NULL FROM r)"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    return statute.parse(acts(spark, sf))


@query(f"WITH {UNITS} SELECT act, unit_id, kind, parent_unit_id, number, title, text, is_chunk, edit_note, 'sha256:' || sha256(text) AS text_hash FROM u")
def parse_units(spark, sf):
    return units(spark, sf).select("act", "unit_id", "kind", "parent_unit_id", "number", "title", "text", "is_chunk", "edit_note", "text_hash")


@query(f"WITH {UNITS} SELECT unit_id, label, context FROM u")
def parse_labels(spark, sf):
    return units(spark, sf).select("unit_id", "label", "context")


@query(f"WITH {UNITS} SELECT act, kind, count(*) AS n, count(edit_note) AS noted, 0::BIGINT AS duplicates, 0::BIGINT AS inferred FROM u GROUP BY ALL")
def parse_stats(spark, sf):
    return statute.parse_stats(units(spark, sf))


@query(f"WITH {UNITS} SELECT act, 2 * count(*) AS removed FROM f GROUP BY act UNION ALL SELECT act, 0 FROM (SELECT act FROM w EXCEPT SELECT act FROM f)")
def noise_lines(spark, sf):
    return statute.noise_lines(acts(spark, sf))


@query(f"WITH {UNITS} SELECT 'term ' || k AS term, 'meaning of ' || k || ';' AS definition, art || '.p3.sp1' AS definition_unit_id, 'point' AS scope, art || '.p3' AS scope_unit_id FROM t")
def dictionary_terms(spark, sf):
    return amendments.terms(shared.written(units(spark, sf))).drop("term_norm")


#: What is cited of an article, and what must be found: (point, subpoint, paragraph, relative, from, status, depth, note, to).
CITED = (
    ("1", "2", None, None, "", "resolved", "subpoint", None, ".p1.sp2"),
    ("9", None, None, None, "", "partial", "article", "point not found", ""),
    ("1", "9", None, None, "", "partial", "point", "subpoint not found", ".p1"),
    ("2", None, 1, None, "", "resolved", "paragraph", None, ".p2.ab1"),
    ("1", None, 3, None, "", "resolved", "paragraph", None, ".p1.sp2"),
    ("2", None, 7, None, "", "partial", "point", "paragraph not found", ".p2"),
    (None, "1", None, None, "", "partial", "article", "subpoint without point", ""),
    (None, None, None, None, "", "resolved", "article", None, ""),
    ("1", None, None, "article", ".p2", "resolved", "point", None, ".p1"),
    (None, "2", None, "point", ".p1.sp1", "resolved", "subpoint", None, ".p1.sp2"),
    (None, None, 1, "subpoint", ".p1.sp1", "resolved", "paragraph", None, ".p1.sp1.ab1"),
)


def _text(v) -> str:
    return "NULL" if v is None else f"'{v}'"


CITED_SQL = "v(i, tail, status, depth, note) AS (VALUES " + ", ".join(f"({i}, '{c[8]}', '{c[5]}', '{c[6]}', {_text(c[7])})" for i, c in enumerate(CITED)) + ")"


def citations_of(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry of CITED for every article in force, one external act and one article that does not exist."""
    rows = articles(spark, sf).where("k % 7 <> 0")
    art = F.concat("act", F.lit(".ch"), "c", F.lit(".art"), "k")
    text = lambda x: F.lit(x).cast("string")
    made = [F.struct(F.lit(i).alias("i"), F.lit("internal_citation").alias("kind"), F.concat(art, F.lit(where)).alias("from_unit_id"), text(None).alias("section"), text(None).alias("chapter"), (text(None) if relative else F.col("k").cast("string")).alias("article"), text(p).alias("point"), text(s).alias("subpoint"), F.lit(n).cast("int").alias("paragraph_ordinal"), text(relative).alias("relative_to")) for i, (p, s, n, relative, where, *_) in enumerate(CITED)]
    none = F.lit(None).cast("int")
    made.append(F.struct(F.lit(100).alias("i"), F.lit("external_act_unit").alias("kind"), art.alias("from_unit_id"), *[text(None).alias(x) for x in ("section", "chapter", "article", "point", "subpoint")], none.alias("paragraph_ordinal"), text(None).alias("relative_to")))
    made.append(F.struct(F.lit(101).alias("i"), F.lit("internal_citation").alias("kind"), art.alias("from_unit_id"), text(None).alias("section"), text(None).alias("chapter"), F.lit("999999").alias("article"), *[text(None).alias(x) for x in ("point", "subpoint")], none.alias("paragraph_ordinal"), text(None).alias("relative_to")))
    made.append(F.struct(F.lit(102).alias("i"), F.lit("internal_citation").alias("kind"), art.alias("from_unit_id"), text(None).alias("section"), F.col("c").cast("string").alias("chapter"), *[text(None).alias(x) for x in ("article", "point", "subpoint")], none.alias("paragraph_ordinal"), text(None).alias("relative_to")))
    return rows.select("act", "k", F.explode(F.array(*made)).alias("x")).select("act", "k", "x.*")


RESOLVED = f"""{UNITS}, {CITED_SQL}, found AS (SELECT act, k, i, status, depth, note, art || tail AS to_unit_id FROM f CROSS JOIN v
UNION ALL SELECT act, k, 100, 'external', NULL, NULL, NULL FROM f UNION ALL SELECT act, k, 101, 'unresolved', NULL, 'article not found', NULL FROM f UNION ALL SELECT act, k, 102, 'resolved', 'chapter', NULL, ch FROM f)"""


@query(f"WITH {RESOLVED} SELECT * FROM found")
def resolve_full(spark, sf):
    out = resolve.resolve(citations_of(spark, sf), shared.written(units(spark, sf)))
    return out.select("act", "k", "i", "status", "depth", "note", "to_unit_id")


@query(f"""WITH {RESOLVED} SELECT act, k, i, CASE status WHEN 'external' THEN 'EXTERNAL' WHEN 'unresolved' THEN 'MISS' WHEN 'partial' THEN 'PART'
WHEN 'resolved' THEN CASE WHEN to_unit_id LIKE '%.p2.ab1' AND k % 3 = 0 THEN 'STALE' ELSE 'OK' END END AS verdict FROM found""")
def verify_citations(spark, sf):
    parsed = shared.written(units(spark, sf))
    gone = articles(spark, sf).where("k % 3 = 0").select(F.concat("act", F.lit(".ch"), "c", F.lit(".art"), "k", F.lit(".p2.ab1")).alias("unit_id"), F.to_date(F.lit("2021-01-01")).alias("repeal_date"))
    return resolve.verify(citations_of(spark, sf), parsed, resolve.unit_intervals(parsed, gone, "2020-01-01"), "2022-01-01").select("act", "k", "i", "verdict")


@query(f"WITH {RESOLVED} SELECT note AS cause, count(*) AS n FROM found WHERE status = 'partial' GROUP BY note")
def partial_report(spark, sf):
    out = resolve.resolve(citations_of(spark, sf), shared.written(units(spark, sf))).withColumn("raw_citation", F.concat_ws(" ", "article", "point", "subpoint"))
    return resolve.partial_report(out).select("cause", "n")


def laws(spark: SparkSession, sf: str) -> DataFrame:
    """act, law, text: one law for each act, one or two instructions for each article in force."""
    k = F.col("k").cast("string")
    change = (
        F.when(F.col("k") % 3 == 1, F.concat(F.lit("в пункте 1 статьи "), k, F.lit(' слова "one of" заменить словами "number one of";')))
        .when(F.col("k") % 3 == 2, F.concat(F.lit("статью "), k, F.lit(' дополнить пунктом 9 следующего содержания:\n"New point '), k, F.lit('.";')))
        .otherwise(F.concat(F.lit("подпункт 2 пункта 1 статьи "), k, F.lit(" признать утратившим силу;")))
    )
    missing = F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit("в пункте 8 статьи "), k, F.lit(' слова "нет" исключить;')))).otherwise(F.array().cast("array<string>"))
    items = articles(spark, sf).where("k % 7 <> 0").select("act", "k", F.posexplode(F.concat(F.array(change), missing)).alias("j", "item"))
    listed = items.groupBy("act").agg(F.sort_array(F.collect_list(F.struct("k", "j", "item"))).alias("l"))  # an act's articles
    body = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x["item"])), "\n\n")
    return listed.select("act", F.lit("1-ФЗ").alias("law"), F.concat(F.lit("Внести в часть первую Кодекса следующие изменения:\n\n"), body, F.lit("\n\nСтатья 2\nНастоящий Федеральный закон вступает в силу с 1 января 2027 года.")).alias("text"))


@query(f"""WITH {UNITS} SELECT act, k, 'replace_words' AS operation, 'ok' AS status, art || '.p1' AS unit_id, 'Point number one of ' || k || '.' AS new_text, NULL AS reason FROM f WHERE k % 3 = 1
UNION ALL SELECT act, k, 'insert_unit', 'ok', art || '.p9', 'New point ' || k || '.', NULL FROM f WHERE k % 3 = 2 UNION ALL SELECT act, k, 'repeal', 'ok', art || '.p1.sp2', '', NULL FROM f WHERE k % 3 = 0
UNION ALL SELECT act, k, 'delete_words', 'failed', NULL, NULL, 'unit ' || art || '.p8 not found' FROM f WHERE k % 4 = 0""")
def apply_patches(spark, sf):
    out = patch.apply_laws(shared.written(units(spark, sf)), laws(spark, sf))
    number = F.regexp_extract(F.coalesce("unit_id", "reason"), r"\.art(\d+)", 1).cast("int")
    return out.select("act", number.alias("k"), "operation", "status", "unit_id", "new_text", "reason")


@query(f"""WITH {UNITS} SELECT unit_id, CASE WHEN kind = 'point' AND number = '1' AND TRY_CAST(regexp_extract(unit_id, 'art(\\d+)', 1) AS INT) % 3 = 1 THEN replace(text, 'one of', 'number one of') WHEN unit_id LIKE '%.p1.sp2' AND TRY_CAST(regexp_extract(unit_id, 'art(\\d+)', 1) AS INT) % 3 = 0 THEN '' ELSE text END AS text,
unit_id LIKE '%.p1.sp2' AND TRY_CAST(regexp_extract(unit_id, 'art(\\d+)', 1) AS INT) % 3 = 0 AS repealed FROM u WHERE kind <> 'paragraph' UNION ALL SELECT art || '.p9', 'New point ' || k || '.', false FROM f WHERE k % 3 = 2""")
def patched_texts(spark, sf):
    parsed = shared.written(units(spark, sf))
    return patch.patched(parsed, patch.apply_laws(parsed, laws(spark, sf)))


@query(f"WITH {UNITS} SELECT art || '.p1' AS unit_id, 'text_differs' AS kind FROM f WHERE k % 3 = 1 UNION ALL SELECT art || '.p9', 'missing' FROM f WHERE k % 3 = 2 UNION ALL SELECT art || '.p1.sp2', 'expected_repealed' FROM f WHERE k % 3 = 0")
def patch_round_trip(spark, sf):
    """A text table that the law has not reached differs in exactly what the law changes."""
    parsed = shared.written(units(spark, sf))
    current = parsed.where("kind <> 'paragraph'").select("unit_id", "text")
    return patch.round_trip(patch.patched(parsed, patch.apply_laws(parsed, laws(spark, sf))), current)


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN make_date(2000 + (o_custkey % 30)::INT, 1, 1) WHEN 1 THEN (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE WHEN 2 THEN o_orderdate::DATE + 20 WHEN 3 THEN o_orderdate::DATE END AS day,
(['by the text', 'a month after publication', 'days after publication', 'on publication', 'no wording'])[(o_orderkey % 5 + 1)::INT] AS reason FROM orders""")
def law_effective(spark, sf):
    tail = " со дня его официального опубликования."
    kinds = F.array(F.concat(F.lit("вступает в силу с 1 января "), 2000 + F.col("o_custkey") % 30, F.lit(" года.")), F.lit("вступает в силу по истечении одного месяца" + tail), F.lit("вступает в силу по истечении 20 дней" + tail), F.lit("вступает в силу" + tail), F.lit("иное"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Настоящий Федеральный закон "), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("text"), F.to_date("o_orderdate").alias("published"))
    return rows.select("o_orderkey", patch.law_effective_date(F.col("text"), F.col("published")).alias("x")).select("o_orderkey", "x.day", "x.reason")


@query("""SELECT c_custkey, 'заявитель [ФИО-1], ИНН [ИНН-1], второй ИНН [ИНН-2], снова [ИНН-1]; ОГРН [ОГРН-1], счёт [СЧЁТ-1], СНИЛС [СНИЛС-1], КПП [КПП-1], паспорт [ПАСПОРТ-1], тел. [ТЕЛ-1], почта [EMAIL-1]; сумма 100 000 руб. от 01.02.2024' AS text, true AS restored, 11::BIGINT AS n FROM customer""")
def redacted_text(spark, sf):
    """All nine kinds of personal data, equal values under equal tokens, and back."""
    c = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    name = F.element_at(F.array(*map(F.lit, ("Петров А.Б.", "А. Б. Петров-Водкин", "Петров Алексей Борисович", "Петровой Анне Борисовне"))), (c % 4 + 1).cast("int"))
    inn = F.concat(F.lit("77"), pad(c, 8))
    parts = [
        "заявитель ", name, ", ИНН ", inn, ", второй ИНН ", F.concat(F.lit("5000"), pad(c, 8)), ", снова ", inn, "; ОГРН ", F.concat(F.lit("10277"), pad(c, 8)), ", счёт ", F.concat(F.lit("40702810"), pad(c, 12)),
        ", СНИЛС ", F.concat(F.lit("111-222-"), pad(c % 1000, 3), F.when(c % 2 == 0, " ").otherwise("-"), pad(c % 100, 2)), ", КПП ", F.concat(F.lit("770"), pad(c, 6)), ", паспорт ", F.concat(F.when(c % 2 == 0, "45 10 ").otherwise("4510 № "), pad(c, 6)),
        ", тел. ", F.concat(F.when(c % 2 == 0, "+7 (495) ").otherwise("8 495 "), pad(c % 1000, 3), F.lit("-12-34")), ", почта ", F.concat(F.lit("u."), c, F.lit("@mail.example.ru")), "; сумма 100 000 руб. от 01.02.2024",
    ]
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))
    red = facts.redact(rows, "c_custkey")
    both = red.join(rows.withColumnRenamed("text", "__was").hint("merge"), "c_custkey")  # texts are wider than the planner takes them to be
    both = facts.restore(both.withColumn("__back", F.col("text")), "__back")
    return both.select("c_custkey", "text", (F.col("__back") == F.col("__was")).alias("restored"), (F.size("tokens") + 1).cast("long").alias("n"))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_windows(spark, sf):
    """Windows of a real stream: closed by the watermark, with a second copy of a third of the events that comes too late."""
    here = shared.shared_folder(spark)
    e = table(spark, sf, "events")
    e.write.parquet(f"{here}/log")
    for day in ("2031-01-01", "2031-01-02"):  # two later events: the first moves the watermark, the second closes the windows
        e.limit(1).withColumn("ts", F.lit(day).cast(e.schema["ts"].dataType)).write.mode("append").parquet(f"{here}/log")
    e.where("event_id % 3 = 0").write.mode("append").parquet(f"{here}/log")
    stream = streams.events(spark, f"{here}/log", e.schema, 1)
    out = streams.windowed(stream, "ts", ["event_type"], late="60 days")
    out.writeStream.format("parquet").option("path", f"{here}/windows").option("checkpointLocation", f"{here}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{here}/windows").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""WITH q AS (SELECT c_custkey AS id, c_custkey % 5 = 0 AS abstain FROM customer)
SELECT id, 1 AS rep, CASE WHEN NOT abstain THEN 2 / 3 END AS precision_unit, CASE WHEN NOT abstain THEN 1.0 END AS recall_unit, CASE WHEN NOT abstain THEN 0.5 END AS precision_article, CASE WHEN NOT abstain THEN 1.0 END AS recall_article,
4::BIGINT AS citations, 1::BIGINT AS hallucinated, 2 / 3 AS temporal, CASE WHEN abstain THEN (id % 2 = 0)::INT END AS abstained FROM q""")
def score_answers(spark, sf):
    """Two expected units of one article; four citations: a unit above one, one itself, one elsewhere, one unknown."""
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer")
    art = F.concat(F.lit("x.ch1.art"), c)
    none = F.array().cast("array<string>")
    questions = rows.select(c.alias("id"), (c % 3).cast("string").alias("topic"), F.when(c % 5 == 0, none).otherwise(F.array(F.concat(art, F.lit(".p1.sp1")), F.concat(art, F.lit(".p2")))).alias("expected"), (c % 5 == 0).alias("abstain"))
    told = F.array(*[F.struct(u.alias("unit_id"), F.lit(v).alias("verdict")) for u, v in ((F.concat(art, F.lit(".p1")), "OK"), (F.concat(art, F.lit(".p2")), "STALE"), (F.lit("x.ch2.artz.p1"), "OK"), (F.lit(None).cast("string"), "PART"))])
    citations = rows.select(c.alias("id"), F.lit(1).alias("rep"), F.explode(told).alias("x")).select("id", "rep", "x.*")
    answers = rows.select(c.alias("id"), F.lit(1).alias("rep"), F.when(c % 2 == 0, "Ответ не найден.").otherwise("Да.").alias("text"))
    return evaluate.score_answers(questions, citations, answers).drop("topic")


@query("""SELECT c_custkey, '[ИНН-' || (c_custkey % 5 + 1) || '], ИНН [ИНН-' || (c_custkey % 5 + 2) || '] [ИНН-' || (c_custkey % 5 + 3) || '] [ТЕЛ-' || (c_custkey % 5 + 2) || '], [ФИО-1] у [ФИО-' || (c_custkey % 5 + 2) || '] Москва' AS text, true AS restored FROM customer""")
def redacted_tokens(spark, sf):
    """Texts that hold tokens of their own, numbers that only blanks part, and back."""
    c = F.col("c_custkey")
    number = lambda head, n: F.concat(F.lit(head), F.lpad(c.cast("string"), n, "0"))
    text = F.concat(F.lit("[ИНН-"), c % 5 + 1, F.lit("], ИНН "), number("77", 8), F.lit(" "), number("50", 8), F.lit(" "), number("8 (495) ", 7), F.lit(", [ФИО-1] у Петрова А. Б. Москва"))
    rows = table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    red = facts.redact(rows, "c_custkey")
    both = red.join(rows.withColumnRenamed("text", "__was").hint("merge"), "c_custkey")
    both = facts.restore(both.withColumn("__back", F.col("text")), "__back")
    return both.select("c_custkey", "text", (F.col("__back") == F.col("__was")).alias("restored"))
