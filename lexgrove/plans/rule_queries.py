"""Registered queries in which every rule of the grammar, the validator, the patches, the audit and the penalties occurs.

What each unit of the small acts must become stands beside the text that it is made from, with {k} for the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions import sql
from lexgrove.operators import calculators, citations, evaluate, patch, statute, validate
from lexgrove.plans import statute_queries as Q
from lexgrove.plans.queries import orders, query, table
from lexgrove.plans.service_queries import said
from lexgrove.sources import shared


def literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """name(columns) AS (VALUES ..): a constant table for SQL."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def filled(column: str, key: str) -> str:
    return f"replace({column}, '{{k}}', {key}::VARCHAR)"


# the grammar: sections, a lost point 1, notes on paragraphs, flattened points, repeated numbers

ACT = """РАЗДЕЛ VIII.1. Special {k}

ПОДРАЗДЕЛ 1. Group {k}

ГЛАВА 26.2. Simplified

Статья 5. General

Opening {k}.

1) alpha {k};

2) beta {k}.

2. Second {k}.

21. Two one {k}.

3. Third {k}.

Next {k}.

<Абзац первый в ред. закона {k}>

<Введен законом {k}>

Статья 6. Other

1. One {k}.

1. Again {k}."""
#: (identifier after the act, kind, parent after the act, number, title, text, note, repeats, inferred)
ACT_UNITS = (
    ("", "part", None, "1", None, "", None, None, False),
    (".rviii-1", "section", "", "VIII.1", "Special {k}", "", None, None, False),
    (".rviii-1@2", "subsection", ".rviii-1", "1", "Group {k}", "", None, ".rviii-1", False),
    (".ch26-2", "chapter", ".rviii-1@2", "26.2", "Simplified", "", None, None, False),
    (".ch26-2.art5", "article", ".ch26-2", "5", "General", "", None, None, False),
    (".ch26-2.art5.p1", "point", ".ch26-2.art5", "1", None, "Opening {k}.", None, None, True),
    (".ch26-2.art5.p1.ab1", "paragraph", ".ch26-2.art5.p1", "1", None, "Opening {k}.", None, None, False),
    (".ch26-2.art5.p1.sp1", "subpoint", ".ch26-2.art5.p1", "1", None, "alpha {k};", None, None, False),
    (".ch26-2.art5.p1.sp1.ab1", "paragraph", ".ch26-2.art5.p1.sp1", "1", None, "alpha {k};", None, None, False),
    (".ch26-2.art5.p1.sp2", "subpoint", ".ch26-2.art5.p1", "2", None, "beta {k}.", None, None, False),
    (".ch26-2.art5.p1.sp2.ab1", "paragraph", ".ch26-2.art5.p1.sp2", "1", None, "beta {k}.", None, None, False),
    (".ch26-2.art5.p2", "point", ".ch26-2.art5", "2", None, "Second {k}.", None, None, False),
    (".ch26-2.art5.p2.ab1", "paragraph", ".ch26-2.art5.p2", "1", None, "Second {k}.", None, None, False),
    (".ch26-2.art5.p2-1", "point", ".ch26-2.art5", "2.1", None, "Two one {k}.", None, None, False),
    (".ch26-2.art5.p2-1.ab1", "paragraph", ".ch26-2.art5.p2-1", "1", None, "Two one {k}.", None, None, False),
    (".ch26-2.art5.p3", "point", ".ch26-2.art5", "3", None, "Third {k}.\n\nNext {k}.", "<Введен законом {k}>", None, False),
    (".ch26-2.art5.p3.ab1", "paragraph", ".ch26-2.art5.p3", "1", None, "Third {k}.", "<Абзац первый в ред. закона {k}>", None, False),
    (".ch26-2.art5.p3.ab2", "paragraph", ".ch26-2.art5.p3", "2", None, "Next {k}.", None, None, False),
    (".ch26-2.art6", "article", ".ch26-2", "6", "Other", "", None, None, False),
    (".ch26-2.art6.p1", "point", ".ch26-2.art6", "1", None, "One {k}.", None, None, False),
    (".ch26-2.art6.p1.ab1", "paragraph", ".ch26-2.art6.p1", "1", None, "One {k}.", None, None, False),
    (".ch26-2.art6.p1@2", "point", ".ch26-2.art6", "1", None, "Again {k}.", None, ".ch26-2.art6.p1", False),
    (".ch26-2.art6.p1.ab1@2", "paragraph", ".ch26-2.art6.p1@2", "1", None, "Again {k}.", None, ".ch26-2.art6.p1.ab1", False),
)
_GRAMMAR = values("v", "id, kind, parent, number, title, text, note, again, inferred", ACT_UNITS)


def small_acts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(said("s", "$s_suppkey").alias("act"), F.replace(F.lit(ACT), F.lit("{k}"), F.col("s_suppkey").cast("string")).alias("text"))


@query(f"""WITH {_GRAMMAR} SELECT 's' || s_suppkey || id AS unit_id, kind, 's' || s_suppkey || parent AS parent_unit_id, number, {filled('title', 's_suppkey')} AS title, {filled('text', 's_suppkey')} AS text,
{filled('note', 's_suppkey')} AS edit_note, 's' || s_suppkey || again AS duplicate_of, inferred FROM supplier, v""")
def parse_headings(spark, sf):
    """Sections and subsections, a lost point 1, a note that names a paragraph, flattened points, repeated numbers."""
    return statute.parse(small_acts(spark, sf)).select("unit_id", "kind", "parent_unit_id", "number", "title", "text", "edit_note", "duplicate_of", "inferred")


@query(f"WITH {_GRAMMAR} SELECT 's' || s_suppkey AS act, kind, count(*) AS n, count(note) AS noted, count(again) AS duplicates, count(*) FILTER (inferred) AS inferred FROM supplier, v GROUP BY ALL")
def parse_heading_stats(spark, sf):
    return statute.parse_stats(statute.parse(small_acts(spark, sf)))


# the validator: (kind, identifier, parent, number, text, note)

FAULTY = (
    ("part", "", None, "1", "", None), ("chapter", ".ch1", "", "1", "", None), ("article", ".ch1.art1", ".ch1", "1", "x", None), ("article", ".ch1.art4", ".ch1", "4", "Утратила силу.", None),
    ("article", ".ch1.art3", ".ch1", "3", "y", None), ("point", ".ch1.art3.p2", ".ch1.art3", "2", "t", None), ("point", ".ch1.art3.p1", ".ch1.art3", "1", "", None), ("subpoint", ".ch1.art3.p2.sp5", ".ch1.art3.p2", "5", "t", None),
    ("subpoint", ".ch1.art3.p2.sp2", ".ch1.art3.p2", "2", "t", None), ("subpoint", ".ch1.art3.p2.spx", ".ch1.art3.p2", "x", "t", None), ("point", ".ch1.art3.p2", ".ch1.art3", "3", "again", None), ("chapter", ".ch9", None, "9", "", None),
    ("point", ".ch1.art9.p1", ".ch1.art9", "1", "t", None), ("subpoint", ".ch1.art1.sp1", ".ch1.art1", "1", "t", None), ("article", ".ch1.art4-1", ".ch1", "4.1", "t", "утратила силу"),
)
ISSUES = (
    ("article_gap", "info", ".ch1.art4", "4"), ("article_order", "error", ".ch1.art3", "3"), ("bad_parent_kind", "error", ".ch1.art1.sp1", "article"), ("duplicate_unit_id", "error", ".ch1.art3.p2", "2"), ("empty_text", "warning", ".ch1.art3.p1", "point"),
    ("fractional_numbers", "info", ".ch1.art4-1", "4.1"), ("missing_parent", "error", ".ch1.art9.p1", "{k}.ch1.art9"), ("orphan_unit", "error", ".ch9", "chapter"), ("point_order", "error", ".ch1.art3.p1", "1"), ("repealed_units", "info", ".ch1.art4", "article"),
    ("repealed_units", "info", ".ch1.art4-1", "article"), ("subpoint_number", "error", ".ch1.art3.p2.spx", "x"), ("subpoint_order", "error", ".ch1.art3.p2.sp2", "2"),
)
_ISSUES = values("v", "rule, severity, id, detail", ISSUES)


def faulty_units(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda v: F.lit(v).cast("string")
    made = [F.struct(text(kind).alias("kind"), text(own).alias("id"), text(above).alias("parent"), text(number).alias("number"), text(said_).alias("text"), text(note).alias("edit_note"), F.lit(at).alias("ord")) for at, (kind, own, above, number, said_, note) in enumerate(FAULTY)]
    act = F.concat(F.lit("f"), F.col("s_suppkey"))
    rows = table(spark, sf, "supplier").select(act.alias("act"), F.explode(F.array(*made)).alias("u")).select("act", "u.*")
    return rows.select("act", F.concat("act", "id").alias("unit_id"), F.concat("act", "parent").alias("parent_unit_id"), "kind", "number", "text", "edit_note", F.lit(None).cast("string").alias("duplicate_of"), "ord")


@query(f"WITH {_ISSUES} SELECT rule, severity, 'f' || s_suppkey || id AS unit_id, replace(detail, '{{k}}', 'f' || s_suppkey) AS detail FROM supplier, v")
def validate_rules(spark, sf):
    """Acts in which every rule of the validator finds something."""
    return validate.validate(faulty_units(spark, sf))


@query(f"WITH {_ISSUES}, i AS (SELECT rule, severity, 'f' || s_suppkey || id AS unit_id FROM supplier, v) SELECT rule, severity, count(*) AS n, array_to_string(list_slice(list_sort(list(unit_id)), 1, 10), ' ') AS first FROM i GROUP BY ALL")
def validate_report(spark, sf):
    return validate.report(validate.validate(faulty_units(spark, sf))).withColumn("first", F.array_join("first", " "))


# amending laws: all nine operations, words that occur too often, a paragraph that is not there

CHANGES = (
    ('пункт 2 статьи {k} изложить в следующей редакции:\n"Second anew {k}."', "replace", ".p2", "Second anew {k}."),
    ('пункт 2 статьи {k} дополнить абзацем следующего содержания:\n"More of {k}."', "insert_paragraph", ".p2", "Second anew {k}.\n\nMore of {k}."),
    ("абзац первый пункта 2 статьи {k} исключить", "delete_paragraph", ".p2", "More of {k}."),
    ('в пункте 1 статьи {k} после слов "Point" дополнить словами "number"', "insert_words", ".p1", "Point number one of {k}."),
    ('в подпункте 1 пункта 1 статьи {k} слова "sub" исключить', "delete_words", ".p1.sp1", "first {k};"),
    ('пункт 1 статьи {k} дополнить подпунктом 7 следующего содержания:\n"seventh sub {k}."', "insert_unit", ".p1.sp7", "seventh sub {k}."),
    ('в подпункте 2 пункта 1 статьи {k} слова "second" заменить словами "2nd"', "replace_words", ".p1.sp2", "2nd sub {k}."),
    ("подпункт 1 пункта 1 статьи {k} признать утратившим силу", "repeal", ".p1.sp1", ""),
    ('в пункте 1 статьи {k} слова "o" исключить', "delete_words", None, "words found 3 times, once is needed"),
    ('подпункт 2 пункта 1 статьи {k} дополнить словами "at the end"', "insert_words", ".p1.sp2", "2nd sub {k} at the end."),
    ('в статье {k}:\nа) в пункте 1 слова "one" заменить словами "first";\nб) абзац пятый пункта 2 изложить в следующей редакции:\n"none"', "replace_words", ".p1", "Point number first of {k}."),
    (None, "replace", None, "no paragraph 5"),
)
_CHANGES = values("v", "j, operation, tail, told", [(j, op, tail, told) for j, (_, op, tail, told) in enumerate(CHANGES)])


@query(f"""WITH {Q.UNITS}, {_CHANGES} SELECT act, k, operation, CASE WHEN tail IS NULL THEN 'failed' ELSE 'ok' END AS status, art || tail AS unit_id, CASE WHEN tail IS NOT NULL THEN {filled('told', 'k')} END AS new_text, CASE WHEN tail IS NULL THEN {filled('told', 'k')} END AS reason FROM f, v""")
def patch_operations(spark, sf):
    """Every operation on every article in force, in one law for each act."""
    texts = F.array(*[F.lit(t) for t, *_ in CHANGES if t])
    items = Q.articles(spark, sf).where("k % 7 <> 0").select("act", "k", F.posexplode(texts).alias("j", "item"))
    item = F.replace("item", F.lit("{k}"), F.col("k").cast("string"))
    listed = items.groupBy("act").agg(F.sort_array(F.collect_list(F.struct("k", "j", item.alias("item")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x["item"], F.lit(";"))), "\n\n")
    law = listed.select("act", F.lit("2-ФЗ").alias("law"), F.concat(F.lit("Внести в часть первую Кодекса следующие изменения:\n\n"), body).alias("text"))
    out = patch.apply_laws(shared.written(Q.units(spark, sf)), law)
    k = Q.articles(spark, sf).where("k % 7 <> 0").groupBy("act").agg(F.sort_array(F.collect_list("k")).alias("ks"))  # an act's articles
    return out.join(k, "act").select("act", F.element_at("ks", (F.floor(F.col("nth") / len(CHANGES)) + 1).cast("int")).alias("k"), "operation", "status", "unit_id", "new_text", "reason")


# citations of other acts, decrees, lists, ranges and short forms

CITING = (
    ("в пункте 3 статьи {k} Гражданского кодекса Российской Федерации", (("external_act_unit", None, None, None, None, None),)),
    ("подпунктами 1 - 3 и 7 пункта 2 статьи {k} настоящего Кодекса", tuple(("internal_citation", None, "{k}", "2", s, None) for s in "1237")),
    ("в абзацах первом - третьем пункта 1 статьи {k}", tuple(("internal_citation", None, "{k}", "1", None, n) for n in (1, 2, 3))),
    ("статьями {k}, {k}.13 и 26 главы 3", tuple(("internal_citation", "3", a, None, None, None) for a in ("{k}", "{k}.13", "26"))),
    ("главой 26.2 настоящего Кодекса", (("internal_citation", "26.2", None, None, None, None),)),
)
_CITING = values("v", "kind, chapter, article, point, subpoint, paragraph_ordinal", [r for _, rows in CITING for r in rows])


def citing(spark: SparkSession, sf: str) -> DataFrame:
    """unit_id, text: for every part one text with all the forms, each a clause."""
    return table(spark, sf, "part").select(said("$p_partkey").alias("unit_id"), F.replace(F.lit("; ".join(t for t, _ in CITING)), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("text"))


_CITED_COLUMNS = f"p_partkey::VARCHAR AS unit_id, kind, chapter, {filled('article', 'p_partkey')} AS article, point, subpoint, paragraph_ordinal::INT AS paragraph_ordinal"


@query(f"WITH {_CITING} SELECT {_CITED_COLUMNS} FROM part, v")
def citation_forms(spark, sf):
    """Another act's unit, lists and ranges of subpoints and ordinals, fractional articles, a chapter."""
    return citations.extract_internal(citing(spark, sf)).select(F.col("from_unit_id").alias("unit_id"), "kind", "chapter", "article", "point", "subpoint", "paragraph_ordinal")


@query(f"WITH {_CITING} SELECT {_CITED_COLUMNS} FROM part, v")
def sql_citations(spark, sf):
    """The same rows by SQL alone: a table function over a whole table."""
    sql.register(spark)
    citing(spark, sf).repartition("unit_id").createOrReplaceTempView("citing_units")  # all tasks read texts, not one a file
    return spark.sql("SELECT unit_id, kind, chapter, article, point, subpoint, paragraph_ordinal FROM citations(TABLE(citing_units))")


@query("""WITH v AS (SELECT 'c' || c_nationkey || '.art' || c_custkey || '.p' || (c_custkey % 9) AS unit, c_custkey, DATE '1990-01-01' + (c_custkey % 4000)::INT AS s, CASE WHEN c_custkey % 3 = 0 THEN DATE '1990-01-01' + (c_custkey % 4000 + 700)::INT END AS e FROM customer)
SELECT regexp_replace(unit, '[.]p[0-9]+$', '') AS article, c_custkey, 3 AS depth FROM v WHERE s <= DATE '1995-06-01' AND (e IS NULL OR e > DATE '1995-06-01') AND (unit LIKE 'c7.%' OR unit LIKE 'c1.%')""")
def sql_subtree_on_day(spark, sf):
    """Intervals and paths in SQL: units of two subtrees in force on a day."""
    sql.register(spark)
    table(spark, sf, "customer").createOrReplaceTempView("unit_owners")
    return spark.sql("""
        SELECT article_of(unit) AS article, c_custkey, size(unit_ancestors(unit)) AS depth
        FROM (SELECT concat('c', c_nationkey, '.art', c_custkey, '.p', c_custkey % 9) AS unit, c_custkey, date_add(DATE'1990-01-01', cast(c_custkey % 4000 AS INT)) AS starts,
                     CASE WHEN c_custkey % 3 = 0 THEN date_add(DATE'1990-01-01', cast(c_custkey % 4000 + 700 AS INT)) END AS ends FROM unit_owners)
        WHERE valid_on(starts, ends, DATE'1995-06-01') AND (in_subtree(unit, 'c7') OR in_subtree(unit, 'c1'))""")


@query("""WITH k AS (SELECT o_orderkey AS a FROM orders) SELECT a::VARCHAR AS unit_id, 'external_gov_decree' AS kind, '26.12.2011' AS law_date, a::VARCHAR AS law_number, NULL AS agency FROM k
UNION ALL SELECT a::VARCHAR, 'external_gov_decree', '5 мая 2016 г.', (a + 1)::VARCHAR, NULL FROM k UNION ALL SELECT a::VARCHAR, 'external_agency_act', '01.02.2020', '03-' || a, 'Минфин' FROM k""")
def decree_pairs(spark, sf):
    """Decrees of the government with a second pair, and a ministry's letter in another case."""
    k = F.col("o_orderkey")
    text = said("постановлением Правительства Российской Федерации от 26.12.2011 № ", k, " и от 5 мая 2016 г. № ", k + 1, ", письмо Минфина России от 01.02.2020 N 03-", k)
    out = citations.extract_acts(table(spark, sf, "orders").select(k.cast("string").alias("unit_id"), text.alias("text")))
    return out.select(F.col("from_unit_id").alias("unit_id"), "kind", "law_date", "law_number", "agency")


# penalties under the rules of 2022 and 2025

RECENT = (("2019-01-01", "2022-02-28", 6.25), ("2022-02-28", "2023-01-01", 20.0), ("2023-01-01", None, 16.0))
_RECENT_RATES = "rates(s, e, rate) AS (VALUES " + ", ".join(f"(DATE '{s}', {'NULL' if e is None else f'DATE {e!r}'}, {r}::DOUBLE)" for s, e, r in RECENT) + ")"


@query(f"""WITH {_RECENT_RATES}, c AS (SELECT o_orderkey AS case_id, o_totalprice AS amount, o_orderdate::DATE + 10000 AS due, (o_orderdate::DATE + 10000 + (o_orderkey % 150)::INT)::DATE AS paid, o_custkey % 3 = 0 AS person FROM orders),
d AS (SELECT *, (due + late)::DATE AS day FROM (SELECT *, unnest(range(1, (paid - due) + 1))::INT AS late FROM c)),
p AS (SELECT *, CASE WHEN person THEN 300 WHEN day BETWEEN DATE '2022-03-09' AND DATE '2024-12-31' THEN 300 WHEN day BETWEEN DATE '2025-01-01' AND DATE '2026-12-31' THEN CASE WHEN late BETWEEN 31 AND 90 THEN 150 ELSE 300 END WHEN late <= 30 THEN 300 ELSE 150 END AS den,
  CASE WHEN person THEN '{calculators.PENALTY_RATE}' WHEN day BETWEEN DATE '2022-03-09' AND DATE '2024-12-31' THEN '{calculators.PENALTY_2022}' WHEN day BETWEEN DATE '2025-01-01' AND DATE '2026-12-31' THEN '{calculators.PENALTY_2025}' ELSE '{calculators.PENALTY_RATE}' END AS rule FROM d JOIN rates ON day >= s AND (e IS NULL OR day < e)),
g AS (SELECT case_id, round(sum(amount * rate / 100 / den ORDER BY day), 2) AS value, count(*) AS days, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM p GROUP BY case_id)
SELECT case_id, coalesce(value, 0.0) AS value, coalesce(days, 0) AS days, '{calculators.PENALTY_DAYS}' || coalesce(',' || rules, '') AS applied FROM c LEFT JOIN g USING (case_id)""")
def penalty_recent(spark, sf):
    """Delays from 2019 to 2026: the rules of 2022 and 2025 apply within a case, each named."""
    rates = spark.createDataFrame(RECENT, "valid_from string, valid_to string, rate double").select(F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), "rate")
    due = F.date_add("day", 10_000)
    cases = orders(spark, sf).select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("amount"), due.alias("due"), F.date_add(due, (F.col("o_orderkey") % 150).cast("int")).alias("paid"), F.when(F.col("o_custkey") % 3 == 0, "individual").otherwise("organization").alias("taxpayer"))
    return calculators.penalties(cases, rates).select("case_id", "value", "days", F.array_join("applied", ",").alias("applied"))


# the audit with letters and suggestions

_AUDIT = """d AS (SELECT c_custkey AS doc, DATE '2021-01-01' + (c_custkey % 300)::INT AS date, CASE WHEN c_custkey % 4 = 0 THEN 'outdated' ELSE 'actual' END AS status, c_custkey % 5 = 0 AS mandatory FROM customer),
n AS (SELECT o_custkey AS doc, o_orderkey::VARCHAR AS item, (['ok', 'ok', 'stale', 'partial', 'missing'])[(o_orderkey % 5 + 1)::INT] AS s, CASE WHEN o_orderkey % 5 < 4 THEN 'a.art' || (o_orderkey * 7 % 15000 + 1) || '.p1' END AS target FROM orders),
ch AS (SELECT 'a.art' || c_custkey || '.p1' AS target, DATE '2021-01-01' + (c_custkey % 500)::INT AS e FROM customer),
norms AS (SELECT n.doc, item, CASE WHEN s = 'ok' AND e <= DATE '2022-01-01' AND e > d.date THEN 'outdated' ELSE s END AS status, target FROM n JOIN d USING (doc) LEFT JOIN ch USING (target)),
cited AS (SELECT o_custkey AS doc, 'letter ' || o_orderkey AS item, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey + o_orderkey % 2 + 1 END AS found FROM orders WHERE o_orderkey % 3 = 0),
letters AS (SELECT cited.doc, item, CASE WHEN found IS NULL THEN 'unknown' WHEN d.status = 'outdated' THEN 'outdated' ELSE 'ok' END AS status, found FROM cited LEFT JOIN d ON d.doc = found),
sug AS (SELECT DISTINCT n.doc, l.doc AS letter FROM n JOIN d l ON l.mandatory AND target = 'a.art' || l.doc || '.p1' WHERE n.doc <> l.doc AND NOT EXISTS (SELECT 1 FROM letters x WHERE x.doc = n.doc AND x.found = l.doc))"""


@query(f"""WITH {_AUDIT} SELECT doc::VARCHAR AS doc_id, item, status, target FROM norms UNION ALL SELECT doc::VARCHAR, item, status, found::VARCHAR FROM letters UNION ALL SELECT doc::VARCHAR, 'suggestion', 'suggested', letter::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY letter) AS n FROM sug) WHERE n <= 20""")
def audit_items(spark, sf):
    """Norms outdated since a document's day, letters that it cites, mandatory letters on its norms that it does not."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    key = F.col("c_custkey")
    name = lambda k: k.cast("string").alias("doc_id")
    docs = c.select(name(key), F.date_add(F.to_date(F.lit("2021-01-01")), (key % 300).cast("int")).alias("date"), F.when(key % 4 == 0, "outdated").otherwise("actual").alias("status"), (key % 5 == 0).alias("mandatory"))
    verdict = F.element_at(F.array(*map(F.lit, ("OK", "OK", "STALE", "PART", "MISS"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    target = said("a.art", F.col("o_orderkey") * 7 % 15_000 + 1, ".p1")
    verified = o.select(name(F.col("o_custkey")), F.col("o_orderkey").cast("string").alias("raw"), F.when(F.col("o_orderkey") % 5 < 4, target).alias("to_unit_id"), verdict.alias("verdict"))
    found = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") + F.col("o_orderkey") % 2 + 1)
    cited = o.where("o_orderkey % 3 = 0").select(name(F.col("o_custkey")), said("letter ", "$o_orderkey").alias("raw"), found.cast("string").alias("found"))
    changes = c.select(said("a.art", "$c_custkey", ".p1").alias("target_unit_id"), F.date_add(F.to_date(F.lit("2021-01-01")), (key % 500).cast("int")).alias("effective_date"))
    edges = c.select(name(key), said("a.art", "$c_custkey").alias("unit_id"))
    return evaluate.audit(verified, cited, docs, changes, edges, "2022-01-01")


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 400 + 1 AS a, o_custkey % 9 + 1 AS p, 'согласно п. ' || (o_custkey % 9 + 1) || ' ст. ' || (o_orderkey % 400 + 1) || ' НК РФ и ' AS head FROM orders)
SELECT o_orderkey, 'п. ' || p || ' ст. ' || a AS raw, 9 AS starts_at, a::VARCHAR AS article, p::VARCHAR AS point, NULL AS subpoint, NULL::INT AS paragraph_ordinal FROM a
UNION ALL SELECT o_orderkey, 'пп. 2 п. 1 ст. ' || (a + 1), length(head)::INT, (a + 1)::VARCHAR, '1', '2', NULL FROM a UNION ALL SELECT o_orderkey, 'абзаце втором пункта 3 статьи ' || a, (length(head) + length('пп. 2 п. 1 ст. ' || (a + 1)) + 4)::INT, a::VARCHAR, '3', NULL, 2 FROM a""")
def sql_short_citations(spark, sf):
    """Short and full forms in free text, by SQL alone."""
    sql.register(spark)
    table(spark, sf, "orders").repartition("o_orderkey").createOrReplaceTempView("answered_orders")
    return spark.sql("""
        SELECT o_orderkey, raw, starts_at, article, point, subpoint, paragraph_ordinal FROM short_citations(TABLE(
            SELECT o_orderkey, concat('согласно п. ', o_custkey % 9 + 1, ' ст. ', o_orderkey % 400 + 1, ' НК РФ и пп. 2 п. 1 ст. ', o_orderkey % 400 + 2, ', в абзаце втором пункта 3 статьи ', o_orderkey % 400 + 1) AS text FROM answered_orders))""")


# accuracy of searches and golden runs

_GOLDEN = """g AS (SELECT o_orderkey AS id, 'topic ' || (o_custkey % 7) AS topic, 'a.art' || (o_orderkey % 90) || CASE WHEN o_orderkey % 3 = 0 THEN '.p1' ELSE '' END AS want FROM orders),
r AS (SELECT o_orderkey AS id, unnest(['lexical', 'dense']) AS variant, o_orderkey, o_custkey FROM orders), h AS (SELECT variant, id, n AS rank, 'a.art' || ((o_orderkey + CASE WHEN n = (o_custkey + length(variant)) % 8 + 1 THEN 0 ELSE n END) % 90) || CASE WHEN o_custkey % 2 = 0 THEN '.p2' ELSE '' END AS unit FROM r, (SELECT unnest(range(1, 9)) AS n))"""


@query(f"""WITH {_GOLDEN}, t AS (SELECT g.id, topic, variant, max((want = unit OR starts_with(unit, want || '.') OR starts_with(want, unit || '.'))::INT) AS u, max((regexp_extract(want, '^a.art[0-9]+') = regexp_extract(unit, '^a.art[0-9]+'))::INT) AS a FROM g JOIN h ON g.id = h.id AND rank <= 5 GROUP BY ALL)
SELECT variant, topic, count(*) AS n, sum(u)::BIGINT AS unit_at_k, sum(a)::BIGINT AS article_at_k FROM t GROUP BY ALL""")
def search_accuracy(spark, sf):
    """Questions whose expected unit, or its article, is among the first five, by variant and topic."""
    o = table(spark, sf, "orders")
    golden = o.select(F.col("o_orderkey").alias("id"), said("topic ", F.col("o_custkey") % 7).alias("topic"), F.array(F.concat(said("a.art", F.col("o_orderkey") % 90), F.when(F.col("o_orderkey") % 3 == 0, ".p1").otherwise(""))).alias("expected"))
    rows = o.select(F.col("o_orderkey").alias("id"), "o_custkey", F.explode(F.array(F.lit("lexical"), F.lit("dense"))).alias("variant")).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(8))))
    off = F.when(F.col("rank") == (F.col("o_custkey") + F.length("variant")) % 8 + 1, 0).otherwise(F.col("rank"))
    results = rows.select("variant", "id", "rank", F.concat(said("a.art", (F.col("id") + off) % 90), F.when(F.col("o_custkey") % 2 == 0, ".p2").otherwise("")).alias("unit_id"))
    return evaluate.search_accuracy(results, golden)


@query("""WITH r AS (SELECT (['search', 'resolve', 'as_of', 'as_of_absent'])[(o_orderkey % 4 + 1)::INT] AS kind, CASE WHEN o_orderkey % 4 = 3 THEN o_custkey % 3 <> 0 ELSE o_custkey % 5 < 3 END AS hit FROM orders)
SELECT kind, count(*) AS n, count(*) FILTER (hit) AS ok, count(*) FILTER (hit) / count(*) AS share FROM r GROUP BY kind""")
def golden_figures(spark, sf):
    """Searches, resolutions and reads on a day that found what was expected; absent ones that found nothing."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    none = F.array().cast("array<string>")
    got = F.when(k == 3, F.when(c % 3 != 0, none).otherwise(F.array(F.lit("u9")))).otherwise(F.when(c % 5 < 3, F.array(F.lit("u2"), F.lit("u1"))).otherwise(F.array(F.lit("u2"))))
    rows = table(spark, sf, "orders").select(F.element_at(F.array(*map(F.lit, ("search", "resolve", "as_of", "as_of_absent"))), (k + 1).cast("int")).alias("kind"), F.when(k == 3, none).otherwise(F.array(F.lit("u1"))).alias("expected"), got.alias("got"))
    return evaluate.golden_run(rows)
