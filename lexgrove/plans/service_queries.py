"""Registered queries of loads, cards, monitoring, documents, drafts and scalar rules.

As in the other modules of this package, what the tables lack is made from their keys on both sides alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgrove.functions import hierarchy as H
from lexgrove.functions import text as X
from lexgrove.operators import amendments, corpus, facts, interpret, monitor, resolve, search
from lexgrove.plans.queries import QUESTION, QUESTION_STEMS, STEMS, orders, query, table
from lexgrove.sources import readers, shared


def said(*parts):
    """Literals and columns joined into one text; column names start with a dollar sign."""
    return F.concat(*[F.col(p[1:]).cast("string") if isinstance(p, str) and p.startswith("$") else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 7, p_partkey % 11, p_partkey % 3, p_partkey)::INT AS place FROM part""")
def number_order(spark, sf):
    rows = table(spark, sf, "part").withColumn("key", H.number_key(said(F.col("p_partkey") % 7, ".", F.col("p_partkey") % 11, "-", F.col("p_partkey") % 3)))
    return rows.selectExpr("p_partkey", "row_number() over (partition by p_size order by key, p_partkey) place")


@query("""SELECT o_orderkey,
CASE o_orderkey % 5 WHEN 0 THEN (DATE '1990-01-01' + (o_custkey % 9000)::INT)::VARCHAR WHEN 1 THEN (1990 + o_custkey % 30) || '-01-01..' || (1990 + o_custkey % 30) || '-12-31'
  WHEN 2 THEN make_date(2000, (1 + o_custkey % 4 * 3)::INT, 1) || '..' || last_day(make_date(2000, (3 + o_custkey % 4 * 3)::INT, 1)) WHEN 4 THEN 'дело ' || o_custkey END AS value,
CASE WHEN o_orderkey % 5 = 3 THEN CASE o_custkey % 3 WHEN 0 THEN o_custkey * 1000000.0::DOUBLE WHEN 1 THEN o_custkey * 1000.0::DOUBLE ELSE o_custkey * 1000 + 0.5::DOUBLE END END AS amount FROM orders""")
def fact_values(spark, sf):
    """Dates, years, quarters, amounts and free facts by their kind."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("date", "period", "period", "amount", "note"))), (k + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (c % 9000).cast("int")), "dd.MM.yyyy")
    money = F.when(c % 3 == 0, said(c, " млн руб.")).when(c % 3 == 1, said(c, " тыс. руб.")).otherwise(said(c, " 000,50 руб."))
    told = F.when(k == 0, said("акт от ", day)).when(k == 1, said(1990 + c % 30, " год")).when(k == 2, said(c % 4 + 1, " квартал 2000")).when(k == 3, money).otherwise(said("  дело ", c, " "))
    rows = table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), told.alias("told"))
    return rows.select("o_orderkey", F.when(F.col("kind") != "amount", X.fact_value("kind", "told")).alias("value"), F.when(F.col("kind") == "amount", X.amount("told")).alias("amount"))


@query("""SELECT o_orderkey, replace(replace(printf('%,.2f', o_totalprice), ',', ' '), '.', ',') AS told FROM orders""")
def money_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.money(F.col("o_totalprice").cast("double")).alias("told"))


LATEST = "SELECT (o_custkey % 100)::VARCHAR AS name, CASE WHEN o_custkey % 5 > 0 THEN o_orderpriority END AS region, max(year(o_orderdate) * 12 + month(o_orderdate))::VARCHAR AS v FROM orders WHERE {} GROUP BY ALL"


@query(f"""WITH a AS ({LATEST.format("o_orderdate < DATE '1997-01-01'")}), b AS ({LATEST.format("o_orderstatus <> 'P'")})
SELECT a.name, a.region, a.v AS before, b.v AS after FROM a JOIN b ON a.name = b.name AND a.region IS NOT DISTINCT FROM b.region WHERE a.v <> b.v""")
def parameter_diffs(spark, sf):
    rows = orders(spark, sf).select((F.col("o_custkey") % 100).cast("string").alias("name"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")).alias("region"), F.col("day").alias("valid_from"), (F.year("day") * 12 + F.month("day")).alias("value"), "o_orderstatus")
    return monitor.parameter_changes(rows.where("valid_from < date '1997-01-01'"), rows.where("o_orderstatus <> 'P'"))


@query("""WITH hit AS (SELECT s_nationkey, s_suppkey AS doc_id, s_suppkey % 2 = 0 AS mandatory, CASE s_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 9 END AS rank_of, DATE '2020-01-01' + (s_suppkey % 500)::INT AS day,
  CASE WHEN s_suppkey % 4 = 0 THEN 'a | b' ELSE 'a | c' END AS citations FROM supplier)
SELECT 'x.art' || s_nationkey || '.p1' AS unit_id, doc_id, citations, row_number() OVER (PARTITION BY s_nationkey ORDER BY rank_of, mandatory DESC, day, doc_id)::INT AS rank FROM hit WHERE day <= DATE '2021-01-01'""")
def letters_of_unit(spark, sf):
    """Each supplier is a document that cites an article, one of its points, or a neighbour of the point asked for."""
    s = table(spark, sf, "supplier")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "letter").when(F.col("s_suppkey") % 3 == 1, "plenum").otherwise("essay")
    docs = s.select(F.col("s_suppkey").alias("doc_id"), kind.alias("kind"), (F.col("s_suppkey") % 2 == 0).alias("mandatory"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") % 500).cast("int")).alias("date"))
    art = said("x.art", "$s_nationkey")
    cites = F.array(F.struct(art.alias("unit_id"), F.lit("a").alias("raw_citation")), F.when(F.col("s_suppkey") % 4 == 0, F.struct(said(art, ".p1.sp2").alias("unit_id"), F.lit("b").alias("raw_citation"))).otherwise(F.struct(said(art, ".p2").alias("unit_id"), F.lit("c").alias("raw_citation"))))
    edges = s.select(F.col("s_suppkey").alias("doc_id"), F.explode(cites).alias("x")).select("doc_id", "x.*")
    asked = table(spark, sf, "nation").select(said("x.art", "$n_nationkey", ".p1").alias("unit_id"))
    return interpret.interpretations(asked, edges, docs, "2021-01-01").select("unit_id", "doc_id", F.array_join("citations", " | ").alias("citations"), "rank")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'tag' WHEN o_orderkey % 4 = 1 THEN 'partial' ELSE 'resolved' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 0.9 WHEN o_orderkey % 4 = 1 THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence,
'u' || o_custkey AS unit_id FROM orders WHERE o_orderkey % 4 < 3 AND o_orderstatus <> 'P'""")
def linked_documents(spark, sf):
    """Citations of orders to customers: resolved, partial, tagged by their source, or unresolved; some twice."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    found = o.where(k > 0).select(F.col("o_orderkey").alias("from_unit_id"), said("u", "$o_custkey").alias("to_unit_id"), F.when(k == 1, "partial").when(k == 2, "resolved").otherwise("unresolved").alias("status"), said("ст. ", "$o_custkey").alias("raw_citation"))
    tags = o.where(k == 0).select(F.col("o_orderkey").alias("doc_id"), said("u", "$o_custkey").alias("unit_id"))
    known = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"))
    return interpret.link(known, found.unionByName(found), tags).drop("raw_citation")


@query("""SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN s_suppkey ELSE -s_suppkey END AS found FROM supplier""")
def cited_letters(spark, sf):
    """A letter is cited by number and date, by a number alone in the register with another date, or is unknown."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey") % 3
    texts = s.select(F.col("s_suppkey").alias("doc_id"), said("По мнению автора (см. письмо Минфина России от 05.03.2020 № 03-04-05/", "$s_suppkey", "), налог уплачен.").alias("text"))
    both = s.where(k == 1).select(said("03-04-05/", "$s_suppkey").alias("number"), F.lit("2020-03-05").cast("date").alias("date"), F.col("s_suppkey").alias("doc_id"))
    namesake = s.where(k == 1).select(said("03-04-05/", "$s_suppkey").alias("number"), F.lit("2019-01-01").cast("date").alias("date"), (F.col("s_suppkey") + 1_000_000).alias("doc_id"))
    alone = s.where(k == 2).select(said("№ 03-04-05/", "$s_suppkey").alias("number"), F.lit("2018-07-01").cast("date").alias("date"), (-F.col("s_suppkey")).alias("doc_id"))
    return interpret.cited_documents(texts, both.unionByName(namesake).unionByName(alone)).select("doc_id", "found")


@query("""SELECT o_orderkey, 'u' || (o_custkey * 2) AS pending, CASE WHEN o_orderkey % 4 = 0 THEN 'z' WHEN c_custkey IS NOT NULL THEN 'u' || (o_custkey * 2) END AS to_unit_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2""")
def pending_links(spark, sf):
    refs = table(spark, sf, "orders").select("o_orderkey", said("u", F.col("o_custkey") * 2).alias("pending"), F.when(F.col("o_orderkey") % 4 == 0, "z").alias("to_unit_id"))
    return resolve.link_pending(refs, table(spark, sf, "customer").select(said("u", "$c_custkey").alias("unit_id")))


@query("""SELECT 'u' || l_orderkey AS unit_id, CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate::DATE END AS repeal_date FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3 = 0, l_linenumber, l_partkey, l_suppkey) = 1""")
def first_repeals(spark, sf):
    rows = table(spark, sf, "lineitem").select(said("u", "$l_orderkey").alias("target_unit_id"), F.when(F.col("l_returnflag") == "R", "repeal").otherwise("amend").alias("operation"), F.when(F.col("l_linestatus") == "F", "unit").otherwise("child").alias("scope"),
        F.when(F.col("l_linenumber") % 3 > 0, F.to_date("l_shipdate")).alias("effective_date"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("nth"))
    return amendments.repeal_dates(rows)


@query(f"""WITH d AS (SELECT doc_id, DATE '2024-01-01' + (doc_id % 400)::INT AS date, 2 * len(list_intersect({STEMS.format("substr(text, 1, 60)")}, {QUESTION_STEMS})) + len(list_intersect({STEMS.format("text")}, {QUESTION_STEMS})) AS score FROM documents)
SELECT doc_id, date, score::INT AS score, row_number() OVER (ORDER BY score DESC, date, doc_id)::INT AS rank FROM d WHERE score > 0 AND date <= DATE '2024-12-01' QUALIFY rank <= 25""")
def document_search(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.substring("text", 1, 60).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("date"))
    return search.documents(docs, QUESTION, "2024-12-01", 25)


@query(f"""WITH d AS (SELECT doc_id, text, list_min(list_filter(list_transform({QUESTION_STEMS}, lambda s: instr(replace(lower(text), 'ё', 'е'), s)), lambda p: p > 0)) AS hit FROM documents)
SELECT doc_id, substr(text, greatest(hit - 100, 1), 200) AS snippet FROM d WHERE hit IS NOT NULL""")
def headlines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", search.headline(F.col("text"), QUESTION, 200).alias("snippet")).where("snippet is not null")


@query("""SELECT 'n' || o_orderkey AS name, 'x.art' || (o_custkey % 30) || '.p' || (o_orderkey % 5) AS source_unit_id, o_orderdate::DATE AS valid_from FROM orders
WHERE o_custkey % 30 = 2 AND o_orderdate::DATE <= DATE '1998-01-01' AND o_orderdate::DATE + 700 > DATE '1998-01-01'""")
def parameters_below(spark, sf):
    rows = orders(spark, sf).select(said("n", "$o_orderkey").alias("name"), said("x.art", F.col("o_custkey") % 30, ".p", F.col("o_orderkey") % 5).alias("source_unit_id"), F.col("day").alias("valid_from"), F.date_add("day", 700).alias("valid_to"))
    return corpus.parameters_for(rows, "x.art2", "1998-01-01").drop("valid_to")


@query("""WITH a AS (SELECT o_custkey AS c, o_orderdate::DATE AS day, 'h' || (o_orderkey % 3) AS h FROM orders),
last AS (SELECT c, h FROM a JOIN customer ON c = c_custkey WHERE h <> 'h' || (c % 3) QUALIFY row_number() OVER (PARTITION BY c ORDER BY day DESC, h) = 1)
SELECT 'u' || c AS unit_id, 'text ' || h AS before, 'text h' || (c % 3) AS after, CASE WHEN c % 2 = 0 THEN '1-ФЗ, ' || (c % 7 + 2) || '-ФЗ' END AS laws FROM last""")
def changed_texts(spark, sf):
    """The latest archived text of a customer that differs from the present one, with the laws that changed it."""
    past = orders(spark, sf).select(said("u", "$o_custkey").alias("unit_id"), said("h", F.col("o_orderkey") % 3).alias("text_hash"), F.col("day").alias("archived_at")).withColumn("text", said("text ", "$text_hash"))
    c = table(spark, sf, "customer")
    now = c.select(said("u", "$c_custkey").alias("unit_id"), said("h", F.col("c_custkey") % 3).alias("text_hash")).withColumn("text", said("text ", "$text_hash"))
    laws = c.where("c_custkey % 2 = 0").select(said("u", "$c_custkey").alias("target_unit_id"), F.explode(F.array(F.lit("1-ФЗ"), said(F.col("c_custkey") % 7 + 2, "-ФЗ"))).alias("amending_act_number"))
    return monitor.what_changed(past, now, laws).select("unit_id", "before", "after", F.array_join("amendments", ", ").alias("laws"))


@query("SELECT p_partkey AS name, (p_size % 5)::INT AS placeholders, (p_size % 3)::INT AS sections FROM part")
def template_counts(spark, sf):
    body = F.concat(F.repeat(F.lit("## Раздел\nтекст\n"), (F.col("p_size") % 3).cast("int")), F.repeat(F.lit("сумма {{sum|0}} # и\n"), (F.col("p_size") % 5).cast("int")))
    return facts.placeholders(table(spark, sf, "part").select(F.col("p_partkey").alias("name"), body.alias("body")))


@query("""SELECT c_custkey::VARCHAR AS draft_id, c_name || ' с ' || CASE WHEN c_custkey % 2 = 0 THEN 'дня ' || c_custkey ELSE 'сегодня' END || ': ' || CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE '[[нет: sum]]' END AS text,
CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'sum' END AS missing FROM customer""")
def rendered_drafts(spark, sf):
    c = F.col("c_custkey")
    given = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")), F.struct(F.lit("day").alias("k"), F.when(c % 2 == 0, said("дня ", c)).alias("v")), F.struct(F.lit("sum").alias("k"), F.when(c % 3 == 0, c.cast("string")).alias("v")),
    ), lambda x: x["v"].isNotNull()))
    drafts = table(spark, sf, "customer").select(c.alias("draft_id"), F.lit("{{name}} с {{ day |сегодня}}: {{sum}}").alias("body"), given.alias("values"))
    return facts.render_all(drafts).withColumn("missing", F.array_join("missing", ", "))


@query("""WITH m AS (SELECT o_custkey AS w, o_orderkey AS e, max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT w AS workspace_id, e AS event_id, ['open', 'seen', 'applied'][m + 1] AS status FROM m""")
def notification_status(spark, sf):
    """Marks of lines move an order's notification forward, never back."""
    opened = table(spark, sf, "orders").select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("event_id"), F.lit("open").alias("status"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") == "A", "seen").when(F.col("l_returnflag") == "R", "applied").otherwise("open").alias("status"))
    return monitor.advance(opened, lines.join(opened.drop("status"), "event_id"))


@query("""SELECT DISTINCT o_custkey AS workspace_id, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || (o_orderkey % 10) END AS unit_id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 10 END AS doc_id FROM orders""")
def merged_subscriptions(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("workspace_id"), F.when(F.col("o_orderkey") % 2 == 0, said("u", F.col("o_orderkey") % 10)).alias("unit_id"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey") % 10).alias("doc_id"), "o_orderkey")
    old = rows.where("o_orderkey % 3 = 0").drop("o_orderkey")
    return monitor.subscribe(old, rows.drop("o_orderkey"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS c_name, c_acctbal, DATE '2020-01-01' + (c_custkey % 900)::INT AS day FROM customer")
def json_round_trip(spark, sf):
    """A table written as JSON lines, nulls kept, and read back with its schema."""
    path = f"{shared.shared_folder(spark)}/rows"
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("c_name"), "c_acctbal", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("day"))
    readers.write_json_lines(rows, path)
    return readers.json_lines(spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


@query("""SELECT DISTINCT o_custkey AS doc_id, l_suppkey AS unit_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 3 > 0 AND l_suppkey % 2 = 0""")
def known_edges(spark, sf):
    """Edges of lines whose document and unit were both loaded."""
    edges = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), F.col("l_suppkey").alias("unit_id")).distinct()
    docs = table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("doc_id"))
    return corpus.known_endpoints(edges, docs, table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("unit_id")))
