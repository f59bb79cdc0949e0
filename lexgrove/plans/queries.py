"""Registered queries of the statute engine over the driver's tables, each beside the SQL it must equal.

Every query applies an operator of this library to whole tables. Where the tables have no legal text, texts,
paths or dates are made from their keys, on both sides alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions import hierarchy as H
from lexgrove.functions import temporal as T
from lexgrove.functions import text as X
from lexgrove.operators import amendments, calculators, citations, corpus, evaluate, facts, interpret, monitor, resolve, search, validate
from lexgrove.sources import readers, shared
from lexgrove.streaming import monitor as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = "1998-01-01"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))


def order_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as versions of its state."""
    rows = orders(spark, sf).select(F.col("o_custkey").alias("unit"), F.col("day").alias("valid_from"), "o_orderkey", "o_totalprice", "o_orderstatus")
    return T.versions(rows, ["unit"], "valid_from", ["o_orderkey"])


VERSIONS = "v AS (SELECT o_custkey AS unit, o_orderdate::DATE AS valid_from, o_orderkey, o_totalprice, o_orderstatus, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS valid_to FROM orders)"


@query(f"""WITH {VERSIONS} SELECT unit, valid_from, valid_to, o_orderkey, o_totalprice FROM v
WHERE valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to > DATE '{DAY}')
QUALIFY row_number() OVER (PARTITION BY unit ORDER BY valid_from DESC NULLS LAST, o_orderkey) = 1""")
def asof_latest_version(spark, sf):
    return T.as_of(order_versions(spark, sf), DAY, ["unit"], ties=["o_orderkey"]).select("unit", "valid_from", "valid_to", "o_orderkey", "o_totalprice")


@query(f"""WITH {VERSIONS} SELECT unit, o_orderkey, row_number() OVER (PARTITION BY unit ORDER BY valid_from NULLS FIRST, o_orderkey)::INT AS version,
(valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to > DATE '{DAY}')) AS current FROM v""")
def version_history(spark, sf):
    rows = order_versions(spark, sf)
    order = W.partitionBy("unit").orderBy(F.col("valid_from").asc_nulls_first(), "o_orderkey")
    return rows.select("unit", "o_orderkey", F.row_number().over(order).alias("version"), T.valid_on(DAY).alias("current"))


@query("""WITH o AS (SELECT o_custkey AS unit, o_orderdate::DATE AS day, o_totalprice AS price, o_orderkey FROM orders),
one AS (SELECT unit, day, max(price) AS price FROM o GROUP BY ALL), old AS (SELECT * FROM one WHERE day < DATE '1999-01-01'), new AS (SELECT * FROM one WHERE day >= DATE '1999-01-01'),
oldv AS (SELECT unit, price, day AS valid_from, lead(day) OVER (PARTITION BY unit ORDER BY day) AS valid_to FROM old),
newv AS (SELECT unit, price, day AS valid_from, lead(day) OVER (PARTITION BY unit ORDER BY day) AS valid_to FROM new),
f AS (SELECT unit, min(day) AS d FROM new GROUP BY unit)
SELECT unit, price, valid_from, coalesce(valid_to, d) AS valid_to FROM oldv LEFT JOIN f USING (unit) UNION ALL SELECT unit, price, valid_from, valid_to FROM newv""")
def scd2_add_versions(spark, sf):
    one = orders(spark, sf).groupBy(F.col("o_custkey").alias("unit"), F.col("day").alias("valid_from")).agg(F.max("o_totalprice").alias("price"))
    split = F.to_date(F.lit("1999-01-01"))
    old, new = (T.versions(one.where(c), ["unit"], "valid_from") for c in (F.col("valid_from") < split, F.col("valid_from") >= split))
    return T.add_versions(old, new, ["unit"]).select("unit", "price", "valid_from", "valid_to")


@query("""WITH v AS (SELECT user_id, ts::DATE AS valid_from, lead(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts::DATE) AS valid_to FROM (SELECT DISTINCT user_id, ts::DATE AS ts FROM events))
SELECT user_id, valid_from, CASE WHEN valid_to IS NULL AND user_id % 3 = 0 THEN DATE '2024-02-01' ELSE valid_to END AS valid_to FROM v""")
def scd2_close(spark, sf):
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("valid_from")).distinct()
    ended = days.where("user_id % 3 = 0").select("user_id").distinct().withColumn("ended", F.to_date(F.lit("2024-02-01")))
    return T.close(T.versions(days, ["user_id"], "valid_from"), ended, ["user_id"], "ended")


def dominant(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("day").orderBy(F.col("n").desc(), "event_type"))
    return counts.withColumn("nth", first).where("nth = 1").select(F.lit("all").alias("series"), "day", "event_type")


DOMINANT = """k AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ts::DATE, event_type), d AS (SELECT day, event_type FROM k QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) = 1),
c AS (SELECT day, event_type, lag(event_type) OVER (ORDER BY day) AS p FROM d),
i AS (SELECT event_type, day AS valid_from, lead(day) OVER (ORDER BY day) AS valid_to FROM c WHERE p IS DISTINCT FROM event_type)"""


@query(f"WITH {DOMINANT} SELECT * FROM i")
def interval_compress(spark, sf):
    return T.compress(dominant(spark, sf), ["series"], "day", "event_type").drop("series")


@query(f"WITH {DOMINANT} SELECT event_id, i.event_type AS ruling, valid_from FROM events e LEFT JOIN i ON e.ts::DATE >= valid_from AND (valid_to IS NULL OR e.ts::DATE < valid_to)")
def range_join_rate(spark, sf):
    intervals = T.compress(dominant(spark, sf), ["series"], "day", "event_type").select(F.col("event_type").alias("ruling"), "valid_from", "valid_to")
    points = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return T.range_join(points, intervals, "day").select("event_id", "ruling", "valid_from")


RATES = [("1990-01-01", "1997-01-01", 16.0), ("1997-01-01", "1998-06-01", 21.0), ("1998-06-01", "2000-03-01", 42.5), ("2000-03-01", None, 18.25)]
RATES_SQL = "rates(valid_from, valid_to, rate) AS (VALUES " + ", ".join(f"(DATE '{a}', {f"DATE '{b}'" if b else 'NULL::DATE'}, {r}::DOUBLE)" for a, b, r in RATES) + ")"
CASES_SQL = "cases AS (SELECT o_orderkey AS case_id, o_totalprice AS amount, o_orderdate::DATE AS due, (o_orderdate::DATE + (o_orderkey % 120)::INT)::DATE AS paid, CASE WHEN o_custkey % 3 = 0 THEN 'individual' ELSE 'organization' END AS taxpayer FROM orders)"
DAYS_SQL = f"""{CASES_SQL}, {RATES_SQL}, days AS (SELECT cases.*, unnest(range(1, (paid - due) + 1)) AS late FROM cases WHERE paid > due),
rated AS (SELECT d.*, (due + late::INT)::DATE AS day, rate, CASE WHEN taxpayer = 'individual' OR late <= 30 THEN 300 ELSE 150 END AS denominator FROM days d JOIN rates ON (due + late::INT)::DATE >= valid_from AND (valid_to IS NULL OR (due + late::INT)::DATE < valid_to))"""


def rate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "valid_from string, valid_to string, rate double").select(F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), "rate")


def late_cases(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("amount"), F.col("day").alias("due"), F.date_add("day", (F.col("o_orderkey") % 120).cast("int")).alias("paid"), F.when(F.col("o_custkey") % 3 == 0, "individual").otherwise("organization").alias("taxpayer"))


@query(f"WITH {DAYS_SQL} SELECT case_id, coalesce(round(sum(amount * rate / 100 / denominator), 2), 0.0) AS value, count(day) AS days FROM cases LEFT JOIN rated USING (case_id, amount) GROUP BY case_id")
def penalty_batch(spark, sf):
    return calculators.penalties(late_cases(spark, sf), rate_table(spark)).select("case_id", "value", "days")


@query(f"""WITH {DAYS_SQL}, f AS (SELECT *, CASE WHEN lag(rate) OVER w IS DISTINCT FROM rate OR lag(denominator) OVER w IS DISTINCT FROM denominator THEN 1 ELSE 0 END AS s FROM rated WINDOW w AS (PARTITION BY case_id ORDER BY day)),
r AS (SELECT *, sum(s) OVER (PARTITION BY case_id ORDER BY day) AS run FROM f)
SELECT case_id, rate, denominator, min(day) AS first, max(day) AS last, count(*) AS n FROM r GROUP BY case_id, run, rate, denominator""")
def penalty_segments(spark, sf):
    return calculators.penalty_segments(late_cases(spark, sf), rate_table(spark))


@query("""WITH c AS (SELECT o_orderkey AS case_id, (['119', '122', '122_willful', '126'])[(o_orderkey % 4 + 1)::INT] AS article, (o_custkey % 1000 + 1) * 1000.0::DOUBLE AS base, o_orderdate::DATE AS due, (o_orderdate::DATE + (o_custkey % 400)::INT)::DATE AS actual,
  o_orderkey % 20 AS documents, o_orderkey % 3 = 0 AS mitigating, o_orderkey % 5 = 0 AS aggravating, 2.0 + o_orderkey % 9 AS factor FROM orders),
m AS (SELECT *, CASE WHEN actual <= due THEN 0 ELSE greatest((year(actual) - year(due)) * 12 + month(actual) - month(due) + (day(actual) > day(due))::INT, 1) END AS months FROM c),
p AS (SELECT *, CASE article WHEN '119' THEN greatest(least(base * 0.05::DOUBLE * months, base * 0.30::DOUBLE), 1000.0) WHEN '122' THEN base * 0.20::DOUBLE WHEN '122_willful' THEN base * 0.40::DOUBLE ELSE 200.0 * documents END * CASE WHEN aggravating THEN 2 ELSE 1 END AS v FROM m)
SELECT case_id, months::BIGINT AS months, round(CASE WHEN mitigating THEN CASE WHEN factor BETWEEN 2 AND 10 THEN v / factor END ELSE v END, 2)::DOUBLE AS value FROM p""")
def fine_batch(spark, sf):
    key = F.col("o_orderkey")
    rows = orders(spark, sf).select(
        key.alias("case_id"), F.element_at(F.array(*map(F.lit, ("119", "122", "122_willful", "126"))), (key % 4 + 1).cast("int")).alias("article"), ((F.col("o_custkey") % 1000 + 1) * 1000.0).alias("base"), F.col("day").alias("due"), F.date_add("day", (F.col("o_custkey") % 400).cast("int")).alias("actual"),
        (key % 20).alias("documents"), (key % 3 == 0).alias("mitigating"), (key % 5 == 0).alias("aggravating"), (2.0 + key % 9).alias("factor"),
    )
    return calculators.fines(rows).select("case_id", F.col("months").cast("long").alias("months"), "value")


HOLIDAYS_SQL = ", ".join(f"{m * 100 + d}" for m, d in calculators.HOLIDAYS)
CALENDAR_SQL = f"""cal AS (SELECT day, isodow(day) < 6 AND month(day) * 100 + day(day) NOT IN ({HOLIDAYS_SQL}) AS w FROM (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE AS day)),
days AS (SELECT day, w, sum(w::INT) OVER (ORDER BY day) AS n, min(CASE WHEN w THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM cal)"""


@query(f"""WITH {CALENDAR_SQL}, c AS (SELECT o_orderkey AS case_id, o_orderdate::DATE AS start, 1 + o_custkey % 12 AS amount, (['days', 'calendar_days', 'months', 'quarters', 'years'])[(o_orderkey % 5 + 1)::INT] AS unit FROM orders),
e AS (SELECT c.*, CASE unit WHEN 'days' THEN t.day WHEN 'calendar_days' THEN (start + amount::INT)::DATE WHEN 'months' THEN (start + to_months(amount::INT))::DATE WHEN 'quarters' THEN last_day((start + to_months((amount * 3)::INT))::DATE) ELSE (start + to_months((amount * 12)::INT))::DATE END AS nominal_end
  FROM c JOIN days s ON s.day = start LEFT JOIN days t ON t.w AND t.n = s.n + amount AND unit = 'days')
SELECT case_id, (start + 1)::DATE AS counting_from, nominal_end, nxt AS end, nxt <> nominal_end AS shifted FROM e JOIN days ON days.day = nominal_end""")
def deadline_batch(spark, sf):
    units = F.element_at(F.array(*map(F.lit, ("days", "calendar_days", "months", "quarters", "years"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = orders(spark, sf).select(F.col("o_orderkey").alias("case_id"), F.col("day").alias("start"), (1 + F.col("o_custkey") % 12).alias("amount"), units.alias("unit"))
    return calculators.deadlines(rows, calculators.calendar(spark, 1994, 2030)).select("case_id", "counting_from", "nominal_end", "end", "shifted")


@query(f"""WITH {CALENDAR_SQL}, c AS (SELECT o_orderkey AS case_id, o_orderdate::DATE AS d, o_orderkey % 3 AS k FROM orders),
t AS (SELECT case_id, 'objections_until' AS name, (d + INTERVAL 1 MONTH)::DATE AS e FROM c WHERE k = 0 UNION ALL SELECT case_id, 'decision_in_force', (d + INTERVAL 1 MONTH)::DATE FROM c WHERE k = 1 UNION ALL SELECT case_id, 'complaint_until', (d + INTERVAL 12 MONTH)::DATE FROM c WHERE k = 2
  UNION ALL SELECT case_id, 'fns_complaint_until', (d + INTERVAL 3 MONTH)::DATE FROM c)
SELECT case_id, name, nxt AS until FROM t JOIN days ON day = e UNION ALL SELECT case_id, 'appeal_until', (e - 1)::DATE FROM t WHERE name = 'decision_in_force'""")
def appeal_batch(spark, sf):
    k = F.col("o_orderkey") % 3
    rows = orders(spark, sf).select(F.col("o_orderkey").alias("case_id"), F.when(k == 0, F.col("day")).alias("act_received"), F.when(k == 1, F.col("day")).alias("decision_received"), F.when(k == 2, F.col("day")).alias("decision_date"), F.col("day").alias("complaint_decision_date"))
    return calculators.appeals(rows, calculators.calendar(spark, 1994, 2030)).select("case_id", "name", "until")


@query("""WITH c AS (SELECT o_orderkey AS case_id, (['119', '120', '122', '126'])[(o_orderkey % 4 + 1)::INT] AS article, o_orderdate::DATE AS offense, last_day(o_orderdate::DATE) AS period_end, (o_orderdate::DATE + (1000 + o_custkey % 200)::INT)::DATE AS decision FROM orders)
SELECT case_id, ((CASE WHEN article IN ('120', '122') THEN period_end ELSE offense END) + INTERVAL 36 MONTH)::DATE AS limitation_ends, decision > ((CASE WHEN article IN ('120', '122') THEN period_end ELSE offense END) + INTERVAL 36 MONTH)::DATE AS expired FROM c""")
def limitation_batch(spark, sf):
    article = F.element_at(F.array(*map(F.lit, ("119", "120", "122", "126"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = orders(spark, sf).select(F.col("o_orderkey").alias("case_id"), article.alias("article"), F.col("day").alias("offense"), F.last_day("day").alias("period_end"), F.date_add("day", (1000 + F.col("o_custkey") % 200).cast("int")).alias("decision"))
    return calculators.limitations(rows).select("case_id", "limitation_ends", "expired")


@query("""WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM old FULL JOIN new USING (doc_id) WHERE old.h IS DISTINCT FROM new.h""")
def reload_diff(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return T.reload_diff(old, new, "doc_id", "h")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS text_hash FROM documents")
def text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.text_hash("text").alias("text_hash"))


def tree(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return region.unionByName(nation).unionByName(table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))


@query("""WITH RECURSIVE t AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
x AS (SELECT node, parent AS ancestor, 1 AS distance FROM t UNION ALL SELECT x.node, t.parent, distance + 1 FROM x JOIN t ON x.ancestor = t.node) SELECT * FROM x""")
def hierarchy_paths(spark, sf):
    return H.parent_closure(tree(spark, sf), "node", "parent", 4)


def paths(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("x.ch"), "n_regionkey", F.lit(".art"), "n_nationkey", F.lit(".p"), "c_custkey").alias("unit_id"), "c_custkey", "c_acctbal", "n_nationkey", "n_regionkey")


PATHS = "paths AS (SELECT 'x.ch' || n_regionkey || '.art' || n_nationkey || '.p' || c_custkey AS unit_id, c_custkey, c_acctbal, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {PATHS}, leaves AS (SELECT unit_id, n_regionkey, n_nationkey, o_totalprice::DECIMAL(18, 2) AS v FROM paths JOIN orders ON o_custkey = c_custkey)
SELECT CASE WHEN GROUPING(unit_id) = 0 THEN unit_id WHEN GROUPING(n_nationkey) = 0 THEN 'x.ch' || n_regionkey || '.art' || n_nationkey WHEN GROUPING(n_regionkey) = 0 THEN 'x.ch' || n_regionkey ELSE 'x' END AS node, sum(v)::DOUBLE AS total, count(*) AS n
FROM leaves GROUP BY GROUPING SETS ((unit_id, n_nationkey, n_regionkey), (n_nationkey, n_regionkey), (n_regionkey), ())""")
def subtree_rollup(spark, sf):
    leaves = paths(spark, sf).join(orders(spark, sf), F.col("c_custkey") == F.col("o_custkey")).select("unit_id", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return H.subtree_totals(leaves, "unit_id", "v").select("node", F.col("total").cast("double").alias("total"), "n")


@query(f"""WITH {PATHS}, a AS (SELECT DISTINCT 'x.ch' || n_regionkey || '.art' || n_nationkey AS unit_id FROM paths UNION ALL SELECT DISTINCT 'x.ch' || n_regionkey FROM paths)
SELECT a.unit_id, p.unit_id AS other FROM a JOIN paths p ON starts_with(p.unit_id, a.unit_id || '.')""")
def hierarchical_join(spark, sf):
    p = paths(spark, sf)
    above = p.select(H.article_of("unit_id").alias("unit_id")).unionByName(p.select(F.concat(F.lit("x.ch"), "n_regionkey").alias("unit_id"))).distinct()
    return H.related_join(above, p.select(F.col("unit_id").alias("other")), "unit_id", "other")


@query("""WITH w AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey % 200 AS dst, count(*) AS weight FROM lineitem GROUP BY ALL),
o AS (SELECT src AS node, count(*) AS d, sum(weight) AS w FROM w GROUP BY src), i AS (SELECT dst AS node, count(*) AS d, sum(weight) AS w FROM w GROUP BY dst)
SELECT node, coalesce(o.d, 0)::BIGINT AS out_degree, coalesce(i.d, 0)::BIGINT AS in_degree, coalesce(o.w, 0)::BIGINT AS out_weight, coalesce(i.w, 0)::BIGINT AS in_weight FROM o FULL JOIN i USING (node)""")
def graph_degree(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), (F.col("l_partkey") % 200)).alias("b"))
    return H.degrees(H.edge_weights(edges, "a", "b"))


@query("""WITH u AS (SELECT 'x.' || (l_partkey % 50) AS id, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS ord FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM u)
SELECT CASE WHEN k > 1 THEN id || '@' || k ELSE id END AS unit_id, CASE WHEN k > 1 THEN id END AS duplicate_of FROM n""")
def duplicate_suffix(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("x."), F.col("l_partkey") % 50).alias("unit_id"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return H.duplicate_suffixes(rows).select("unit_id", "duplicate_of")


TOKENS = r"regexp_extract_all(replace(lower({}), 'ё', 'е'), '[\p{{L}}\p{{N}}]+')"
STEMS = "list_distinct(list_transform(list_filter(" + TOKENS + ", lambda w: length(w) > 2), lambda w: substr(w, 1, 5)))"
QUESTION = "the tion of ering pathetic ention"
QUESTION_STEMS = list(dict.fromkeys(w[:5] for w in QUESTION.split() if len(w) > 2))
LEXICAL = f"lexical AS (SELECT doc_id, len(list_intersect({STEMS.format('text')}, {STEMS.format(repr(QUESTION))})) AS hits, len(list_intersect({STEMS.format('text')}, {STEMS.format(repr(QUESTION))})) / (1 + length(text) / 4000) AS score FROM documents)"


@query(f"WITH {LEXICAL} SELECT doc_id, score, hits, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM lexical WHERE hits > 0 QUALIFY rank <= 50")
def lexical_stem(spark, sf):
    return search.lexical(table(spark, sf, "documents"), QUESTION, 50, "doc_id")


TERMS = sorted(set(QUESTION.split()))
BM25 = f"""t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM t, (SELECT unnest({TERMS!r}) AS term)), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))) AS score, count(*) AS matched FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id)"""


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score, matched FROM bm")
def bm25(spark, sf):
    return search.bm25(table(spark, sf, "documents"), TERMS, "doc_id").select("doc_id", F.round("score", 6).alias("score"), "matched")


@query(f"""WITH {BM25}, g AS (SELECT doc_id, matched = {len(TERMS)} AS strict, CASE WHEN matched = {len(TERMS)} THEN score ELSE score / (score + 1) END AS score FROM bm)
SELECT doc_id, CASE WHEN strict THEN 'strict' ELSE 'loose' END AS pass, round(score, 6) AS score, row_number() OVER (ORDER BY strict DESC, round(score, 9) DESC, doc_id) AS rank FROM g QUALIFY rank <= 40""")
def strict_loose(spark, sf):
    return search.two_pass(table(spark, sf, "documents"), QUESTION, 40, "doc_id").select("doc_id", "pass", F.round("score", 6).alias("score"), "rank")


VECTOR = [round(math.sin(i + 1), 6) for i in range(64)]
DENSE = f"dense AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[]) AS score FROM embeddings)"


@query(f"WITH {DENSE} SELECT doc_id, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM dense QUALIFY rank <= 40")
def dense_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return search.dense(vectors, VECTOR, 40, "doc_id").select("doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {DENSE}, {LEXICAL}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM lexical WHERE hits > 0 QUALIFY rank <= 30), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM dense QUALIFY rank <= 30),
u AS (SELECT doc_id, rank, 'lexical' AS source FROM a UNION ALL SELECT doc_id, rank, 'dense' FROM b), f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY doc_id)
SELECT doc_id, round(score, 9) AS score, sources, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f QUALIFY rank <= 20""")
def hybrid_search(spark, sf):
    out = search.hybrid(table(spark, sf, "documents"), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), QUESTION, VECTOR, 20, "doc_id")
    return out.select("doc_id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"), "rank")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 97 DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY doc_id)
SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f QUALIFY rank <= 50""")
def rrf_fusion(spark, sf):
    docs = table(spark, sf, "documents")
    lists = {"length": search.ranked(docs.select("doc_id", F.col("n_chars").alias("score")), "doc_id", 100), "residue": search.ranked(docs.select("doc_id", (F.col("doc_id") % 97).alias("score")), "doc_id", 100)}
    return search.fuse(lists, "doc_id", 50).select("doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {LEXICAL}, t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM lexical WHERE hits > 0 QUALIFY rank <= 20) SELECT doc_id, rank, array_to_string(list_filter({QUESTION_STEMS!r}, lambda s: list_contains({STEMS.format('text')}, s)), ', ') AS matched FROM t JOIN documents USING (doc_id)")
def explain_hits(spark, sf):
    docs = table(spark, sf, "documents")
    return search.explain(search.lexical(docs, QUESTION, 20, "doc_id"), docs, QUESTION, "doc_id").select("doc_id", "rank", F.array_join("matched_terms", ", ").alias("matched"))


@query(f"SELECT doc_id, len(list_distinct({TOKENS.format('text')})) AS n_terms FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.array_distinct(search.tokens("text"))).cast("long").alias("n_terms"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey % 2 = 0 DESC, length(p_name), p_name, p_partkey LIMIT 100000")
def term_lookup(spark, sf):
    terms = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("term"), F.when(F.col("p_partkey") % 2 == 0, "code").otherwise("article").alias("scope"))
    return search.find_terms(terms, "RING", 100_000).select("p_partkey", F.col("term").alias("p_name"))


LAW_TEXT = "'в ред. Федерального закона от 0' || (o_orderkey % 9 + 1) || '.1' || (o_orderkey % 3) || '.20' || (10 + o_orderkey % 15) || ' № ' || o_orderkey || '-ФЗ и от 5 мая 2016 г. № ' || o_custkey || '-ФЗ, приказ ФНС России от 01.02.2020 № ММВ-' || o_custkey || '/7@'"


def law_texts(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = [F.lit("в ред. Федерального закона от 0"), k % 9 + 1, F.lit(".1"), k % 3, F.lit(".20"), 10 + k % 15, F.lit(" № "), k, F.lit("-ФЗ и от 5 мая 2016 г. № "), c, F.lit("-ФЗ, приказ ФНС России от 01.02.2020 № ММВ-"), c, F.lit("/7@")]
    return orders(spark, sf).select(k.cast("string").alias("unit_id"), F.concat(*[p.cast("string") for p in parts]).alias("text"))


@query("""WITH k AS (SELECT o_orderkey AS a, o_custkey AS b FROM orders)
SELECT a::VARCHAR AS unit_id, 'external_federal_law' AS kind, '0' || (a % 9 + 1) || '.1' || (a % 3) || '.20' || (10 + a % 15) AS law_date, a || '-ФЗ' AS law_number FROM k
UNION ALL SELECT a::VARCHAR, 'external_federal_law', '5 мая 2016 г.', b || '-ФЗ' FROM k UNION ALL SELECT a::VARCHAR, 'external_agency_act', '01.02.2020', 'ММВ-' || b || '/7@' FROM k""")
def citation_pairs(spark, sf):
    return citations.extract_acts(law_texts(spark, sf)).select(F.col("from_unit_id").alias("unit_id"), "kind", "law_date", "law_number")


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderkey % 300 + 1 AS a, o_custkey % 40 AS d FROM orders), r AS (SELECT id, unnest(range(a, a + 3)) AS p, a FROM k WHERE d % 2 = 0)
SELECT id::VARCHAR AS unit_id, a::VARCHAR AS article, p::VARCHAR AS point, NULL::INT AS paragraph_ordinal FROM r UNION ALL SELECT id::VARCHAR, a::VARCHAR, '7', 2 FROM k WHERE d % 2 = 1""")
def internal_citations(spark, sf):
    a = F.col("o_orderkey") % 300 + 1
    even = F.concat(F.lit("согласно пунктам "), a, F.lit(" - "), a + 2, F.lit(" статьи "), a, F.lit(" настоящего Кодекса"))
    odd = F.concat(F.lit("в абзаце втором пункта 7 статьи "), a, F.lit(" и подпункты без номера"))
    rows = orders(spark, sf).select(F.col("o_orderkey").cast("string").alias("unit_id"), F.when(F.col("o_custkey") % 40 % 2 == 0, even).otherwise(odd).alias("text"))
    return citations.extract_internal(rows).select(F.col("from_unit_id").alias("unit_id"), "article", "point", "paragraph_ordinal")


@query("""WITH n AS (SELECT p_partkey, p_size || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 2 = 0 THEN '-1' ELSE '' END AS x FROM part)
SELECT p_partkey, v AS variant FROM (SELECT DISTINCT p_partkey, unnest([x, replace(x, '.', '-'), replace(x, '.', ''), replace(replace(x, '.', ''), '-', '')]) AS v FROM n)""")
def number_variants(spark, sf):
    number = F.concat("p_size", F.lit("."), F.col("p_partkey") % 7, F.when(F.col("p_partkey") % 2 == 0, "-1").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", F.explode(citations.number_variants(number)).alias("variant"))


def statute_units(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as chapters, nations as articles (numbers k.r), customers as points of them."""
    n = table(spark, sf, "nation")
    none = F.lit(None).cast("string")
    base = lambda kind, uid, parent, number, text, order: [F.lit("x").alias("act"), F.lit(kind).alias("kind"), uid.alias("unit_id"), parent.alias("parent_unit_id"), number.cast("string").alias("number"), text.alias("text"), none.alias("edit_note"), none.alias("duplicate_of"), order.cast("long").alias("ord")]
    chapter = table(spark, sf, "region").select(*base("chapter", F.concat(F.lit("x.ch"), "r_regionkey"), F.lit("x"), F.col("r_regionkey"), F.col("r_name"), F.col("r_regionkey") * 10_000_000))
    part = spark.range(1).select(*base("part", F.lit("x"), none, F.lit("1"), F.lit("t"), F.lit(-1)))
    aid = F.concat(F.lit("x.ch"), "n_regionkey", F.lit(".art"), "n_nationkey")
    article = n.where("n_nationkey % 7 <> 3").select(*base("article", aid, F.concat(F.lit("x.ch"), "n_regionkey"), F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey") * 10_000_000 + F.col("n_nationkey") * 100_000 + 1))
    p = paths(spark, sf)
    point = p.select(*base("point", F.col("unit_id"), H.article_of("unit_id"), F.concat(F.col("c_custkey") % 50, F.when(F.col("c_custkey") % 9 == 0, ".1").otherwise("")), F.when(F.col("c_acctbal") < 0, "").otherwise("text"), F.col("n_regionkey") * 10_000_000 + F.col("n_nationkey") * 100_000 + 10 + F.col("c_custkey")))
    return part.unionByName(chapter).unionByName(article).unionByName(point)


@query(f"""WITH {PATHS}, a AS (SELECT *, lag(n_nationkey) OVER (ORDER BY n_regionkey, n_nationkey) AS p FROM nation WHERE n_nationkey % 7 <> 3),
k AS (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN [c_custkey % 50, 1] ELSE [c_custkey % 50] END AS key FROM paths), q AS (SELECT *, lag(key) OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS p FROM k),
r AS (SELECT 'article_order' AS rule, n_nationkey::VARCHAR AS x FROM a WHERE n_nationkey <= p UNION ALL SELECT 'article_gap', n_nationkey::VARCHAR FROM a WHERE n_nationkey > p + 1
  UNION ALL SELECT 'point_order', unit_id FROM q WHERE key <= p UNION ALL SELECT 'missing_parent', unit_id FROM k WHERE n_nationkey % 7 = 3 UNION ALL SELECT 'empty_text', unit_id FROM k WHERE c_acctbal < 0 UNION ALL SELECT 'fractional_numbers', unit_id FROM k WHERE c_custkey % 9 = 0)
SELECT rule, count(*) AS n FROM r GROUP BY rule""")
def validate_units(spark, sf):
    return validate.validate(statute_units(spark, sf)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT n_nationkey || '.' || n_regionkey AS number, n_nationkey FROM nation), v AS (SELECT DISTINCT n_nationkey, number, unnest([number, replace(number, '.', '-'), replace(number, '.', '')]) AS v FROM u),
c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN number WHEN 1 THEN replace(number, '.', '-') WHEN 2 THEN replace(number, '.', '') ELSE number || '9' END AS x FROM customer JOIN u ON c_nationkey = n_nationkey),
e AS (SELECT c_custkey, min(n_nationkey) AS hit FROM c JOIN u ON x = number GROUP BY c_custkey HAVING count(*) = 1),
cv AS (SELECT DISTINCT c_custkey, unnest([x, replace(x, '.', '-'), replace(x, '.', ''), replace(replace(x, '.', ''), '-', '')]) AS v FROM c),
l AS (SELECT c_custkey, min(n_nationkey) AS hit FROM cv JOIN v USING (v) GROUP BY c_custkey HAVING count(DISTINCT n_nationkey) = 1)
SELECT c.c_custkey, CASE WHEN coalesce(e.hit, l.hit) IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, 'x.art' || coalesce(e.hit, l.hit) AS to_unit_id FROM c LEFT JOIN e USING (c_custkey) LEFT JOIN l USING (c_custkey)""")
def resolve_status(spark, sf):
    none = F.lit(None).cast("string")
    n = table(spark, sf, "nation").withColumn("number", F.concat("n_nationkey", F.lit("."), "n_regionkey"))
    uid = F.concat(F.lit("x.art"), "n_nationkey")
    units = n.select(uid.alias("unit_id"), F.lit("x").alias("parent_unit_id"), F.lit("article").alias("kind"), "number", none.alias("duplicate_of"), none.alias("section_id"), none.alias("chapter_id"), uid.alias("article_id"), none.alias("point_id"), none.alias("subpoint_id"), F.lit(1).alias("ord"))
    k = F.col("c_custkey") % 4
    number = F.when(k == 0, F.col("number")).when(k == 1, F.replace("number", F.lit("."), F.lit("-"))).when(k == 2, F.replace("number", F.lit("."), F.lit(""))).otherwise(F.concat("number", F.lit("9")))
    refs = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lit("x").alias("from_unit_id"), F.lit("internal_citation").alias("kind"), none.alias("section"), none.alias("chapter"), number.alias("article"), none.alias("point"), none.alias("subpoint"), F.lit(None).cast("int").alias("paragraph_ordinal"), none.alias("relative_to"))
    return resolve.resolve(refs, units).select("c_custkey", "status", "to_unit_id")


QUOTE_FORM = r"lower(trim(regexp_replace(translate({}, '«»„“”—– ', '" + '"' * 5 + r"-- '), '\s+', ' ', 'g')))"


@query(
    "WITH d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '  ' || substr(text, 5, 40) WHEN 1 THEN reverse(substr(text, 5, 40)) ELSE '' END AS q FROM documents), "
    f"n AS (SELECT doc_id, {QUOTE_FORM.format('text')} AS t, {QUOTE_FORM.format('q')} AS q FROM d) SELECT doc_id, q <> '' AND contains(t, q) AS held FROM n"
)
def quote_gate(spark, sf):
    k = F.col("doc_id") % 3
    quote = F.when(k == 0, F.concat(F.lit("  "), F.substring("text", 5, 40))).when(k == 1, F.reverse(F.substring("text", 5, 40))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", X.holds_quote(F.col("text"), quote).alias("held"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^\s@<>()\[\],;:"«»]+@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}')) AS emails FROM documents""")
def redact_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.pii_counts("text")["EMAIL"].cast("long").alias("emails"))


@query("SELECT doc_id, text FROM documents")
def redact_round_trip(spark, sf):
    return facts.restore(facts.redact(table(spark, sf, "documents").select("doc_id", "text"))).select("doc_id", "text")


@query(r"""SELECT o_orderkey, (o_custkey % 900 + 1) * 1000.0 AS amount, make_date(2000 + (o_orderkey % 49)::INT, (o_custkey % 12 + 1)::INT, (o_orderkey % 28 + 1)::INT) AS day,
make_date(2001 + (o_orderkey % 20)::INT, ((o_custkey % 4) * 3 + 1)::INT, 1) AS period_start, last_day(make_date(2001 + (o_orderkey % 20)::INT, ((o_custkey % 4) * 3 + 3)::INT, 1)) AS period_end FROM orders""")
def parse_facts(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    money = F.concat((c % 900 + 1), F.lit(" тыс. руб."))
    words = F.element_at(F.array(*map(F.lit, X.MONTHS)), (c % 12 + 1).cast("int"))
    day = F.when(k % 3 == 0, F.concat(k % 28 + 1, F.lit(" "), words, F.lit(" "), 2000 + k % 49, F.lit(" г."))).when(k % 3 == 1, F.concat(k % 28 + 1, F.lit("."), c % 12 + 1, F.lit("."), F.lpad((k % 49).cast("string"), 2, "0"))).otherwise(F.format_string("%04d-%02d-%02d", 2000 + k % 49, c % 12 + 1, k % 28 + 1))
    span = X.period(F.concat(c % 4 + 1, F.lit(" квартал "), 2001 + k % 20))
    return orders(spark, sf).select("o_orderkey", X.amount(money).alias("amount"), X.fact_date(day).alias("day"), span["start"].alias("period_start"), span["end"].alias("period_end"))


@query("""SELECT o_orderkey::VARCHAR AS unit_id, (['repeal', 'replace', 'insert'])[(o_orderkey % 3 + 1)::INT] AS operation, CASE WHEN o_orderkey % 5 = 0 THEN 'child' ELSE 'unit' END AS scope, o_custkey || '-ФЗ' AS law, make_date(2020, 11, (o_custkey % 28 + 1)::INT) AS law_date,
CASE WHEN o_orderkey % 2 = 0 THEN make_date(2021, 1, 1) END AS effective FROM orders""")
def amendment_notes(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    op = F.element_at(F.array(*map(F.lit, ("Утратил силу", "В новой ред.", "Введен"))), (k % 3 + 1).cast("int"))
    child = F.when(k % 5 == 0, F.concat(F.lit("Абзац второй "), F.lower(op))).otherwise(op)
    note = F.concat(F.lit("<"), child, F.when(k % 2 == 0, " с 1 января 2021 г.").otherwise(""), F.lit(": Федеральный закон от "), F.lpad((c % 28 + 1).cast("string"), 2, "0"), F.lit(".11.2020 N "), c, F.lit("-ФЗ>"))
    units = orders(spark, sf).select(k.cast("string").alias("unit_id"), F.lit("point").alias("kind"), note.alias("edit_note"), k.alias("ord"))
    rows = amendments.amendments(units)
    return rows.select(F.col("target_unit_id").alias("unit_id"), "operation", "scope", F.col("amending_act_number").alias("law"), F.col("amending_act_date").alias("law_date"), F.col("effective_date").alias("effective"))


@query(f"SELECT 'u' || o_custkey AS target_unit_id, o_orderkey AS amending_act_number, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate::DATE END AS effective_date FROM orders WHERE o_orderkey % 10 = 0 OR o_orderdate::DATE >= DATE '{DAY}'")
def amendments_since(spark, sf):
    rows = orders(spark, sf).select(F.concat(F.lit("u"), "o_custkey").alias("target_unit_id"), F.col("o_orderkey").alias("amending_act_number"), F.when(F.col("o_orderkey") % 10 > 0, F.col("day")).alias("effective_date"))
    return amendments.since(rows, DAY)


def letters(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("letter", "plenum", "review", "constitutional", "appeal", "other"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", kinds.alias("kind"), (F.col("doc_id") % 4 == 0).alias("mandatory"), F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("doc_id") % 700).cast("int")).alias("date"), "source")


LETTERS = "letters AS (SELECT doc_id, (['letter', 'plenum', 'review', 'constitutional', 'appeal', 'other'])[(doc_id % 6 + 1)::INT] AS kind, doc_id % 4 = 0 AS mandatory, (DATE '2020-01-01' + (doc_id % 700)::INT)::DATE AS date, source FROM documents)"
RANKED = "CASE kind WHEN 'constitutional' THEN 0 WHEN 'review' THEN 1 WHEN 'plenum' THEN 2 WHEN 'appeal' THEN 4 WHEN 'letter' THEN 5 ELSE 9 END"


@query(f"WITH {LETTERS} SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {RANKED}, mandatory DESC, date, doc_id)::INT AS rank FROM letters")
def authority_order(spark, sf):
    return letters(spark, sf).select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy(*interpret.by_authority())).alias("rank"))


@query(f"""WITH {LETTERS}, p AS (SELECT doc_id, 'u' || doc_id % 37 AS unit_id, (['for_taxpayer', 'for_authority', 'neutral', 'none'])[(doc_id % 4 + 1)::INT] AS stance FROM documents), c AS (SELECT 'u' || k AS unit_id, (DATE '2020-06-01' + (k * 10)::INT)::DATE AS d FROM range(37) t(k)),
r AS (SELECT * FROM p JOIN letters USING (doc_id) JOIN c USING (unit_id) WHERE stance <> 'none' AND date <= DATE '2021-06-01')
SELECT unit_id, count(*) FILTER (stance = 'for_taxpayer') AS for_taxpayer, count(*) FILTER (stance = 'for_authority') AS for_authority, count(*) FILTER (stance = 'neutral') AS neutral, first(stance ORDER BY {RANKED}, mandatory DESC, date, doc_id) AS leading,
count(*) FILTER (d <= DATE '2021-06-01' AND date < d) AS older FROM r GROUP BY unit_id""")
def position_map(spark, sf):
    docs = letters(spark, sf)
    positions = docs.select("doc_id", F.concat(F.lit("u"), F.col("doc_id") % 37).alias("unit_id"), F.element_at(F.array(*map(F.lit, ("for_taxpayer", "for_authority", "neutral", "none"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("stance"))
    changes = spark.range(37).select(F.concat(F.lit("u"), "id").alias("unit_id"), F.date_add(F.to_date(F.lit("2020-06-01")), (F.col("id") * 10).cast("int")).alias("effective_date"))
    return interpret.position_map(positions, docs, changes, "2021-06-01").select("unit_id", "for_taxpayer", "for_authority", "neutral", "leading", "older")


@query("""WITH p AS (SELECT 'q' || s_suppkey % 6 AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS region, s_acctbal AS value, (DATE '2020-01-01' + (s_suppkey % 500)::INT)::DATE AS valid_from, s_suppkey FROM supplier),
l AS (SELECT * FROM p WHERE valid_from <= DATE '2021-01-01' QUALIFY row_number() OVER (PARTITION BY name, region ORDER BY valid_from DESC, s_suppkey) = 1), n AS (SELECT n_nationkey AS region, name FROM nation, (SELECT DISTINCT name FROM l))
SELECT n.region, n.name, coalesce(o.value, f.value) AS value, o.value IS NULL AS federal FROM n LEFT JOIN l o ON o.region = n.region AND o.name = n.name LEFT JOIN l f ON f.region IS NULL AND f.name = n.name WHERE coalesce(o.value, f.value) IS NOT NULL""")
def param_region_pref(spark, sf):
    s = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("q"), s % 6).alias("name"), F.when(s % 3 > 0, F.col("s_nationkey")).alias("region"), F.col("s_acctbal").alias("value"), F.date_add(F.to_date(F.lit("2020-01-01")), (s % 500).cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), "s_suppkey")
    one = T.latest(rows.where(T.valid_on("2021-01-01")), ["name", "region"], ties=["s_suppkey"])
    return corpus.regional_preference(one, table(spark, sf, "nation").select(F.col("n_nationkey").alias("region")), "2021-01-01")


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def snapshot_counts(spark, sf):
    return corpus.snapshot({n: table(spark, sf, n) for n in NAMES})


@query("SELECT p_brand AS agency, p_type AS kind, count(*) AS n, max((DATE '2020-01-01' + p_size)::DATE) AS last FROM part GROUP BY ALL")
def documents_by_agency(spark, sf):
    return corpus.documents_by_agency(table(spark, sf, "part").select(F.col("p_brand").alias("agency"), F.col("p_type").alias("kind"), F.date_add(F.to_date(F.lit("2020-01-01")), F.col("p_size")).alias("date")))


ANSWERS = "a AS (SELECT doc_id AS id, doc_id % 3 AS rep, CASE WHEN doc_id % 5 > 0 THEN 't' || doc_id % 4 END AS topic, CASE WHEN doc_id % 9 > 0 THEN quality::DOUBLE END AS p, toxic::DOUBLE AS r, doc_id % 7 AS c, doc_id % 7 // 2 AS h FROM labels)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    none = F.lit(None).cast("double")
    return table(spark, sf, "labels").select(
        k.alias("id"), (k % 3).alias("rep"), F.when(k % 5 > 0, F.concat(F.lit("t"), k % 4)).alias("topic"), F.when(k % 9 > 0, F.col("quality").cast("double")).alias("precision_unit"), F.col("toxic").cast("double").alias("recall_unit"),
        none.alias("precision_article"), none.alias("recall_article"), none.alias("temporal"), none.alias("abstained"), (k % 7).alias("citations"), F.floor((k % 7) / 2).alias("hallucinated"),
    )


@query(f"""WITH {ANSWERS} SELECT coalesce(topic, 'no topic') AS topic, rep, round(avg(p), 9) AS precision_unit, round(avg(r), 9) AS recall_unit, round(CASE WHEN sum(c) <> 0 THEN sum(h) / sum(c) END, 9) AS hallucination_rate, count(*) AS n
FROM (SELECT * REPLACE (coalesce(topic, 'no topic') AS topic) FROM a) GROUP BY GROUPING SETS ((topic), (rep), ())""".replace("coalesce(topic, 'no topic') AS topic, rep, round", "topic, rep, round"))
def eval_metrics(spark, sf):
    out = evaluate.summary(scores(spark, sf))
    return out.select("topic", "rep", *[F.round(c, 9).alias(c) for c in ("precision_unit", "recall_unit", "hallucination_rate")], "n")


@query(f"WITH {ANSWERS}, m AS (SELECT rep, avg(p) AS m FROM a GROUP BY rep) SELECT round(min(m), 9) AS low, round(max(m), 9) AS high, count(*) AS reps FROM m HAVING count(*) >= 2")
def spread(spark, sf):
    return evaluate.spread(scores(spark, sf)).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "reps")


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    kind = F.when(F.col("event_type") == "error", "edition_available").otherwise("unit_text_changed")
    return table(spark, sf, "events").select("event_id", kind.alias("kind"), F.concat(F.lit("x.ch"), u % 5, F.lit(".art"), u % 23, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(".p"), F.col("event_id") % 11)).otherwise("")).alias("unit_id"), F.lit(None).cast("string").alias("doc_id"))


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer")
    return rows.select((c % 13).alias("workspace_id"), F.concat(F.lit("x.ch"), c % 5, F.when(c % 3 > 0, F.concat(F.lit(".art"), c % 23)).otherwise(""), F.when(c % 3 == 2, F.concat(F.lit(".p"), c % 11)).otherwise("")).alias("unit_id"), F.lit(None).cast("string").alias("doc_id")).distinct()


MATCH = r"""e AS (SELECT event_id, 'x.ch' || user_id % 5 || '.art' || user_id % 23 || CASE WHEN event_id % 2 = 0 THEN '.p' || event_id % 11 ELSE '' END AS a FROM events WHERE event_type <> 'error'),
s AS (SELECT DISTINCT c_custkey % 13 AS workspace_id, 'x.ch' || c_custkey % 5 || CASE WHEN c_custkey % 3 > 0 THEN '.art' || c_custkey % 23 ELSE '' END || CASE WHEN c_custkey % 3 = 2 THEN '.p' || c_custkey % 11 ELSE '' END AS b FROM customer), u AS (SELECT DISTINCT a FROM e),
p AS (SELECT a, workspace_id, b FROM u JOIN s ON a = b OR starts_with(a, b || '.') OR starts_with(b, a || '.') OR (contains(b, '.art') AND regexp_extract(a, '^(.*?\.art[^.]+)', 1) = regexp_extract(b, '^(.*?\.art[^.]+)', 1))),
m AS (SELECT workspace_id, event_id, string_agg(DISTINCT b, ',' ORDER BY b) AS matched_by FROM e JOIN p USING (a) GROUP BY ALL)"""


@query(f"WITH {MATCH} SELECT * FROM m")
def event_match(spark, sf):
    return monitor.match_events(stream_events(spark, sf), subscriptions(spark, sf)).select("workspace_id", "event_id", F.array_join("matched_by", ",").alias("matched_by"))


@query(f"WITH {MATCH} SELECT workspace_id, event_id, matched_by, 'open' AS status FROM m")
def monitor_stream(spark, sf):
    here = shared.shared_folder(spark)
    stream_events(spark, sf).withColumn("act_code", F.lit("x")).withColumn("detected_at", F.current_timestamp()).write.parquet(f"{here}/log")
    streams.notify(spark, f"{here}/log", subscriptions(spark, sf), f"{here}/notifications", f"{here}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{here}/notifications").select("workspace_id", "event_id", F.array_join("matched_by", ",").alias("matched_by"), "status")


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    return streams.windowed(table(spark, sf, "events"), "ts", ["event_type"]).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, s""")
def session_windows(spark, sf):
    return streams.sessions(table(spark, sf, "events"), "ts", ["user_id"], "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id AS fact_id, CASE WHEN event_id % 2 = 0 THEN ts::DATE ELSE ts::DATE END AS start, CASE WHEN event_id % 2 = 0 THEN (ts::DATE + 5)::DATE END AS end FROM events WHERE event_type <> 'view'")
def timeline(spark, sf):
    day = F.to_date("ts")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("fact_id"), F.when(F.col("event_type") == "view", "party").when(F.col("event_id") % 2 == 0, "period").otherwise("date").alias("kind"), F.when(F.col("event_id") % 2 == 0, F.concat(day.cast("string"), F.lit(".."), F.date_add(day, 5).cast("string"))).otherwise(day.cast("string")).alias("value"))
    return facts.timeline(rows).select("fact_id", "start", "end")


@query(f"SELECT DISTINCT conv_id AS workspace_id, unnest({TOKENS.format('text')}) AS unit_id FROM conversations")
def explode_sources(spark, sf):
    return monitor.derived_subscriptions(table(spark, sf, "conversations").select(F.col("conv_id").alias("workspace_id"), search.tokens("text").alias("sources")))


@query("SELECT conv_id AS thread_id, count(*) AS n, max(turn) AS last, bool_or(turn = 0 AND length(text) % 2 = 0) AS resolved FROM conversations GROUP BY conv_id")
def thread_rollup(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select(F.when(F.col("turn") == 0, F.col("conv_id")).otherwise(F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), F.when(F.col("turn") > 0, F.col("conv_id")).alias("parent_id"), F.col("turn").alias("at"), (F.length("text") % 2 == 0).alias("resolved"))
    return facts.threads(rows)


@query(f"""WITH {PATHS}, v AS (SELECT o_orderkey % 500 AS doc_id, o_orderkey AS raw, (['OK', 'STALE', 'PART', 'MISS'])[(o_custkey % 4 + 1)::INT] AS verdict, CASE WHEN o_custkey % 4 < 3 THEN unit_id END AS target, o_custkey FROM orders JOIN paths ON c_custkey = o_custkey),
a AS (SELECT unit_id AS target, (DATE '2020-01-01' + (c_custkey % 900)::INT)::DATE AS d FROM paths), {LETTERS},
s AS (SELECT v.doc_id, CASE WHEN verdict = 'OK' AND a.d > l.date AND a.d <= DATE '2022-01-01' THEN 'outdated' ELSE lower(CASE verdict WHEN 'PART' THEN 'partial' WHEN 'MISS' THEN 'missing' ELSE verdict END) END AS status FROM v LEFT JOIN a USING (target) LEFT JOIN letters l ON l.doc_id = v.doc_id)
SELECT doc_id, status, count(*) AS n FROM s GROUP BY ALL""")
def audit_status(spark, sf):
    p = paths(spark, sf)
    k = F.col("o_custkey") % 4
    verified = orders(spark, sf).join(p, F.col("c_custkey") == F.col("o_custkey")).select((F.col("o_orderkey") % 500).alias("doc_id"), F.col("o_orderkey").cast("string").alias("raw"), F.element_at(F.array(*map(F.lit, ("OK", "STALE", "PART", "MISS"))), (k + 1).cast("int")).alias("verdict"), F.when(k < 3, F.col("unit_id")).alias("to_unit_id"))
    changes = p.select(F.col("unit_id").alias("target_unit_id"), F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("c_custkey") % 900).cast("int")).alias("effective_date"))
    docs = letters(spark, sf).withColumn("status", F.lit("actual"))
    none = docs.where("false").select("doc_id", F.lit("").alias("raw"), F.lit("").alias("number"), "date", F.col("doc_id").cast("string").alias("found"))
    edges = docs.where("false").select(F.col("doc_id"), F.lit("").alias("unit_id"))
    return evaluate.audit_counts(evaluate.audit(verified, none, docs, changes, edges, "2022-01-01"))


@query("""WITH f AS (SELECT c_custkey, c_acctbal AS v, c_name FROM customer WHERE c_custkey % 10 <> 1), s AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v, c_name FROM customer WHERE c_custkey % 10 <> 2)
SELECT f.c_custkey, CASE WHEN s.c_custkey IS NULL THEN 'added' WHEN f.v <> s.v THEN 'changed' ELSE 'same' END AS sync FROM f LEFT JOIN s USING (c_custkey)""")
def workspace_mirror(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), "c_name")
    stored = c.where("c_custkey % 10 <> 2").withColumn("v", F.when(F.col("c_custkey") % 6 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return facts.mirror(stored, c.where("c_custkey % 10 <> 1"), ["c_custkey"]).select("c_custkey", "sync")


@query("SELECT o.* FROM orders o ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40) d ON o_orderkey = l_orderkey")
def incremental_resume(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return readers.missing(table(spark, sf, "orders"), done, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 < 3 GROUP BY s_nationkey HAVING count(*) > 0) AND (c_nationkey % 2 = 0)")
def access_filter(spark, sf):
    s = F.col("s_suppkey")
    members = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("slug"), F.when(F.col("s_nationkey") % 2 == 0, "a@x").otherwise("b@x").alias("email"), F.element_at(F.array(*map(F.lit, ("editor", "owner", "editor", "viewer", "viewer"))), (s % 5 + 1).cast("int")).alias("role"))
    rows = orders(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", F.col("c_nationkey").alias("slug"))
    return facts.visible(rows, members, "a@x", "editor").select("o_orderkey", "o_custkey")


@query(r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS t FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/?p|/?div|/?li|/?h[1-6]|/?tr|/?table|/?ul|/?ol)(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&laquo;', '«'), '&raquo;', '»'), '&mdash;', '—'), '&amp;', '&') AS t FROM c)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{2,}', chr(10), 'g'), ' ') AS text FROM d""")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_text("html").alias("text"))


_ENTITIES = """replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&laquo;', '«'), '&raquo;', '»'), '&mdash;', '—'), '&amp;', '&')"""


@query(rf"""WITH s AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS t FROM pages),
m AS (SELECT page_id, string_split(regexp_replace(regexp_replace(t, '(?i)<p(\s[^>]*)?>', chr(1) || 'open\1' || chr(2), 'g'), '(?i)</p(\s[^>]*)?>', chr(1), 'g'), chr(1)) AS l FROM s),
p AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM m), b AS (SELECT page_id, i, lower(split_part(x, chr(2), 1)) AS head, split_part(x, chr(2), 2) AS body FROM p WHERE x LIKE 'open%'),
c AS (SELECT page_id, i, contains(head, 'center') AS centred, regexp_replace(regexp_replace(body, '(?i)<(?:br|/?p|/?div|/?li|/?h[1-6]|/?tr|/?table|/?ul|/?ol)(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM b),
d AS (SELECT page_id, i, centred, trim(regexp_replace({_ENTITIES.format('t')}, '[\s\x{{A0}}]+', ' ', 'g'), ' ') AS block FROM c)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS n, block, centred FROM d WHERE block <> ''""")
def html_blocks(spark, sf):
    return readers.html_blocks(table(spark, sf, "pages"), "page_id")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.variant_get(facts.json_block("props"), "$.k", "long").alias("k"))


@query("""WITH t AS (SELECT 'u' || l_suppkey AS unit_id, sha256(l_partkey::VARCHAR) AS h FROM lineitem), o AS (SELECT unit_id, max(h) AS h FROM t GROUP BY unit_id), n AS (SELECT unit_id, min(h) AS h FROM t GROUP BY unit_id)
SELECT unit_id, 'unit_text_changed' AS kind FROM o JOIN n USING (unit_id) WHERE o.h <> n.h""")
def unit_change_events(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("u"), "l_suppkey").alias("unit_id"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("h"))
    state = lambda f: rows.groupBy("unit_id").agg(f("h").alias("text_hash")).withColumn("in_force", F.lit(True))
    return monitor.unit_changes(state(F.max), state(F.min)).select("unit_id", "kind")
