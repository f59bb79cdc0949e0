"""Registered queries of stems, stored indexes, dated versions, digests and loads that change as one.

Stores lie in the shared folder, one a session and table folder, so that queries over one index build it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions import stemming as S
from lexgrove.operators import corpus, index, vector_index, versions
from lexgrove.plans import statute_queries as Q
from lexgrove.plans.queries import BM25, QUESTION, TERMS, TOKENS, VECTOR, query, table
from lexgrove.plans.service_queries import said
from lexgrove.sources import archive, shared
from lexgrove.sources.store import Store
from lexgrove.streaming import state

_BUILT: dict[tuple, Store] = {}


def built(spark: SparkSession, sf: str, name: str, build) -> Store:
    """The store of this session and folder, made by build(store) at its first use, and again where it is gone."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BUILT or not _BUILT[key].versions():
        store = Store(spark, shared.shared_folder(spark))
        build(store)
        _BUILT[key] = store
    return _BUILT[key]


# stems

BASES = ("налог", "стоим", "важн", "плат", "организац", "пенсион", "обязан", "возвра", "прочит", "сдел", "доход", "льгот", "учет", "отчетн", "расход", "имуществ", "процент", "период", "ставк", "вычет", "расстро", "решен", "удостовер", "тол")
ENDINGS = tuple(sorted({"", "ько", "ённый", "ностью", "остями", "ость", "ейшие", "ившиеся", "ющемуся", "авшись", "янный", "аемость", *" ".join((S.GERUND_LED, S.GERUND, S.REFLEXIVE, S.ADJECTIVE, S.PARTICIPLE, S.VERB_LED, S.VERB, S.NOUN, S.DERIVATIONAL, S.SUPERLATIVE)).split()}))
_ADJ, _NOUN, _REFL, _SUP = (S.ending(x).replace("()", "") for x in (S.ADJECTIVE, S.NOUN, S.REFLEXIVE, S.SUPERLATIVE))
WORDS = f"(SELECT o_orderkey, o_custkey, ({list(BASES)!r})[(o_orderkey % {len(BASES)} + 1)::INT] || ({list(ENDINGS)!r})[(o_orderkey // {len(BASES)} % {len(ENDINGS)} + 1)::INT] AS word FROM orders)"
STEMMED = f"""s0 AS (SELECT *, replace(word, 'ё', 'е') AS w FROM {WORDS}), s1 AS (SELECT *, regexp_extract(w, '{S.HEAD}') AS head FROM s0), s2 AS (SELECT *, substr(w, length(head) + 1) AS rv FROM s1),
s3 AS (SELECT *, regexp_replace(rv, '{_REFL}', '') AS x FROM s2),
s4 AS (SELECT *, CASE WHEN regexp_matches(rv, '{S.GERUNDS}') THEN regexp_replace(rv, '{S.GERUNDS}', '\\1') WHEN regexp_matches(x, '{_ADJ}') THEN regexp_replace(regexp_replace(x, '{_ADJ}', ''), '{S.PARTICIPLES}', '\\1')
  WHEN regexp_matches(x, '{S.VERBS}') THEN regexp_replace(x, '{S.VERBS}', '\\1') ELSE regexp_replace(x, '{_NOUN}', '') END AS y FROM s3),
s5 AS (SELECT *, substr(regexp_replace(head || regexp_replace(y, 'и$', ''), '{S.DERIVED}', '\\1'), length(head) + 1) AS z FROM s4), s6 AS (SELECT *, regexp_replace(z, '{_SUP}', '') AS short FROM s5),
stems AS (SELECT o_orderkey, o_custkey, word, w, CASE WHEN head = '' THEN w WHEN short LIKE '%нн' THEN head || regexp_replace(short, 'н$', '') WHEN short <> z THEN head || short ELSE head || regexp_replace(z, 'ь$', '') END AS stem,
  list_contains({list(S.STOP_WORDS)!r}, w) AS stop FROM s6)"""


def order_words(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(pick(BASES, k), pick(ENDINGS, F.floor(k / len(BASES)))).alias("word"))


@query(f"WITH {STEMMED} SELECT o_orderkey, word, stem, stop FROM stems")
def stem_terms(spark, sf):
    return order_words(spark, sf).select("o_orderkey", "word", S.stem(F.col("word")).alias("stem"), (F.size(S.kept(S.words("word"))) == 0).alias("stop"))


ASKED_RUSSIAN = "Организации и доходами по льготам, обязанностей только налогового"


def customer_texts(spark: SparkSession, sf: str) -> DataFrame:
    """c, text: a customer's words in order of its orders."""
    words = order_words(spark, sf).groupBy(F.col("o_custkey").alias("c")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "word"))).alias("l"))
    return words.select("c", F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("text"))


@query(f"""WITH {STEMMED}, d AS (SELECT o_custkey AS c, list(stem ORDER BY o_orderkey) FILTER (NOT stop) AS t FROM stems GROUP BY o_custkey), s AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS a FROM d),
tf AS (SELECT c, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (SELECT unnest(['организац', 'доход', 'льгот', 'обязан', 'налогов']) AS term)), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)
SELECT c, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score, count(*) AS matched FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY c""")
def stemmed_search(spark, sf):
    """A Russian question over a stored index of stems; stop words are asked for by nobody."""
    store = built(spark, sf, "stems", lambda s: index.InvertedIndex(s, index.stemmed).add(customer_texts(spark, sf), "c"))
    found = index.InvertedIndex(store, index.stemmed)
    return found.bm25(sorted(set(found.analysed(ASKED_RUSSIAN)))).select(F.col("key").alias("c"), F.round("score", 6).alias("score"), "matched")


# the inverted index


def documents_index(spark: SparkSession, sf: str) -> index.InvertedIndex:
    return index.InvertedIndex(built(spark, sf, "documents", lambda s: index.InvertedIndex(s).add(table(spark, sf, "documents"), "doc_id")))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score, matched FROM bm")
def indexed_bm25(spark, sf):
    """The rows of bm25 from the buckets of the asked terms."""
    return documents_index(spark, sf).bm25(TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "matched")


@query(f"""WITH {BM25}, g AS (SELECT doc_id, matched = {len(TERMS)} AS strict, CASE WHEN matched = {len(TERMS)} THEN score ELSE score / (score + 1) END AS score FROM bm)
SELECT doc_id, CASE WHEN strict THEN 'strict' ELSE 'loose' END AS pass, round(score, 6) AS score, row_number() OVER (ORDER BY strict DESC, round(score, 9) DESC, doc_id) AS rank FROM g QUALIFY rank <= 40""")
def indexed_two_pass(spark, sf):
    return documents_index(spark, sf).two_pass(QUESTION, 40).select(F.col("key").alias("doc_id"), "pass", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), n AS (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS occurrences FROM t)
SELECT doc_id, occurrences::INT AS occurrences FROM n WHERE occurrences > 0""")
def indexed_phrase(spark, sf):
    return documents_index(spark, sf).phrase("Of the").select(F.col("key").alias("doc_id"), "occurrences")


@query(f"""WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN text || ' the tion' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0), {BM25} SELECT doc_id, round(score, 6) AS score, matched FROM bm""")
def index_after_changes(spark, sf):
    """Documents indexed again with other texts, some taken out, the batches folded: what a fresh index would find."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    store = Store(spark, shared.shared_folder(spark))
    found = index.InvertedIndex(store, buckets=8)
    found.add(docs.where("doc_id % 5 <> 2"), "doc_id")
    found.add(docs.where("doc_id % 5 in (1, 2)").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" the tion"))).otherwise(F.col("text"))), "doc_id")
    found.remove(docs.where("doc_id % 5 = 0"), "doc_id")
    found.compact()
    return found.bm25(TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "matched")


# the vector index

PROBED = 0.8  # share of the cells that a search reads; the given vectors have no cells of their own


@query(f"SELECT true AS recall_at_10, count(*) AS asked FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, sf):
    """Whether probing finds nine in ten of the exact ten nearest of every vector whose id is divisible by 100."""
    rows = table(spark, sf, "embeddings")
    found = vector_index.VectorIndex(built(spark, sf, "vectors", lambda s: vector_index.VectorIndex(s).build(rows, "vec_id")))
    hits = found.recall(rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, max(1, round(PROBED * len(found.centres()))))
    return hits.agg((F.sum("hits") >= 0.9 * 10 * F.count(F.lit(1))).alias("recall_at_10"), F.count(F.lit(1)).alias("asked"))


@query(f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS e FROM embeddings WHERE vec_id % 11 <> 0),
s AS (SELECT vec_id, list_cosine_similarity(e::DOUBLE[], {VECTOR}::DOUBLE[]) AS score FROM v) SELECT vec_id, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 40""")
def vector_index_updates(spark, sf):
    """Stale vectors replaced and those of unknown units taken out, then the exact way over all cells."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = vector_index.VectorIndex(Store(spark, shared.shared_folder(spark)))
    found.build(rows, "vec_id", cells=16)
    found.put(rows.where("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), "vec_id")
    found.keep_only(rows.where("vec_id % 11 <> 0"), "vec_id")
    return found.exact(VECTOR, 40).select(F.col("key").alias("vec_id"), F.round("score", 5).alias("score"), "rank")


# dated versions

DAY_A, DAY_B = "1997-06-01", "1999-06-01"


def listed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """unit_id, text, valid_from, valid_to: a customer's list of orders in two versions, the second from 1998 on."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("unit_id"), "o_orderkey", said("order ", "$o_orderkey", " of ", "$o_orderpriority").alias("line"), F.to_date("o_orderdate").alias("day"))
    lines = lambda when: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("o_orderkey", "line")))), lambda x: x["line"]), "\n")
    one = o.groupBy("unit_id").agg(lines(F.col("day") < "1997-01-01").alias("a"), lines(F.col("day") >= "1995-01-01").alias("b"))
    version = lambda c, start, end: one.where(F.col(c) != "").select("unit_id", F.col(c).alias("text"), F.lit(start).cast("date").alias("valid_from"), F.lit(end).cast("date").alias("valid_to"))
    return version("a", "1990-01-01", "1998-01-01").unionByName(version("b", "1998-01-01", None))


LISTED = """o AS (SELECT 'c' || o_custkey AS unit_id, o_orderkey, 'order ' || o_orderkey || ' of ' || o_orderpriority AS line, o_orderdate::DATE AS day FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY o_orderkey)::INT AS at FROM o WHERE day < DATE '1997-01-01'), b AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY o_orderkey)::INT AS at FROM o WHERE day >= DATE '1995-01-01'),
d AS (SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, CASE WHEN b.line IS NULL THEN '-' WHEN a.line IS NULL THEN '+' ELSE '=' END AS op, a.at AS line_before, b.at AS line_after, coalesce(a.line, b.line) AS line FROM a FULL JOIN b USING (unit_id, o_orderkey)),
x AS (SELECT * FROM d WHERE unit_id IN (SELECT unit_id FROM d WHERE op <> '='))"""


@query(f"WITH {LISTED} SELECT unit_id, op, line_before, line_after, line FROM x")
def version_diff(spark, sf):
    """Aligned lines of every customer's list on two days."""
    return versions.version_diff(listed_orders(spark, sf), DAY_A, DAY_B).select("unit_id", "op", "line_before", "line_after", "line")


@query(f"WITH {LISTED} SELECT unit_id, string_agg(line, chr(10) ORDER BY line_after) FILTER (line_after IS NOT NULL) AS text FROM x WHERE line_after IS NOT NULL GROUP BY unit_id")
def diff_replay(spark, sf):
    """Replaying a diff gives the second text."""
    return versions.replayed(versions.version_diff(listed_orders(spark, sf), DAY_A, DAY_B), "unit_id")


@query(f"""WITH {LISTED}, l AS (SELECT unit_id, count(*) FILTER (op = '-') AS removed, count(*) FILTER (op = '+') AS added FROM x GROUP BY unit_id),
n AS (SELECT 'c' || l_suppkey AS unit_id, count(DISTINCT l_partkey) AS documents FROM lineitem WHERE l_shipdate::DATE > DATE '{DAY_A}' AND l_shipdate::DATE <= DATE '{DAY_B}' AND l_linenumber = 1 GROUP BY ALL)
SELECT unit_id, removed, added, coalesce(documents, 0) AS documents FROM l LEFT JOIN n USING (unit_id)""")
def changed_since(spark, sf):
    """Changed units with the documents on them that are dated between the two days."""
    items = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.concat_ws(":", "l_partkey", F.to_date("l_shipdate")).alias("doc_id"), "l_partkey", F.concat(F.lit("c"), "l_suppkey").alias("unit_id"), F.to_date("l_shipdate").alias("date"))
    edges = items.select(F.col("l_partkey").cast("string").alias("doc_id"), "unit_id", "date")
    between = edges.where(f"date > date'{DAY_A}' and date <= date'{DAY_B}'")
    documents = between.groupBy("doc_id").agg(F.max("date").alias("date"))
    return versions.changed_since(listed_orders(spark, sf), between, documents, DAY_A, DAY_B)


LAW_TEXTS = f"""{Q.UNITS}, q AS (SELECT * FROM f WHERE substr(act, 4)::INT % 5 <> 0),
base AS (SELECT unit_id, text, DATE '2020-01-01' AS valid_from, CASE WHEN unit_id IN (SELECT art || '.p1' FROM f WHERE k % 2 = 0) THEN DATE '2030-01-01' END AS valid_to FROM u WHERE kind <> 'paragraph'),
later AS (SELECT art || '.p1' AS unit_id, 'Later point ' || k || '.' AS text, DATE '2030-01-01' AS valid_from, NULL::DATE AS valid_to FROM f WHERE k % 2 = 0),
own AS (SELECT art || '.p1' AS unit_id, 'Point number one of ' || k || '.' AS text, CASE WHEN k % 2 = 0 THEN DATE '2030-01-01' END AS valid_to FROM q WHERE k % 3 = 1 UNION ALL SELECT art || '.p9', 'New point ' || k || '.', NULL FROM q WHERE k % 3 = 2),
above AS (SELECT act AS unit_id FROM q UNION SELECT ch FROM q UNION SELECT art FROM q UNION SELECT art || '.p1' FROM q WHERE k % 3 = 0),
ended AS (SELECT unit_id FROM own UNION SELECT unit_id FROM above UNION SELECT art || '.p1.sp2' FROM q WHERE k % 3 = 0)"""


def dated_texts(spark: SparkSession, sf: str, parsed: DataFrame) -> DataFrame:
    """Every unit from 2020 on; the first point of every other article has a version from 2030 on, too."""
    day = lambda d: F.lit(d).cast("date")
    two = Q.articles(spark, sf).where("k % 7 <> 0 and k % 2 = 0").select(F.concat("act", F.lit(".ch"), "c", F.lit(".art"), "k", F.lit(".p1")).alias("unit_id"), F.concat(F.lit("Later point "), "k", F.lit(".")).alias("text"))
    first = parsed.where("kind <> 'paragraph'").select("unit_id", "text").join(two.select("unit_id", F.lit(True).alias("two")), "unit_id", "left")
    return first.select("unit_id", "text", day("2020-01-01").alias("valid_from"), F.when(F.col("two"), day("2030-01-01")).alias("valid_to")).unionByName(two.select("unit_id", "text", day("2030-01-01").alias("valid_from"), day(None).alias("valid_to")))


def dated_laws(spark: SparkSession, sf: str) -> DataFrame:
    """The laws of apply_patches from 2027 on; those of every fifth act name no day."""
    return Q.laws(spark, sf).withColumn("effective", F.when(F.substring("act", 4, 9).cast("int") % 5 != 0, F.lit("2027-01-01").cast("date")))


@query(f"""WITH {LAW_TEXTS} SELECT unit_id, text, valid_from, CASE WHEN unit_id IN (SELECT unit_id FROM ended) THEN DATE '2027-01-01' ELSE valid_to END AS valid_to, NULL AS change FROM base UNION ALL SELECT *, NULL FROM later
UNION ALL SELECT unit_id, text, DATE '2027-01-01', valid_to, 'own' FROM own UNION ALL SELECT unit_id, text, DATE '2027-01-01', valid_to, 'ancestor' FROM base JOIN above USING (unit_id)""")
def apply_law_versions(spark, sf):
    """Closed, new and ancestor versions of every unit that a law reaches, later ones kept."""
    parsed = shared.written(Q.units(spark, sf))
    after, _ = versions.apply_law_versions(parsed, dated_texts(spark, sf, parsed), dated_laws(spark, sf))
    return after.select("unit_id", "text", "valid_from", "valid_to", "change")


@query(f"""WITH {Q.UNITS}, i AS (SELECT act, k, 'ok' AS status, CASE k % 3 WHEN 1 THEN 'replace_words' WHEN 2 THEN 'insert_unit' ELSE 'repeal' END AS operation FROM f UNION ALL SELECT act, k, 'failed', 'delete_words' FROM f WHERE k % 4 = 0)
SELECT act, CASE WHEN substr(act, 4)::INT % 5 = 0 THEN 'queued' ELSE status END AS status, operation, count(*) AS n FROM i GROUP BY ALL""")
def law_outcomes(spark, sf):
    """What was applied, what failed and what waits for a day."""
    parsed = shared.written(Q.units(spark, sf))
    _, outcomes = versions.apply_law_versions(parsed, dated_texts(spark, sf, parsed), dated_laws(spark, sf), dry_run=True)
    return outcomes.groupBy("act", "status", "operation").agg(F.count(F.lit(1)).alias("n"))


# digests

_CELLS = ", ".join(f"'=' || {c}" for c in ("l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_returnflag"))
_SUMS = ", ".join(f"(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT::HUGEINT) % {versions.PRIME})::BIGINT AS sum{i}, bit_xor(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) AS xor{i}" for i in range(versions.WORDS))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")


@query(f"WITH h AS (SELECT (l_orderkey % 64)::VARCHAR AS part, md5(concat_ws(chr(31), {_CELLS})) AS h FROM lineitem) SELECT part, count(*) AS n, {_SUMS} FROM h GROUP BY part UNION ALL SELECT 'all', count(*) AS n, {_SUMS} FROM h")
def snapshot_digest(spark, sf):
    """Order-free digests of 64 parts of a table, and the whole from theirs."""
    parts = versions.digest(items(spark, sf), F.col("l_orderkey") % 64)
    return parts.unionByName(versions.rolled_up(parts).withColumn("part", F.lit("all")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 1 THEN 'removed' WHEN o_orderkey % 1009 = 2 THEN 'added' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 1009 BETWEEN 1 AND 3""")
def snapshot_differences(spark, sf):
    """Rows that differ between two states, compared only in the parts whose digests differ."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = o.where("o_orderkey % 1009 <> 2")
    after = o.where("o_orderkey % 1009 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 1009 == 3, F.lit("changed")).otherwise(F.col("o_orderstatus")))
    return versions.changed_rows(before, after, F.col("o_orderkey") % 256, "o_orderkey")


# loads that change as one


def act_state(spark: SparkSession, sf: str, act: str, later: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units, texts and references of one act: customers by parity; the later state changes, drops and adds some."""
    c = table(spark, sf, "customer").where(f"c_custkey % 2 = {'AB'.index(act)}").select("c_custkey", said("text ", "$c_custkey").alias("text"))
    if later:
        changed = c.where("c_custkey % 14 <> 0").withColumn("text", F.when(F.col("c_custkey") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
        c = changed.unionByName(c.where("c_custkey % 22 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    units = c.select(said(f"{act}.art", "$c_custkey").alias("unit_id"), "text", "c_custkey")
    texts = units.select("unit_id", "text", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("text_hash"))
    none = F.lit(None).cast("string")
    other = said(f"{'BA'['AB'.index(act)]}.art", F.col("c_custkey") + 1)
    return units.select("unit_id"), texts, units.select(F.col("unit_id").alias("from_unit_id"), none.alias("to_unit_id"), other.alias("pending"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), a AS (SELECT k, 'A.art' || k AS u FROM c WHERE k % 2 = 0), b AS (SELECT k, 'B.art' || k AS u FROM c WHERE k % 2 = 1),
kept AS (SELECT k, u FROM a WHERE k % 14 <> 0), fresh AS (SELECT k + 1000000 AS k, 'A.art' || (k + 1000000) AS u FROM a WHERE k % 22 = 0), now AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh UNION ALL SELECT * FROM b),
r AS (SELECT u, 'B.art' || (k + 1) AS t FROM kept UNION ALL SELECT u, 'B.art' || (k + 1) FROM fresh UNION ALL SELECT u, 'A.art' || (k + 1) FROM b)
SELECT 'event' AS what, u AS unit_id, CASE WHEN k % 14 = 0 THEN 'unit_repealed' ELSE 'unit_text_changed' END AS detail FROM a WHERE k % 14 = 0 OR k % 10 = 0 UNION ALL SELECT 'event', u, 'unit_added' FROM fresh UNION ALL SELECT 'event', u, 'unit_added' FROM b WHERE false
UNION ALL SELECT 'archive', u, 'text ' || k FROM a WHERE k % 14 = 0 OR k % 10 = 0
UNION ALL SELECT 'resolved', u, t FROM r WHERE t IN (SELECT u FROM now) UNION ALL SELECT 'pending', u, t FROM r WHERE t NOT IN (SELECT u FROM now)
UNION ALL SELECT 'version 2', u, 'text ' || k FROM a UNION ALL SELECT 'version 2', u, 'text ' || k FROM b""")
def reload_versions(spark, sf):
    """Two acts loaded and one loaded again: events, archived texts and links of the last version, texts of the one before."""
    store = Store(spark, shared.shared_folder(spark))
    for act, later, day in (("A", False, "2024-01-01"), ("B", False, "2024-02-01"), ("A", True, "2025-01-01")):
        corpus.reload_act(store, act, *act_state(spark, sf, act, later), day)
    row = lambda d, what, detail, unit="unit_id": d.select(F.lit(what).alias("what"), F.col(unit).alias("unit_id"), F.col(detail).alias("detail"))
    links = store.read("reference")
    out = row(store.read("corpus_event").where("act = 'A'"), "event", "kind").unionByName(row(store.read("unit_text_archive"), "archive", "text"))
    out = out.unionByName(row(links.where("to_unit_id is not null"), "resolved", "to_unit_id", "from_unit_id")).unionByName(row(links.where("to_unit_id is null"), "pending", "pending", "from_unit_id"))
    return out.unionByName(row(store.read("unit_text", 2), "version 2", "text"))


# streams


@query("""WITH t AS (SELECT 'u' || l_suppkey AS unit_id, l_linenumber AS n, sha256(max(l_partkey)::VARCHAR) AS h FROM lineitem GROUP BY ALL), a AS (SELECT * FROM t WHERE n = 5), b AS (SELECT * FROM t WHERE n = 6), c AS (SELECT * FROM t WHERE n = 7),
d AS (SELECT 2 AS load, coalesce(a.unit_id, b.unit_id) AS unit_id, a.h AS old, b.h AS new FROM a FULL JOIN b ON a.unit_id = b.unit_id UNION ALL SELECT 3, coalesce(b.unit_id, c.unit_id), b.h, c.h FROM b FULL JOIN c ON b.unit_id = c.unit_id)
SELECT load, CASE WHEN old IS NULL THEN 'unit_added' WHEN new IS NULL THEN 'unit_repealed' ELSE 'unit_text_changed' END AS kind, unit_id FROM d WHERE old IS DISTINCT FROM new""")
def unit_event_stream(spark, sf):
    """Three loads stream in; the stream is stopped after the first and goes on from its checkpoint."""
    here = shared.shared_folder(spark)
    lines = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("u"), "l_suppkey").alias("unit_id"), "l_linenumber").agg(F.sha2(F.max("l_partkey").cast("string"), 256).alias("text_hash"))
    loads = [lines.where(F.col("l_linenumber") == n).select("unit_id", "text_hash", F.lit(True).alias("in_force")) for n in (5, 6, 7)]
    for n, now in enumerate(loads, 1):
        state.load_rows(loads[n - 2] if n > 1 else None, now, n).write.mode("append").parquet(f"{here}/loads")
        if n != 2:
            state.unit_events(spark, f"{here}/loads", f"{here}/events", f"{here}/checkpoint")
    return spark.read.schema(state.EVENTS).parquet(f"{here}/events")


@query("SELECT page_id, url, md5(html) AS digest, DATE '2024-01-01' + (page_id % 12)::INT AS day FROM pages WHERE page_id % 12 >= 3")
def archived_pages(spark, sf):
    """A stored archive of pages by day, read through the data source with the days pushed."""
    archive.register(spark)
    here = shared.shared_folder(spark)
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 12).cast("int"))
    table(spark, sf, "pages").select("page_id", "url", "html", day.alias("day")).write.partitionBy("day").json(f"{here}/pages")
    rows = spark.read.format("page_archive").load(f"{here}/pages").where("day >= date'2024-01-04'")
    return rows.select("page_id", "url", F.md5("html").alias("digest"), "day")
