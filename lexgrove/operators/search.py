"""Lexical, dense and fused search with explanations; every ranking ends with the key, so ties are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Abbreviations of queries, BM25 parameters, field weights, fusion constant.
ABBREVIATIONS = {"ндс": "налог на добавленную стоимость", "ндфл": "налог на доходы физических лиц", "нк рф": "налоговый кодекс", "усн": "упрощенная система налогообложения", "енс": "единый налоговый счет", "енп": "единый налоговый платеж", "ип": "индивидуальный предприниматель", "кнп": "камеральная налоговая проверка", "внп": "выездная налоговая проверка", "фнс": "федеральная налоговая служба"}
K1, B, TEXT_WEIGHT, CONTEXT_WEIGHT = 1.2, 0.75, 1.0, 0.4
RRF_K, DEPTH, STEM = 60, 30, 5
PLACES = 9


def tokens(text: str | Column) -> Column:
    """Lower-case letter and digit runs, ё as е."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def stems(text: str | Column) -> Column:
    """Distinct five-letter stems of words longer than two letters."""
    return F.array_distinct(F.transform(F.filter(tokens(text), lambda w: F.length(w) > 2), lambda w: F.substring(w, 1, STEM)))


def expand_query(query: str) -> str:
    """The query with the phrases of its abbreviations added."""
    words = query.lower().split()
    return " ".join([query, *(full for short, full in ABBREVIATIONS.items() if all(w in words for w in short.split()))])


def lexical(docs: DataFrame, query: str, k: int = 10, key: str = "unit_id", text: str = "text") -> DataFrame:
    """key, score, rank: distinct stem hits / (1 + length / 4000)."""
    asked = stems(F.lit(query))
    hits = F.size(F.array_intersect(stems(text), asked))
    # the explosion of one number or none keeps the hits from being computed again for the filter and the score
    found = docs.select(key, F.length(text).alias("__length"), F.explode(F.filter(F.array(hits), lambda h: h > 0)).alias("hits"))
    scored = found.select(key, (F.col("hits") / (1 + F.col("__length") / 4000)).alias("score"), "hits")
    return ranked(scored, key, k)


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The best k rows with their rank; only k rows meet in the ranking window."""
    best = scored.orderBy(F.col("score").desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), key)))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, dl (terms in the document)."""
    split = docs.select(key, tokens(text).alias("__t"))
    return split.select(key, F.size("__t").alias("dl"), F.explode("__t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, terms: list[str], key: str = "unit_id", text: str = "text") -> DataFrame:
    """key, score, matched (terms found) over the documents that hold any of the terms.

    Corpus figures come from one aggregate; only postings of the asked terms are shuffled.
    """
    split = docs.select(key, tokens(text).alias("__t")).withColumn("dl", F.size("__t"))
    stats = split.agg(F.count(F.lit(1)).alias("__n"), F.avg("dl").alias("__avg"))
    asked = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    held = split.select(key, "dl", F.explode(F.filter("__t", lambda t: F.array_contains(asked, t))).alias("term"))
    tf = held.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per asked term
    row = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("__avg")))
    return row.groupBy(key).agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("matched"))


def two_pass(docs: DataFrame, query: str, k: int = 10, key: str = "unit_id", text: str = "text", context: str | None = None) -> DataFrame:
    """key, pass (strict, loose), score, rank: documents with every term first, then those with any, up to k.

    The loose score r is shown as r / (r + 1). Text weighs 1.0 and context 0.4. Ranks go by scores of ``PLACES`` decimals: the
    order in which a sum meets its terms shows in the last bits, which would settle ties before the key does.
    """
    terms = sorted({t for t in query.lower().replace("ё", "е").split()})
    found = bm25(docs, terms, key, text).select(key, (F.col("score") * TEXT_WEIGHT).alias("score"), "matched")
    if context:
        other = bm25(docs, terms, key, context).select(key, (F.col("score") * CONTEXT_WEIGHT).alias("score"), "matched")
        found = found.unionByName(other).groupBy(key).agg(F.sum("score").alias("score"), F.max("matched").alias("matched"))
    strict = F.col("matched") == len(terms)
    graded = found.withColumn("pass", F.when(strict, "strict").otherwise("loose")).withColumn("score", F.when(strict, F.col("score")).otherwise(F.col("score") / (F.col("score") + 1)))
    order = [(F.col("pass") == "strict").desc(), F.round("score", PLACES).desc(), F.col(key)]
    best = graded.orderBy(*order).limit(k)
    return best.select(key, "pass", "score", F.row_number().over(W.orderBy(*order)).alias("rank"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(vectors: DataFrame, query: list[float], k: int = 10, key: str = "unit_id", vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """key, score, rank by cosine; the allowed set filters before the top k is taken."""
    rows = vectors if allowed is None else vectors.join(allowed.select(key).distinct(), key, "left_semi")
    return ranked(rows.select(key, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score")), key, k)


def fuse(lists: dict[str, DataFrame], key: str = "unit_id", k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: key, score, sources, rank."""
    rows = None
    for name, ranking in sorted(lists.items()):
        part = ranking.select(key, F.lit(name).alias("source"), F.col("rank"))
        rows = part if rows is None else rows.unionByName(part)
    one = rows.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))
    return ranked(one, key, k)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, embedded: list[float], k: int = 10, key: str = "unit_id", text: str = "text", rerank=None) -> DataFrame:
    """Lexical and dense lists of depth 30 fused; an optional reranker maps (key, text) rows to scores."""
    out = fuse({"lexical": lexical(docs, query, DEPTH, key, text), "dense": dense(vectors, embedded, DEPTH, key)}, key, DEPTH)
    if rerank is not None:
        scores = rerank(out.join(docs.select(key, F.col(text).alias("text")), key))
        out = ranked(out.drop("score", "rank").join(scores.select(key, "score"), key), key, DEPTH)
    return out.where(F.col("rank") <= k)


def explain(hits: DataFrame, docs: DataFrame, query: str, key: str = "unit_id", text: str = "text") -> DataFrame:
    """hits with the query stems that each document holds, in query order, and a reason."""
    held = docs.select(key, F.array_intersect(stems(F.lit(query)), stems(text)).alias("matched_terms"))
    return hits.join(held, key, "left").withColumn("reason", F.concat(F.lit("matched: "), F.array_join("matched_terms", ", ")))


def headline(text: Column, query: str, width: int = 400) -> Column:
    """A window of the text around the first stem of the query that occurs in it."""
    wanted = stems(F.lit(query))
    low = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    at = F.array_min(F.filter(F.transform(wanted, lambda s: F.position(s, low)), lambda p: p > 0))
    return F.when(at.isNotNull(), F.substring(text, F.greatest(at - width // 2, F.lit(1)), F.lit(width)))


def find_terms(terms: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Terms that hold the query (ё as е): code-wide ones first, then the shorter, then by name."""
    q = query.lower().replace("ё", "е")
    hit = terms.where(F.replace(F.lower("term"), F.lit("ё"), F.lit("е")).contains(q))
    return hit.orderBy((F.col("scope") == "code").desc(), F.length("term"), "term").limit(k)


def documents(docs: DataFrame, query: str, day: str, k: int = 10) -> DataFrame:
    """doc_id, score, rank: two points a title stem, one a text stem; documents after the day are out, ties by date."""
    asked = stems(F.lit(query))
    score = 2 * F.size(F.array_intersect(stems("title"), asked)) + F.size(F.array_intersect(stems("text"), asked))
    rows = docs.where(F.col("date") <= F.to_date(F.lit(day))).select("doc_id", "date", score.alias("score")).where("score > 0")
    best = rows.orderBy(F.col("score").desc(), "date", "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "date", "doc_id")))
