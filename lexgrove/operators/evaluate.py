"""Scores of answers against a golden set, and audits of documents' citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.hierarchy import article_of, related, related_join

ABSTENTION = r"(?iu)не наш[её]л|не найден|отсутству|не могу ответить|нет ответа|недостаточно данных"


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; NULL where whole is 0."""
    return F.when(whole != 0, part / whole)


def score_answers(questions: DataFrame, citations: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question and repeat: precision and recall of units and articles, hallucination counts, temporal
    correctness, abstention.

    questions(id, topic, expected array, abstain); citations(id, rep, unit_id, verdict), documents left out by the
    caller; answers(id, rep, text). A cited unit hits when it equals an expected one, or is above or below it. All tables
    grow with the answers, so the joins merge sorted rows and nothing is broadcast.
    """
    asked = answers.join(questions.hint("merge"), "id").select("id", "rep", "topic", "text", "abstain", F.array_distinct("expected").alias("expected"))
    wanted = asked.select("id", "rep", F.explode("expected").alias("want"))
    found = citations.where("unit_id is not null").select("id", "rep", "unit_id").distinct()
    # an answer's expected and cited units meet by the answer: a handful times a handful, no list of ancestors
    pairs = wanted.join(found.hint("merge"), ["id", "rep"]).where(related(F.col("want"), F.col("unit_id")))
    hits = pairs.groupBy("id", "rep").agg(F.count_distinct("want").alias("__recalled"), F.count_distinct("unit_id").alias("__right"))
    arts = lambda d, u: d.groupBy("id", "rep").agg(F.collect_set(article_of(u)).alias(f"__{u}_arts"))  # noqa: E731  an answer's citations: a handful
    cited = citations.groupBy("id", "rep").agg(
        F.count_distinct("unit_id").alias("__cited"), F.count(F.lit(1)).alias("citations"), F.count_if(F.col("verdict").isin("MISS", "STALE")).alias("hallucinated"),
        F.count_if(F.col("verdict") == "OK").alias("__ok"), F.count_if(F.col("verdict").isin("OK", "STALE")).alias("__dated"),
    )
    rows = asked
    for told in (hits, cited, arts(wanted, "want"), arts(found, "unit_id")):
        rows = rows.join(told.hint("merge"), ["id", "rep"], "left")
    z = lambda name: F.coalesce(F.col(name), F.lit(0))
    n = F.size("expected")
    common = F.size(F.array_intersect("__want_arts", "__unit_id_arts"))
    none = n == 0
    return rows.select(
        "id", "rep", "topic", F.when(~none, ratio(z("__right"), z("__cited"))).alias("precision_unit"), F.when(~none, z("__recalled") / n).alias("recall_unit"),
        F.when(~none, ratio(F.coalesce(common, F.lit(0)), F.coalesce(F.size("__unit_id_arts"), F.lit(0)))).alias("precision_article"), F.when(~none, F.coalesce(common, F.lit(0)) / F.size("__want_arts")).alias("recall_article"),
        z("citations").alias("citations"), z("hallucinated").alias("hallucinated"), ratio(z("__ok"), z("__dated")).alias("temporal"),
        F.when(F.col("abstain"), F.col("text").rlike(ABSTENTION)).cast("int").alias("abstained"),
    )


METRICS = ("precision_unit", "recall_unit", "precision_article", "recall_article", "temporal", "abstained")


def summary(scores: DataFrame) -> DataFrame:
    """Means (NULLs left out) by topic, by repeat and over all, in one pass of grouping sets."""
    named = scores.withColumn("topic", F.coalesce("topic", F.lit("no topic")))
    means = [F.avg(m).alias(m) for m in METRICS]
    total = ratio(F.sum("hallucinated"), F.sum("citations")).alias("hallucination_rate")
    return named.groupingSets([["topic"], ["rep"], []], "topic", "rep").agg(*means, total, F.count(F.lit(1)).alias("n"))


def spread(scores: DataFrame, metric: str = "precision_unit") -> DataFrame:
    """Least and greatest mean of a metric over repeats; empty with fewer than two."""
    by_rep = scores.groupBy("rep").agg(F.avg(metric).alias("m"))
    return by_rep.agg(F.min("m").alias("low"), F.max("m").alias("high"), F.count(F.lit(1)).alias("reps")).where("reps >= 2")


def search_accuracy(results: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """variant, topic, n, unit_at_k, article_at_k: questions with an expected unit (its subtree) or article among the first k."""
    top = results.where(F.col("rank") <= k).select("variant", "id", "unit_id")
    want = golden.select("id", "topic", F.explode("expected").alias("want"))
    variants = results.select("variant").distinct()
    # a question's expected units meet its first k by the question
    near = want.join(top.hint("merge"), "id")
    hit = near.select("variant", "id", (article_of("want") == article_of("unit_id")).alias("__a"), related(F.col("want"), F.col("unit_id")).cast("int").alias("__u"))
    exact = hit.groupBy("variant", "id").agg(F.max("__u").alias("unit_at_k"), F.max(F.col("__a").cast("int")).alias("article_at_k"))
    rows = golden.select("id", "topic").crossJoin(F.broadcast(variants)).join(exact.hint("merge"), ["variant", "id"], "left")  # variants: a handful
    return rows.groupBy("variant", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("unit_at_k", F.lit(0))).alias("unit_at_k"), F.sum(F.coalesce("article_at_k", F.lit(0))).alias("article_at_k"))


def audit(verified: DataFrame, cited: DataFrame, documents: DataFrame, amendments: DataFrame, edges: DataFrame, day: str, suggestions: int = 20) -> DataFrame:
    """doc_id, item, status, target of audited documents.

    verified(doc_id, raw, to_unit_id, verdict), cited (from ``cited_documents``), documents(doc_id, date, status,
    mandatory), amendments(target_unit_id, effective_date), edges(doc_id, unit_id). A norm that changed after the
    document's date is outdated; mandatory letters on its norms that it does not cite are suggested.
    """
    status = F.create_map(*[F.lit(x) for kv in {"OK": "ok", "STALE": "stale", "PART": "partial", "MISS": "missing", "EXTERNAL": "external"}.items() for x in kv])
    norms = verified.select("doc_id", F.col("raw").alias("item"), status[F.col("verdict")].alias("status"), F.col("to_unit_id").alias("target"))
    dated = documents.select("doc_id", F.col("date").alias("__date"))
    changed = amendments.where(F.col("effective_date") <= F.to_date(F.lit(day))).select(F.col("target_unit_id").alias("target"), "effective_date")
    later = norms.where("status = 'ok'").join(dated, "doc_id").join(changed, "target").where("effective_date > __date").select("doc_id", "item", "target").distinct().withColumn("__later", F.lit(True))
    norms = norms.join(later, ["doc_id", "item", "target"], "left").select("doc_id", "item", F.when(F.col("__later"), "outdated").otherwise(F.col("status")).alias("status"), "target")
    state = documents.select(F.col("doc_id").alias("found"), F.col("status").alias("__s"))
    letters = cited.join(state, "found", "left").select("doc_id", F.col("raw").alias("item"), F.when(F.col("found").isNull(), "unknown").when(F.col("__s") == "outdated", "outdated").otherwise("ok").alias("status"), F.col("found").alias("target"))
    own = norms.where("target is not null").select("doc_id", "target").distinct()
    must = edges.join(documents.where("mandatory").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("__letter"), F.col("unit_id").alias("__unit"))
    near = related_join(own, must, "target", "__unit").select("doc_id", "__letter").distinct()
    missing = near.join(letters.select("doc_id", F.col("target").alias("__letter")), ["doc_id", "__letter"], "left_anti").where("doc_id <> __letter")
    from pyspark.sql import Window as W

    few = missing.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("__letter"))).where(F.col("__n") <= suggestions)
    return norms.unionByName(letters).unionByName(few.select("doc_id", F.lit("suggestion").alias("item"), F.lit("suggested").alias("status"), F.col("__letter").alias("target")))


def audit_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"))


def golden_run(results: DataFrame) -> DataFrame:
    """kind, n, ok, share of results(kind, expected, got): searches hit when an expected unit is among those got,
    resolutions and as-of reads when the one got is expected, absent ones when nothing came."""
    hit = F.when(F.col("kind") == "as_of_absent", F.size("got") == 0).otherwise(F.size(F.array_intersect("expected", "got")) > 0)
    return results.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("ok")).withColumn("share", F.col("ok") / F.col("n"))


def render_counts(counts: DataFrame) -> DataFrame:
    """One Markdown row per (doc_id, status, n)."""
    return counts.select(F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), "status", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))
