"""Interpretation documents, their links to units, and the map of positions on a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.hierarchy import related_join
from lexgrove.functions.text import document_number, fact_date, holds_quote

# Order of authority.
AUTHORITY = {"constitutional": 0, "review": 1, "ruling": 1, "plenum": 2, "appeal": 4, "letter": 5}
UNKNOWN_AUTHORITY = 9
STANCES = ("for_taxpayer", "for_authority", "neutral")
CITED_DOCUMENT = r"(?iu)((?:письм|постановлени|определени|решени)\p{L}*[^.;]{0,80}?от\s+(?:\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}\s+\p{L}+\s+\d{4})[^№N]{0,10}(?:№|N)\s*[\p{L}\d@/.-]*[\p{L}\d@])"


def authority(kind: str | Column) -> Column:
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.coalesce(F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv])[c], F.lit(UNKNOWN_AUTHORITY))


def by_authority() -> list[Column]:
    """Sort columns: authority, mandatory ones first, then by date (older first), then by identifier."""
    return [authority("kind"), F.col("mandatory").desc_nulls_last(), F.col("date").asc_nulls_last(), F.col("doc_id")]


def link(documents: DataFrame, resolved: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """doc_id, unit_id, status, confidence, raw_citation: resolved citations (1.0, partial ones 0.7) and source tags."""
    found = resolved.where("status in ('resolved', 'partial')").select(F.col("from_unit_id").alias("doc_id"), F.col("to_unit_id").alias("unit_id"), "status", F.when(F.col("status") == "resolved", 1.0).otherwise(0.7).alias("confidence"), "raw_citation")
    if tags is not None:
        found = found.unionByName(tags.select("doc_id", "unit_id", F.lit("tag").alias("status"), F.lit(0.9).alias("confidence"), F.lit("tag").alias("raw_citation")))
    return found.join(documents.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "unit_id", "raw_citation"])


def interpretations(units: DataFrame, edges: DataFrame, documents: DataFrame, day: str) -> DataFrame:
    """unit_id, doc_id, citations, rank: documents up to a day that cite the unit, its ancestors, descendants or article."""
    asked = units.select(F.col("unit_id").alias("asked"))
    hit = related_join(asked, edges.select(F.col("unit_id").alias("cited"), "doc_id", "raw_citation"), "asked", "cited")
    known = documents.where(F.col("date") <= F.to_date(F.lit(day))).select("doc_id", "kind", "mandatory", "date")
    one = hit.groupBy("asked", "doc_id").agg(F.sort_array(F.collect_set("raw_citation")).alias("citations")).join(known, "doc_id")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("asked").orderBy(*by_authority()))).withColumnRenamed("asked", "unit_id")


def cited_documents(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """doc_id, raw, number, date, found: documents cited in texts(doc_id, text), looked up by number and date,
    else by a number that is unique in the registry."""
    raw = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CITED_DOCUMENT), F.lit(1))).alias("raw"))
    cited = raw.withColumn("number", document_number(F.regexp_extract("raw", r"(?:№|N)\s*([\p{L}\d@/.-]+)$", 1))).withColumn("date", fact_date(F.regexp_extract("raw", r"(?iu)от\s+([^№N]+)", 1)))
    known = registry.select(document_number("number").alias("number"), F.col("date").alias("__date"), F.col("doc_id").alias("__doc"))
    both = cited.join(known.groupBy("number", "__date").agg(F.min("__doc").alias("__both")).withColumnRenamed("__date", "date"), ["number", "date"], "left")
    alone = known.groupBy("number").agg(F.min("__doc").alias("__alone"), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return both.join(alone, "number", "left").select("doc_id", "raw", "number", "date", F.coalesce("__both", "__alone").alias("found"))


def gate_positions(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidate positions whose quote stands verbatim in their document; others are refused."""
    return candidates.join(documents.select("doc_id", F.col("text").alias("__text")), "doc_id").withColumn("accepted", holds_quote("__text", "quote")).drop("__text")


def position_map(positions: DataFrame, documents: DataFrame, changes: DataFrame, day: str) -> DataFrame:
    """One row per unit: counts by stance, conflict, leading stance, positions older than the unit's last change.

    changes(unit_id, effective_date). Positions of stance none and documents after the day are left out; the
    leading stance is that of the document of the highest authority.
    """
    known = documents.where(F.col("date") <= F.to_date(F.lit(day))).select("doc_id", "kind", "mandatory", "date")
    last = changes.where(F.col("effective_date") <= F.to_date(F.lit(day))).groupBy("unit_id").agg(F.max("effective_date").alias("last_change"))
    rows = positions.where("stance <> 'none'").join(known, "doc_id").join(last, "unit_id", "left")
    rows = rows.withColumn("older", F.coalesce(F.col("date") < F.col("last_change"), F.lit(False)))
    lead = F.min_by("stance", F.struct(authority("kind").alias("a"), (~F.coalesce("mandatory", F.lit(False))).alias("m"), "date", "doc_id"))
    counts = [F.count_if(F.col("stance") == s).alias(s) for s in STANCES]
    out = rows.groupBy("unit_id").agg(*counts, lead.alias("leading"), F.count_if("older").alias("older"), F.max("last_change").alias("last_change"))
    return out.withColumn("conflict", (F.col("for_taxpayer") > 0) & (F.col("for_authority") > 0))


def extract_positions(edges: DataFrame, documents: DataFrame, done: DataFrame, extractor, budget: int | None = None) -> DataFrame:
    """Candidate positions of edges(doc_id, unit_id) that have none yet, refusals included (stance none).

    ``extractor`` maps (document text, unit_id) to a dict with stance, summary, quote and confidence, or None; it
    runs in Arrow batches where the rows are. A budget takes the first pairs by key. A quote that does not stand in
    the document makes the position a refusal, so it is not asked for again.
    """
    import pyarrow as pa

    todo = edges.select("doc_id", "unit_id").distinct().join(done.select("doc_id", "unit_id"), ["doc_id", "unit_id"], "left_anti")
    if budget is not None:
        todo = todo.orderBy("doc_id", "unit_id").limit(budget)
    rows = todo.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "unit_id", "text")
    fields = "doc_id string, unit_id string, text string, stance string, summary string, quote string, confidence double"

    def run(batches):
        for b in batches:
            found = [extractor(t or "", u) or {} for u, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array([f.get(k) for f in found], pa.float64() if k == "confidence" else pa.string()) for k in ("stance", "summary", "quote", "confidence")]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=["doc_id", "unit_id", "text", "stance", "summary", "quote", "confidence"])

    got = rows.mapInArrow(run, fields)
    good = F.col("stance").isin(*STANCES) & holds_quote("text", "quote")
    return got.select("doc_id", "unit_id", F.when(good, F.col("stance")).otherwise("none").alias("stance"), "summary", "quote", "confidence", F.coalesce(good, F.lit(False)).alias("accepted"))
