"""Loads, snapshots, cards, jobs and the registry of tools: everything is a table rebuilt from its sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.temporal import as_of, latest, valid_on
from lexgrove.operators import amendments as A
from lexgrove.operators import calculators, citations, interpret, monitor, resolve, search, statute
from lexgrove.sources.store import Change, Store


def load(texts: DataFrame, edition_day: str) -> dict[str, DataFrame]:
    """units, references, amendments, unit_text, terms of statute texts(act, text): one pass of the grammar, the
    rest by joins. Units are parsed once: the caller may write them before reading the others."""
    units = statute.parse(texts)
    changes = A.amendments(units)
    inner = citations.extract_internal(units.where("kind <> 'paragraph'"))
    intervals = resolve.unit_intervals(units, A.repeal_dates(changes), edition_day)
    return {
        "units": units, "references": resolve.resolve(inner, units), "acts": citations.extract_acts(units.where("kind <> 'paragraph'")), "amendments": changes,
        "unit_text": units.select("unit_id", "text", "text_hash", "edit_note").join(intervals, "unit_id"), "terms": A.terms(units),
    }


def reload_act(store: Store, act: str, units: DataFrame, unit_text: DataFrame, references: DataFrame, day: str) -> int:
    """One act's units, texts and references replaced in one commit, with all that depends on them.

    units(unit_id, ..), unit_text(unit_id, text, text_hash, ..) and references(from_unit_id, pending, to_unit_id, ..) are the new
    state of the act; those of other acts stay as they are. In the same version: ``unit_text_archive`` gains the texts that
    the load replaces, ``corpus_event`` the units added, changed and repealed (none on a first load), and every act's references
    whose pending unit exists now point at it. Readers see all of it or none.
    """
    base = store.manifest()["version"]
    loaded = bool(base) and store.has("unit_text", base)
    tagged = lambda df: df.withColumn("act", F.lit(act))
    state = lambda df: df.select("unit_id", "text_hash", F.lit(True).alias("in_force"))
    changes = {"unit": Change(tagged(units), tag=act), "unit_text": Change(tagged(unit_text), tag=act)}
    known, mine = units.select("unit_id"), references.withColumn("act", F.lit(act))
    if loaded:
        held = lambda name: store.read(name, base).drop("batch")
        old = held("unit_text").where(F.col("act") == act)
        events = monitor.unit_changes(state(old), state(unit_text)).withColumns({"act": F.lit(act), "detected": F.to_date(F.lit(day)), "version": F.lit(base + 1)})
        replaced = old.join(unit_text.select("unit_id", "text_hash"), ["unit_id", "text_hash"], "left_anti").select("unit_id", "text_hash", "text", F.to_date(F.lit(day)).alias("archived_at"))
        if store.has("unit_text_archive", base):
            replaced = replaced.join(held("unit_text_archive").select("unit_id", "text_hash"), ["unit_id", "text_hash"], "left_anti")
        changes |= {"unit_text_archive": Change(replaced, append=True), "corpus_event": Change(events, append=True)}
        known = known.unionByName(held("unit").where(F.col("act") != act).select("unit_id"))
        mine = mine.unionByName(held("reference").where(F.col("act") != act), allowMissingColumns=True)
    elsewhere = F.when(F.col("to_unit_id").isNotNull() & F.col("__there").isNull(), F.col("to_unit_id")).otherwise(F.col("pending"))
    # what pointed at a unit that is gone waits for it again
    there = known.distinct().select(F.col("unit_id").alias("to_unit_id"), F.lit(True).alias("__there"))
    mine = mine.join(there, "to_unit_id", "left").withColumns({"pending": elsewhere, "to_unit_id": F.when(F.col("__there"), F.col("to_unit_id"))}).drop("__there")
    return store.commit(changes | {"reference": Change(resolve.link_pending(mine, known))}, base)


def get_unit(units: DataFrame, unit_text: DataFrame, unit_id: str, day: str) -> DataFrame:
    """The unit's text in force on a day, or no row."""
    return as_of(unit_text.where(F.col("unit_id") == unit_id), day, ["unit_id"]).join(units.where(F.col("unit_id") == unit_id).select("unit_id", "label", "context", "kind"), "unit_id")


def get_parameter(parameters: DataFrame, units: DataFrame, name: str, day: str, region: str | None = None) -> DataFrame:
    """The parameter in force on a day: the region's own value before the federal one, then the latest start."""
    rows = parameters.where((F.col("name") == name) & valid_on(day) & (F.col("region").eqNullSafe(F.lit(region)) | F.col("region").isNull()))
    best = rows.orderBy(F.col("region").isNull(), F.col("valid_from").desc_nulls_last()).limit(1)
    return best.join(units.select(F.col("unit_id").alias("source_unit_id"), "label"), "source_unit_id", "left")


def regional_preference(parameters: DataFrame, regions: DataFrame, day: str) -> DataFrame:
    """region, name, value, federal: for every region its own value, else the federal one."""
    live = parameters.where(valid_on(day))
    names = live.select("name").distinct()
    own = latest(live.where("region is not null"), ["name", "region"]).select("name", "region", F.col("value").alias("__own"))
    fed = latest(live.where("region is null"), ["name"]).select("name", F.col("value").alias("__fed"))
    out = regions.select("region").distinct().join(names).join(own, ["name", "region"], "left").join(fed, "name", "left")
    return out.select("region", "name", F.coalesce("__own", "__fed").alias("value"), F.col("__own").isNull().alias("federal")).where("value is not null")


def parameters_for(parameters: DataFrame, unit_id: str, day: str) -> DataFrame:
    """Parameters whose source is the unit or lies below it."""
    below = (F.col("source_unit_id") == unit_id) | F.col("source_unit_id").startswith(unit_id + ".")
    return parameters.where(below & valid_on(day)).orderBy("name", F.col("valid_from").desc_nulls_last())


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of every table in one union of counts."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def documents_by_agency(documents: DataFrame) -> DataFrame:
    return documents.groupBy("agency", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))


def known_endpoints(edges: DataFrame, documents: DataFrame, units: DataFrame) -> DataFrame:
    """Edges whose document and unit both exist."""
    return edges.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").join(units.select("unit_id").distinct(), "unit_id", "left_semi")


def card(units: DataFrame, unit_text: DataFrame, changes: DataFrame, edges: DataFrame, documents: DataFrame, positions: DataFrame, unit_id: str, day: str) -> DataFrame:
    """One row: the unit's text on a day with its amendments, interpretations and positions counted."""
    base = get_unit(units, unit_text, unit_id, day)
    one = units.where(F.col("unit_id") == unit_id).select("unit_id")
    laws = changes.where(F.col("target_unit_id") == unit_id).agg(F.sort_array(F.collect_set("amending_act_number")).alias("amendments"))
    letters = interpret.interpretations(one, edges, documents, day).agg(F.count_distinct("doc_id").alias("interpretations"))
    views = positions.where(F.col("unit_id") == unit_id).agg(F.count(F.lit(1)).alias("positions"))
    return base.crossJoin(F.broadcast(laws)).crossJoin(F.broadcast(letters)).crossJoin(F.broadcast(views))  # one row each


#: Tools by name: each takes tables and plain arguments and returns a DataFrame.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "get_unit": get_unit, "get_parameter": get_parameter, "parameters_for_unit": parameters_for, "search": search.hybrid, "search_lexical": search.lexical, "search_two_pass": search.two_pass,
    "search_documents": search.documents, "find_terms": search.find_terms, "resolve": resolve.resolve, "verify_citations": resolve.verify, "list_amendments": A.since, "get_interpretations": interpret.interpretations,
    "position_map": interpret.position_map, "deadline": calculators.deadlines, "penalty": calculators.penalties, "fine": calculators.fines, "appeal_deadlines": calculators.appeals, "limitation": calculators.limitations,
    "what_changed": monitor.what_changed, "unit_card": card,
}


def call(name: str, *args, **kwargs) -> tuple[DataFrame | None, str | None]:
    """(result, error) of a tool; a wrong name or arguments are an error, not an exception."""
    try:
        return TOOLS[name](*args, **kwargs), None
    except KeyError:
        return None, f"no such tool: {name}"
    except (TypeError, ValueError) as e:
        return None, str(e)


JOBS: dict[str, Callable[[SparkSession], dict]] = {}


def job(name: str):
    def register(f: Callable[[SparkSession], dict]):
        JOBS[name] = f
        return f

    return register


def run_job(spark: SparkSession, name: str, log_path: str | None = None) -> dict:
    """Runs a registered job; a failure is recorded, not raised. The record is appended to the log table."""
    import datetime
    import json

    began = datetime.datetime.now(datetime.UTC)
    record = {"job": name, "started_at": began.isoformat(), "status": "ok", "stats": None, "error": None}
    try:
        record["stats"] = json.dumps(JOBS[name](spark), default=str)
    except Exception as e:  # the log must hold it whatever it was
        record |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:2000]}
    record["finished_at"] = datetime.datetime.now(datetime.UTC).isoformat()
    if log_path:
        schema = "job string, started_at string, status string, stats string, error string, finished_at string"
        spark.createDataFrame([tuple(record[k] for k in ("job", "started_at", "status", "stats", "error", "finished_at"))], schema).write.mode("append").parquet(log_path)
    return record
