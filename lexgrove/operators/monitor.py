"""Changes between loads, events, subscriptions and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.hierarchy import ancestors, article_of

UNIT_KINDS = ("unit_text_changed", "unit_repealed", "unit_added")
DOCUMENT_KINDS = ("document_added", "document_status_changed")
STATUSES = ("open", "seen", "applied")


def unit_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, unit_id of two states (unit_id, text_hash, in_force); nothing on a first load."""
    a = old.select("unit_id", F.col("text_hash").alias("__a"), F.col("in_force").alias("__af"), F.lit(True).alias("__ina"))
    b = new.select("unit_id", F.col("text_hash").alias("__b"), F.col("in_force").alias("__bf"), F.lit(True).alias("__inb"))
    gone = F.col("__af") & (F.col("__inb").isNull() | ~F.col("__bf"))
    kind = F.when(gone, "unit_repealed").when(F.col("__ina").isNull() & F.col("__bf"), "unit_added").when(F.col("__a") != F.col("__b"), "unit_text_changed")
    first = old.limit(1).agg((F.count(F.lit(1)) > 0).alias("__loaded"))  # one row
    return a.join(b, "unit_id", "full_outer").select(kind.alias("kind"), "unit_id").where("kind is not null").crossJoin(F.broadcast(first)).where("__loaded").drop("__loaded")


def parameter_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, before, after of latest values (name, region, valid_from, value) whose text differs."""
    top = lambda d, n: d.groupBy("name", "region").agg(F.max_by("value", F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))).cast("string").alias(n))
    a, b = top(old, "before"), top(new, "after")
    joined = a.alias("a").join(b.alias("b"), (F.col("a.name") == F.col("b.name")) & F.col("a.region").eqNullSafe(F.col("b.region")))
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).select("a.name", "a.region", "before", "after")


def archive(archived: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """archived with the texts of old that new replaces; (unit_id, text_hash) stays unique."""
    replaced = old.join(new.select("unit_id", "text_hash"), ["unit_id", "text_hash"], "left_anti").select("unit_id", "text_hash", "text")
    return archived.unionByName(replaced.join(archived.select("unit_id", "text_hash"), ["unit_id", "text_hash"], "left_anti"))


def match_events(events: DataFrame, subscriptions: DataFrame, cites: DataFrame | None = None) -> DataFrame:
    """workspace_id, event_id, matched_by of events that touch a subscribed unit (itself, above, below, same
    article) or document; one row per workspace and event. cites(workspace_id, doc_id): documents its files cite."""
    units = events.where(F.col("kind").isin(*UNIT_KINDS) & F.col("unit_id").isNotNull()).select("event_id", F.col("unit_id").alias("__event_unit"))
    # distinct units meet distinct subscriptions: a unit with many events is matched once, its events take the result
    by_unit = subscribed(units.select("__event_unit").distinct(), subscriptions.where("unit_id is not null").select("workspace_id", "unit_id").distinct())
    hits = units.join(by_unit, "__event_unit").select("workspace_id", "event_id", "matched_by")
    docs = events.where(F.col("kind").isin(*DOCUMENT_KINDS) & F.col("doc_id").isNotNull()).select("event_id", "doc_id")
    by_doc = docs.join(subscriptions.where("doc_id is not null").select("workspace_id", "doc_id"), "doc_id").select("workspace_id", "event_id", F.col("doc_id").alias("matched"))
    if cites is not None:
        by_doc = by_doc.unionByName(docs.join(cites.select("workspace_id", "doc_id").distinct(), "doc_id").select("workspace_id", "event_id", F.col("doc_id").alias("matched")))
    # an event has a unit or a document, as its kind says
    return hits.unionByName(by_doc.groupBy("workspace_id", "event_id").agg(F.sort_array(F.collect_set("matched")).alias("matched_by")))


def subscribed(units: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """__event_unit, workspace_id, matched_by of distinct units and subscriptions(workspace_id, unit_id): subscribed units that
    are the event's own, above or below it, or in its article.

    What a workspace subscribes to in one article is one list, and an event's unit takes the list whole, so a hot article costs a row
    for each workspace and unit, not for each pair of units. Above the article, and for events that touch no article,
    ancestors meet by equality."""
    wanted = subscriptions.select("workspace_id", F.col("unit_id").alias("__unit"), article_of("unit_id").alias("__article"))
    inside = F.col("__article").contains(".art")
    listed = wanted.where(inside).groupBy("workspace_id", "__article").agg(F.collect_list("__unit").alias("__units"))
    own = units.withColumn("__article", article_of("__event_unit"))
    same = own.where(inside).join(listed, "__article").select("__event_unit", "workspace_id", "__units")
    one = F.array("__unit").alias("__units")
    above = own.select("__event_unit", F.explode(ancestors("__event_unit")).alias("__unit")).join(wanted.where(~inside).drop("__article"), "__unit").select("__event_unit", "workspace_id", one)
    below = own.where(~inside).select("__event_unit").join(wanted.select("workspace_id", "__unit", F.explode(ancestors("__unit")).alias("__event_unit")), "__event_unit").where(F.col("__unit") != F.col("__event_unit")).select("__event_unit", "workspace_id", one)
    met = same.unionByName(above).unionByName(below).groupBy("__event_unit", "workspace_id").agg(F.flatten(F.collect_list("__units")).alias("__units"))
    return met.select("__event_unit", "workspace_id", F.sort_array(F.array_distinct("__units")).alias("matched_by"))


def new_notifications(existing: DataFrame, events: DataFrame, subscriptions: DataFrame, after_event: int, cites: DataFrame | None = None) -> DataFrame:
    """Notifications of events past a checkpoint that do not exist yet, all open."""
    found = match_events(events.where(F.col("event_id") > after_event), subscriptions, cites)
    return found.join(existing.select("workspace_id", "event_id"), ["workspace_id", "event_id"], "left_anti").withColumn("status", F.lit("open"))


def advance(notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """notifications with the furthest status among their own and marks(workspace_id, event_id, status)."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)])
    top = marks.groupBy("workspace_id", "event_id").agg(F.max(order[F.col("status")]).alias("__m"))
    names = F.array(*map(F.lit, STATUSES))
    joined = notifications.join(top, ["workspace_id", "event_id"], "left")
    return joined.withColumn("status", F.element_at(names, (F.greatest(order[F.col("status")], F.coalesce("__m", F.lit(0))) + 1))).drop("__m")


def what_changed(archived: DataFrame, current: DataFrame, amendments: DataFrame) -> DataFrame:
    """unit_id, before, after, amendments: the latest archived text that differs from the current one."""
    nth = F.row_number().over(W.partitionBy("unit_id").orderBy(F.col("archived_at").desc(), "text_hash"))
    past = archived.join(current.select("unit_id", F.col("text_hash").alias("__now"), F.col("text").alias("after")), "unit_id").where(F.col("text_hash") != F.col("__now"))
    last = past.withColumn("__n", nth).where("__n = 1").select("unit_id", F.col("text").alias("before"), "after")
    laws = amendments.groupBy(F.col("target_unit_id").alias("unit_id")).agg(F.sort_array(F.collect_set("amending_act_number")).alias("amendments"))
    return last.join(laws, "unit_id", "left")


def derived_subscriptions(files: DataFrame) -> DataFrame:
    """workspace_id, unit_id: the distinct sources that files(workspace_id, sources array) name."""
    return files.select("workspace_id", F.explode("sources").alias("unit_id")).distinct()


def subscribe(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union without doubles; NULL units and documents compare as equal."""
    return existing.unionByName(new).dropDuplicates(["workspace_id", "unit_id", "doc_id"])
