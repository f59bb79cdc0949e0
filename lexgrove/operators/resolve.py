"""References to units: level by level joins against an index of numbers, with graded status.

Status: resolved, partial (an ancestor was found), unresolved, external. Rows of the index are units, so a
reference's joins are equalities on (kind, parent, number); an exact number wins over a variant spelling, and
a number that several units answer to resolves to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.temporal import valid_on
from lexgrove.operators.citations import number_variants

NUMBERED = ("section", "chapter", "article", "point", "subpoint")


def unit_index(units: DataFrame) -> DataFrame:
    """kind, parent, number, variant, unit_id; duplicates stay out. Sections, chapters and articles are listed under their
    act (units may have none) and under '' for references whose act is not known."""
    scopes = F.array(F.col("act"), F.lit("")) if "act" in units.columns else F.array(F.lit(""))
    parent = F.when(F.col("kind").isin("section", "chapter", "article"), scopes).otherwise(F.array("parent_unit_id"))
    live = units.where(F.col("duplicate_of").isNull() & F.col("kind").isin(*NUMBERED) & F.col("number").isNotNull())
    listed = live.select("kind", F.explode(parent).alias("parent"), "number", number_variants("number").alias("__v"), "unit_id")
    return listed.select("kind", "parent", "number", F.explode("__v").alias("variant"), "unit_id").distinct()


def by_numbers(rows: DataFrame, index: DataFrame, asked: list[tuple[str, str, Column, str]]) -> DataFrame:
    """rows(__id, ..) with the unit of each (kind, number column, parent, result column), or NULL.

    All spellings of all numbers of a row go out together, meet the index by one equality join and come back to their
    row, which travels along: rows are read once, however many levels follow.
    """
    listed = []
    for kind, number, parent, _ in asked:
        n = F.col(number).cast("string")
        spelled = F.transform(number_variants(n), lambda v: F.struct(F.lit(kind).alias("kind"), parent.alias("parent"), v.alias("variant"), n.alias("number")))  # noqa: B023
        listed.append(F.when(n.isNotNull(), spelled).otherwise(F.filter(spelled, lambda v: F.lit(False))))
    own = index.select(*[F.col(c).alias(f"__i_{c}") for c in ("kind", "parent", "variant", "number", "unit_id")]).hint("merge")  # an index of all units, larger than the planner takes it to be
    sent = rows.select(F.struct(*rows.columns).alias("__row"), F.explode_outer(F.concat(*listed)).alias("__q"))
    met = sent.join(own, (F.col("__q.kind") == F.col("__i_kind")) & (F.col("__q.parent") == F.col("__i_parent")) & (F.col("__q.variant") == F.col("__i_variant")), "left")
    units = []
    for kind, _, _, out in asked:
        mine = F.col("__q.kind") == kind
        exact = mine & (F.col("__q.variant") == F.col("__q.number")) & (F.col("__i_number") == F.col("__q.number"))
        units += [F.collect_set(F.when(exact, F.col("__i_unit_id"))).alias(f"__exact_{out}"), F.collect_set(F.when(mine, F.col("__i_unit_id"))).alias(f"__loose_{out}")]
    told = met.groupBy(F.col("__row.__id").alias("__key")).agg(F.first("__row").alias("__row"), *units)
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    return told.select("__row.*", *[F.coalesce(one(f"__exact_{out}"), one(f"__loose_{out}")).alias(out) for *_, out in asked])


def legal_lines(units: DataFrame) -> DataFrame:
    """unit_id, line, target: lines of a unit as lawyers count paragraphs (own ones, then every subpoint and
    its further paragraphs)."""
    own = units.where("kind = 'paragraph'").select(F.col("parent_unit_id").alias("unit_id"), F.col("ord"), F.col("unit_id").alias("target"))
    head = units.where("kind = 'subpoint'").select(F.col("parent_unit_id").alias("unit_id"), F.col("ord"), F.col("unit_id").alias("target"))
    inner = units.where("kind = 'paragraph' and subpoint_id is not null and number <> '1'").select(F.col("point_id").alias("unit_id"), "ord", F.col("unit_id").alias("target"))
    rows = own.unionByName(head).unionByName(inner).where("unit_id is not null")
    listed = rows.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("ord", "target"))).alias("l"))  # a unit's lines: tens of rows
    return listed.select("unit_id", F.posexplode("l").alias("__pos", "__x")).select("unit_id", (F.col("__pos") + 1).alias("line"), F.col("__x.target").alias("target"))


def resolve(references: DataFrame, units: DataFrame) -> DataFrame:
    """references with to_unit_id, status, depth, note.

    References need from_unit_id, section, chapter, article, point, subpoint, paragraph_ordinal, relative_to;
    a column ``kind`` of external_* makes a row external. Numbers are those of the act of from_unit_id; where that unit
    is not known, those that only one act has.
    """
    index = unit_index(units)
    rows = references.withColumn("__id", F.monotonically_increasing_id())
    act = F.col("act") if "act" in units.columns else F.lit(None).cast("string")
    source = units.select(F.col("unit_id").alias("from_unit_id"), act.alias("__act"), F.col("section_id").alias("__section"), F.col("chapter_id").alias("__chapter"), F.col("article_id").alias("__article"), F.col("point_id").alias("__point"), F.col("subpoint_id").alias("__subpoint"))
    rows = rows.join(source.hint("merge"), "from_unit_id", "left")
    rows = by_numbers(rows, index, [(kind, kind, F.coalesce("__act", F.lit("")), f"__to_{kind}") for kind in ("section", "chapter", "article")])
    base_kind = F.coalesce("relative_to", F.when(F.col("point").isNotNull(), "article").otherwise("point"))
    base = F.when(base_kind == "article", F.col("__article")).when(base_kind == "chapter", F.col("__chapter")).when(base_kind == "section", F.col("__section")).when(base_kind == "point", F.col("__point")).otherwise(F.col("__subpoint"))
    falls = base.isNull() & base_kind.isin("point", "subpoint")
    rows = rows.withColumn("__base", F.when(F.col("article").isNotNull(), F.col("__to_article")).otherwise(F.coalesce(base, F.when(falls, F.col("__article")))))
    rows = rows.withColumn("__base_kind", F.when(F.col("article").isNotNull() | falls, "article").otherwise(base_kind))
    rows = by_numbers(rows, index, [("point", "point", F.col("__base"), "__to_point")])
    at_point = F.when(F.col("point").isNotNull(), F.col("__to_point")).when(F.col("__base_kind") == "point", F.col("__base")).when(F.col("__base_kind") == "subpoint", F.col("__point"))
    rows = by_numbers(rows.withColumn("__at_point", at_point), index, [("subpoint", "subpoint", F.col("__at_point"), "__to_subpoint")])
    host = F.when(F.col("subpoint").isNotNull(), F.col("__to_subpoint")).when(F.col("point").isNotNull(), F.col("__to_point")).otherwise(F.col("__base"))
    rows = rows.withColumn("__host", host)
    named = units.where("kind = 'paragraph'").select(F.col("parent_unit_id").alias("__host"), F.col("number").cast("int").alias("paragraph_ordinal"), F.col("unit_id").alias("__to_ab"))
    lined = legal_lines(units).select(F.col("unit_id").alias("__host"), F.col("line").alias("paragraph_ordinal"), F.col("target").alias("__to_line"))
    named, lined = named.dropDuplicates(["__host", "paragraph_ordinal"]), lined.dropDuplicates(["__host", "paragraph_ordinal"])
    rows = rows.join(named.hint("merge"), ["__host", "paragraph_ordinal"], "left").join(lined.hint("merge"), ["__host", "paragraph_ordinal"], "left")

    c = F.col
    container = c("article").isNull() & (c("chapter").isNotNull() | c("section").isNotNull())
    to_container = F.when(c("chapter").isNotNull(), c("__to_chapter")).otherwise(c("__to_section"))
    lost_point = c("point").isNotNull() & c("__to_point").isNull()
    no_point = c("subpoint").isNotNull() & ~lost_point & ~(c("point").isNotNull() | c("__base_kind").isin("point", "subpoint"))
    lost_sub = c("subpoint").isNotNull() & ~no_point & c("__to_subpoint").isNull()
    paragraph = F.coalesce("__to_ab", "__to_line")
    lost_line = c("paragraph_ordinal").isNotNull() & paragraph.isNull()
    deepest = F.when(c("subpoint").isNotNull(), "subpoint").when(c("point").isNotNull(), "point").otherwise(c("__base_kind"))
    none = F.lit(None).cast("string")

    def told(to: Column, status: str, depth: Column, note: Column = none) -> Column:
        return F.struct(to.alias("to"), F.lit(status).alias("status"), depth.alias("depth"), note.alias("note"))

    outcome = (
        F.when(c("kind").startswith("external"), told(none, "external", none))
        .when(container & to_container.isNotNull(), told(to_container, "resolved", F.when(c("chapter").isNotNull(), "chapter").otherwise("section")))
        .when(container, told(none, "unresolved", none, F.lit("container not found")))
        .when(c("__base").isNull(), told(none, "unresolved", none, F.when(c("article").isNotNull(), "article not found").otherwise("no such ancestor")))
        .when(lost_point, told(c("__base"), "partial", c("__base_kind"), F.lit("point not found")))
        .when(no_point, told(c("__base"), "partial", c("__base_kind"), F.lit("subpoint without point")))
        .when(lost_sub, told(F.coalesce("__to_point", "__base"), "partial", F.when(c("point").isNotNull(), "point").otherwise(c("__base_kind")), F.lit("subpoint not found")))
        .when(lost_line, told(c("__host"), "partial", deepest, F.lit("paragraph not found")))
        .when(c("paragraph_ordinal").isNotNull(), told(paragraph, "resolved", F.lit("paragraph")))
        .otherwise(told(c("__host"), "resolved", deepest))
    )
    return rows.withColumn("__o", outcome).select(*[F.col(x) for x in references.columns], F.col("__o.to").alias("to_unit_id"), F.col("__o.status").alias("status"), F.col("__o.depth").alias("depth"), F.col("__o.note").alias("note"))


def verify(citations: DataFrame, units: DataFrame, intervals: DataFrame, day: str) -> DataFrame:
    """citations(article, point, ..) with to_unit_id and a verdict on a day: OK, STALE, PART, MISS."""
    found = resolve(citations, units)
    on = found.join(intervals.select(F.col("unit_id").alias("to_unit_id"), "valid_from", "valid_to"), "to_unit_id", "left")
    verdict = F.when(F.col("status") == "external", "EXTERNAL").when(F.col("status") == "unresolved", "MISS").when(F.col("status") == "partial", "PART").when(valid_on(day), "OK").otherwise("STALE")
    return on.withColumn("verdict", verdict)


def unit_intervals(units: DataFrame, repeals: DataFrame, edition_day: str) -> DataFrame:
    """unit_id, valid_from, valid_to: a repealed unit ends on its repeal (or edition) day, others begin with the edition."""
    ended = units.select("unit_id").join(repeals.select("unit_id", "repeal_date", F.lit(True).alias("__r")), "unit_id", "left")
    day = F.to_date(F.lit(edition_day))
    return ended.select("unit_id", F.when(F.col("__r").isNull(), day).alias("valid_from"), F.when(F.col("__r"), F.coalesce("repeal_date", day)).alias("valid_to"))


def link_pending(references: DataFrame, units: DataFrame) -> DataFrame:
    """references whose pending target exists now point at it; others stay pending."""
    known = units.select(F.col("unit_id").alias("pending"), F.lit(True).alias("__known")).distinct()
    return references.join(known, "pending", "left").withColumn("to_unit_id", F.coalesce("to_unit_id", F.when(F.col("__known"), F.col("pending")))).drop("__known")


def partial_report(resolved: DataFrame, samples: int = 25) -> DataFrame:
    """cause, n, citations, the first ``samples`` raw citations of each cause of partial references.

    Citations are counted once each before causes are ranked, and a task passes on no more of a cause than is shown."""
    p = resolved.where("status = 'partial'").groupBy(F.col("note").alias("cause"), "raw_citation").agg(F.count(F.lit(1)).alias("n"))
    named = p.where("raw_citation is not null").withColumn("__nth", F.row_number().over(W.partitionBy("cause").orderBy("raw_citation")))
    shown = named.where(F.col("__nth") <= samples).groupBy(F.col("cause").alias("__cause")).agg(F.sort_array(F.collect_list("raw_citation")).alias("sample"))
    totals = p.groupBy("cause").agg(F.sum("n").alias("n"), F.count("raw_citation").alias("citations"))
    return totals.join(shown, F.col("cause").eqNullSafe(F.col("__cause")), "left").drop("__cause")
