"""Amendments from edition notes, repeal dates, legal terms: one row per law of every note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.text import effective_date, numeric_date, word_date

# Keywords of operations in order of priority.
OPERATIONS = (("наименование в ред", "title_change"), ("наименование изложено", "title_change"), ("в новой ред", "replace"), ("изложен", "replace"), ("в ред", "replace"), ("введен", "insert"), ("дополнен", "insert"), ("изменен", "modify"), ("утратил силу", "repeal"))


def operation_of(note: Column) -> Column:
    """The operation whose keyword stands first; equal places go by priority."""
    low = F.lower(note)
    found = F.array(*[F.struct(F.position(F.lit(k), low).alias("at"), F.lit(i).alias("p"), F.lit(op).alias("op")) for i, (k, op) in enumerate(OPERATIONS)])
    return F.array_min(F.filter(found, lambda x: x["at"] > 0))["op"]


def scope_of(note: Column, kind: Column) -> Column:
    """child: the note is about a paragraph, point or subpoint inside the unit that carries it."""
    low = F.lower(note)
    return F.when((kind == "paragraph") & low.rlike(r"^<?\s*абзац"), "unit").when(low.rlike(r"^<?\s*(?:абзац|пункт|подпункт)\p{L}*\s"), "child").otherwise("unit")


def amendments(units: DataFrame) -> DataFrame:
    """target_unit_id, scope, operation, amending_act_number, amending_act_date, effective_date, raw_note.

    units(unit_id, kind, edit_note, ord). A law without its own date takes the note's first one; the change
    takes effect on the day named next to its law, else on the note's.
    """
    notes = units.where("edit_note is not null").select("unit_id", "kind", "ord", F.posexplode(F.split("edit_note", "\n")).alias("pos", "note")).withColumn("note", F.trim("note"))
    notes = notes.where((F.col("note") != "") & ~F.lower("note").rlike(r"^[< ]*изменения:")).withColumn("operation", operation_of(F.col("note"))).where("operation is not null")
    part = r"(?iu)((?:(?<!\p{L})со?\s+\d{1,2}\s+\p{L}+\s+\d{4}[^№N]{0,40}?)?(?:от\s+\d{1,2}[.\s][^№N]{1,30})?(?:№|N)\s*\d+(?:-\d+)*-ФЗ)"
    laws = notes.select("*", F.posexplode(F.regexp_extract_all("note", F.lit(part), F.lit(1))).alias("nth", "law"))
    own_day = F.coalesce(word_date(F.col("law"), r"от\s+"), numeric_date(F.col("law"), r"от\s+"))
    head_day = F.coalesce(word_date(F.col("note"), r"от\s+"), numeric_date(F.col("note"), r"от\s+"))
    return laws.select(
        F.col("unit_id").alias("target_unit_id"), scope_of(F.col("note"), F.col("kind")).alias("scope"), "operation", F.upper(F.regexp_extract("law", r"(?iu)(\d+(?:-\d+)*-ФЗ)", 1)).alias("amending_act_number"),
        F.coalesce(own_day, head_day).alias("amending_act_date"), F.coalesce(effective_date(F.col("law")), effective_date(F.col("note"))).alias("effective_date"), F.col("note").alias("raw_note"), "ord", "pos", "nth",
    )


def repeal_dates(rows: DataFrame) -> DataFrame:
    """unit_id, repeal_date: the first dated repeal of the unit itself, NULL when none has a date."""
    own = rows.where("operation = 'repeal' and scope = 'unit'")
    order = W.partitionBy("target_unit_id").orderBy(F.col("effective_date").isNull(), "ord", "pos", "nth")
    return own.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(F.col("target_unit_id").alias("unit_id"), F.col("effective_date").alias("repeal_date"))


def since(rows: DataFrame, day: str) -> DataFrame:
    """Amendments that take effect on or after a day; undated ones come last."""
    return rows.where(F.col("effective_date").isNull() | (F.col("effective_date") >= F.to_date(F.lit(day)))).orderBy(F.col("effective_date").asc_nulls_last(), "target_unit_id", "amending_act_number")


def split_definition(text: Column) -> tuple[Column, Column]:
    """(term, definition) at the first dash outside brackets; NULL when the term is not 2 to 120 long."""
    flat = F.regexp_replace(text, r"\([^()]*\)", "")
    term = F.trim(F.regexp_extract(flat, r"^([^—–]*?)\s+[—–-]\s+", 1))
    body = F.trim(F.regexp_extract(text, r"^(?:[^()—–]|\([^()]*\))*?\s+[—–-]\s+(.*)$", 1))
    ok = F.length(term).between(2, 120) & (body != "")
    return F.when(ok, term), F.when(ok, body)


def dictionary_scope(head: Column) -> Column:
    low = F.lower(head)
    return F.when(low.contains("настоящей статьи"), "article").when(low.contains("настоящего пункта"), "point").when(low.contains("настоящей главы"), "chapter").otherwise("code")


def terms(units: DataFrame) -> DataFrame:
    """term, term_norm, definition, definition_unit_id, scope, scope_unit_id of the dictionaries in the units.

    A dictionary's head is a first paragraph that ends with a colon and speaks of terms; its entries are the
    further paragraphs and the subpoints of the same unit.
    """
    head = units.where((F.col("kind") == "paragraph") & (F.col("number") == "1") & F.col("text").rlike(r":\s*$") & F.lower("text").rlike("поняти|термин"))
    head = head.select(F.col("parent_unit_id").alias("host"), F.col("text").alias("head"), "chapter_id", "article_id", "point_id")
    entries = units.where("(kind = 'paragraph' and number <> '1') or kind = 'subpoint'").select(F.col("parent_unit_id").alias("host"), "unit_id", "text")
    term, body = split_definition(F.col("text"))
    scope = dictionary_scope(F.col("head"))
    rows = entries.join(head, "host").withColumn("term", term).withColumn("definition", body).where("term is not null").withColumn("scope", scope)
    where = F.when(F.col("scope") == "article", F.col("article_id")).when(F.col("scope") == "chapter", F.col("chapter_id")).when(F.col("scope") == "point", F.col("point_id"))
    return rows.select("term", F.replace(F.lower("term"), F.lit("ё"), F.lit("е")).alias("term_norm"), "definition", F.col("unit_id").alias("definition_unit_id"), "scope", where.alias("scope_unit_id"))
