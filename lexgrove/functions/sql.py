"""The engine's functions under names of their own in SQL: table functions over whole tables, and scalar functions.

``register(spark)`` makes them known to a session. Table functions take TABLE(..) and add their columns to those of the input
row, whose names they learn when the query is analysed; scalar ones are SQL expressions that the optimiser sees through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexgrove.operators import citations, patch, versions

SCALARS = {
    "valid_on(starts DATE, ends DATE, day DATE) RETURNS BOOLEAN": "(starts IS NULL OR starts <= day) AND (ends IS NULL OR ends > day)",
    "unit_ancestors(unit STRING) RETURNS ARRAY<STRING>": "transform(sequence(1, size(split(unit, '[.]'))), i -> array_join(slice(split(unit, '[.]'), 1, i), '.'))",
    "in_subtree(unit STRING, root STRING) RETURNS BOOLEAN": "unit = root OR startswith(unit, concat(root, '.'))",
    "article_of(unit STRING) RETURNS STRING": "coalesce(nullif(regexp_extract(unit, '^(.*?[.]art[^.]+)', 1), ''), unit)",
    "number_key(number STRING) RETURNS ARRAY<INT>": "CASE WHEN number RLIKE '^[0-9]+([.-][0-9]+)*$' THEN transform(split(number, '[.-]'), x -> cast(x AS INT)) ELSE cast(array() AS ARRAY<INT>) END",
}


def _told(table: AnalyzeArgument, needed: tuple[str, ...], added: StructType) -> AnalyzeResult:
    """The input's columns, then the added ones; wrong input is an error of analysis, before anything runs."""
    if not table.isTable:
        raise ValueError("the argument has to be TABLE(..)")
    held = table.dataType.fieldNames()
    if missing := [n for n in needed if n not in held]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    if twice := [n for n in added.fieldNames() if n in held]:
        raise ValueError(f"the table has a column {', '.join(twice)} already")
    return AnalyzeResult(StructType([*table.dataType.fields, *added.fields]))


class Citations:
    """citations(TABLE(t)): one row a unit cited in the column ``text``, with what is cited and where it stands."""

    ADDED = StructType([StructField(n, StringType()) for n in ("kind", "raw_citation", "section", "chapter", "article", "point", "subpoint")] + [StructField("paragraph_ordinal", IntegerType()), StructField("relative_to", StringType()), StructField("act_name", StringType()), StructField("starts_at", IntegerType()), StructField("confidence", DoubleType())])

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _told(table, ("text",), Citations.ADDED)

    def eval(self, row: Row) -> Iterator[tuple]:
        for c in citations.internal(None, row["text"] or ""):
            yield (*row, *(c["start" if n == "starts_at" else n] for n in self.ADDED.fieldNames()))


class ShortCitations:
    """short_citations(TABLE(t)): one row a citation of free text, in short or full form, with its place in ``text``."""

    ADDED = StructType([StructField("raw", StringType()), StructField("starts_at", IntegerType()), *(StructField(n, StringType()) for n in ("article", "point", "subpoint")), StructField("paragraph_ordinal", IntegerType())])

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _told(table, ("text",), ShortCitations.ADDED)

    def eval(self, row: Row) -> Iterator[tuple]:
        for c in citations.short_citations(row["text"] or ""):
            ordinal = c.get("paragraph_ordinal")
            yield (*row, c["raw"], c["start"], c["article"], c.get("point"), c.get("subpoint"), None if ordinal is None else int(ordinal))


class Instructions:
    """instructions(TABLE(t)): one row an instruction of the amending law in ``text``, in its order."""

    ADDED = StructType([StructField("nth", IntegerType()), *(StructField(n, StringType()) for n in ("operation", "article", "point", "subpoint")), StructField("paragraph", IntegerType()), *(StructField(n, StringType()) for n in ("old", "new", "new_kind", "new_number"))])

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _told(table, ("text",), Instructions.ADDED)

    def eval(self, row: Row) -> Iterator[tuple]:
        for nth, i in enumerate(patch.read_law(row["text"] or "")):
            yield (*row, nth, *(i[n] for n in self.ADDED.fieldNames()[1:]))


class DiffLines:
    """diff_lines(TABLE(t)): the aligned lines of the columns ``before`` and ``after``."""

    ADDED = StructType([StructField("op", StringType()), StructField("line_before", IntegerType()), StructField("line_after", IntegerType()), StructField("line", StringType())])

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _told(table, ("before", "after"), DiffLines.ADDED)

    def eval(self, row: Row) -> Iterator[tuple]:
        for found in versions.align(*(row[c].split("\n") if row[c] is not None else [] for c in ("before", "after"))):
            yield (*row, *found)


TABLES = {"citations": Citations, "short_citations": ShortCitations, "instructions": Instructions, "diff_lines": DiffLines}


def register(spark: SparkSession) -> None:
    """Table and scalar functions for the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, handler in TABLES.items():
        spark.udtf.register(name, udtf(handler))
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
