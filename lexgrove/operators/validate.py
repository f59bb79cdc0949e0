"""Data-quality rules over ordered unit records: rule, severity, unit_id, detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.hierarchy import number_key
from lexgrove.operators.statute import REPEALED_WORDS

ALLOWED_PARENTS = {"part": (), "section": ("part",), "subsection": ("section",), "chapter": ("part", "section", "subsection"), "article": ("chapter", "section", "subsection", "part"), "point": ("article",), "subpoint": ("point",), "paragraph": ("article", "point", "subpoint")}


def validate(units: DataFrame) -> DataFrame:
    """Issues of units(act, unit_id, parent_unit_id, kind, number, text, edit_note, duplicate_of, ord).

    Every rule reads flags that one pass over the ordered units computes; a unit's parent and its having children are
    the only joins.
    """
    u = units.withColumn("__key", number_key("number"))
    keyed = F.when(F.size("__key") > 0, F.col("__key"))
    before = lambda own, *keys: F.last(own, True).over(W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    is_article = (F.col("kind") == "article") & F.col("duplicate_of").isNull()
    u = u.withColumn("__nth", F.row_number().over(W.partitionBy("unit_id").orderBy("ord")))
    u = u.withColumn("__article", before(F.when(is_article, keyed), "act")).withColumn("__sibling", before(keyed, "parent_unit_id", "kind"))
    parents = units.select(F.col("unit_id").alias("parent_unit_id"), F.col("kind").alias("__parent")).dropDuplicates(["parent_unit_id"])
    hosts = units.where("parent_unit_id is not null").select(F.col("parent_unit_id").alias("unit_id"), F.lit(True).alias("__host")).distinct()
    u = u.join(parents, "parent_unit_id", "left").join(hosts, "unit_id", "left")

    kind, key, note = F.col("kind"), F.col("__key"), F.coalesce(F.lower("edit_note"), F.lit("")).contains("утратил")
    allowed = F.lit(False)
    for k, above in ALLOWED_PARENTS.items():
        allowed = allowed | ((kind == k) & F.col("__parent").isin(*above)) if above else allowed
    hung, has_key = F.col("parent_unit_id").isNotNull(), F.size(key) > 0
    falls = lambda column: has_key & F.col(column).isNotNull() & (key <= F.col(column))
    empty = kind.isin("article", "point", "subpoint", "paragraph") & (F.trim("text") == "") & ~note & F.col("__host").isNull()
    rules = [
        ("duplicate_unit_id", "error", F.col("__nth") > 1, F.col("__nth")),
        ("orphan_unit", "error", ~hung & (kind != "part"), kind),
        ("missing_parent", "error", hung & F.col("__parent").isNull(), F.col("parent_unit_id")),
        ("bad_parent_kind", "error", hung & F.col("__parent").isNotNull() & ~allowed, F.col("__parent")),
        ("article_order", "error", is_article & falls("__article"), F.col("number")),
        ("article_gap", "info", is_article & (F.size(key) == 1) & (F.size("__article") == 1) & (F.try_element_at(key, F.lit(1)) > F.try_element_at("__article", F.lit(1)) + 1), F.col("number")),
        ("point_order", "error", (kind == "point") & falls("__sibling"), F.col("number")),
        ("subpoint_order", "error", (kind == "subpoint") & falls("__sibling"), F.col("number")),
        ("subpoint_number", "error", (kind == "subpoint") & ~has_key, F.col("number")),
        ("empty_text", "warning", empty, kind),
        ("repealed_units", "info", F.lower("text").rlike("^(?:" + "|".join(REPEALED_WORDS) + r")\s+силу") | note, kind),
        ("fractional_numbers", "info", F.col("number").contains("."), F.col("number")),
    ]
    found = [F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))) for rule, severity, when, detail in rules]
    return u.select("unit_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.rule", "x.severity", "unit_id", "x.detail")


def counts(units: DataFrame) -> DataFrame:
    return units.groupBy("kind").count()


def report(issues: DataFrame, samples: int = 10) -> DataFrame:
    """rule, severity, n and the first units of each rule; a task passes on no more of a rule than is shown."""
    by = ["rule", "severity"]
    first = issues.withColumn("__nth", F.row_number().over(W.partitionBy(*by).orderBy("unit_id"))).where(F.col("__nth") <= samples)
    shown = first.groupBy(*by).agg(F.sort_array(F.collect_list("unit_id")).alias("first"))
    return issues.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(shown, by, "left")
