"""Path-shaped identifiers: every prefix that ends at a dot is an ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.sources.shared import written


def ancestors(unit: str | Column) -> Column:
    """The identifier's own path and those above it, outermost first."""
    c = F.col(unit) if isinstance(unit, str) else unit
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def in_subtree(unit: Column, root: Column) -> Column:
    """unit is root or lies below it (a plain prefix test; no wildcard surprises)."""
    return (unit == root) | unit.startswith(F.concat(root, F.lit(".")))


def related(a: Column, b: Column) -> Column:
    """Equal, above or below."""
    return in_subtree(a, b) | in_subtree(b, a)


def article_of(unit: str | Column) -> Column:
    """The path down to its article segment; identifiers without one stay as they are."""
    c = F.col(unit) if isinstance(unit, str) else unit
    found = F.regexp_extract(c, r"^(.*?\.art[^.]+)", 1)
    return F.when(found != "", found).otherwise(c)


def related_join(left: DataFrame, right: DataFrame, left_unit: str, right_unit: str, on: list[tuple[str, str]] = ()) -> DataFrame:
    """left x right where the units are equal or one is above the other, or both lie in one article, and the
    columns of ``on`` (left name, right name) agree.

    Each side lists its ancestors; pairs then meet by equality on them. The pair is found when one unit is
    an ancestor of the other, which is an equality of the shorter one with a listed ancestor. Both sides are tables, and
    listing makes them larger than the planner takes them to be, so neither is broadcast.
    """

    def meet(a: Column, b: Column) -> DataFrame:
        same = F.col("__left_key") == F.col("__right_key")
        for x, y in on:
            same = same & (F.col(x) == F.col(y))
        return left.withColumn("__left_key", a).join(right.withColumn("__right_key", b).hint("merge"), same)

    up = meet(F.explode(ancestors(left_unit)), F.col(right_unit))
    down = meet(F.col(left_unit), F.explode(ancestors(right_unit))).where(F.col(left_unit) != F.col(right_unit))
    article = meet(article_of(left_unit), article_of(right_unit)).where(~related(F.col(left_unit), F.col(right_unit)) & F.col("__left_key").contains(".art"))
    return up.unionByName(down).unionByName(article).drop("__left_key", "__right_key")


def number_key(number: str | Column) -> Column:
    """'105.16-6' -> [105, 16, 6]; not a number -> empty. Arrays compare as tuples do."""
    c = F.col(number) if isinstance(number, str) else number
    return F.when(c.rlike(r"^\d+([.-]\d+)*$"), F.transform(F.split(c, "[.-]"), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))


def parent_closure(nodes: DataFrame, node: str, parent: str, depth: int | None = None) -> DataFrame:
    """node, ancestor, distance for every pair, or up to ``depth`` levels, by doubling joins.

    Each of the log2 rounds is written, so a later one reads a table instead of all before; the rounds end where
    no pair is twice as far. A cycle of parents ends them with an error.
    """
    reach = written(nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")).distinct())
    step = 1
    while depth is None or step < depth:
        top = reach.where(F.col("distance") == step).select(F.col("node").alias("__n"), F.col("ancestor").alias("__a"))
        far = top.join(reach.withColumnRenamed("node", "__a"), "__a").select(F.col("__n").alias("node"), "ancestor", (F.col("distance") + step).alias("distance"))
        far = written(far.distinct())
        if far.isEmpty():
            break
        if not far.where(F.col("node") == F.col("ancestor")).isEmpty():
            raise ValueError("a node is its own ancestor")
        reach, step = reach.unionByName(far), step * 2
    return reach if depth is None else reach.where(F.col("distance") <= depth)


def subtree_totals(leaves: DataFrame, unit: str, value: str) -> DataFrame:
    """Sum and count of value over every node's subtree."""
    return leaves.withColumn("node", F.explode(ancestors(unit))).groupBy("node").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def full_text(units: DataFrame) -> DataFrame:
    """unit_id, full_text: a unit's own text and that of the points and subpoints below it, in order.

    units(unit_id, kind, number, text, ord). Paragraph units repeat their parent's text and stay out.
    """
    piece = F.when(F.col("kind") == "point", F.concat("number", F.lit(". "), "text")).when(F.col("kind") == "subpoint", F.concat("number", F.lit(") "), "text")).otherwise(F.col("text"))
    below = units.where("kind <> 'paragraph'").select(F.explode(ancestors("unit_id")).alias("root"), F.col("unit_id").alias("below"), "ord", piece.alias("piece"), "text")
    own = F.when(F.col("root") == F.col("below"), F.col("text")).otherwise(F.col("piece"))
    rows = below.where(own.isNotNull() & (own != "")).groupBy("root").agg(F.sort_array(F.collect_list(F.struct("ord", own.alias("t")))).alias("p"))
    return units.select(F.col("unit_id")).join(rows.select(F.col("root").alias("unit_id"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("full_text")), "unit_id", "left").na.fill("", ["full_text"])


def duplicate_suffixes(units: DataFrame, unit: str = "unit_id", order: str = "ord") -> DataFrame:
    """units whose nth repeated identifier carries @n and names the first one in duplicate_of."""
    nth = F.row_number().over(W.partitionBy(unit).orderBy(order))
    out = units.withColumn("__nth", nth).withColumn("duplicate_of", F.when(F.col("__nth") > 1, F.col(unit)))
    return out.withColumn(unit, F.when(F.col("__nth") > 1, F.concat(F.col(unit), F.lit("@"), F.col("__nth"))).otherwise(F.col(unit))).drop("__nth")


def edge_weights(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def degrees(weights: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, out_weight, in_weight; self loops count once on each side."""
    both = weights.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0).cast("long").alias("iw")).unionByName(
        weights.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).cast("long").alias("ow"), F.col("weight").alias("iw"))
    )
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("ow").alias("out_weight"), F.sum("iw").alias("in_weight"))
