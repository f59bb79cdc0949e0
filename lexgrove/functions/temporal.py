"""Valid-time algebra on half-open intervals [valid_from, valid_to); NULL is an open end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_on(day: str | Column, start: str | Column = "valid_from", end: str | Column = "valid_to") -> Column:
    """start <= day < end, open where NULL."""
    day = F.to_date(F.lit(day)) if isinstance(day, str) and day[:1].isdigit() else col(day)
    return (col(start).isNull() | (col(start) <= day)) & (col(end).isNull() | (col(end) > day))


def latest(df: DataFrame, keys: list[str], start: str = "valid_from", ties: list[str] = ()) -> DataFrame:
    """The row of each key with the latest start (NULL starts last, then ``ties`` ascending)."""
    order = W.partitionBy(*keys).orderBy(F.col(start).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])
    return df.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def as_of(df: DataFrame, day: str, keys: list[str], start: str = "valid_from", end: str = "valid_to", ties: list[str] = ()) -> DataFrame:
    """The version of each key in force on a day: the filter runs before the window's shuffle."""
    return latest(df.where(valid_on(day, start, end)), keys, start, ties)


def versions(df: DataFrame, keys: list[str], start: str, ties: list[str] = ()) -> DataFrame:
    """df with valid_to: each version ends where the next one of its key starts."""
    order = W.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first(), *ties)
    return df.withColumn("valid_to", F.lead(start).over(order))


def history(df: DataFrame, keys: list[str], day: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """All versions, oldest first, with ``version`` and whether it is current on a day."""
    order = W.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first())
    return df.withColumn("version", F.row_number().over(order)).withColumn("current", valid_on(day, start, end))


def add_versions(old: DataFrame, new: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """old with the rows of new: an open interval that began earlier closes at the new start, a version of
    the same start is replaced. One window over the union, no update in place."""
    stacked = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    same = W.partitionBy(*keys, start).orderBy(F.col("__new").desc())
    kept = stacked.withColumn("__nth", F.row_number().over(same)).where("__nth = 1")
    order = W.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first())
    after = F.min(F.when(F.col("__new") == 1, F.col(start))).over(order.rowsBetween(1, W.unboundedFollowing))
    return kept.withColumn(end, F.coalesce(F.when(F.col(end).isNull(), after), F.col(end))).drop("__new", "__nth")


def close(df: DataFrame, ended: DataFrame, keys: list[str], day: str, end: str = "valid_to") -> DataFrame:
    """df where the open intervals of the keys in ended(keys, day) end on that day."""
    hit = df.join(ended.select(*keys, F.col(day).alias("__day")), keys, "left")
    return hit.withColumn(end, F.when(F.col(end).isNull(), F.col("__day")).otherwise(F.col(end))).select(*df.columns)


def compress(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Change-only intervals of a series: keys, value, valid_from, valid_to."""
    order = W.partitionBy(*keys).orderBy(day)
    change = df.withColumn("__before", F.lag(value).over(order)).withColumn("__nth", F.row_number().over(order))
    starts = change.where((F.col("__nth") == 1) | ~F.col("__before").eqNullSafe(F.col(value)))
    return starts.select(*keys, value, F.col(day).alias("valid_from"), F.lead(day).over(order).alias("valid_to"))


def islands(df: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """Runs of neighbouring rows with equal values: keys, values, first, last, n."""
    order = W.partitionBy(*keys).orderBy(day)
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.lag(v).over(order).eqNullSafe(F.col(v))
    run = df.withColumn("__new", F.when(F.row_number().over(order) == 1, 1).otherwise(differs.cast("int")))
    run = run.withColumn("__run", F.sum("__new").over(order))
    return run.groupBy(*keys, "__run", *values).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def range_join(points: DataFrame, intervals: DataFrame, day: str, how: str = "left", keys: list[str] = (), bucket_days: int = 32) -> DataFrame:
    """points x intervals where day lies in [valid_from, valid_to) and the keys agree.

    Both sides meet by equality on time buckets, so neither needs a broadcast; an interval is listed once
    per bucket it covers, up to the last day asked for.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / bucket_days)
    span = points.agg(F.min(bucket(F.col(day))).alias("__min"), F.max(bucket(F.col(day))).alias("__max"))
    low = F.greatest(F.coalesce(bucket(F.col("valid_from")), F.col("__min")), F.col("__min"))
    high = F.least(F.coalesce(bucket(F.date_sub("valid_to", 1)), F.col("__max")), F.col("__max"))
    listed = intervals.crossJoin(F.broadcast(span)).where(low <= high).withColumn("__bucket", F.explode(F.sequence(low, high))).drop("__min", "__max")  # span is one row
    right = listed.select("__bucket", *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in intervals.columns if c not in keys])
    left = points.withColumn("__bucket", bucket(F.col(day)))
    on = (left["__bucket"] == right["__bucket"]) & valid_on(F.col(day))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on, how).drop("__bucket", *[f"__{k}" for k in keys])


def reload_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, kind (added, changed, removed) of two states; unchanged keys give no row."""
    a, b = old.select(key, F.col(value).alias("__old")), new.select(key, F.col(value).alias("__new"))
    both = a.withColumn("__in_old", F.lit(True)).join(b.withColumn("__in_new", F.lit(True)), key, "full_outer")
    kind = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(key, kind.alias("kind")).where("kind is not null")
