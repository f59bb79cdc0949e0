"""The page archive: table and stream give the same rows, days are pruned, a second run reads what is new."""

import datetime

from pyspark.sql import functions as F

from lexgrove.sources import archive


def test_batch_and_stream_agree_and_resume(spark, tmp_path):
    archive.register(spark)
    root, target, checkpoint = (f"{tmp_path}/{n}" for n in ("pages", "read", "checkpoint"))
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.when(F.col("id") % 9 != 0, F.lit("<p>é </p>")).alias("html"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 10).cast("int")).alias("day"))
    first, second = pages.where("page_id < 40"), pages.where("page_id >= 40")
    stream = lambda: spark.readStream.format("page_archive").load(root).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    key = lambda df: sorted((r["page_id"], r["url"], r["html"], r["day"]) for r in df.collect())
    first.write.partitionBy("day").json(root)
    stream()
    assert key(spark.read.schema(archive.SCHEMA).parquet(target)) == key(first) == key(spark.read.format("page_archive").load(root))
    before = set(archive.files(root))
    second.write.mode("append").partitionBy("day").json(root)
    reader = archive.ArchiveStream(root)
    assert {p.name for p in reader.partitions({"file": max(before)}, reader.latestOffset())} == set(archive.files(root)) - before
    stream()
    assert key(spark.read.schema(archive.SCHEMA).parquet(target)) == key(pages)


def test_days_outside_a_filter_are_not_opened(spark, tmp_path):
    archive.register(spark)
    root = f"{tmp_path}/pages"
    spark.range(20).select(F.col("id").alias("page_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("day")).write.partitionBy("day").json(root)
    (tmp_path / "pages" / "day=2024-01-02").joinpath("broken.json").write_text("{not json")
    rows = spark.read.format("page_archive").load(root)
    assert rows.where("day >= date'2024-01-03' and page_id > 10").count() == 5  # the broken day is not read
    assert rows.where("day = date'2024-01-01'").count() == 5
    reader = archive.ArchiveReader(root)
    kept = list(reader.pushFilters([archive.GreaterThan(("day",), datetime.date(2024, 1, 3)), archive.EqualTo(("url",), "x")]))
    assert [type(f).__name__ for f in kept] == ["EqualTo"] and {archive.day_of(p.name).day for p in reader.partitions()} == {4}


def test_an_archive_without_files(spark, tmp_path):
    archive.register(spark)
    assert spark.read.format("page_archive").load(f"{tmp_path}/none").count() == 0
