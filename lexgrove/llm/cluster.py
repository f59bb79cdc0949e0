"""What the operators need from the session: lineage cuts in the shared folder, row keys and partition counts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGERS = ("byte", "short", "integer", "long")


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the session names, and read back from there.

    The files are in the shared store, so a lost executor costs no recomputation. A session on one machine (tests)
    that names no folder gets a temporary one; a cluster has to name one, as its executors share no local disk.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexgrove-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files, and where spark.cleaner.referenceTracking.cleanCheckpoints
    is set the checkpoints, of tables that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ids_are_keys(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether the key is a whole number that no two rows share. Moves one id a row at most."""
    if docs.schema[key].dataType.typeName() not in INTEGERS:
        return False
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull()).isEmpty()


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for every row, and that column's name; written, so that every use sees the same."""
    taken = [c.lower() for c in docs.columns]
    key = "__row__"
    while any(c.startswith(key) for c in taken):  # so that names made from it are free, too
        key += "_"
    return cut(docs.withColumn(key, F.monotonically_increasing_id())), key


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan_partitions(df: DataFrame) -> int:
    """Partitions of df's input as planned, without running a job."""
    return df.rdd.getNumPartitions()
