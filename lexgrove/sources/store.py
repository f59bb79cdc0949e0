"""A set of tables that changes as one: versioned manifests over immutable parquet folders.

A table is a list of batches, folders ``<root>/<table>/batch=<id>``; a batch may carry a tag, and a change of that tag takes its
place and leaves the others. A commit writes its batches first, then one small
manifest that names the batches of every table; the manifest appears by an atomic rename that never replaces another, so
readers see all tables of a commit or none, a job that dies midway leaves the old version in force, and of two writers
that began from one version the second fails. Readers are pinned to a version for as long as they hold it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

MANIFESTS, DIGITS = "manifests", 12


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Change:
    """Rows of a table for a commit: ``append`` keeps the earlier batches, ``tag`` those of other tags; ``partition`` lays
    rows out by columns, ``spread`` deals a partition's rows to several tasks by further ones."""

    rows: DataFrame
    append: bool = False
    tag: str | None = None
    partition: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()
    spread: tuple[Column, ...] = ()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._folder = self._path(MANIFESTS)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version": n, "tables": {name: [[batch, tag], ..]}} of a version, the latest by default."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(MANIFESTS, f"{version:0{DIGITS}d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version; ``batch`` tells where a row was written."""
        batches = self.manifest(version)["tables"][table]
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/batch={b}" for b, _ in batches])

    def has(self, table: str, version: int | None = None) -> bool:
        return bool(self.manifest(version)["tables"].get(table))

    def commit(self, changes: dict[str, Change | DataFrame], base: int | None = None) -> int:
        """Writes all changes and publishes them as the version after ``base`` (the latest, unless given)."""
        before = self.manifest(base)
        batch, tables = f"b{uuid.uuid4().hex}", dict(before["tables"])
        for name, change in changes.items():
            change = change if isinstance(change, Change) else Change(change)
            rows = change.rows.drop("batch")
            if change.partition:
                rows = rows.repartition(*change.partition, *change.spread).sortWithinPartitions(*change.partition, *change.sort)
            rows.write.partitionBy(*change.partition).parquet(f"{self.root}/{name}/batch={batch}")
            held = [b for b in tables.get(name, []) if change.append or (change.tag is not None and b[1] != change.tag)]
            tables[name] = [*held, [batch, change.tag]]
        return self._publish({"version": before["version"] + 1, "tables": tables})

    def _publish(self, manifest: dict) -> int:
        name = f"{manifest['version']:0{DIGITS}d}.json"
        self._fs.mkdirs(self._folder)
        draft = self._path(MANIFESTS, f"_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, self._path(MANIFESTS, name), no_options)
        except Exception as e:
            self._fs.delete(draft, False)
            if manifest["version"] in self.versions():
                raise Conflict(f"version {manifest['version']} of {self.root} was committed by another writer") from e
            raise
        return manifest["version"]
