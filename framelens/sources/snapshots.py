"""Versioned table sets: a version is visible only when its manifest is.

A root folder holds ``data/<table>-<uuid>`` (Parquet) and ``manifest/v<n>``
(JSON rows: version, table, folder). ``publish`` writes the tables' folders
first and the manifest last. Spark's committer moves the manifest into place
when its job commits, and readers only follow manifests, so a torn write
leaves nothing but unread folders, and a rewrite can read the version that it
replaces. A table is one or more folders: ``append`` adds one to those of the
last version, ``tables`` starts anew (and so also compacts).

One writer at a time (the daily run); any number of readers. The manifest of
the newest version is what reaches the driver: a row for each table and
appended folder. Folders of old versions stay until the owner removes them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, table string, folder string"


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def latest(self) -> int:
        """The newest complete version; 0 if there is none."""
        return self._manifests().agg(F.max("version")).first()[0] or 0

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table in a version (the newest, unless one is named)."""
        version = self.latest() if version is None else version
        out: dict[str, list[str]] = {}
        for r in self._manifests().where(F.col("version") == version).orderBy("table", "folder").collect():
            out.setdefault(r.table, []).append(r.folder)
        if version and not out:
            raise FileNotFoundError(f"{self.root} has no version {version}")
        return out

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self.folders(version).get(table)
        if not found:
            raise FileNotFoundError(f"{self.root} has no table {table}" + (f" in version {version}" if version else ""))
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in found])

    def _store(self, table: str, df: DataFrame) -> str:
        folder = f"data/{table}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, tables: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> int:
        """Write a new version and return its number. Tables named in neither argument stay as they are."""
        version = self.latest()
        folders = self.folders(version) if version else {}
        for name, df in (append or {}).items():
            folders[name] = [*folders.get(name, []), self._store(name, df)]
        for name, df in (tables or {}).items():
            folders[name] = [self._store(name, df)]
        rows = [(version + 1, name, f) for name, fs in sorted(folders.items()) for f in fs]
        # overwrite: an earlier, torn attempt at this version may have left its folder
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/v{version + 1}")
        return version + 1
