"""Versioned tables: immutable folders of Parquet and a log of commits that names those of each version.

A version is one file of the log, which appears as a whole or not at all, so a reader never sees half of one. Writers write
their data first and then claim the next number; who finds it taken tries again on top of what the other has committed.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed on top of the version that this one expected."""


class Versions:
    """The versions of a table below `path`. Each has parts: (kind, folder, number of the commit that wrote it)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._at = self._hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path("log")):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path("log")) if s.getPath().getName().endswith(".json"))

    def latest(self) -> int:
        """The last version's number, 0 before the first."""
        return max(self.numbers(), default=0)

    def entry(self, version: int | None = None) -> dict:
        """What the log says of a version: version, at (seconds), note, meta, parts."""
        version = version or self.latest()
        if not version:
            return {"version": 0, "at": 0, "note": "", "meta": {}, "parts": []}
        stream = self._fs.open(self._path(f"log/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def list(self) -> list[dict]:
        """All versions, the last first, as a list of backups shows them."""
        return [{k: e[k] for k in ("version", "at", "note")} | {"parts": len(e["parts"])} for e in map(self.entry, reversed(self.numbers()))]

    def _claim(self, entry: dict) -> bool:
        """Publish a log file under its number unless that exists; the file is complete before it gets its name."""
        self._fs.mkdirs(self._path("log"))
        target, draft = self._path(f"log/{entry['version']:020d}.json"), self._path(f"log/.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename there would replace the other's file
                os.link(urlparse(draft.toString()).path, urlparse(target.toString()).path)
                return True
            return not self._fs.exists(target) and self._fs.rename(draft, target)  # fails where the name is taken
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)

    def write(self, kind: str, df: DataFrame, by: tuple[str, ...] = ()) -> tuple[str, str]:
        """Write data that no version names yet."""
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.path}/{folder}")
        return kind, folder

    def commit(self, added: list[tuple[str, str]], replace: bool = False, note: str = "", meta: dict | None = None, expected: int | None = None) -> int:
        """Make a version of the last one's parts (none with replace) and what was written. expected: the version that this
        must follow; else a writer that comes second goes on top of the first."""
        while True:
            last = self.entry()
            if expected is not None and last["version"] != expected:
                raise Conflict(f"version {last['version']} came after {expected}")
            version = last["version"] + 1
            kept = [] if replace else last["parts"]
            entry = {"version": version, "at": time.time(), "note": note, "meta": {**({} if replace else last["meta"]), **(meta or {})}, "parts": kept + [[kind, folder, version] for kind, folder in added]}
            if self._claim(entry):
                return version

    def restore(self, version: int) -> int:
        """A new version that is as the old one was; nothing in between is lost."""
        old = self.entry(version)
        while True:
            new = self.latest() + 1
            if self._claim(old | {"version": new, "at": time.time(), "note": f"restored {version}"}):
                return new

    def parts(self, kind: str, version: int | None = None) -> list[tuple[str, int]]:
        return [(f"{self.path}/{folder}", number) for k, folder, number in self.entry(version)["parts"] if k == kind]

    def read(self, kind: str, version: int | None = None, number: str | None = None) -> DataFrame | None:
        """The rows of a version's parts of one kind, on demand with the number of the commit that wrote them."""
        frames = [self.spark.read.parquet(p).withColumns({number: F.lit(n)} if number else {}) for p, n in self.parts(kind, version)]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def live(self, kind: str, version: int | None = None, id_col: str = "id") -> DataFrame | None:
        """The rows of a kind, but for those whose id a later commit names in its part "gone"."""
        rows, gone = self.read(kind, version, "_of"), self.read("gone", version, "_gone")
        if rows is None or gone is None:
            return None if rows is None else rows.drop("_of")
        return self.without(rows, gone, id_col)

    @staticmethod
    def without(rows: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
        last = gone.groupBy(F.col(id_col).alias("_gone_id")).agg(F.max("_gone").alias("_gone"))
        return rows.join(last, F.col(id_col) == F.col("_gone_id"), "left").where("_gone is null or _of >= _gone").drop("_of", "_gone", "_gone_id")

    def changes(self, kind: str, after: int, number: str = "version") -> DataFrame | None:
        """What commits after a version have added, each once, with their numbers; rows that a later version dropped included."""
        seen = {folder: n for v in self.numbers() if v > after for k, folder, n in self.entry(v)["parts"] if k == kind and n > after}
        frames = [self.spark.read.parquet(f"{self.path}/{folder}").withColumn(number, F.lit(n)) for folder, n in sorted(seen.items(), key=lambda x: x[1])]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def forget(self, keep: int) -> int:
        """Drop all but the last `keep` versions and the folders that none of these names."""
        numbers = self.numbers()
        kept = {folder for v in numbers[-keep:] for _, folder, _ in self.entry(v)["parts"]}
        gone = {folder for v in numbers[:-keep] for _, folder, _ in self.entry(v)["parts"]} - kept
        for v in numbers[:-keep]:
            self._fs.delete(self._path(f"log/{v:020d}.json"), False)
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        return len(gone)


class Backups:
    """Backups of a store: a version holds all its tables as they were at one moment, or none."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.versions = Versions(spark, path)

    def create(self, tables: dict[str, DataFrame], note: str = "") -> int:
        return self.versions.commit([self.versions.write(name, df) for name, df in tables.items()], replace=True, note=note)

    def list(self) -> list[dict]:
        return self.versions.list()

    def restore(self, version: int) -> dict[str, DataFrame]:
        """The tables of a version; a version that doesn't exist is an error."""
        if version not in self.versions.numbers():
            raise ValueError(f"no backup {version}")
        return {kind: self.versions.read(kind, version) for kind in dict.fromkeys(k for k, _, _ in self.versions.entry(version)["parts"])}


class ChangeFeed:
    """Events by commit: who joins late gets all there is as a snapshot with its number, and every later commit once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.versions = Versions(spark, path)

    def publish(self, events: DataFrame) -> int:
        return self.versions.commit([self.versions.write("events", events)])

    def snapshot(self) -> tuple[int, DataFrame | None]:
        version = self.versions.latest()
        return version, self.versions.read("events", version, "version") if version else None

    def after(self, version: int) -> tuple[int, DataFrame | None]:
        """The number up to which a consumer is served now, and what came after `version`, in the order of `version`."""
        upto = self.versions.latest()
        rows = self.versions.changes("events", version)
        return upto, None if rows is None else rows.where(F.col("version") <= upto)
