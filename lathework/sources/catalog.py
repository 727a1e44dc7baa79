"""Tables by name, and versioned tables that can be changed.

A written table is a manifest: a list of Parquet files and a schema. Appending adds files; updating and
deleting rewrite only the files that hold affected rows; nothing is overwritten in place. A transaction
keeps its manifests aside until it is committed, and a savepoint is a copy of those.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Manifest:
    files: tuple[str, ...]
    schema: T.StructType
    version: int = 0


class Catalog:
    """``folder`` holds ``<table>.parquet`` inputs; ``store`` takes written tables (all executors must reach it)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, store: str | None = None, schema: str | None = None):
        self.spark, self.folder, self.schema = spark, folder, schema
        self._store = store
        self.named: dict[str, DataFrame] = {}
        self.committed: dict[str, Manifest] = {}
        self.pending: dict[str, Manifest] | None = None
        self.savepoints: list[tuple[str, dict[str, Manifest]]] = []
        self.counters: dict[str, int] = {}

    @property
    def store(self) -> str:
        if self._store is None:
            base = self.spark.conf.get("spark.checkpoint.dir", None)
            if not base:
                if not self.spark.sparkContext.master.startswith("local"):
                    raise ValueError("name a store, or set spark.checkpoint.dir, that the driver and all executors share")
                base = "file://" + tempfile.mkdtemp(prefix="lathework-store-")
            self._store = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex[:12]}"
        return self._store

    # -- reading

    def register(self, name: str, df: DataFrame) -> None:
        self.named[name.lower()] = df

    def _key(self, schema: str | None, name: str) -> str:
        schema = schema or self.schema
        return f"{schema}.{name}".lower() if schema else name.lower()

    def _current(self, key: str) -> Manifest | None:
        return (self.pending or {}).get(key) or self.committed.get(key)

    def read(self, manifest: Manifest) -> DataFrame:
        if not manifest.files:
            return self.spark.createDataFrame([], manifest.schema)
        return self.spark.read.schema(manifest.schema).parquet(*manifest.files)

    def table(self, schema: str | None, name: str) -> DataFrame:
        key = self._key(schema, name)
        if manifest := self._current(key):
            return self.read(manifest)
        for k in (key, name.lower()):
            if k in self.named:
                return self.named[k]
        if self.folder:
            path = f"{self.folder.rstrip('/')}/{name}.parquet"
            if self._exists(path):
                self.named[key] = self.spark.read.parquet(path)
                return self.named[key]
        return self.spark.table(f"{schema or self.schema}.{name}" if schema or self.schema else name)

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    # -- writing

    def _written(self, df: DataFrame, key: str) -> tuple[str, ...]:
        path = f"{self.store}/{key}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return tuple(self.spark.read.schema(df.schema).parquet(path).inputFiles())

    def manifest(self, schema: str | None, name: str) -> tuple[str, Manifest]:
        """The table's current manifest; a Parquet table is adopted with its files, others are written once."""
        key = self._key(schema, name)
        if found := self._current(key):
            return key, found
        df = self.table(schema, name)
        files = tuple(df.inputFiles()) if key in self.named and self.folder and self._exists(f"{self.folder.rstrip('/')}/{name}.parquet") else self._written(df, key)
        return key, Manifest(files, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))

    def create(self, name: str, schema: T.StructType) -> None:
        """An empty table."""
        self._publish(self._key(None, name), Manifest((), schema))

    def drop(self, name: str) -> None:
        for place in (self.committed, self.named, self.pending or {}):
            place.pop(self._key(None, name), None)

    def _publish(self, key: str, manifest: Manifest) -> None:
        if self.pending is not None:
            self.pending[key] = manifest
        else:
            self.committed[key] = manifest
            self._save(key, manifest)

    def _save(self, key: str, manifest: Manifest) -> None:
        fs, target = self._fs(f"{self.store}/{key}/manifest-{manifest.version:08d}.json")
        out = fs.create(target, True)
        out.write(bytearray(json.dumps({"files": manifest.files, "schema": manifest.schema.jsonValue(), "version": manifest.version}).encode()))
        out.close()

    def load(self, name: str) -> bool:
        """Take up the newest manifest that an earlier catalog saved in the store."""
        key = self._key(None, name)
        fs, target = self._fs(f"{self.store}/{key}")
        if not fs.exists(target):
            return False
        names = sorted(s.getPath().toString() for s in fs.listStatus(target) if s.getPath().getName().startswith("manifest-"))
        if not names:
            return False
        saved = json.loads(self.spark.read.text(names[-1], wholetext=True).first()[0])
        self.committed[key] = Manifest(tuple(saved["files"]), T.StructType.fromJson(saved["schema"]), saved["version"])
        return True

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written to the store and read again, so that they are the same whenever they are asked for."""
        return self.read(Manifest(self._written(df, f"staged-{name}"), df.schema))

    def append(self, schema: str | None, name: str, rows: DataFrame) -> tuple[int, DataFrame]:
        """Add rows; missing columns become null. Returns their number and the rows as they were written."""
        key, now = self.manifest(schema, name)
        known = {c.lower(): c for c in rows.columns}
        extra = set(known) - {f.name.lower() for f in now.schema.fields}
        if extra:
            raise ValueError(f"{name} has no column {', '.join(sorted(extra))}")
        full = rows.select(*[(F.col(f"`{known[f.name.lower()]}`") if f.name.lower() in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in now.schema.fields])
        seen = Observation()
        files = self._written(full.observe(seen, F.count(F.lit(1)).alias("n")), key)
        self._publish(key, Manifest(now.files + files, now.schema, now.version + 1))
        return seen.get["n"], self.read(Manifest(files, now.schema))

    def rewrite(self, schema: str | None, name: str, alias: str, matches: Column, change: Callable[[DataFrame], DataFrame] | None) -> tuple[int, DataFrame]:
        """Change (or drop, without ``change``) the rows for which ``matches`` is true.

        Returns their number and the rows as they were. Only files with such rows are read again and written.
        """
        key, now = self.manifest(schema, name)
        sure = F.coalesce(matches, F.lit(False))
        before = self.read(now).alias(alias)
        hit = before.where(sure)
        if not now.files:
            return 0, hit
        places = hit.groupBy(F.col("_metadata.file_path").alias("file")).count().collect()  # one row per affected file
        if not places:
            return 0, hit
        # the same local file may be spelled file:/ or file:///
        known = {f.replace("file:///", "file:/", 1): f for f in now.files}
        affected = {known.get(p["file"].replace("file:///", "file:/", 1), p["file"]) for p in places}
        keep = tuple(f for f in now.files if f not in affected)
        if len(keep) + len(affected) != len(now.files):  # a store that spells its paths otherwise: rewrite all
            keep, affected = (), set(now.files)
        part = self.read(Manifest(tuple(affected), now.schema)).alias(alias)
        new = part.where(~sure) if change is None else change(part)
        files = self._written(new, key)
        self._publish(key, Manifest(keep + files, now.schema, now.version + 1))
        return sum(p["count"] for p in places), hit

    # -- transactions

    @property
    def in_transaction(self) -> bool:
        return self.pending is not None

    def begin(self) -> None:
        if self.pending is None:
            self.pending, self.savepoints = {}, []

    def commit(self) -> None:
        for key, manifest in (self.pending or {}).items():
            self.committed[key] = manifest
            self._save(key, manifest)
        self.pending, self.savepoints = None, []

    def rollback(self) -> None:
        self.pending, self.savepoints = None, []

    def savepoint(self, name: str) -> None:
        self.begin()
        self.savepoints.append((name, dict(self.pending or {})))

    def release(self, name: str) -> None:
        self.savepoints = self.savepoints[: self._savepoint(name)]

    def rollback_to(self, name: str) -> None:
        at = self._savepoint(name)
        self.pending = dict(self.savepoints[at][1])
        self.savepoints = self.savepoints[: at + 1]

    def _savepoint(self, name: str) -> int:
        for i in reversed(range(len(self.savepoints))):
            if self.savepoints[i][0] == name:
                return i
        raise ValueError(f"there is no savepoint {name}")

    # -- counters

    def counter(self, name: str, advance: int = 1) -> int:
        """The counter's value after ``advance`` more; 0 asks for the current one."""
        key = name.lower()
        if advance:
            self.counters[key] = self.counters.get(key, 0) + int(advance)
        elif key not in self.counters:
            raise ValueError(f"currval of sequence {name} is not yet defined")
        return self.counters[key]
