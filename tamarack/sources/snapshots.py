"""Versions of keyed tables: data files that never change, and a manifest a version that is swapped in as one step.

A table's rows lie in buckets by the hash of its key columns. A commit writes new files for the buckets that it touches, and
then a manifest: for each table and bucket the folders that make it up, the version before, a time, and how far each stream
of batches has come. A manifest appears under its number by a rename that never replaces a file: what a crash leaves
behind no manifest names, so that readers keep the version they had, and of two writers that begin from one version one
gets an error. Manifests are as long as there are buckets, whatever the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.relational import merged

BUCKET = "_bucket"


@dataclass(frozen=True)
class Keyed:
    """A table: its schema (DDL), the columns that rows are dealt to buckets by, how many of these there are.

    Take so many that a bucket is a few hundred MB when the table is as large as it will get.
    """

    schema: str
    keys: tuple[str, ...]
    buckets: int = 64


@dataclass(frozen=True)
class Change:
    """Rows for ``buckets`` of a table (None: all): in place of what is there, or behind it. ``dealt``: rows that have
    their bucket in the column BUCKET and lie by it already."""

    rows: DataFrame
    buckets: tuple[int, ...] | None = None
    append: bool = False
    dealt: bool = False


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class Snapshots:
    """Versions of ``tables`` below the folder ``root``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Keyed]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(tables)

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._fs().listStatus(path)] if self._fs().exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None, as_of: datetime | None = None) -> dict:
        """A version's manifest: the last one's, one by number, or the last that was there at a time."""
        known = self.versions()
        if version is not None:
            if version and version not in known:
                raise ValueError(f"no version {version}")
            return self._manifest(version)
        if as_of is None:
            return self._manifest(known[-1] if known else 0)
        for v in reversed(known):
            found = self._manifest(v)
            if datetime.fromisoformat(found["time"]) <= as_of.astimezone(UTC):
                return found
        return self._manifest(0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"version": 0, "parent": None, "time": "0001-01-01T00:00:00+00:00", "tables": {}, "batches": {}}
        stream = self._fs().open(self._path("manifests", f"{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, version: int, manifest: dict) -> None:
        """The manifest under its number, whole or not at all, and never in place of another."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, final = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"{version:020d}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, how)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {version} is there already") from e
            raise

    # rows

    def bucket(self, name: str) -> Column:
        """The bucket of a row by the table's key columns."""
        table = self.tables[name]
        return F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> tuple[int, ...]:
        """The buckets that ``rows``, which have the key columns, lie in."""
        return tuple(sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect()))

    def read(self, name: str, buckets: tuple[int, ...] | None = None, version: int | None = None, as_of: datetime | None = None) -> DataFrame:
        """A table's rows in one version; of ``buckets`` only, if given, whose files alone are then read."""
        parts = self.manifest(version, as_of)["tables"].get(name, {})
        folders = [f"{self.root}/{f}" for b, own in parts.items() if buckets is None or int(b) in buckets for f in own]
        schema = self.tables[name].schema
        # joins with a table that is known to be empty are left out of the plan
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema).where(F.lit(False))

    def commit(self, changes: Mapping[str, Change], parent: int | None = None, batch: tuple[str, int] | None = None, at: datetime | None = None) -> int:
        """Write the changes of all tables and make them one new version, whose number is returned.

        ``parent`` is the version that the rows were derived from; if another came in between, ``Conflict`` is raised and
        nothing changes. ``batch``: a stream and the number of the batch that the version brings it to.
        """
        before = self.manifest(parent)
        tables = {name: {b: list(f) for b, f in parts.items()} for name, parts in before["tables"].items()}
        with ThreadPoolExecutor(max(1, len(changes))) as pool:  # the tables' jobs run beside each other
            made = list(pool.map(lambda c: self._write(*c), changes.items()))
        for (name, change), folders in zip(changes.items(), made):
            own = tables.setdefault(name, {})
            if not change.append:
                for b in list(own) if change.buckets is None else map(str, change.buckets):
                    own.pop(b, None)
            for b, f in folders.items():
                own.setdefault(b, []).append(f)
        version = before["version"] + 1
        time = (at or datetime.now(UTC)).astimezone(UTC).isoformat()
        batches = before["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._swap(version, {"version": version, "parent": before["version"], "time": time, "tables": tables, "batches": batches})
        return version

    def _write(self, name: str, change: Change) -> dict[str, str]:
        """New files of a table; the folder of each bucket that got any."""
        columns = self.spark.createDataFrame([], self.tables[name].schema).columns
        rows = change.rows if change.dealt else change.rows.withColumn(BUCKET, self.bucket(name)).repartition(BUCKET)
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.select(*columns, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{BUCKET}=")}

    def done(self, stream: str, batch_id: int) -> bool:
        """Whether a version has taken in that batch of a stream, whose numbers rise."""
        return self.manifest()["batches"].get(stream, -1) >= batch_id

    def upsert(self, name: str, new: DataFrame, rules: Mapping[str, str], seq: str = "seq", batch: tuple[str, int] | None = None, at: datetime | None = None) -> int:
        """Rows by key, each column by its rule (see ``relational.MERGE_RULES``); only buckets with new rows are read and
        written. A batch that was taken in before changes nothing."""
        now = self.manifest()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return now["version"]
        buckets, keys = self.touched(name, new), list(self.tables[name].keys)
        if not buckets:
            return now["version"]
        both = self.read(name, buckets, now["version"]).unionByName(new, allowMissingColumns=True)
        # dealt by bucket once, for the aggregate and for the files
        rows = both.withColumn(BUCKET, self.bucket(name)).repartition(BUCKET)
        return self.commit({name: Change(merged(rows, [BUCKET, *keys], dict(rules), seq), buckets, dealt=True)}, now["version"], batch, at)

    def replace(self, name: str, rows: DataFrame, at: datetime | None = None) -> int:
        """A version in which the table holds ``rows`` alone."""
        return self.commit({name: Change(rows)}, self.manifest()["version"], at=at)

    def removed(self, name: str, before: int, after: int) -> DataFrame:
        """Keys that version ``before`` has and ``after`` has not; buckets that both share aren't read."""
        keys, (a, b) = self.tables[name].keys, (self.manifest(v)["tables"].get(name, {}) for v in (before, after))
        differ = tuple(int(k) for k in a if a[k] != b.get(k))
        old, new = (self.read(name, differ, v).select(*keys).distinct() for v in (before, after))
        return old.join(new, list(keys), "left_anti")

    def expire(self, keep: int) -> list[str]:
        """Forget all but the last ``keep`` versions and delete what no version names, but not what a running commit could
        have written: call it while there is none. Returns the folders that went."""
        known, fs = self.versions(), self._fs()
        named = {f.rpartition("/")[0] for v in known[-keep:] for parts in self._manifest(v)["tables"].values() for own in parts.values() for f in own}
        for v in known[:-keep]:
            fs.delete(self._path("manifests", f"{v:020d}.json"), False)
        gone = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in named]
        for folder in gone:
            fs.delete(self._path(folder), True)
        return gone
