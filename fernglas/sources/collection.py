"""A collection: rows by id in hash buckets, changed by commits, read as snapshots.

Every change is a folder of new rows (or ids that go) and an entry in the log; nothing is rewritten, so a change of 1 % of the rows
writes about 1 % of the bytes. A snapshot is the base without the ids that changed since, and those ids' latest rows. When changes
pile up, the buckets that have most of them are written anew, those alone. A log entry names every folder of its version and comes
into being by one rename that never replaces another, so a crash or a lost race leaves the version before as it was, and readers of
old versions keep their files until ``vacuum``.

Base files hold one bucket each, sorted by id, with a Bloom filter on it: the row of an id is found in one file's row group. Ids are
not null and occur once in a change; ValueError otherwise. Columns are fixed when a collection is made; missing ones are null,
others are an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from .readers import exists

#: Changes (folders) that a version may have, and their share of the base's bytes, before buckets are written anew.
MOST_CHANGES, MOST_SHARE = 16, 0.25
_BUCKET, _GONE, _AT = "__bucket", "__gone", "__version"


class Conflict(RuntimeError):
    """Another writer has taken this version."""


@dataclass(frozen=True)
class Collection:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: str = "photo_id", buckets: int = 64) -> Collection:
        made = cls(spark, path.rstrip("/"))
        made._commit({"version": 0, "key": key, "buckets": buckets, "schema": schema.jsonValue(), "base": [], "changes": [], "tag": None})
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        if not exists(spark, f"{path.rstrip('/')}/log"):
            raise FileNotFoundError(f"no collection at {path}")
        return cls(spark, path.rstrip("/"))

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, schema: StructType, key: str = "photo_id", buckets: int = 64) -> Collection:
        return cls.open(spark, path) if exists(spark, f"{path.rstrip('/')}/log") else cls.create(spark, path, schema, key, buckets)

    # ---- the log ----

    def _system(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._system().listStatus(self._hadoop(f"{self.path}/log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def entry(self, version: int | None = None) -> dict:
        """The log's entry of a version, by default the last."""
        version = self.versions()[-1] if version is None else version
        where = f"{self.path}/log/{version:012d}.json"
        if not exists(self.spark, where):
            raise LookupError(f"no version {version} of {self.path}")
        stream = self._system().open(self._hadoop(where))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, entry: dict) -> int:
        system, name = self._system(), f"{self.path}/log/{entry['version']:012d}.json"
        if system.exists(self._hadoop(name)):
            raise Conflict(name)
        draft = f"{self.path}/log/.draft-{uuid.uuid4().hex}"
        out = system.create(self._hadoop(draft), False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(system.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)  # none: an existing file is an error
        try:
            context.rename(self._hadoop(draft), self._hadoop(name), kind)
        except Exception as e:
            system.delete(self._hadoop(draft), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from None
            raise
        return entry["version"]

    def _next(self, change: dict | None, tag: str | None = None, tries: int = 5) -> int:
        """A version after the last with one more change; changes don't depend on what is there, so a lost race is tried again."""
        for _ in range(tries):
            last = self.entry()
            if tag is not None and last["tag"] == tag:
                return last["version"]
            version = last["version"] + 1
            changes = last["changes"] + ([] if change is None else [{**change, "version": version}])
            try:
                return self._commit({**last, "version": version, "changes": changes, "tag": tag})
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} races were lost")

    # ---- changes ----

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _fitted(self, rows: DataFrame, entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        if more := sorted(set(rows.columns) - set(schema.names)):
            raise ValueError(f"not columns of {self.path}: {', '.join(more)}")
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))

    def _stage(self, rows: DataFrame, entry: dict, gone: bool, batch: int = 0) -> dict | None:
        """Write a change's rows, at most ``batch`` a file (0: any number); None if there are none. Until a commit names them
        they are seen by nobody, so a task that fails leaves nothing behind but files for ``vacuum``."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = rows.withColumns({_GONE: F.lit(gone), _BUCKET: self.bucket(F.col(entry["key"]), entry["buckets"])})
        rows.repartitionByRange(_BUCKET, entry["key"]).sortWithinPartitions(_BUCKET, entry["key"]).write.option("maxRecordsPerFile", batch).parquet(f"{self.path}/{folder}")
        ids = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").select(entry["key"])
        n, distinct = ids.groupBy(entry["key"]).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") == 1) - F.count_if(F.col(entry["key"]).isNull())).first()
        if n != distinct:
            raise ValueError("ids must not be null and occur once in a change")
        return {"folder": folder, "rows": n} if n else None

    def upsert(self, rows: DataFrame, tag: str | None = None, batch: int = 0) -> int:
        """The new version. tag: names the change; it is left out if the last version has the same. batch: the most rows that a
        file takes."""
        entry = self.entry()
        change = self._stage(self._fitted(rows, entry), entry, False, batch)
        version = self._next(change, tag) if change or tag else entry["version"]
        return self._tidy(version)

    def delete(self, ids: DataFrame) -> int:
        """Take the rows of ``ids`` (a column of the key) out."""
        entry = self.entry()
        some = self._fitted(ids.select(entry["key"]).where(F.col(entry["key"]).isNotNull()).distinct(), entry)
        change = self._stage(some, entry, True)
        return self._tidy(self._next(change) if change else entry["version"])

    def ingest(self, rows: DataFrame, reset: bool = False, batch: int = 5000) -> bool:
        """Fill the collection once, in files of at most ``batch`` rows, and check the count: False and nothing done if it has rows
        and ``reset`` isn't set."""
        if not reset and not self.snapshot().isEmpty():
            return False
        if reset:
            self.clear()
        self.upsert(rows, batch=batch)
        if (there := self.snapshot().count()) != (given := rows.count()):
            raise ValueError(f"{there} rows stored of {given}")
        return True

    def clear(self) -> int:
        """Take all rows out."""
        last = self.entry()
        return self._commit({**last, "version": last["version"] + 1, "base": [], "changes": [], "tag": None})

    def _bytes(self, folder: str) -> int:
        return self._system().getContentSummary(self._hadoop(f"{self.path}/{folder}")).getLength()

    def _tidy(self, version: int) -> int:
        """Write the buckets with most changes anew if there are too many."""
        entry = self.entry(version)
        if not entry["changes"]:
            return version
        changed, base = (sum(self._bytes(f) for f in {c["folder"] for c in entry[kind]}) for kind in ("changes", "base"))
        if len(entry["changes"]) <= MOST_CHANGES and changed <= MOST_SHARE * base:
            return version
        try:
            return self.compact(version)
        except Conflict:
            return version  # the next change will

    def compact(self, version: int | None = None) -> int:
        """Write the buckets that changed since they were written, those alone."""
        entry = self.entry(version)
        if not entry["changes"]:
            return entry["version"]
        touched = sorted(r[0] for r in self._changes(entry).select(_BUCKET).distinct().collect())  # at most the number of buckets
        folder = f"data/{uuid.uuid4().hex}"
        rows = self._merged(entry, touched).withColumn(_BUCKET, self.bucket(F.col(entry["key"]), entry["buckets"]))
        writer = rows.repartition(_BUCKET).sortWithinPartitions(_BUCKET, entry["key"]).write.partitionBy(_BUCKET)
        writer.option(f"parquet.bloom.filter.enabled#{entry['key']}", "true").parquet(f"{self.path}/{folder}")
        there = {f.getPath().getName().partition("=")[2] for f in self._system().listStatus(self._hadoop(f"{self.path}/{folder}"))}
        kept = [b for b in entry["base"] if b["bucket"] not in touched]
        base = kept + [{"bucket": b, "folder": f"{folder}/{_BUCKET}={b}"} for b in touched if str(b) in there]
        return self._commit({**entry, "version": entry["version"] + 1, "base": base, "changes": []})

    # ---- snapshots ----

    def _changes(self, entry: dict) -> DataFrame:
        """All changed rows, with the version of their change."""
        schema = StructType.fromJson(entry["schema"]).add(_GONE, BooleanType()).add(_BUCKET, IntegerType())
        out = self.spark.createDataFrame([], schema).withColumn(_AT, F.lit(0).cast("long"))
        for c in entry["changes"]:
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.path}/{c['folder']}").withColumn(_AT, F.lit(c["version"]).cast("long")))
        return out

    def _merged(self, entry: dict, buckets: list[int] | None = None, wanted: Column | None = None) -> DataFrame:
        schema, key = StructType.fromJson(entry["schema"]), entry["key"]
        folders = [f"{self.path}/{b['folder']}" for b in entry["base"] if buckets is None or b["bucket"] in buckets]
        base = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        changes = self._changes(entry)
        if buckets is not None:
            changes = changes.where(F.col(_BUCKET).isin(buckets))
        if wanted is not None:
            base, changes = base.where(wanted), changes.where(wanted)
        if not entry["changes"]:
            return base
        rows = F.struct(_GONE, *schema.names)
        latest = changes.groupBy(F.col(key).alias("__key")).agg(F.max_by(rows, _AT).alias("row"))
        kept = base.join(latest.select("__key"), F.col(key) == F.col("__key"), "left_anti")
        return kept.unionByName(latest.select("row.*").where(~F.col(_GONE)).drop(_GONE))

    def snapshot(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the last."""
        return self._merged(self.entry(version))

    def lookup(self, key: object, version: int | None = None) -> Row | None:
        """The row of one id: its bucket's file alone is read, and of it the row group that may hold the id."""
        return self.lookups([key], version).first()

    def lookups(self, keys: list, version: int | None = None) -> DataFrame:
        """The rows of a few ids."""
        entry = self.entry(version)
        kind = StructType.fromJson(entry["schema"])[entry["key"]].dataType
        local = self.spark.createDataFrame([(k,) for k in keys if k is not None], StructType().add("key", kind))
        buckets = sorted({r[0] for r in local.select(self.bucket(F.col("key"), entry["buckets"])).collect()})
        return self._merged(entry, buckets, F.col(entry["key"]).isin([k for k in keys if k is not None]))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove the entries but for the last ``keep``, and the folders that only they name. Returns the folders."""
        versions = self.versions()
        stay = {f"{c['folder']}".split("/")[1] for v in versions[-keep:] for kind in ("base", "changes") for c in self.entry(v)[kind]}
        system, gone = self._system(), []
        for v in versions[:-keep]:
            system.delete(self._hadoop(f"{self.path}/log/{v:012d}.json"), False)
        if exists(self.spark, f"{self.path}/data"):
            for f in system.listStatus(self._hadoop(f"{self.path}/data")):
                if f.getPath().getName() not in stay:
                    system.delete(f.getPath(), True)
                    gone.append(f.getPath().getName())
        return gone
