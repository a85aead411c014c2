"""A table in versions by hash buckets: a batch rewrites only the buckets it touches, and a feed gives what changed.

Version n is a manifest that names, for each bucket, the version whose folder holds it.
A batch writes the buckets that it changes to a new folder and then its manifest, by one
rename: before that nothing refers to the folder, so a batch that stops on the way leaves
the table as it was, and one that runs again does nothing. The change feed compares the two
folders of a bucket that differ between successive versions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from galeria.plans.shared import fresh
from galeria.sources.folders import files, opened


class Snapshots:
    """The table under ``path``: rows by ``keys``, in ``buckets`` buckets by the keys' hash (its own number once it has a version)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The numbers of the versions that are there, from 1."""
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version is made of; the last one's if not said, None before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0])

    def _folders(self, manifest: dict, some: set[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{v:012d}/bucket={b}" for b, v in sorted(manifest["held"].items()) if some is None or int(b) in some]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table at a version, the last one if not said; None before the first."""
        m = self.manifest(version)
        return m and self._read(m)

    def _read(self, m: dict, some: set[int] | None = None) -> DataFrame:
        schema, folders = T.StructType.fromJson(m["schema"]), self._folders(m, some)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def apply(self, changes: DataFrame, batch: int, order: str | None = None) -> int:
        """The version after a batch of changes: columns of the table, and ``op`` (put or remove; put where there is none).

        Of a key's changes the last by ``order`` counts, any one without it. Batch numbers
        must grow: one that is not larger than the last version's has been applied. Keys may
        be null; columns named otherwise than the first batch's are an error.
        """
        old = self.manifest()
        if old and batch <= old["batch"]:
            return old["version"]
        n, number = old["buckets"] if old else self.buckets, (old["version"] if old else 0) + 1
        columns = [f.name for f in T.StructType.fromJson(old["schema"]).fields] if old else [c for c in changes.columns if c not in ("op", order)]
        rows = changes if "op" in changes.columns else changes.withColumn("op", F.lit("put"))
        bucket, rank = fresh(rows, "bucket"), fresh(rows, "rank")
        last = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc(order) if order else F.lit(0)))
        rows = rows.withColumn(rank, last).where(F.col(rank) == 1).select("op", *columns).withColumn(bucket, self._bucket(n))
        rows = rows.persist()
        try:
            touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # at most as many as there are buckets
            puts = rows.where("op = 'put'").select(*columns, bucket)
            if old:
                before = self._read(old, touched)
                same = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.keys]
                kept = before.alias("b").join(rows.alias("c"), same, "left_anti")
                puts = kept.withColumn(bucket, self._bucket(n)).unionByName(puts)
            schema = puts.select(*columns).schema
            puts.withColumnRenamed(bucket, "bucket").repartition(min(n, max(1, len(touched))), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/{number:012d}")
        finally:
            rows.unpersist()
        there = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._path(f"data/{number:012d}")) if "=" in f.getPath().getName()}
        held = {b: v for b, v in (old["held"] if old else {}).items() if int(b) not in touched} | {str(b): number for b in there}
        self._commit({"version": number, "batch": batch, "buckets": n, "keys": self.keys, "held": held, "schema": json.loads((T.StructType.fromJson(old["schema"]) if old else schema).json())})
        return number

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(n)).cast("int")

    def _commit(self, manifest: dict) -> None:
        name = f"manifests/{manifest['version']:012d}"
        self._fs.mkdirs(self._path("manifests"))
        out = self._fs.create(self._path(f"{name}.part"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(self._path(f"{name}.part"), self._path(f"{name}.json")):
            raise OSError(f"{name} is there already: another writer was faster")

    def forget(self, before: int) -> None:
        """Delete the versions below ``before`` and the folders that none of the others holds."""
        keep = [v for v in self.versions() if v >= before]
        used = {v for k in keep for v in self.manifest(k)["held"].values()}
        for v in self.versions():
            if v < before:
                self._fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        data = self._path("data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if int(f.getPath().getName()) < before and int(f.getPath().getName()) not in used:
                self._fs.delete(f.getPath(), True)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str | None = None, buckets: int = 64):
    """A writer that applies every micro-batch to the table of ``Snapshots`` under ``path``, once a batch."""
    return stream.writeStream.foreachBatch(lambda batch, number: Snapshots(batch.sparkSession, path, keys, buckets).apply(batch, number, order))


@dataclass
class Pair(InputPartition):
    """A bucket that differs between two versions: its folders, None where it has no rows."""

    version: int
    before: str | None
    after: str | None


def _rows(system, folder: str | None, schema: pa.Schema, keys: list[str]) -> dict[tuple, dict]:
    out: dict[tuple, dict] = {}
    for info in files(system, folder, ".parquet") if folder else ():
        with system.open_input_file(info.path) as file:
            for batch in pq.ParquetFile(file).iter_batches():
                for r in batch.select(schema.names).to_pylist():
                    out[tuple(r[k] for k in keys)] = r
    return out


def _same(a, b) -> bool:
    """Equal, and not a number equal to not a number."""
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a):
        return math.isnan(b)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


class ChangeReader:
    """What changed from one version to the next, bucket by bucket; a task holds two versions of one bucket."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def _manifests(self) -> dict[int, str]:
        system, root = opened(self.path)
        return {int(i.path.rsplit("/", 1)[1][:-5]): i.path for i in files(system, f"{root}/manifests", ".json", recursive=False)}

    def _manifest(self, path: str) -> dict:
        system, _ = opened(self.path)
        with system.open_input_stream(path) as file:
            return json.loads(file.read())

    def last(self) -> int:
        return max(self._manifests(), default=0)

    def pairs(self, start: int, end: int) -> list[Pair]:
        there = self._manifests()
        _, root = opened(self.path)
        known = [v for v in sorted(there) if start <= v <= end]
        if start and start not in there:
            raise ValueError(f"version {start} has been forgotten: the feed can't go on from it")
        before, out = (self._manifest(there[start])["held"] if start else {}), []
        for v in known:
            if v == start:
                continue
            held = self._manifest(there[v])["held"]
            folder = lambda of, b: f"{root}/data/{of[b]:012d}/bucket={b}" if b in of else None
            out += [Pair(v, folder(before, b), folder(held, b)) for b in sorted({*before, *held}, key=int) if before.get(b) != held.get(b)]
            before = held
        return out

    def read(self, partition: Pair | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # nothing changed
            return
        m = self._manifest(self._manifests()[partition.version])
        schema = to_arrow_schema(T.StructType.fromJson(m["schema"]))
        system, _ = opened(self.path)
        old, new = (_rows(system, f, schema, m["keys"]) for f in (partition.before, partition.after))
        found = [("insert", r) for k, r in new.items() if k not in old] + [("delete", r) for k, r in old.items() if k not in new]
        found += [("update", r) for k, r in new.items() if k in old and not _same(r, old[k])]
        for at in range(0, len(found), 4096):
            some = found[at : at + 4096]
            columns = [pa.array([partition.version] * len(some), pa.int64()), pa.array([op for op, _ in some], pa.string())]
            columns += [pa.array([r[f.name] for _, r in some], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, ["version", "op", *schema.names])


class BatchChanges(ChangeReader, DataSourceReader):
    """The changes of the versions after the option ``after`` (0) up to ``until`` (the last)."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.after, self.until = int(options.get("after", 0)), options.get("until")

    def partitions(self) -> list[Pair]:
        return self.pairs(self.after, self.last() if self.until is None else int(self.until))


class StreamChanges(ChangeReader, DataSourceStreamReader):
    """The changes as a stream; an offset is a version."""

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": self.last()}

    def partitions(self, start: dict, end: dict) -> list[Pair]:
        return self.pairs(start["version"], end["version"])


class Changes(DataSource):
    """The source ``galeria_changes``: ``version, op`` (insert, update, delete) and the table's columns; of deleted rows the last they had."""

    @classmethod
    def name(cls) -> str:
        return "galeria_changes"

    def schema(self) -> T.StructType:
        reader = ChangeReader(self.options)
        there = reader._manifests()
        if not there:
            raise ValueError(f"{reader.path} has no version yet")
        own = T.StructType.fromJson(reader._manifest(there[max(there)])["schema"])
        return T.StructType([T.StructField("version", T.LongType()), T.StructField("op", T.StringType()), *own.fields])

    def reader(self, schema) -> BatchChanges:
        return BatchChanges(self.options)

    def streamReader(self, schema) -> StreamChanges:
        return StreamChanges(self.options)


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    """The stream of changes of the table of ``Snapshots`` under ``path``."""
    spark.dataSource.register(Changes)
    return spark.readStream.format("galeria_changes").option("path", path).load()


def changes_between(spark: SparkSession, path: str, after: int = 0, until: int | None = None) -> DataFrame:
    """The changes of the versions after ``after`` up to ``until``, the last if not said."""
    spark.dataSource.register(Changes)
    reader = spark.read.format("galeria_changes").option("path", path).option("after", after)
    return (reader if until is None else reader.option("until", until)).load()
