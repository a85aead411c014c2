"""Data sources for files: the first bytes of many files, and copies that all arrive or none.

``register`` makes them known to a session. Reading gives ``path, length, prefix`` and
takes no more than ``bytes`` of any file; writing takes ``source, target`` and copies into
a folder through a staging folder of the job.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from galeria.sources.folders import files, opened

PREFIX = 4 << 20


@dataclass
class Paths(InputPartition):
    """Files of one task: (path, length)."""

    paths: list[tuple[str, int]]


class PrefixReader(DataSourceReader):
    """Reads at most ``bytes`` of each file under ``path``, ``files`` files a task, a few megabytes at a time."""

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("bytes", PREFIX))
        self.each, self.suffix = int(options.get("files", 64)), options.get("suffix", "")

    def partitions(self) -> list[Paths]:
        system, path = opened(self.path)
        found = [(i.path, i.size) for i in files(system, path, self.suffix)]
        return [Paths(found[k : k + self.each]) for k in range(0, len(found), self.each)]

    def read(self, partition: Paths | None) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for path, length in partition.paths if partition else ():  # None: there are no files
            with system.open_input_file(path) as file:
                prefix = file.read(self.most)
            columns = [pa.array([path]), pa.array([length], pa.int64()), pa.array([prefix], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length", "prefix"])


class Prefixes(DataSource):
    """The source ``galeria_prefixes``: options path, bytes, suffix, files."""

    @classmethod
    def name(cls) -> str:
        return "galeria_prefixes"

    def schema(self) -> str:
        return "path string, length long, prefix binary"

    def reader(self, schema) -> PrefixReader:
        return PrefixReader(self.options)


@dataclass
class Copied(WriterCommitMessage):
    """What a task has staged: (staged file, target, length); and how many files were there already."""

    staged: list[tuple[str, str, int]]
    there: int


class CopyWriter(DataSourceWriter):
    """Copies ``source`` to ``target`` under ``path``. Tasks copy into a staging folder; commit renames, abort deletes it.

    A file that stands at its target with the source's length is not copied again. A task
    that fails deletes what it staged, so neither a retry nor a lost executor leaves a file
    behind; what a lost task had staged goes with the folder.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Copied:
        system, root = opened(self.path)
        staged, there = [], 0
        try:
            for r in rows:
                source_system, source = opened(r["source"])
                length = source_system.get_file_info(source).size
                if length is None:
                    raise FileNotFoundError(r["source"])
                if system.get_file_info(f"{root}/{r['target']}").size == length:
                    there += 1
                    continue
                system.create_dir(f"{root}/{self.staging}", recursive=True)
                held = f"{root}/{self.staging}/{uuid.uuid4().hex}"
                staged.append((held, r["target"], length))
                with source_system.open_input_stream(source, compression=None) as a, system.open_output_stream(held, compression=None) as b:
                    copied = 0
                    while block := a.read(1 << 20):
                        b.write(block)
                        copied += len(block)
                if copied != length:
                    raise OSError(f"{r['source']} has {copied} bytes, not {length}")
        except BaseException:
            for held, _, _ in staged:
                if system.get_file_info(held).is_file:
                    system.delete_file(held)
            raise
        return Copied(staged, there)

    def _clear(self) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type.name == "Directory":
            system.delete_dir(f"{root}/{self.staging}")

    def commit(self, messages: list[Copied | None]) -> None:
        system, root = opened(self.path)
        moved: list[str] = []
        try:
            for message in messages:
                for held, target, _ in message.staged if message else ():
                    place = f"{root}/{target}"
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    new = not system.get_file_info(place).is_file
                    system.move(held, place)
                    if new:
                        moved.append(place)
        except BaseException:
            for place in moved:  # all of them or none
                system.delete_file(place)
            raise
        finally:
            self._clear()

    def abort(self, messages: list[Copied | None]) -> None:
        self._clear()


class Copies(DataSource):
    """The sink ``galeria_copies``: rows (source, target) to files under the option path."""

    @classmethod
    def name(cls) -> str:
        return "galeria_copies"

    def schema(self) -> str:
        return "source string, target string"

    def writer(self, schema, overwrite: bool) -> CopyWriter:
        return CopyWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the sources known to the session."""
    spark.dataSource.register(Prefixes)
    spark.dataSource.register(Copies)


def prefixes(spark: SparkSession, path: str, most: int = PREFIX, suffix: str = "") -> DataFrame:
    """``path, length, prefix``: at most ``most`` bytes of each file under ``path``; hidden files are left out."""
    register(spark)
    return spark.read.format("galeria_prefixes").option("path", path).option("bytes", most).option("suffix", suffix).load()


def duplicate_files(spark: SparkSession, path: str, most: int = PREFIX, suffix: str = "") -> DataFrame:
    """``length, hash, n, first_path, reclaimable``: groups of equal files under ``path``; ``hash`` is the SHA-256 of the first ``most`` bytes.

    Lengths are compared first, then prefixes, and only files that share both and are longer
    than a prefix are read whole. Empty files are equal. A folder without files gives no rows.
    """
    found = prefixes(spark, path, most, suffix)
    lengths = found.select("length").groupBy("length").agg(F.count("*").alias("c")).where("c > 1").select("length")
    hashed = found.join(lengths, "length", "left_semi").select("path", "length", F.sha2("prefix", 256).alias("hash"))
    long = hashed.where(F.col("length") > most)
    shared = long.groupBy("length", "hash").agg(F.count("*").alias("c")).where("c > 1")
    whole = [r["path"] for r in long.join(shared, ["length", "hash"], "left_semi").select("path").toLocalIterator()]
    groups = hashed.where(F.col("length") <= most).withColumn("whole", F.col("hash"))
    if whole:
        bodies = spark.read.format("binaryFile").load(whole).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("whole"))
        groups = groups.unionByName(long.join(bodies, "path"))
    groups = groups.groupBy("length", "hash", "whole").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).drop("whole")
    return groups.where("n > 1").withColumn("reclaimable", F.col("length") * (F.col("n") - 1))


def copy_files(rows: DataFrame, path: str) -> None:
    """Copy every ``source`` to its ``target`` under ``path``: all of them, or none if one fails."""
    register(rows.sparkSession)
    rows.select("source", "target").write.format("galeria_copies").option("path", path).mode("append").save()
