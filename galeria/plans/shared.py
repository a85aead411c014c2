"""Intermediate tables in the folder that the driver and all executors share, and components of edges.

Nothing here reads a local path: what is written goes to the folder named by
``spark.checkpoint.dir``, and goes away again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where none is set and one machine does all, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if root is None and jsc.getCheckpointDir().isDefined():
        root = jsc.getCheckpointDir().get()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="galeria-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


#: The lists of paths that the open ``scratch`` blocks of this thread (or other context) have made, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def _made(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return path


def path_of(df: DataFrame) -> str:
    """Where ``checkpoint`` put a frame's rows."""
    return df.__dict__.get("rows_at") or df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def checkpoint(df: DataFrame, plain: bool = False) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors. Goes like a table of ``stored``.

    ``plain`` also cuts what Spark knows of the rows' partitioning. In loops it must go: a
    join knows the partitionings of both its sides, so they would double each round; and a
    join of plain frames shuffles both sides, which adaptive execution can split.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    path = _made(spark, path_of(out))
    if plain:
        rows = out._jdf.queryExecution().toRdd()
        out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)
        out.__dict__["rows_at"] = path
    return out


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder; return it reread, and its path.

    The table goes when the driver's JVM ends, or earlier through ``discard`` or ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(_made(spark, path)), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete what ``stored`` and ``checkpoint`` wrote, once nothing reads it any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Delete all that this thread wrote inside to the shared folder at the end, but the paths put into the set that it gives.

    What is kept belongs to the block around it, if there is one. Other threads have blocks
    of their own.
    """
    mine, keep = [], set()
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield keep
    finally:
        _OPEN.reset(token)
        discard(spark, *(p for p in mine if p not in keep))
        if _OPEN.get():
            _OPEN.get()[-1].extend(p for p in mine if p in keep)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def partitions(df: DataFrame, each: int = 64 << 20, most: int = 100_000) -> int:
    """Partitions to deal ``df`` out to: the session's shuffle partitions, more where its input is larger than ``each`` bytes a partition.

    Sizes are Spark's estimate, taken only for plans of one input, where no join multiplies it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.collectLeaves().size() == 1:
        n = max(n, min(most, int(str(plan.stats().sizeInBytes())) // each))
    return n


def components(edges: DataFrame, few: int = 8192) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(v, comp)`` per vertex.

    ``comp`` is the smallest vertex reachable. At most ``few`` edge ends, a checked number,
    are joined by one task. Of more, each vertex points to a smaller one. In every round a
    vertex, and the one it points to, take the smallest that a neighbour's pointer points
    to, and pointers are halved; so whole trees move at once and the rounds grow with the
    logarithm of the vertices, long chains included. All joins are keyed, with a plain
    shuffle of a checkpoint on each side, so that adaptive execution splits the edges of a
    hub and the vertices of a large component; minima combine before their shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both.where("a <> b").distinct(), plain=True)
    if both.limit(few + 1).count() <= few:
        kind = both.schema["a"].dataType
        return both.coalesce(1).mapInArrow(_united, T.StructType([T.StructField("v", kind), T.StructField("comp", kind)]))
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    labels = checkpoint(labels.select("v", F.least("v", "m").alias("comp")), plain=True)
    none = F.lit(None).cast(both.schema["a"].dataType)
    while True:
        jump = labels.select(F.col("v").alias("comp"), F.col("comp").alias("further"))
        labels = checkpoint(labels.join(jump, "comp").select("v", "comp", "further"), plain=True)
        near = both.join(labels.select(F.col("v").alias("b"), "further"), "b").groupBy(F.col("a").alias("v")).agg(F.min("further").alias("m"))
        moved = checkpoint(labels.join(near, "v").select("v", "comp", F.least("further", "m").alias("m")), plain=True)
        new = moved.select("v", F.col("m").alias("new"), F.col("comp").alias("old")).union(moved.select("comp", "m", none))
        new = checkpoint(new.groupBy("v").agg(F.min("new").alias("comp"), F.max("old").alias("old")), plain=True)
        labels = new.select("v", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task to (vertex, smallest vertex reachable)."""
    up: dict = {}

    def root(v):
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(v) for v in up], kind)], ["v", "comp"])
