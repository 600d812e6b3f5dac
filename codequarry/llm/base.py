"""Shared plumbing: scratch tables in the cluster's shared folder, connected components, Arrow row slices.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every executor can read, so a lost
executor costs a task retry and never a lost intermediate. Where the setting is absent, and the driver is the only machine (master ``local``
or ``local[...]``, as in tests), a temporary folder is chosen here; ``local-cluster`` and real clusters must name one.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Spark puts at a plan (files of a written table, less what is projected away) up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, read from the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove what operators of this session have left: the tables that their results read, and token shards. Call it when the results are written."""
    delete_path(spark, _session_dir(spark))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one operator run; ``drop`` and ``keep_only`` remove those that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back, which cuts its lineage."""
        path = new_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Drop all tables but these, which the result still reads."""
        for path in self.paths - {t._scratch_path for t in tables}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        delete_path(self.spark, path)
        self.paths.discard(path)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its estimated bytes are at most ``limit``, else unchanged, and the join shuffles.

    Use on written tables: there the estimate is the size of the files, and filters can only lower the truth.
    """
    return F.broadcast(df) if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit else df


def fresh_names(docs: DataFrame, *names: str) -> None:
    """Refuse input columns that an operator is about to add (names compare as Spark does, without case)."""
    taken = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"input columns {sorted(taken)} have the names of result columns; rename them first")


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges(u, v)``, v < u, has one edge up or is a root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low > 0 and high > 0").isEmpty()


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links(a, b)`` of longs: rows (node, root), root the smallest node.

    Alternates large-star and small-star steps until only stars are left, each written to a table of ``scratch``; the last stays. Every step is a min-aggregation
    with a map-side combine and a join, so a hub with very many links never meets in one task as a list. Nodes
    without a link to another node are absent. Null ends and self links are ignored.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = scratch.table(links.where("a <> b").select(u, v).distinct(), "edges")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = scratch.table(moved.union(low).distinct(), "edges")
        scratch.drop(edges)
        edges = fresh
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with null as empty, as one flat array."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return col.fill_null("")


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 20):
    """Cut a batch into row ranges of about ``limit`` bytes of text; a longer text stands alone."""
    import numpy as np

    if batch.num_rows == 0:
        return
    col = text_column(batch, name)
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
