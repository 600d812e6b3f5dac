"""A store of analyses by content: each content is lowered once for every profile of settings, whatever files and trees it is in."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import lowering

#: Raised with every change of what lowering gives.
VERSION = 3
#: What the store keeps of an analysis.
FIELDS = ["failed", "scanned_lines", "exec_lines", "callables", "statements", "findings"]


def profile(**settings) -> str:
    """Fingerprint of the settings that an analysis depends on: equal settings in any order have equal ones, and so does no other version."""
    return hashlib.sha256(json.dumps({"version": VERSION, "settings": settings}, sort_keys=True).encode()).hexdigest()[:32]


def _folder(root: str, of: str) -> str:
    return f"{root.rstrip('/')}/profile={of}"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(path))


def _digest():
    return F.sha2(F.to_json(F.struct("oid", "language", *FIELDS)).cast("binary"), 256)


def stored(spark: SparkSession, root: str, of: str) -> DataFrame:
    """(oid, language, fields of lowering) of the profile ``of`` in the store, one row a content. Rows that don't have their digest are damaged and left out."""
    schema = StructType.fromDDL(lowering.SCHEMA.replace("path string", "oid string", 1) + ", digest string")
    folder = _folder(root, of)
    rows = spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)
    return rows.where(F.col("digest") == _digest()).drop("digest").dropDuplicates(["oid", "language"])


def misses(files: DataFrame, root: str, of: str) -> DataFrame:
    """One file of ``files(path, language, text, oid)`` for each content that the store doesn't have."""
    left = files.join(stored(files.sparkSession, root, of).select("oid", "language"), ["oid", "language"], "left_anti")
    return left.dropDuplicates(["oid", "language"])


def lower(files: DataFrame, root: str, of: str) -> DataFrame:
    """``lowering.lower`` of ``files(path, language, text, oid)`` by way of the store in the folder ``root``.

    What is missing is lowered and added to the folder of its profile: new files, which their writer's commit moves into place, so readers see all of an analysis or nothing, and
    two writers of one content leave it twice, which reads as once. Then all files take their rows from the store.
    """
    new = misses(files, root, of)
    if not new.isEmpty():
        made = lowering.lower(new.select(F.col("oid").alias("path"), "language", "text")).withColumnRenamed("path", "oid")
        made.select("oid", "language", *FIELDS, _digest().alias("digest")).write.mode("append").parquet(_folder(root, of))
    known = stored(files.sparkSession, root, of)
    return files.select("path", "language", "oid").join(known, ["oid", "language"]).select("path", "language", *FIELDS)


def load_plan(base: DataFrame, cand: DataFrame, changes: DataFrame, renames: DataFrame, cached: DataFrame, clones: bool = True) -> DataFrame:
    """(side, path, oid, action) of the files that a check analyses: ``hit`` those whose (oid, language) is in ``cached``, else ``miss``.

    Changed files of both sides, and with ``clones`` also the candidate's unchanged ones, whose duplicates a changed file may repeat. A renamed file's base is that of its old path.
    """
    gone = changes.where("status <> 'added'").select("path").union(renames.select(F.col("from_path"))).distinct()
    old = base.join(gone, "path", "left_semi").select(F.lit("base").alias("side"), "path", "oid", "language")
    new = changes.where("status <> 'deleted'").select("path").distinct()
    fresh = cand if clones else cand.join(new, "path", "left_semi")
    both = old.unionByName(fresh.select(F.lit("candidate").alias("side"), "path", "oid", "language"))
    probe = cached.select("oid", "language").distinct().withColumn("_hit", F.lit(True))
    return both.join(probe, ["oid", "language"], "left").select("side", "path", "oid", F.when(F.col("_hit"), "hit").otherwise("miss").alias("action"))
