"""Sources of trees: folders, and commits and indexes of a git repository on a shared path."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import discovery

SCHEMA = "path string, oid string, size long, content binary"


def folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, oid, size, content) of all files below ``root``, without those of ``.git``.

    Files over the ceiling are not read: their content is null, and size and time of change stand for it in their oid.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = root.rstrip("/").split("://")[-1] + "/"
    rel = F.substr(F.col("path"), F.locate(bare, F.col("path")) + len(bare))
    small = rows.where(F.col("length") <= discovery.CEILING).select(rel.alias("path"), F.sha2("content", 256).alias("oid"), F.col("length").alias("size"), "content")
    stamp = F.concat_ws(":", F.lit("large"), F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    large = rows.where(F.col("length") > discovery.CEILING).select(rel.alias("path"), stamp.alias("oid"), F.col("length").alias("size"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).where("path not rlike '(^|/)[.]git/'")


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def merge_base(repo: str, a: str, b: str) -> str:
    """The best common ancestor of two commits."""
    return _git(repo, "merge-base", a, b).decode().strip()


def commit(spark: SparkSession, repo: str, revision: str = "HEAD") -> DataFrame:
    """(path, oid, size, content) of the files of a commit. Bytes of a path that are not UTF-8 are written as ``\\xNN``, so different paths stay different."""
    rows = [r.split(b"\t", 1) for r in _git(repo, "ls-tree", "-r", "-z", revision).split(b"\0") if r]
    return _blobs(spark, repo, [(p.decode(errors="backslashreplace"), h.split()[2].decode()) for h, p in rows if h.split()[1] == b"blob"])


def index(spark: SparkSession, repo: str) -> DataFrame:
    """(path, oid, size, content) of the files in the index. An index with conflicts is no snapshot (G101)."""
    rows = [r.split(b"\t", 1) for r in _git(repo, "ls-files", "-s", "-z").split(b"\0") if r]
    clashes = sorted({p.decode(errors="backslashreplace") for h, p in rows if h.split()[2] != b"0"})
    if clashes:
        raise ValueError(f"G101: conflicted entries in the index: {', '.join(clashes[:5])}")
    return _blobs(spark, repo, [(p.decode(errors="backslashreplace"), h.split()[1].decode()) for h, p in rows])


def _blobs(spark: SparkSession, repo: str, entries: list[tuple[str, str]]) -> DataFrame:
    """Contents are read in tasks, one ``git cat-file`` process a task; only names and ids pass through the driver."""
    names = spark.createDataFrame(entries, "path string, oid string").repartition(max(1, min(len(entries) // 200 + 1, 2000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for b in batches:
                for path, oid in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    git.stdin.write(oid.encode() + b"\n")
                    git.stdin.flush()
                    size = int(git.stdout.readline().split()[2])
                    data = git.stdout.read(size)
                    git.stdout.read(1)
                    kept = data if size <= discovery.CEILING else None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([oid]), pa.array([size], pa.int64()), pa.array([kept], pa.binary())], names=["path", "oid", "size", "content"])
            git.stdin.close()

    return names.mapInArrow(run, SCHEMA)


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(glob, negated) of the lines of an ignore file at the root, for ``discovery.ignored``."""
    out = []
    for line in text.split("\n"):
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[negated:]
        anchored = "/" in rule.rstrip("/")
        out.append((rule.lstrip("/").rstrip("/") + ("/**" if rule.endswith("/") else "") if anchored else discovery.anywhere(rule), negated))
    return out


def texts(files: DataFrame) -> DataFrame:
    """``files(path, content, ...)`` with ``language`` and ``text``; text is null where the content is missing or not UTF-8."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumns({"language": discovery.language(F.col("path")), "text": text}).drop("content")
