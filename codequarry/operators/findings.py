"""Findings of two snapshots matched by rule, context and syntax digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut

KEY = ["rule", "digest", "ctx_path", "ctx_ix"]


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("path", "ix")))


def match(base: DataFrame, cand: DataFrame, pairs: DataFrame, renames: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, unmatched candidates) of ``base`` and ``cand(path, ix, rule, digest, line, owner)``.

    ``owner`` is the place of the enclosing callable in its file, or null. The context of a finding is its callable, if ``pairs(base_path, base_ix, path, ix)`` holds it, named
    as the candidate names it; else its file under the candidate's path. Inside a key of rule, digest and context, findings whose lines map to each other (``mapped``, under the candidate's path) are
    paired first, the k-th base finding of a line with the k-th candidate of the line that it maps to; what is left is paired in order, by path
    and place. Pairs are (base_path, base_ix, path, ix, phase, in_file_context), phase ``line`` or ``order``; unmatched rows have the columns of ``cand``.
    """
    renamed = renames.select(F.col("from_path").alias("path"), F.col("path").alias("to"))
    old = pairs.select(F.col("base_path").alias("path"), F.col("base_ix").alias("owner"), F.col("path").alias("c_path"), F.col("ix").alias("c_ix"))
    new = pairs.select("path", F.col("ix").alias("owner"), F.lit(True).alias("known")).distinct()
    lines = mapped.where("base_line is not null and line is not null").select(F.col("path").alias("file"), F.col("base_line"), F.col("line").alias("to_line"))
    b = base.join(renamed, "path", "left").withColumn("file", F.coalesce("to", "path")).join(old, ["path", "owner"], "left")
    b = b.withColumns({"ctx_path": F.coalesce("c_path", "file"), "ctx_ix": F.coalesce("c_ix", F.lit(-1))})  # -1: the file itself
    b = cut(b.withColumnRenamed("line", "base_line").join(lines, ["file", "base_line"], "left").select(*KEY, "file", "path", "ix", "to_line"))
    c = cand.join(new, ["path", "owner"], "left").withColumns({"ctx_path": F.col("path"), "ctx_ix": F.when(F.col("known"), F.col("owner")).otherwise(-1)})
    c = cut(c.select(*KEY, "path", "ix", "line"))

    def joined(x: DataFrame, y: DataFrame, key: list[str], phase: str) -> DataFrame:
        x = x.select(*key, "k", F.col("path").alias("base_path"), F.col("ix").alias("base_ix"))
        y = y.select(*key, "k", F.col("path").alias("cand_path"), "ix")
        got = x.join(y, [*key, "k"])
        return got.select("base_path", "base_ix", F.col("cand_path").alias("path"), "ix", F.lit(phase).alias("phase"), (F.col("ctx_ix") < 0).alias("in_file_context"))

    at = [*KEY, "file", "to_line"]
    by_line = cut(joined(_numbered(b.where("to_line is not null"), at), _numbered(c.withColumns({"file": F.col("path"), "to_line": F.col("line")}), at), at, "line"))
    rest_b = b.join(by_line.select(F.col("base_path").alias("path"), F.col("base_ix").alias("ix")), ["path", "ix"], "left_anti")
    rest_c = c.join(by_line.select("path", "ix"), ["path", "ix"], "left_anti")
    in_order = joined(_numbered(rest_b, KEY), _numbered(rest_c, KEY), KEY, "order")
    all_pairs = cut(by_line.unionByName(in_order))
    return all_pairs, cand.join(all_pairs.select("path", "ix"), ["path", "ix"], "left_anti")
