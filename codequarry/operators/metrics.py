"""Complexity, size, mass, erosion, verbosity, top-k and capped listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut

HIGH = 10


def with_mass(callables: DataFrame) -> DataFrame:
    """``mass`` = cc * sqrt(sloc)."""
    return callables.withColumn("mass", F.col("cc") * F.sqrt(F.col("sloc").cast("double")))


def erosion(callables: DataFrame, families: list[str]) -> DataFrame:
    """(family, erosion): share of mass in callables of cc over 10, for ``overall`` and every family; 0.0 without mass."""
    spark = callables.sparkSession
    made = with_mass(callables).groupingSets([["language"], []], "language").agg(
        F.sum("mass").alias("total"), F.sum(F.when(F.col("cc") > HIGH, F.col("mass")).otherwise(0.0)).alias("high"), F.grouping("language").alias("g")
    )
    made = made.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("language")).alias("family"), "total", "high")
    wanted = spark.createDataFrame([(f,) for f in ["overall", *families]], "family string")
    ratio = F.when(F.coalesce("total", F.lit(0.0)) == 0.0, 0.0).otherwise(F.try_divide("high", "total"))
    return wanted.join(F.broadcast(made), "family", "left").select("family", (F.round(ratio, 6) + 0.0).alias("erosion"))


def top_callables(callables: DataFrame, k: int = 25) -> DataFrame:
    """The k callables of highest cc; ties by path, then start line if there is one. A bounded sort, no shuffle of all rows."""
    ties = [c for c in ("path", "start_line") if c in callables.columns]
    return with_mass(callables).orderBy(F.desc("cc"), *ties).limit(k)


def capped_listing(rows: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group, with ``place`` and ``omitted``, the number of rows left out of it."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("place") <= cap)
    return ranked.join(counts, group).withColumn("omitted", F.greatest(F.col("n") - cap, F.lit(0)).cast("long")).drop("n")


def verbosity(scanned: DataFrame, flagged: DataFrame, families: list[str]) -> DataFrame:
    """(family, flagged_lines, scanned_lines, ratio, complete) of ``scanned(language, lines, failed)`` and distinct ``flagged(language, path, line)``."""
    spark = scanned.sparkSession
    name = F.when(F.col("g") == 1, "overall").otherwise(F.col("language")).alias("family")
    base = scanned.groupingSets([["language"], []], "language").agg(F.sum("lines").alias("scanned_lines"), F.bool_and(~F.col("failed")).alias("complete"), F.grouping("language").alias("g"))
    hits = flagged.groupingSets([["language"], []], "language").agg(F.count("*").alias("flagged_lines"), F.grouping("language").alias("g"))
    wanted = spark.createDataFrame([(f,) for f in ["overall", *families]], "family string")
    of_family = lambda x, *columns: F.broadcast(x.select(name, *columns))  # a row per language
    out = wanted.join(of_family(base, "scanned_lines", "complete"), "family", "left").join(of_family(hits, "flagged_lines"), "family", "left")
    f, s = F.coalesce("flagged_lines", F.lit(0)), F.coalesce("scanned_lines", F.lit(0))
    ratio = F.when(s == 0, 0.0).otherwise(F.try_divide(f, s))
    return out.select("family", f.cast("long").alias("flagged_lines"), s.cast("long").alias("scanned_lines"), F.round(ratio, 6).alias("ratio"), F.coalesce("complete", F.lit(True)).alias("complete"))


def zero_filled_counts(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """(label, n) for each of ``labels``, zero where no row has it."""
    wanted = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    made = rows.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return wanted.join(made, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their number in a total order: sorted range by range, each behind the rows of those before it."""
    at = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = at.groupBy("_part").agg(F.count("*").alias("n"))  # a row per range
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    k = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return at.withColumn("_k", k).join(F.broadcast(before), "_part").withColumn("place", (F.col("_before") + F.col("_k")).cast("long")).drop("_part", "_k", "_before")


def summaries(callables: DataFrame, scanned: DataFrame, flagged: DataFrame, changed: DataFrame, families: list[str]) -> DataFrame:
    """(scope, family, erosion, flagged_lines, scanned_lines, ratio, complete) of a candidate: over its ``changed(path)`` files, and over all (scope ``full``).

    ``callables(path, language, cc, sloc)``, ``scanned(path, language, lines, failed)`` and distinct ``flagged(language, path, line)`` are those of the whole candidate.
    """
    made = None
    for scope in ("changed", "full"):
        of = lambda x: x.join(changed.select("path").distinct(), "path", "left_semi") if scope == "changed" else x  # noqa: B023, E731
        one = erosion(of(callables), families).join(verbosity(of(scanned), of(flagged), families), "family").select(F.lit(scope).alias("scope"), "*")
        made = one if made is None else made.unionByName(one)
    return made


def file_coverage(changed: DataFrame, analyzed: DataFrame, gaps: DataFrame) -> DataFrame:
    """(path, analyzed, unanalyzed_lines, complete, gaps) of ``changed(path)`` files.

    ``analyzed(path, lines, failed)`` are the files that could be read, with their executable lines, ``gaps(path, start, end)`` their damage: merged here where spans overlap or touch line by line. A file's unanalysed lines are those in gaps, or
    all of them if it failed; it is complete if it was analysed and has none of either.
    """
    each = gaps.where("start <= end").distinct()
    w = Window.partitionBy("path").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("_new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy("path", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = islands.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gaps"), F.sum(F.col("end") - F.col("start") + 1).alias("_in"))  # of one file
    rows = changed.select("path").distinct().join(analyzed.select("path", "lines", "failed"), "path", "left").join(lists, "path", "left")
    known = F.col("failed").isNotNull()
    lost = F.when(~known, None).when(F.col("failed"), F.col("lines")).otherwise(F.coalesce("_in", F.lit(0))).cast("long")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.select("path", known.alias("analyzed"), lost.alias("unanalyzed_lines"), F.coalesce(known & ~F.col("failed") & F.col("gaps").isNull(), F.lit(False)).alias("complete"), F.coalesce(F.col("gaps").cast("array<struct<start:bigint,end:bigint>>"), empty).alias("gaps"))
