"""Wasteful-construct rules and interval operators over sibling sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import stabbed, within


def unreachable(children: DataFrame, container: list[str], terminators: list[str], hoisted: list[str]) -> DataFrame:
    """One finding per container: later siblings of its first terminator that are not hoisted, with first, last and count."""
    first = F.min(F.when(F.col("kind").isin(terminators), F.col("ix"))).over(Window.partitionBy(*container))
    hit = children.withColumn("stop", first).where((F.col("ix") > F.col("stop")) & ~F.col("kind").isin(hoisted))
    return hit.groupBy(*container).agg(F.min("ix").alias("start"), F.max("ix").alias("end"), F.count("*").alias("flagged"))


def empty(children: DataFrame, container: list[str], named: list[str]) -> DataFrame:
    """Containers without any child of a named kind."""
    return children.select(*container).distinct().join(children.where(F.col("kind").isin(named)), container, "left_anti")


def redundant_alternative(children: DataFrame, container: list[str], terminators: list[str]) -> DataFrame:
    """Containers of exactly three children whose second always returns: the third is flagged."""
    made = children.groupBy(*container).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("ix") == 2, F.col("kind"))).alias("second"), F.max(F.when(F.col("ix") == 3, F.col("event_id"))).alias("flagged")
    )
    return made.where((F.col("n") == 3) & F.col("second").isin(terminators)).select(*container, "flagged")


def innermost(points: DataFrame, spans: DataFrame, key: list[str], point: str, at: str) -> DataFrame:
    """For each point the innermost span ``[start, end]`` of its key that holds it: latest start, then earliest end."""
    best = stabbed(points, spans, key, at, F.struct("start", (-F.col("end")).alias("end")), F.max, "s").where("s is not null")
    return best.select(point, F.col("s.start").alias("start"), (-F.col("s.end")).alias("end"))


def excluded(spans: DataFrame, dirty: DataFrame, key: list[str]) -> DataFrame:
    """Spans that lie inside no dirty span of their key. Nesting is laminar, so containment decides the whole cascade."""
    return within(spans, dirty, key).where("not held").select(*spans.columns)


def islands(spans: DataFrame, key: list[str]) -> DataFrame:
    """Merged overlapping or touching spans of each key: start, end and how many spans each holds."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    marked = spans.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("g")


def by_family(findings: DataFrame, names: dict[tuple[str, str], str]) -> DataFrame:
    """``findings(language, rule)`` with ``rule`` as its family names it; a family without the rule has no such findings."""
    spark = findings.sparkSession
    known = spark.createDataFrame([(f, r, n) for (f, r), n in names.items()], "language string, rule string, named string")
    return findings.join(F.broadcast(known), ["language", "rule"]).drop("rule").withColumnRenamed("named", "rule")
