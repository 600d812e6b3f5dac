"""Interval joins of closed spans of whole numbers from 0 on, by dyadic cells.

A dyadic cell (level, c) holds the numbers c * 2**level to (c + 1) * 2**level - 1. A span is the union of a few disjoint cells, and a number lies in one cell a level, so a span
holds a number exactly if they share a cell, and then they share one. Joins are equi-joins on key and cell: the spans of one key are spread over tasks, and no
two rows are compared that don't belong together. Where only the best, the number or the existence of partners counts, cells are aggregated before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of cells; wider spans are made of cells of the highest level.
LEVELS = 20


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def cells(start: str, end: str) -> Column:
    """The cells that make up [start, end], none if it is empty."""
    low, high = F.col(start).cast("long"), F.col(end).cast("long") + 1

    def of_level(j: Column) -> Column:
        left, right = _shift(low + _shift(F.lit(1 << LEVELS).cast("long"), F.lit(LEVELS) - j) - 1, j), _shift(high, j)
        cell = lambda odd, c: F.when((odd.bitwiseAND(F.lit(1)) == 1) & (left < right), F.struct(j.alias("level"), c.alias("c")))
        return F.array(cell(left, left), cell(right, right - 1))

    lower = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of_level)), lambda x: x.isNotNull())
    left, right = _shift(low + ((1 << LEVELS) - 1), F.lit(LEVELS)), _shift(high, F.lit(LEVELS))
    top = F.when(left < right, F.transform(F.sequence(left, right - 1), lambda c: F.struct(F.lit(LEVELS).alias("level"), c.alias("c"))))
    return F.when(high > low, F.concat(lower, F.coalesce(top, F.array().cast("array<struct<level:int,c:bigint>>"))))


def above(at: str) -> Column:
    """The cells that hold the number ``at``, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda j: F.struct(j.alias("level"), _shift(F.col(at).cast("long"), j).alias("c")))


def _spread(rows: DataFrame, of: Column, *columns) -> DataFrame:
    return rows.select(*columns, F.explode(of).alias("_cell"))


def stabbed(points: DataFrame, spans: DataFrame, key: list[str], at: str, value: Column, pick=F.max, name: str = "best") -> DataFrame:
    """``points`` with the largest (``pick``) ``value`` of the ``spans(key, start, end)`` that hold ``at``; null if none does."""
    by_cell = _spread(spans.withColumn("_value", value), cells("start", "end"), *key, "_value").groupBy(*key, "_cell").agg(pick("_value").alias("_value"))
    each = _spread(points.select(*key, at).distinct(), above(at), *key, at).join(by_cell, [*key, "_cell"]).groupBy(*key, at).agg(pick("_value").alias(name))
    return points.join(each, [*key, at], "left")


def inside(inner: DataFrame, outer: DataFrame, key: list[str], more: list[str]) -> DataFrame:
    """Pairs of ``inner`` rows and the ``outer`` spans that hold them whole; ``more`` names the columns of ``outer`` to add, other than key, start and end."""
    wide = _spread(outer.select(*key, *more, F.col("start"), F.col("end").alias("_end")), cells("start", "_end"), *key, *more, "_end")
    deep = inner.withColumn("_cell", F.explode(above("start")))
    return deep.join(wide, [*key, "_cell"]).where("end <= _end").drop("_cell", "_end")


def within(spans: DataFrame, outer: DataFrame, key: list[str]) -> DataFrame:
    """``spans`` with ``held``: whether some span of ``outer`` holds it whole."""
    far = stabbed(spans, outer, key, "start", F.col("end"), F.max, "_far")
    return far.withColumn("held", F.coalesce(F.col("_far") >= F.col("end"), F.lit(False))).drop("_far")


def overlapped(spans: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """``spans`` with ``touched``: whether some span of ``others`` shares a number with it.

    Either the other one holds its start, or it holds the other one's start.
    """
    spans = stabbed(spans, others, key, "start", F.lit(True), F.max, "_in")
    n = gathered(spans, others.where("start <= end").select(*key, "start").distinct(), key, "start", {"_n": (F.lit(1), F.sum)})
    return n.withColumn("touched", (F.coalesce("_in", F.lit(False)) | (F.coalesce("_n", F.lit(0)) > 0)) & (F.col("start") <= F.col("end"))).drop("_in", "_n")


def gathered(spans: DataFrame, points: DataFrame, key: list[str], at: str, what: dict) -> DataFrame:
    """``spans`` with aggregates of the ``points`` that they hold: ``what`` maps a name to (value of a point, aggregate), one that can be applied again to its results."""
    values = {f"_v{i}": v for i, (v, _) in enumerate(what.values())}
    twice = lambda rows, *by: rows.groupBy(*by).agg(*[f(f"_v{i}").alias(f"_v{i}") for i, (_, f) in enumerate(what.values())])
    by_cell = twice(_spread(points.withColumns(values), above(at), *key, *values), *key, "_cell")
    ends = spans.select(*key, "start", "end").distinct()
    found = twice(_spread(ends, cells("start", "end"), *key, "start", "end").join(by_cell, [*key, "_cell"]), *key, "start", "end")
    return spans.join(found.withColumnsRenamed({f"_v{i}": name for i, name in enumerate(what)}), [*key, "start", "end"], "left")


def mapped_gaps(gaps: DataFrame, base_gaps: DataFrame, mapped: DataFrame) -> DataFrame:
    """(path, start, end, base_start, base_end, tolerated) of different candidate ``gaps(path, start, end)``.

    ``base_gaps`` carry the candidate's path, as ``mapped`` does. The base span is the earliest one that holds a base line which a line of the gap maps from, null if there is none;
    a gap is tolerated if each of its lines maps from a line of some base span.
    """
    kept = mapped.where("base_line is not null and line is not null")
    old = stabbed(kept, base_gaps, ["path"], "base_line", F.struct(F.col("start").alias("s"), F.col("end").alias("e")), F.min, "_span").where("_span is not null")
    out = gathered(gaps.select("path", "start", "end").distinct(), old, ["path"], "line", {"_first": (F.col("_span"), F.min), "_n": (F.lit(1), F.sum)})
    tolerated = F.coalesce(F.col("_n") == F.col("end") - F.col("start") + 1, F.lit(False))
    return out.select("path", "start", "end", F.col("_first.s").alias("base_start"), F.col("_first.e").alias("base_end"), tolerated.alias("tolerated"))
