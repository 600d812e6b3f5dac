"""Line maps between two versions of a file, and what hangs on them: added and deleted lines, findings that moved, duplicate runs in changed files."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of rows that an alignment keeps at once; beyond them it is split in two.
KEPT = 1 << 28


def split_lines(text: str) -> list[str]:
    """Lines of a text; a last line end starts no line, and an empty text has none."""
    out = text.split("\n")
    return out[:-1] if out[-1] == "" else out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j), ascending, of a longest common subsequence of lines."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(x) & set(y)  # other lines are in no common subsequence
    rows, columns = ([i for i, line in enumerate(side) if line in both] for side in (x, y))
    inner = _common([x[i] for i in rows], [y[j] for j in columns])
    return [(k, k) for k in range(lo)] + [(rows[i] + lo, columns[j] + lo) for i, j in inner] + ends


def _rows(a: list[str], b: list[str]):
    """For every line of ``a``, an integer whose bit j is 0 where the longest common subsequence with b[:j + 1] is longer than that with b[:j]; a row is one addition of long integers."""
    masks: dict[str, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for line in a:
        u = v & masks.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Where its rows would take too much memory, ``a`` is halved and ``b`` cut where the halves together have most in common."""
    if not a or not b:
        return []
    if len(a) * len(b) > KEPT and len(a) > 1:
        middle = len(a) // 2
        steps = lambda v: f"{v:0{len(b)}b}"[::-1].translate({48: "1", 49: "0"})
        ahead, behind = (deque(_rows(x, y), 1)[0] for x, y in ((a[:middle], b), (a[middle:][::-1], b[::-1])))
        up, down = [0], [0]
        for total, v in ((up, ahead), (down, behind)):
            for c in steps(v):
                total.append(total[-1] + (c == "1"))
        cut = max(range(len(b) + 1), key=lambda j: up[j] + down[len(b) - j])
        return _common(a[:middle], b[:cut]) + [(i + middle, j + cut) for i, j in _common(a[middle:], b[cut:])]
    rows, out, i, j = list(_rows(a, b)), [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def line_names(text: Column) -> Column:
    """16 bytes (MD5) of each line of ``split_lines``, so that two versions of a file can meet in a join without their texts."""
    every = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    own = F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every)
    return F.transform(own, lambda x: F.unhex(F.md5(x.cast("binary"))))


def line_map(pairs: DataFrame) -> DataFrame:
    """(path, base_line, line) of ``pairs(path, base_text, text)``, or ``pairs(path, base_names, names)`` of ``line_names``: unchanged lines, deleted ones (line null) and added ones (base_line null), numbered from 1.

    Null texts have no lines. A file's two texts are compared in one row; rows are independent.
    """
    texts = "base_text" in pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, old, new in zip(*(c.to_pylist() for c in b.columns)):
                x, y = (split_lines(old or ""), split_lines(new or "")) if texts else (old or [], new or [])
                same = align(x, y)
                kept, found = {i for i, _ in same}, {j for _, j in same}
                rows = [(i + 1, j + 1) for i, j in same] + [(i + 1, None) for i in range(len(x)) if i not in kept] + [(None, j + 1) for j in range(len(y)) if j not in found]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "base_line", "line"])

    return pairs.select("path", *(["base_text", "text"] if texts else ["base_names", "names"])).mapInArrow(run, "path string, base_line long, line long")


def line_changes(mapped: DataFrame) -> DataFrame:
    """(path, kept, added, deleted): number of lines of each sort."""
    return mapped.groupBy("path").agg(
        F.count_if(F.col("line").isNotNull() & F.col("base_line").isNotNull()).alias("kept"), F.count_if(F.col("base_line").isNull()).alias("added"), F.count_if(F.col("line").isNull()).alias("deleted")
    )


def deleted_runs(runs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Rows of base ``runs(path, lines, ...)`` all of whose lines were deleted. ``path`` is the name that ``mapped`` uses."""
    gone = mapped.where("line is null").groupBy("path").agg(F.collect_set("base_line").alias("_gone"))  # lines of one file
    return runs.join(gone, "path").where(F.size(F.array_except("lines", "_gone")) == 0).drop("_gone")


def clone_subjects(members: DataFrame, mapped: DataFrame) -> DataFrame:
    """Members of maximal groups, ``members(path, lines, ...)``, that hold added lines of a changed file, with ``added``, their number."""
    new = mapped.where("base_line is null").groupBy("path").agg(F.collect_set("line").alias("_new"))
    return members.join(new, "path").withColumn("added", F.size(F.array_intersect("lines", "_new")).cast("long")).where("added > 0").drop("_new")


def extension_grades(subjects: DataFrame, base_runs: DataFrame, mapped: DataFrame) -> DataFrame:
    """``subjects(path, key, start, end, lines, added)`` with ``effective`` and ``fires``: whether more was added than a grown duplicate may gain.

    A base run of the same path counts by the lines of the subject that it maps to (overlap) and those of its own that map elsewhere or nowhere (excess). The best has the largest
    overlap - excess, then the smallest excess, most lines, smallest start and end; runs of which a line maps outside the subject's span don't count. With
    effective = overlap + min(unmapped, added) the subject fires if added exceeds the larger of 1 and a tenth of effective; without a base run it fires.
    """
    kept = mapped.where("base_line is not null and line is not null")
    runs = base_runs.select("path", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.size("lines").alias("b_n"), F.explode("lines").alias("base_line"))
    to = runs.join(kept, ["path", "base_line"], "left").groupBy("path", "b_start", "b_end", "b_n").agg(F.collect_list("line").alias("_to"))  # lines of one run
    both = subjects.join(to, "path")
    overlap, mapped_n = F.size(F.array_intersect("_to", "lines")), F.size("_to")
    inside = ~F.exists("_to", lambda x: (x < F.col("start")) | (x > F.col("end")))
    both = both.where(inside & (overlap > 0)).withColumns({"_overlap": overlap, "_excess": F.col("b_n") - overlap, "_unmapped": F.col("b_n") - mapped_n})
    rank = Window.partitionBy("path", "key", "start").orderBy(F.desc(F.col("_overlap") - F.col("_excess")), "_excess", F.desc("b_n"), "b_start", "b_end")
    best = both.withColumn("_r", F.row_number().over(rank)).where("_r = 1")
    best = best.select("path", "key", "start", (F.col("_overlap") + F.least("_unmapped", "added")).cast("long").alias("effective"))
    out = subjects.join(best, ["path", "key", "start"], "left")
    return out.withColumn("fires", F.coalesce(F.col("added") > F.greatest(F.lit(1), F.floor(F.col("effective") / 10)), F.lit(True)))


def matched_by_line(base: DataFrame, cand: DataFrame, mapped: DataFrame, key: list[str]) -> DataFrame:
    """(path, base_line, line, *key): findings of equal key on lines that map to each other. ``base`` carries the candidate's path."""
    both = mapped.where("base_line is not null and line is not null")
    old = base.select("path", F.col("line").alias("base_line"), *key)
    return old.join(both, ["path", "base_line"]).join(cand.select("path", "line", *key), ["path", "line", *key]).select("path", "base_line", "line", *key)


def new_suppressions(suppressed: DataFrame, base_suppressed: DataFrame, matched: DataFrame) -> DataFrame:
    """(path, rule, line, directive_line): suppressed findings whose base finding, if any, was not suppressed."""
    before = matched.join(base_suppressed.select("path", "rule", F.col("line").alias("base_line")), ["path", "rule", "base_line"], "left_semi").select("path", "rule", "line")
    return suppressed.join(before, ["path", "rule", "line"], "left_anti").select("path", "rule", "line", (F.col("line") - 1).alias("directive_line"))


def damaged(cand: DataFrame, base: DataFrame, mapped: DataFrame) -> DataFrame:
    """(path, start, end): spans of ``cand(path, start, end)`` of which some line maps from no line of a span of ``base``, under the candidate's path.

    Damage that the base had stays tolerated where its lines are unchanged; a file without a line map is new, so all its spans remain. Equal spans count once.
    """
    each = lambda x, name: x.where("start <= end").select("path", "start", "end", F.explode(F.sequence("start", "end")).alias(name))
    kept = mapped.where("base_line is not null and line is not null")
    old = kept.join(each(base, "base_line").select("path", "base_line").distinct(), ["path", "base_line"], "left_semi").select("path", "line", F.lit(True).alias("_old"))
    spans = each(cand.distinct(), "line").join(old, ["path", "line"], "left").groupBy("path", "start", "end").agg(F.bool_and(F.coalesce("_old", F.lit(False))).alias("_old"))
    return spans.where("not _old").drop("_old")


def contained(needle: Column, hay: Column, sep: str = "\x01") -> Column:
    """Whether the tokens of ``needle`` stand next to each other, in order, in ``hay`` (arrays of strings without ``sep``)."""
    framed = lambda x: F.concat(F.lit(sep), F.array_join(x, sep), F.lit(sep))
    return F.contains(framed(hay), framed(needle))
