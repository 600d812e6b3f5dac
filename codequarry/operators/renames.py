"""Renames of files that also changed: weighted set-similarity join over lines, and one-to-one assignment, the most similar first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut

THRESHOLD, CEILING = 50, 1 << 20


def _lines(files: DataFrame) -> DataFrame:
    """(path, line, k, w): every line of a file as an element of a set, k its number among equal ones, w its bytes with the line end."""
    each = files.select("path", F.explode(F.split("text", "\n", -1)).alias("text"))
    counted = each.groupBy("path", F.sha2(F.col("text").cast("binary"), 256).alias("line")).agg(F.count("*").alias("n"), (F.octet_length(F.first("text")) + 1).cast("long").alias("w"))
    return counted.select("path", "line", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"), "w")


def _prefixes(lines: DataFrame, rare: DataFrame, threshold: int) -> DataFrame:
    """Elements of each file, rarest first, up to where what follows weighs too little for a similarity of ``threshold``.

    Two files that are similar enough share more than what either one has behind its prefix, so they share an element of both prefixes.
    """
    ranked = lines.join(rare, ["line", "k"])
    order = Window.partitionBy("path").orderBy("files", "line", "k")
    whole = F.sum("w").over(Window.partitionBy("path"))
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.select("path", "line", "k", whole.alias("size"), (whole - before).alias("rest")).where(F.col("rest") * 100 >= F.col("size") * threshold)


def similar(gone: DataFrame, new: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(from_path, path, similarity) of ``gone`` and ``new(path, text)``: bytes of the lines that both have, each as often as both have it, in whole percent of the larger file.

    Candidates share a line of their prefixes, where lines that few files have come first; only they are compared in full. Empty files are not similar to any.
    """
    b, c = (cut(_lines(x.where("text <> ''"))) for x in (gone, new))
    rare = b.select("line", "k").unionByName(c.select("line", "k")).groupBy("line", "k").agg(F.count("*").alias("files"))
    shared = cut(rare.join(b.select("line", "k").distinct(), ["line", "k"], "left_semi").join(c.select("line", "k").distinct(), ["line", "k"], "left_semi"))
    # elements of one side only can't be shared, but weigh
    sizes = lambda x: x.groupBy("path").agg(F.sum("w").alias("size"))
    rank = rare.join(shared.select("line", "k", F.lit(True).alias("both")), ["line", "k"], "left")
    rank = cut(rank.select("line", "k", F.when(F.col("both"), F.col("files")).otherwise(F.lit(0)).alias("files"), F.coalesce("both", F.lit(False)).alias("both")))
    first = lambda x: _prefixes(x, rank.select("line", "k", "files"), threshold).join(rank.where("both").select("line", "k"), ["line", "k"], "left_semi").select("path", "line", "k")
    pairs = cut(first(b).withColumnRenamed("path", "from_path").join(first(c), ["line", "k"]).select("from_path", "path").distinct())
    full = pairs.join(b.select(F.col("path").alias("from_path"), "line", "k", "w"), "from_path").join(c.select("path", "line", "k"), ["path", "line", "k"])
    common = full.groupBy("from_path", "path").agg(F.sum("w").alias("common"))
    size = common.join(sizes(b).select(F.col("path").alias("from_path"), F.col("size").alias("sb")), "from_path").join(sizes(c), "path")
    percent = F.expr("common * 100 div greatest(sb, size)")
    return size.select("from_path", "path", percent.alias("similarity")).where(F.col("similarity") >= threshold)


def assigned(pairs: DataFrame) -> DataFrame:
    """Pairs of ``pairs(from_path, path, similarity)`` that a walk from the most similar one down takes, each path once; ties by from_path, then path.

    The walk is done in rounds: a pair that is the best left of both its paths is taken by the walk whatever comes before it, so all such pairs are taken at once and their paths fall
    away. The best pair of all is always among them, so every round ends some.
    """
    order = F.struct((-F.col("similarity")).alias("s"), "from_path", "path")
    left, taken = cut(pairs.select("from_path", "path", "similarity")), None
    while not left.isEmpty():
        best = lambda side: left.groupBy(side).agg(F.min(order).alias("o")).select("o.from_path", "o.path")
        won = cut(left.join(best("from_path"), ["from_path", "path"], "left_semi").join(best("path"), ["from_path", "path"], "left_semi"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select("from_path"), "from_path", "left_anti").join(won.select("path"), "path", "left_anti"))
    return pairs.limit(0) if taken is None else taken.select("from_path", "path", "similarity")


def renames(gone: DataFrame, new: DataFrame, threshold: int = THRESHOLD, ceiling: int = CEILING) -> DataFrame:
    """(from_path, path, similarity) of deleted and added files ``(path, oid, text)``: equal contents are renames of 100 percent, the k-th of one with the k-th of the other, by path;
    of the rest those of at most ``ceiling`` bytes are compared by lines. Each path is used once."""
    place = F.row_number().over(Window.partitionBy("oid").orderBy("path"))
    b, c = gone.withColumn("k", place), new.withColumn("k", place)
    exact = cut(b.select(F.col("path").alias("from_path"), "oid", "k").join(c.select("path", "oid", "k"), ["oid", "k"]).select("from_path", "path"))
    small = F.octet_length("text") <= ceiling
    b = gone.where(small).join(exact.select(F.col("from_path").alias("path")), "path", "left_anti")
    c = new.where(small).join(exact.select("path"), "path", "left_anti")
    return exact.withColumn("similarity", F.lit(100).cast("long")).unionByName(assigned(similar(b, c, threshold)))
