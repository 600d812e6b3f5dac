"""Move credit: duplicate runs that were deleted in one place and stand in another are moves, not growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .policy import growth_limit


def places(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(rank, slot, at, n, base_lines): every place ``at`` where the ``n`` tokens of an entry stand next to each other inside a run that isn't longer than the entry may grow.

    Takes what ``moves`` takes. Entries are found by the hash of as many first tokens as the shortest entry of their language has, then compared token by token.
    """
    least = entries.groupBy("language").agg(F.min(F.size("tokens")).alias("g"))
    e = entries.join(least, "language").select("language", "slot", F.size("tokens").alias("n"), F.col("lines").alias("base_lines"), F.xxhash64(F.slice("tokens", F.lit(1), F.col("g"))).alias("anchor"))
    r = runs.join(least, "language").where("size(tokens) >= g").select("language", "rank", "lines", "tokens", F.size("tokens").alias("m"), F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("g"))).alias("at"), "g")
    r = r.select("language", "rank", "lines", "m", "at", F.xxhash64(F.slice("tokens", F.col("at") + 1, F.col("g"))).alias("anchor"))
    near = r.join(e, ["language", "anchor"]).where((F.col("at") + F.col("n") <= F.col("m")) & (F.col("lines") <= growth_limit(F.col("base_lines"))))
    full = near.join(runs.select("rank", "tokens"), "rank").join(entries.select("slot", F.col("tokens").alias("_tokens")), "slot")
    return full.where(F.slice("tokens", F.col("at") + 1, F.col("n")) == F.col("_tokens")).select("rank", "slot", "at", "n", "base_lines")


def moves(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """(rank, slot, at): the candidate runs that are moves, each with its entry and the place of it in the run.

    ``entries(slot, language, block, first, tokens, lines)`` are deleted base runs in order, ``runs(rank, language, block, first, tokens, lines)`` added ones, the longest first; ``first`` is the place of
    the first token in its block, which overlapping runs share. By rank, each run takes the entry that stands in it and already has most of its tokens credited onto the very same tokens, then the
    one of most lines, then the first, at its first place; the entry's tokens are then credited onto the run's. A token that is credited elsewhere is spent.

    A run's choice depends on earlier ones only through base tokens that both could take. So in every round all runs choose that have no open earlier run at any of their base tokens;
    the first open run is always among them. Their choices are those of a walk by rank.
    """
    found = cut(places(entries, runs))
    each = found.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.join(entries.select("slot", F.col("block").alias("b_block"), F.col("first").alias("b_first")), "slot").join(runs.select("rank", F.col("block").alias("c_block"), F.col("first").alias("c_first")), "rank")
    token = lambda block, first, more: F.struct(F.col(block).alias("block"), (F.col(first) + more).cast("long").alias("at"))
    each = cut(each.select("rank", "slot", "at", "n", "base_lines", token("b_block", "b_first", F.col("o")).alias("base"), token("c_block", "c_first", F.col("at") + F.col("o")).alias("onto")))
    open_runs, spent, taken = cut(found.select("rank").distinct()), each.select("base", "onto").limit(0), []
    while not open_runs.isEmpty():
        mine = each.join(open_runs, "rank", "left_semi")
        least = mine.groupBy("base").agg(F.min("rank").alias("first_rank"))
        waits = mine.join(least, "base").where("rank > first_rank").select("rank").distinct()
        ready = cut(open_runs.join(waits, "rank", "left_anti"))
        known = mine.join(ready, "rank", "left_semi").join(spent.withColumnRenamed("onto", "_onto"), "base", "left")
        same = F.col("_onto") == F.col("onto")
        graded = known.groupBy("rank", "slot", "at", "base_lines").agg(F.count_if(same).alias("shared"), F.coalesce(F.bool_or(~same), F.lit(False)).alias("clash")).where("not clash")
        best = F.min(F.struct((-F.col("shared")).alias("s"), (-F.col("base_lines")).alias("l"), "slot", "at")).alias("b")
        won = cut(graded.groupBy("rank").agg(best).select("rank", "b.slot", "b.at"))
        taken.append(won)
        spent = cut(spent.unionByName(mine.join(won, ["rank", "slot", "at"], "left_semi").select("base", "onto")).distinct())
        open_runs = cut(open_runs.join(ready, "rank", "left_anti"))
    out = found.select("rank", "slot", "at").limit(0)
    for won in taken:
        out = out.unionByName(won)
    return out


def ranked(runs: DataFrame, order: list, name: str) -> DataFrame:
    """``runs`` with the column ``name``, a number that ascends with ``order``: the number of a range partition, and the place in it."""
    parts = runs.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, F.shiftleft(F.col("_part").cast("long"), 40) + place).drop("_part")


def longest_first() -> list:
    """The order in which added runs take their moves."""
    return [F.desc(F.size("tokens")), F.col("path"), F.col("start"), F.desc("end")]
