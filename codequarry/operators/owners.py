"""Owner forests: digests of the chain from the root to each owner, owners without dropped ones, subtrees by intervals.

Parents are links of any depth. Links are followed by pointer doubling: in a round every row takes over the link of the row that its own link leads to, so chains of
n owners take log2(n) self-joins, each written before the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut

#: Prime moduli of the parts of a digest, and the base of its polynomial.
PRIMES, RADIX = (2147483647, 2147483629, 2147483587, 2147483579), 1000003


def segment(kind: Column, name: Column) -> Column:
    """SHA-256 of an owner's kind and name; no name differs from an empty one."""
    frame = F.concat(F.octet_length(kind).cast("string"), F.lit(":"), kind, F.coalesce(F.concat(F.lit("="), name), F.lit("!")))
    return F.sha2(frame.cast("binary"), 256)


def _values(digest: Column) -> list[Column]:
    """Four numbers of 60 bits of a SHA-256 in hex, one below each modulus."""
    return [F.conv(F.substr(digest, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("long") % p for i, p in enumerate(PRIMES)]


def chain_digests(owners: DataFrame, context_kinds: list[str], key: str = "path") -> DataFrame:
    """(``key``, id, depth, digest, plain) of ``owners(key, id, parent, kind, name)``.

    ``digest`` is over all owners from the root to this one, outermost first, ``plain`` over those among them whose kind is not in ``context_kinds``. A digest is a polynomial over the
    owners' segments modulo four primes: that of a chain follows from those of its two parts, whatever the cut, and so can be put together from doubled links.
    Owners of different keys with equal chains have equal digests. A link that leads to no owner counts as none; a circle of links is refused.
    """
    counted = ~F.col("kind").isin(context_kinds)
    parts = lambda x: F.array(*x)
    value = F.col("_v")
    start = owners.select(key, "id", F.col("parent").alias("ptr"), counted.alias("_counted"), parts(_values(segment(F.col("kind"), F.col("name")))).alias("_v"))
    radix, one, zero = parts([F.lit(RADIX).cast("long")] * 4), parts([F.lit(1).cast("long")] * 4), parts([F.lit(0).cast("long")] * 4)
    rows = start.select(
        key, "id", "ptr", F.lit(1).cast("long").alias("depth"), value.alias("h"), radix.alias("p"),
        F.when(F.col("_counted"), value).otherwise(zero).alias("ph"), F.when(F.col("_counted"), radix).otherwise(one).alias("pp"),
    )
    mul = lambda x, y: F.array(*[x[i] * y[i] % m for i, m in enumerate(PRIMES)])
    join = lambda up, low, p: F.array(*[(up[i] * p[i] + low[i]) % m for i, m in enumerate(PRIMES)])
    rows, col = cut(rows), F.col
    longest = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):  # a chain has as many owners as its key, at most
        if rows.where("ptr is not null").isEmpty():
            break
        up = rows.select(key, col("id").alias("ptr"), col("ptr").alias("u_ptr"), *[col(c).alias(f"u_{c}") for c in ("depth", "h", "p", "ph", "pp")])
        both = rows.join(up, [key, "ptr"], "left")  # rows that have arrived find none and stay; a union with them would add partitions in every round
        known = lambda new, old: F.when(col("u_depth").isNull(), col(old)).otherwise(new).alias(old)
        moved = both.select(
            key, "id", col("u_ptr").alias("ptr"), known(col("u_depth") + col("depth"), "depth"),
            known(join(col("u_h"), col("h"), col("p")), "h"), known(mul(col("u_p"), col("p")), "p"), known(join(col("u_ph"), col("ph"), col("pp")), "ph"), known(mul(col("u_pp"), col("pp")), "pp"),
        )
        rows = cut(moved)
    else:
        raise ValueError("owners' links lead in a circle")
    hexed = lambda h: F.concat(*[F.lpad(F.lower(F.hex(F.col(h)[i])), 8, "0") for i in range(4)])
    return rows.select(key, "id", "depth", hexed("h").alias("digest"), hexed("ph").alias("plain"))


def without(owners: DataFrame, dropped: DataFrame, key: str = "path") -> DataFrame:
    """``owners(key, id, parent, ...)`` that are not in ``dropped(key, id)``; a link to a dropped one becomes null."""
    gone = dropped.select(key, F.col("id").alias("parent"), F.lit(True).alias("_gone")).distinct()
    left = owners.join(dropped.select(key, "id"), [key, "id"], "left_anti").join(gone, [key, "parent"], "left")
    return left.withColumn("parent", F.when(F.col("_gone").isNull(), F.col("parent"))).select(*owners.columns)


def pruned(nodes: DataFrame, damaged: DataFrame, key: str = "path") -> DataFrame:
    """``nodes(key, node, last, ...)`` in pre-order numbers, ``last`` the last number of a node's subtree, without the subtrees of ``damaged(key, node)``.

    A node lies in such a subtree exactly if the farthest end of those that begin at it or before reaches its own. So one sort of a key's nodes does, and no table is built on the driver.
    """
    marks = damaged.select(key, "node").distinct().withColumn("_cut", F.lit(True)).hint("merge")  # rows by the million pass for small by their written bytes
    reach = F.max(F.when(F.col("_cut"), F.col("last"))).over(Window.partitionBy(key).orderBy("node").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    marked = nodes.join(marks, [key, "node"], "left").withColumn("_reach", reach)
    return marked.where(F.col("_reach").isNull() | (F.col("_reach") < F.col("last"))).select(*nodes.columns)


def lost_lines(nodes: DataFrame, left: DataFrame, key: str = "path") -> DataFrame:
    """(key, line): different executable ``lines`` of ``nodes`` that none of those ``left`` has."""
    each = lambda x, kept: x.select(key, F.explode("lines").alias("line"), F.lit(kept).alias("_kept"))
    return each(nodes, False).unionByName(each(left, True)).groupBy(key, "line").agg(F.bool_or("_kept").alias("_kept")).where("not _kept").drop("_kept")
