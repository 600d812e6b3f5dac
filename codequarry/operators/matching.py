"""Snapshot comparison: tree diff, renames, matching of callables in three tiers, ambiguities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut


def tree_diff(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(path, status, base_oid, oid): added, deleted and modified files."""
    b, c = base.select("path", F.col("oid").alias("base_oid")), cand.select("path", "oid")
    status = F.when(F.col("base_oid").isNull(), "added").when(F.col("oid").isNull(), "deleted").otherwise("modified")
    return b.join(c, "path", "full_outer").where(~F.col("base_oid").eqNullSafe(F.col("oid"))).select("path", status.alias("status"), "base_oid", "oid")


def exact_renames(changes: DataFrame) -> DataFrame:
    """(from_path, path, oid): deleted and added files of equal content, the k-th of one with the k-th of the other."""
    place = lambda x: F.row_number().over(Window.partitionBy(x).orderBy("path"))
    gone = changes.where("status = 'deleted'").select(F.col("path").alias("from_path"), F.col("base_oid").alias("oid"), place("base_oid").alias("k"))
    new = changes.where("status = 'added'").select("path", "oid", place("oid").alias("k"))
    return gone.join(new, ["oid", "k"]).select("from_path", "path", "oid")


def changed_entities(base: DataFrame, cand: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, base_path, oid, base_oid): candidate entities that are new or differ from their base, which may have another path."""
    b = base.select(F.col("path").alias("base_path"), F.col("oid").alias("base_oid"))
    both = cand.select("path", "oid").join(renames.select("path", "from_path"), "path", "left").join(b, F.col("base_path") == F.coalesce("from_path", "path"), "left")
    return both.where(~F.col("oid").eqNullSafe(F.col("base_oid"))).select("path", "base_path", "oid", "base_oid")


def snapshot_id(files: DataFrame) -> DataFrame:
    """One digest of (path, oid) of a tree: digests of 4,096 path buckets in order, each over its files in path order."""
    leaf = F.concat(F.octet_length("path").cast("string"), F.lit(":"), F.col("path"), F.lit(" "), F.col("oid"))
    part = files.select(F.substr(F.sha2("path", 256), F.lit(1), F.lit(3)).alias("bucket"), "path", leaf.alias("leaf")).groupBy("bucket").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "leaf"))), lambda x: x["leaf"]), "\n"), 256).alias("digest")
    )
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), ""), 256).alias("snapshot_id"))


def _exact(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Pairs of equal (file, name, fingerprint), k-th with k-th in source order; ``file`` is the candidate's path."""
    k = F.row_number().over(Window.partitionBy("file", "name", "fp").orderBy("ix"))
    b, c = base.withColumn("k", k), cand.withColumn("k", k)
    keys = ["file", "name", "fp", "k"]
    return b.select(*keys, F.col("path").alias("base_path"), F.col("ix").alias("base_ix")).join(c.select(*keys, "path", "ix"), keys).select("base_path", "base_ix", "path", "ix")


def _left(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    p, i = ("base_path", "base_ix") if side == "base" else ("path", "ix")
    return rows.join(pairs.select(F.col(p).alias("path"), F.col(i).alias("ix")), ["path", "ix"], "left_anti")


def _by_context(base: DataFrame, cand: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leftovers of both sides with ``ctx``: their context where the set of ``key`` has the same contexts on both sides, each as often, else ''.

    Multisets are compared by signed counts: all of them are 0 exactly if the two sides agree. Without a column ``context`` every context is ''.
    """
    if "context" not in base.columns:
        return base.withColumn("ctx", F.lit("")), cand.withColumn("ctx", F.lit(""))
    sign = lambda x, n: x.select(*key, "context", F.lit(n).alias("n"))
    counts = sign(base, 1).unionByName(sign(cand, -1)).groupBy(*key, "context").agg(F.sum("n").alias("n"))
    equal = counts.groupBy(*key).agg((F.max(F.abs("n")) == 0).alias("_equal"))
    ctx = F.when(F.col("_equal"), F.col("context")).otherwise(F.lit(""))
    return tuple(x.join(equal, key).withColumn("ctx", ctx).drop("_equal") for x in (base, cand))


def _positional(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Leftovers of equal (file, name), and of equal context where that agrees, k-th with k-th."""
    base, cand = _by_context(base, cand, ["file", "name"])
    k = F.row_number().over(Window.partitionBy("file", "name", "ctx").orderBy("ix"))
    b, c = base.withColumn("k", k), cand.withColumn("k", k)
    keys = ["file", "name", "ctx", "k"]
    return b.select(*keys, F.col("path").alias("base_path"), F.col("ix").alias("base_ix")).join(c.select(*keys, "path", "ix"), keys).select("base_path", "base_ix", "path", "ix")


def same_file(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Tier one on ``(path, ix, name, fp)``, with ``context`` if there is one: equal fingerprints first, then positions."""
    b, c = base.withColumn("file", F.col("path")), cand.withColumn("file", F.col("path"))
    exact = _exact(b, c)
    rest = _positional(_left(b, exact, "base"), _left(c, exact, "cand"))
    return exact.withColumn("pairing", F.lit("fingerprint_exact")).unionByName(rest.withColumn("pairing", F.lit("positional")))


def through_renames(base: DataFrame, cand: DataFrame, done: DataFrame, renames: DataFrame) -> DataFrame:
    """Tier two: what tier one left, in files that were renamed."""
    b = _left(base, done, "base").join(renames.select(F.col("from_path").alias("path"), F.col("path").alias("file")), "path")
    c = _left(cand, done, "cand").withColumn("file", F.col("path"))
    exact = _exact(b, c)
    rest = _positional(_left(b, exact, "base"), _left(c, exact, "cand"))
    return exact.withColumn("pairing", F.lit("fingerprint_exact")).unionByName(rest.withColumn("pairing", F.lit("positional")))


def by_fingerprint(base: DataFrame, cand: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tier three on the rest: (matches of fingerprints that are unique on both sides, ambiguous fingerprints with their counts)."""
    b, c = _left(base, done, "base"), _left(cand, done, "cand")
    nb = b.groupBy("fp").agg(F.count("*").alias("nb"), F.min(F.struct("path", "ix")).alias("b"))
    nc = c.groupBy("fp").agg(F.count("*").alias("nc"), F.min(F.struct("path", "ix")).alias("c"))
    both = nb.join(nc, "fp", "full_outer").withColumns({"nb": F.coalesce("nb", F.lit(0)), "nc": F.coalesce("nc", F.lit(0))})
    one = both.where("nb = 1 and nc = 1").select(F.col("b.path").alias("base_path"), F.col("b.ix").alias("base_ix"), F.col("c.path").alias("path"), F.col("c.ix").alias("ix"))
    return one, both.where("nb > 1 or nc > 1").select("fp", "nb", "nc")


def displaced(base: DataFrame, cand: DataFrame, one: DataFrame, two: DataFrame, renames: DataFrame) -> DataFrame:
    """Pairs of tiers one and two with ``tier``, after candidates paired by position only have left for a free base of their fingerprint.

    In a set of leftovers of equal (file, name), and context where that agrees, other than one to one, candidates whose fingerprint an unmatched base has leave the pairing, for
    tier three to take; those that stay are paired by position anew. Sets without such a candidate keep their pairs.
    """
    key, more = ["tier", "file", "name", "ctx"], [x for x in ("context",) if x in base.columns]
    kept = lambda rows, tier: rows.select(F.lit(tier).alias("tier"), "file", "name", "path", "ix", "fp", *more)
    here = lambda rows: rows.withColumn("file", F.col("path"))
    moved = _left(base, one, "base").join(renames.select(F.col("from_path").alias("path"), F.col("path").alias("file")), "path")
    equal, equal2 = (x.where("pairing = 'fingerprint_exact'") for x in (one, two))
    rb = kept(_left(here(base), equal, "base"), 1).unionByName(kept(_left(moved, equal2, "base"), 2))
    rc = kept(_left(here(cand), equal, "cand"), 1).unionByName(kept(_left(_left(here(cand), one, "cand"), equal2, "cand"), 2))
    rb, rc = (cut(x) for x in _by_context(rb, rc, key[:3]))
    free = _left(base, one.unionByName(two), "base").select("fp").distinct()
    sizes = rb.groupBy(*key).agg(F.count("*").alias("nb")).join(rc.groupBy(*key).agg(F.count("*").alias("nc")), key).where("nb > 1 or nc > 1")
    gone = cut(rc.join(sizes.select(*key), key, "left_semi").join(free, "fp", "left_semi").select(*key, "path", "ix"))
    touched = gone.select(*key).distinct()
    k = F.row_number().over(Window.partitionBy(*key).orderBy("ix"))
    b = rb.join(touched, key, "left_semi").select(*key, F.col("path").alias("base_path"), F.col("ix").alias("base_ix")).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("base_ix")))
    c = rc.join(touched, key, "left_semi").join(gone, [*key, "path", "ix"], "left_anti").withColumn("k", k)
    again = b.join(c, [*key, "k"]).select("tier", "base_path", "base_ix", "path", "ix", F.lit("positional").alias("pairing"))
    pairs = one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2)))
    loose = rc.join(touched, key, "left_semi").select("tier", "path", "ix", F.lit("positional").alias("pairing"))
    return pairs.join(loose, ["tier", "path", "ix", "pairing"], "left_anti").select(*again.columns).unionByName(again)


def set_members(base: DataFrame, cand: DataFrame, one: DataFrame, two: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates whose base is not certain and the bases that may be theirs, by set (tier, file, name).

    Sets are the positional remainders of tiers one and two, less what tier three takes, and the ambiguities of tier three (file is the
    fingerprint). Returns (candidates (tier, file, name, path, ix, unmatched), bases (tier, file, name, path, ix)); unmatched says whether the
    candidate may have no base: it is surplus, or its set has more open candidates than bases.
    """
    key, more = ["tier", "file", "name"], [x for x in ("context",) if x in base.columns]
    kept = lambda rows, tier: rows.select(F.lit(tier).alias("tier"), "file", "name", "path", "ix", *more)
    here = lambda rows: rows.withColumn("file", F.col("path"))
    equal = one.where("pairing = 'fingerprint_exact'")
    b2 = _left(base, one, "base").join(renames.select(F.col("from_path").alias("path"), F.col("path").alias("file")), "path")
    c2 = here(_left(cand, one, "cand"))
    equal2 = two.where("pairing = 'fingerprint_exact'")
    rb = kept(_left(here(base), equal, "base"), 1).unionByName(kept(_left(b2, equal2, "base"), 2))
    rc = kept(_left(here(cand), equal, "cand"), 1).unionByName(kept(_left(c2, equal2, "cand"), 2)).join(rb.select(*key).distinct(), key, "left_semi")
    done = one.unionByName(two)
    if more:  # the context, where it parts a set, is a part of the name
        named = lambda x: x.withColumn("name", F.concat_ws("\x01", "name", F.nullif("ctx", F.lit("")))).drop("ctx", *more)
        rb, rc = map(named, _by_context(rb, rc, key))
        rc = rc.join(rb.select(*key).distinct(), key, "left_semi")
    rb, rc = cut(rb), cut(rc)
    three, unclear = (cut(x) for x in by_fingerprint(base, cand, done))
    pool = lambda rows, side: _left(rows, done, side).join(unclear, "fp").select(F.lit(3).alias("tier"), F.col("fp").alias("file"), F.lit("").alias("name"), "path", "ix", "nb", "nc")
    ab, ac = cut(pool(base, "base")), cut(pool(cand, "cand"))
    rb = _left(rb, three, "base")
    free = _left(rc, three, "cand").join(ac.where("nb > 0").select("path", "ix"), ["path", "ix"], "left_anti")
    counts = rb.select(*key, F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(free.select(*key, F.lit(0).alias("b"), F.lit(1).alias("c")))
    more = counts.groupBy(*key).agg((F.sum("c") > F.sum("b")).alias("unmatched"))
    pairs = one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2))).where("pairing = 'positional'").select("tier", "path", "ix")
    paired = rc.join(pairs, ["tier", "path", "ix"], "left_semi").join(more, key, "left").withColumn("unmatched", F.coalesce("unmatched", F.lit(False)))
    rest = _left(_left(rc, done, "cand"), three, "cand").join(ac.select("path", "ix"), ["path", "ix"], "left_anti")
    surplus = rest.groupBy("path", "ix").agg(F.max(F.struct(*key)).alias("s")).select("s.*", "path", "ix").withColumn("unmatched", F.lit(True))
    held = ac.withColumn("unmatched", F.expr("nc > nb")).drop("nb", "nc")
    return paired.select(*held.columns).unionByName(held).unionByName(surplus), rb.unionByName(ab.drop("nb", "nc"))
