"""MinHash near-dedup with tensored banding.

Two small collections of ``m`` band hashes each are computed per text (``r`` minimum hashes per band, so ``2*m*r``
minima). The table keys are all ``m * m`` combinations of one band of the left and one of the right collection, as if
``m * m`` tables of ``2 * r`` minima had been drawn, for about the square root of the minhash work. Every candidate is
confirmed on the full shingle sets, so the chance lies only in missing a pair: with r=4, m=17 a pair at similarity
0.80 is missed with probability 0.00026, at 0.85 with 0.000007.

Texts with equal shingle sets form one class first. A band hash that only one class has can't be part of a shared key, so such bands are dropped by a count
(map-side combined) before the keys are formed; that loses nothing. Candidates, the members of a table key, are never expanded into all pairs:

1. Each key's smallest member is linked to the others, and the components of these links are the families: every candidate pair lies
   in one. A family's hub is the member that meets the most others under its keys.
2. All members are compared with the hub. Most families are one component after that.
3. A shingle that no other member of the family has can't be in an intersection, so it bounds the similarity of its text to all others at once. Members
   that the bound rules out leave; members outside the hub's component that are left are compared with all that are left.

A family of up to ``TOKENS`` shingles is solved in one task. A larger one is cut into slices of about that size: the hub meets every slice, the bound is a grouped count,
and the last step runs over pairs of slices, each of which returns a spanning forest of its links instead of the links.

Defined results: null text counts as empty; a text without words has an empty set and links with nothing; rows with a
null doc_id are returned with a null component and kept false; rows that repeat a doc_id belong to one document id, linked by any of its texts.
An empty table gives an empty result. Other columns are ignored by the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textcore as T
from .base import Scratch, components, slices, small_side, text_column

#: Shingles of a slice of a family, and members of it.
TOKENS, MEMBERS = 1 << 20, 1 << 13


def _seeds(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2)


def _bands(low: np.ndarray, m: int, r: int) -> np.ndarray:
    """(rows, 2 m) band hashes of (rows, 2 m r) minima."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(low), 2 * m), np.uint64)
        for j in range(2 * m):
            h = np.full(len(low), np.uint64(j + 1), np.uint64)
            for i in range(r):
                h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + low[:, j * r + i])
            out[:, j] = h
    return out


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, k: int, m: int, r: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands): set size, digest of the set and its 2 m band hashes."""
    seeds = _seeds(2 * m * r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                s, offs = T.shingles(*T.words(text_column(b, "text")), k)
                d1, d2 = T.digest(s, offs)
                bands = _bands(T.minima(s, offs, seeds), m, r)
                n = len(offs) - 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(offs)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _lists(bands.ravel(), np.arange(n + 1) * 2 * m)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def shingle_sets(members: DataFrame, k: int) -> DataFrame:
    """``members(text, d1, d2, ...)`` with ``items``, the full set of each text as sorted 64-bit shingle hashes, in place of text and digest; rows of another digest go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                s, offs = T.shingles(*T.words(text_column(b, "text")), k)
                d1, d2 = (d.view(np.int64) for d in T.digest(s, offs))
                same = pa.array((d1 == b.column(1).to_numpy()) & (d2 == b.column(2).to_numpy()))
                out = pa.RecordBatch.from_arrays([*b.columns[3:], _lists(s, offs)], names=[*b.schema.names[3:], "items"])
                yield out.filter(same)

    rest = [c for c in members.columns if c not in ("text", "d1", "d2")]
    return members.select("text", "d1", "d2", *rest).mapInArrow(run, StructType([*members.select(*rest).schema.fields, *StructType.fromDDL("items array<long>").fields]))


def _flat(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and its n + 1 offsets."""
    one = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    size = np.diff(np.asarray(one.offsets))
    return np.asarray(one.flatten()), np.concatenate([[0], np.cumsum(size)])


def _pick(x: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of some rows."""
    size = (offs[1:] - offs[:-1])[rows]
    to = np.concatenate([[0], np.cumsum(size)])
    return x[np.repeat(offs[rows] - to[:-1], size) + np.arange(to[-1])], to


def similar(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sets of x and y with 100 * intersection >= percent * union.

    Sets of x come 64 at a time: a shingle's mask tells which of them hold it, and bits of the masks of a set of y add up to its intersections.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    owner, ny = np.repeat(np.arange(len(yo) - 1), np.diff(yo)), np.diff(yo)
    for a in range(0, len(xo) - 1, 64):
        z = min(a + 64, len(xo) - 1)
        some, size = x[xo[a] : xo[z]], np.diff(xo[a : z + 1])
        if not len(some) or not len(y):
            continue
        order = np.argsort(some, kind="stable")
        bit = np.uint64(1) << np.repeat(np.arange(z - a, dtype=np.uint64), size)[order]
        some = some[order]
        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        known, mask = some[first], np.bitwise_or.reduceat(bit, first)
        at = np.minimum(np.searchsorted(known, y), len(known) - 1)
        hit = np.flatnonzero(known[at] == y)
        common = np.zeros((len(ny), z - a), np.int64)
        for c in range(0, len(hit), 1 << 17):
            part = hit[c : c + (1 << 17)]
            row = owner[part]
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            bits = np.unpackbits(mask[at[part]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : z - a]
            common[row[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        j, i = np.nonzero((100 * common >= percent * (ny[:, None] + size[None, :] - common)) & (common > 0))
        left.append(i + a)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes with links i - j, the smallest node that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(fresh, at, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _alive(n: np.ndarray, unique: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Whether a text of n shingles, ``unique`` of which nobody else has, can be similar to one of at least ``least`` shingles."""
    partner = np.maximum(least, -(-percent * n // 100))
    return (n - unique) * (100 + percent) >= percent * (n + partner)


def _solve(percent: int):
    """Solves a family that fits in a task: (rep, root) of each member that shares a component."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("hub", "descending"), ("rep", "ascending")])
        rep = rows["rep"].to_numpy()
        x, offs = _flat(rows["items"])
        n = np.diff(offs)
        _, i = similar(*_pick(x, offs, np.array([0])), x, offs, percent)
        linked = np.zeros(len(rep), bool)
        linked[i] = linked[0] = True
        a, b = np.zeros(len(i), np.int64), i
        if not linked.all():
            _, of, often = np.unique(x, return_inverse=True, return_counts=True)
            unique = np.add.reduceat(np.append(often[of] == 1, False), offs[:-1], dtype=np.int64)
            alive = _alive(n, unique, int(n.min()), percent)
            q, m = np.flatnonzero(alive & ~linked), np.flatnonzero(alive)
            if len(q):
                i, j = similar(*_pick(x, offs, q), *_pick(x, offs, m), percent)
                a, b = np.concatenate([a, q[i]]), np.concatenate([b, m[j]])
        reps, of = np.unique(rep, return_inverse=True)
        root = _labels(len(reps), of[a], of[b])
        moved = np.flatnonzero(root != np.arange(len(reps)))
        return pa.table({"rep": reps[moved], "root": reps[root[moved]]})

    return run


def _tile(percent: int):
    """Compares the rows of side 0 of a tile with those of side 1: a spanning forest (a, b) of their links."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rep, side = rows["rep"].to_numpy(), rows["side"].to_numpy()
        x, offs = _flat(rows["items"])
        q, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = similar(*_pick(x, offs, q), *_pick(x, offs, m), percent)
        reps, of = np.unique(rep, return_inverse=True)
        root = _labels(len(reps), of[q[i]], of[m[j]])
        moved = np.flatnonzero(root != np.arange(len(reps)))
        return pa.table({"a": reps[moved], "b": reps[root[moved]]})

    return run


def _large(scratch: Scratch, members: DataFrame, percent: int) -> DataFrame:
    """(rep, root) of the members of families that are cut into slices; ``members(fam, slices, hub, rep, n_shingles, items)``."""
    slot = lambda slices: F.pmod(F.xxhash64("rep"), F.col(slices)).cast("int")
    every = lambda slices: F.explode(F.sequence(F.lit(0), F.col(slices) - 1))
    keys = members.where("hub").select("fam", every("slices").alias("j"), F.lit(0).alias("side"), "rep", "items")
    met = keys.unionByName(members.select("fam", slot("slices").alias("j"), F.lit(1).alias("side"), "rep", "items"))
    near = scratch.table(met.groupBy("fam", "j").applyInArrow(_tile(percent), "a long, b long"), "hub-links")
    linked = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("linked", F.lit(True))
    unique = members.select("fam", "rep", F.explode("items").alias("item")).groupBy("fam", "item").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    unique = unique.where("n = 1").groupBy("rep").agg(F.count("*").alias("unique"))
    texts = members.groupBy("rep").agg(F.count("*").alias("texts")).where("texts > 1")
    sizes = members.groupBy("fam").agg(F.min("n_shingles").alias("least"))
    state = members.select("fam", "slices", "rep", "n_shingles").join(unique, "rep", "left").join(texts, "rep", "left").join(linked, "rep", "left").join(sizes, "fam")
    partner = F.greatest(F.col("least"), F.ceil(F.lit(percent) * F.col("n_shingles") / 100))
    own = F.when(F.col("texts").isNull(), F.coalesce("unique", F.lit(0))).otherwise(0)  # several texts of one id share the count
    state = state.where((F.col("n_shingles") - own) * (100 + percent) >= percent * (F.col("n_shingles") + partner))
    state = scratch.table(state.groupBy("fam", "slices", "rep", F.coalesce("linked", F.lit(False)).alias("linked")).agg(F.max("n_shingles").alias("n_shingles")), "alive")
    cut = scratch.table(state.where("not linked").groupBy("fam").agg(_slices().alias("outer")), "outer")  # families with members still to compare
    left = state.join(cut, "fam").select("fam", "rep", "linked", "outer", "slices").join(members.select("fam", "rep", "items"), ["fam", "rep"])
    queries = left.where("not linked").select("fam", slot("outer").alias("i"), every("slices").alias("j"), F.lit(0).alias("side"), "rep", "items")
    others = left.select("fam", every("outer").alias("i"), slot("slices").alias("j"), F.lit(1).alias("side"), "rep", "items")
    more = queries.unionByName(others).groupBy("fam", "i", "j").applyInArrow(_tile(percent), "a long, b long")
    return components(scratch, scratch.table(near.union(more), "large-links")).select(F.col("node").alias("rep"), "root")


def _slices() -> Column:
    """Number of slices of a group of texts."""
    return F.greatest(F.ceil(F.sum("n_shingles") / TOKENS), F.ceil(F.count("*") / MEMBERS)).cast("int")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, m: int = 17, r: int = 4) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, kept (see the module)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sigs = scratch.table(signatures(docs, k, m, r), "sigs")
    classes = scratch.table(
        sigs.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")),
        "classes",
    )
    bands = classes.select("d1", "d2", "rep", F.posexplode("bands").alias("j", "band"))
    shared = scratch.table(bands.groupBy("band").count().where("count > 1").select("band"), "bands")
    live = bands.join(small_side(shared), "band").groupBy("d1", "d2", "rep").agg(*[F.collect_list(F.when(side, F.col("band"))).alias(x) for x, side in (("x", F.col("j") < m), ("y", F.col("j") >= m))])
    keys = live.select("rep", F.explode(F.flatten(F.transform("x", lambda a: F.transform("y", lambda b: F.xxhash64(a, b))))).alias("key"))
    keys = scratch.table(keys, "keys")
    groups = scratch.table(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lo")).where("n > 1"), "groups")
    met = scratch.table(keys.join(small_side(groups), "key").groupBy("rep", "lo").agg(F.sum("n").alias("n")), "met")
    families = components(scratch, met.select(F.col("rep").alias("a"), F.col("lo").alias("b")))
    families = scratch.table(families.union(families.select("root", "root").distinct()).toDF("rep", "fam"), "families")
    known = classes.select("rep", "d1", "d2", "n_shingles").join(small_side(families), "rep")
    known = known.join(met.groupBy("rep").agg(F.sum("n").alias("met")), "rep", "left")
    known = scratch.table(known.select("rep", "d1", "d2", "n_shingles", "fam", F.coalesce("met", F.lit(0)).alias("met")), "known")
    size = known.groupBy("fam").agg(_slices().alias("slices"), F.max_by("rep", F.struct("met", -F.col("rep"))).alias("hub"))
    members = scratch.table(known.join(size, "fam").select("rep", "d1", "d2", "n_shingles", "fam", "slices", (F.col("rep") == F.col("hub")).alias("hub")), "members")
    chosen = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(small_side(members), "rep")
    sets = scratch.table(shingle_sets(chosen, k), "sets")
    if not sigs.where("doc_id is not null").groupBy("doc_id", "d1", "d2").count().where("count > 1").isEmpty():
        sets = scratch.table(sets.dropDuplicates(["rep", "items"]), "sets-once")
    small = sets.where("slices = 1").select("fam", "rep", "hub", "items").groupBy("fam").applyInArrow(_solve(percent), "rep long, root long")
    roots = scratch.table(small, "small")
    if not members.where("slices > 1").isEmpty():
        roots = roots.union(_large(scratch, sets.where("slices > 1"), percent))
    of_class = classes.select("d1", "d2", "n_shingles", "rep").join(roots, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    of_class = scratch.table(of_class, "roots")
    scratch.keep_only(sigs, of_class)
    out = sigs.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents`` on 2-word shingles at similarity 0.80."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=2, percent=80)


#: All pairs that share a shingle, and the transitive closure of the links.
OP10_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, m.y FROM r JOIN (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l) m ON r.root = m.x),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.node
"""
