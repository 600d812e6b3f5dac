"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors x, y have cosine >= c exactly when |x - y|^2 <= 2 - 2c. After a random rotation the coordinates are split into
blocks; since block distances add up to the whole distance, some block b has |x_b - y_b|^2 <= (2 - 2c) * dim_b / dim, its
share of the budget. So a range join inside each block finds every linked pair. In a block, a vector lies in one cell of a grid over
the block's first coordinates, twice as wide as the radius, and is copied to the later ones of the few neighbouring cells its ball touches.

Candidates are met in tiles of at most ``TILE`` by ``TILE`` vectors: a larger cell is cut into slices that are paired with each other. A first pass
carries only the few coordinates of a block and finds the vectors that have any partner within the block's budget; whole vectors are brought for those
alone. In the second pass numpy compares a tile as matrices, confirms with the cosine of the original vectors in double precision, and counts a pair only
in the first block that admits it, so a union over blocks needs no pair table. A tile emits per vector its count of links, and a
spanning forest of its links instead of the links; so a group of n copies makes about n rows a tile, not n * n.

Equal vectors are collapsed to one with a weight before the join.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different length.
Rows with a null vec_id are returned unlinked (component null, kept false). Every other row is a vector of its own, also where it repeats a
vec_id: equal rows link with each other. Components of 64-bit numbers are compared as they are, narrower ones too. An empty table gives an empty result.
Columns of other names are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, components, small_side

BLOCK_DIM, GRID, TILE = 8, 3, 4096
#: Rows that a task holds, pairs that it compares at once by block, and those by whole vectors.
ROWS, PAIRS, PART = 1 << 14, 1 << 19, 1 << 15
#: Pairs of a tile above which it is compared as a matrix.
MATRIX = 1 << 12
KEY = ["dim", "block", "cell", "i", "j", "alone"]
SLACK = 1e-6
#: Slice numbers of copies begin here.
COPIES = 1 << 20


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(1234 + dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, cosine: float) -> list[tuple[int, int, float]]:
    """(start, stop, squared radius) of each block."""
    edges = list(range(0, dim, BLOCK_DIM)) + [dim]
    return [(a, b, (2 - 2 * cosine) * (b - a) / dim + SLACK) for a, b in zip(edges[:-1], edges[1:])]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; their cosines stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cells(rotated: np.ndarray, start: int, stop: int, radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own): the own cell of every vector, and the neighbours after it whose cell its ball touches."""
    g = min(GRID, stop - start)
    width = 2 * math.sqrt(radius2)
    at = rotated[:, start : start + g] / width
    home = np.floor(at).astype(np.int64)
    part = (at - home) * width
    code = lambda c: ((c + (1 << 20)) * (np.int64(1) << np.int64(21)) ** np.arange(g)[::-1]).sum(axis=1)
    rows, found, own = [np.arange(len(at))], [code(home)], [np.ones(len(at), bool)]
    for move in itertools.product((-1, 0, 1), repeat=g):
        if move <= (0,) * g:
            continue  # the pair is met from the other side
        move = np.array(move)
        gap = np.where(move > 0, width - part, np.where(move < 0, part, 0.0))
        hit = np.flatnonzero((gap * gap).sum(axis=1) <= radius2 * (1 + 1e-9))
        rows.append(hit)
        found.append(code(home[hit] + move))
        own.append(np.zeros(len(hit), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(own)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), dim)


def _placed(classes: DataFrame, cosine: float) -> DataFrame:
    """(dim, block, cell, own, cid, p) of every place of every vector, p being its coordinates in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == dim))
                turned = unit(scaled(_matrix(some.column(2), dim))) @ rotation(dim)
                for i, (start, stop, r2) in enumerate(blocks(dim, cosine)):
                    row, cell, own = cells(turned, start, stop, r2)
                    n, part = len(row), turned[row, start:stop].astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (stop - start)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, i, np.int32)), pa.array(cell), pa.array(own), some.column(0).take(pa.array(row)), lists],
                        names=["dim", "block", "cell", "own", "cid", "p"],
                    )

    return classes.select("cid", "dim", "v").mapInArrow(run, "dim int, block int, cell long, own boolean, cid long, p array<float>")


def _pairs(begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each row i with the ``count[i]`` rows from ``begin[i]``, about PAIRS at a time."""
    stops = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, np.repeat(begin[at:to] - (np.cumsum(n) - n), n) + np.arange(len(i))
        at = to


def _near(rows: pa.Table, p: np.ndarray, r2: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of whole tiles, in order of KEY and side, that a tile pairs and whose p are within the squared radius.

    Tiles of more than ``MATRIX`` pairs are compared as matrices, some rows at a time; the pairs of the others are listed together.
    """
    cols, side = [rows[c].to_numpy() for c in KEY], rows["side"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
    size = np.diff(np.append(start, len(side)))
    tile, alone = np.repeat(np.arange(len(start)), size), cols[-1][start]
    other = np.add.reduceat(side, start, dtype=np.int64)  # rows of side 1, which stand last
    left, end = size - other, start + size
    large = np.flatnonzero(left * np.where(alone, left, other) > MATRIX)
    begin = np.where(alone[tile], np.arange(len(side)) + 1, (end - other)[tile])
    count = np.where(side == 0, end[tile] - begin, 0)
    count[np.isin(tile, large)] = 0
    for i, j in _pairs(begin, count):
        hit = ((p[i] - p[j]) ** 2).sum(1) <= r2
        yield i[hit], j[hit]
    norm = (p * p).sum(1)
    for t in large.tolist():
        first, last = int(start[t]), int(start[t] + left[t])
        to = first if alone[t] else last
        o, n = p[to : end[t]].T, norm[to : end[t]]
        for a in range(first, last, 512):
            z = min(a + 512, last)
            i, j = np.nonzero(norm[a:z, None] + n - 2 * (p[a:z] @ o) <= r2)
            i, j = i + a, j + to
            if alone[t]:
                i, j = i[i < j], j[i < j]
            yield i, j


def _first(rows: pa.Table, dim: int, block: int, cosine: float) -> pa.Table:
    """First pass: (dim, block, cell, own, cid) of the vectors with a partner in the block."""
    start, stop, r2 = blocks(dim, cosine)[block]
    p, has = _matrix(rows["p"], stop - start).astype(np.float32), np.zeros(rows.num_rows, bool)
    for i, j in _near(rows, p, r2 + 1e-5):
        has[i] = has[j] = True
    own = (rows["side"].to_numpy() == 0) | (rows["j"].to_numpy() < COPIES)
    n = int(has.sum())
    return pa.table({"dim": np.full(n, dim, np.int32), "block": np.full(n, block, np.int32), "cell": rows["cell"].to_numpy()[has], "own": own[has], "cid": rows["cid"].to_numpy()[has]})


def _second(rows: pa.Table, dim: int, block: int, cosine: float) -> pa.Table:
    """Second pass, on whole vectors: (cid, n, root), links of each vector that this block is the first to admit, and a spanning forest of them."""
    cid, weight, x = rows["cid"].to_numpy(), rows["weight"].to_numpy(), scaled(_matrix(rows["v"], dim))
    parts, turned, norm = blocks(dim, cosine), unit(x) @ rotation(dim), np.sqrt(np.einsum("ij,ij->i", x, x))
    start, stop, r2 = parts[block]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _near(rows, np.ascontiguousarray(turned[:, start:stop]), r2 + 1e-9):
        for a in range(0, len(i), PART):
            u, w = i[a : a + PART], j[a : a + PART]
            ok = np.einsum("ij,ij->i", x[u], x[w]) / (norm[u] * norm[w]) >= cosine
            u, w = u[ok], w[ok]
            d = (turned[u] - turned[w]) ** 2
            mine = d[:, start:stop].sum(1) <= r2
            for s, t, budget in parts[:block]:
                mine &= d[:, s:t].sum(1) > budget
            left.append(u[mine])
            right.append(w[mine])
    i, j = np.concatenate(left), np.concatenate(right)
    n = np.bincount(i, weights=weight[j], minlength=len(cid)) + np.bincount(j, weights=weight[i], minlength=len(cid))
    has = np.flatnonzero(n)
    link = dict(zip(*(z.tolist() for z in _forest(cid[i], cid[j]))))
    return pa.table({"cid": cid[has], "n": n[has].astype(np.int64), "root": pa.array([link.get(r, r) for r in cid[has].tolist()], pa.int64())})


def _solved(tiles: DataFrame, solve, cosine: float, schema: str) -> DataFrame:
    """``solve`` over whole tiles, some at a time, of one block; a task holds ROWS rows or one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ends = [c.to_numpy() for c in (rows["dim"], rows["block"])]
            cuts = np.flatnonzero((ends[0][1:] != ends[0][:-1]) | (ends[1][1:] != ends[1][:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), rows.num_rows]):
                yield from solve(rows.slice(a, b - a), int(ends[0][a]), int(ends[1][a]), cosine).to_batches()

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                new = np.any([(c := rows[k].to_numpy())[1:] != c[:-1] for k in KEY], axis=0)
                at = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
                if at:
                    yield from done(rows.slice(0, at))
                held = rows.slice(at).to_batches()
        if sum(x.num_rows for x in held):
            yield from done(pa.Table.from_batches(held).combine_chunks())

    return tiles.repartition(*[F.col(c) for c in KEY]).sortWithinPartitions(*KEY, "side").mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the links a - b connect: label passing on the links of one tile."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ix[: len(a)], ix[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        np.minimum.at(fresh, i, low)
        np.minimum.at(fresh, j, low)
        np.minimum.at(fresh, label[i], low)
        np.minimum.at(fresh, label[j], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _tiles(scratch: Scratch, placed: DataFrame, name: str, *carried: str) -> DataFrame:
    """``placed`` cut into tiles: KEY, side, cid and the carried columns. Slices of a cell's own vectors meet each other (alone: one slice itself) and all slices of its copies."""
    sizes = placed.groupBy("dim", "block", "cell").agg(F.count_if("own").alias("nx"), F.count_if(~F.col("own")).alias("ny"))
    slots = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / TILE)).cast("int")
    sizes = scratch.table(sizes.where("nx > 0 and nx + ny > 1").select("dim", "block", "cell", slots("nx").alias("sx"), slots("ny").alias("sy")), name)
    h = F.xxhash64("cid")
    cut = placed.join(small_side(sizes), ["dim", "block", "cell"]).withColumn("s", F.when(F.col("own"), F.pmod(h, F.col("sx"))).otherwise(F.pmod(h, F.col("sy"))).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # own against own: slices s <= t; side 0 is s, side 1 is t. own against copies: every slice pair.
    among = F.transform(each("sx"), lambda t: F.struct(F.least("s", t).alias("i"), F.greatest("s", t).alias("j"), (F.col("s") == t).alias("alone"), F.when(F.col("s") <= t, 0).otherwise(1).alias("side")))
    to_copies = F.transform(each("sy"), lambda t: F.struct(F.col("s").alias("i"), (F.lit(COPIES) + t).alias("j"), F.lit(False).alias("alone"), F.lit(0).alias("side")))
    to_own = F.transform(each("sx"), lambda t: F.struct(t.alias("i"), (F.lit(COPIES) + F.col("s")).alias("j"), F.lit(False).alias("alone"), F.lit(1).alias("side")))
    tiles = cut.select("dim", "block", "cell", "cid", *carried, F.explode(F.when(F.col("own"), F.concat(among, to_copies)).otherwise(to_own)).alias("t"))
    return tiles.select("dim", "block", "cell", "t.i", "t.j", "t.alone", "t.side", "cid", *carried)


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, ...)``: vec_id, n_links, component_id, kept (see the module)."""
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() in ("float", "byte", "short") else "double"
    v = F.transform(F.col("embedding"), lambda x: x.cast(kind))
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("ok", usable & F.col("vec_id").isNotNull())

    classes = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("cid"), "rep", "weight", F.size("v").alias("dim"), "v"), "classes")
    placed = scratch.table(_placed(classes, cosine), "placed")
    pairs = _solved(_tiles(scratch, placed, "sizes", "p"), _first, cosine, "dim int, block int, cell long, own boolean, cid long")
    chosen = scratch.table(pairs.distinct(), "chosen")
    whole = _tiles(scratch, chosen, "chosen-sizes").join(classes.select("cid", "weight", "v"), "cid")
    found = scratch.table(_solved(whole, _second, cosine, "cid long, n long, root long"), "found")
    roots = components(scratch, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("rep", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "cid").alias("root"))
    known = scratch.table(known, "known")
    least = scratch.table(known.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("of")).where("of > 1").select("root", "least"), "least")
    known = scratch.table(known.join(small_side(least), "root", "left").select("v", "n", F.coalesce("least", "rep").alias("component")), "named")
    scratch.keep_only(known)
    out = rows.where("ok").select("vec_id", "v").join(known, "v").select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all ``embeddings`` at cosine 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs, and the transitive closure of the links.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.y FROM r JOIN l ON r.root = l.x),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON v.vec_id = c.node LEFT JOIN n ON v.vec_id = n.x
"""
