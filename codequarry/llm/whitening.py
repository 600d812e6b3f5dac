"""Embedding whitening from a covariance that is recovered by polarisation.

For two dimensions i and j, cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. So sums of squares are all that is aggregated: of every dimension and of every
sum of two dimensions. Components are turned into integers first (``SCALE`` times the component, floored, plus ``SHIFT``), which makes all of it exact: a first pass
adds up n and the sums S of the dimensions; the second one centres every value at the whole part of its mean, y = x - floor(S / n), squares y_i + y_j, and adds the squares up; what
the fraction of the mean still takes off, R = S mod n, is an integer over n and is taken off in Python integers. Numbers that could leave 64 bits are added in smaller parts, and
those parts as decimals, so no sum is rounded.

A task turns its vectors into one row per pair of dimensions, which Spark adds up; the driver gets d * (d + 1) / 2 of them, whatever the number of vectors, and solves the
eigenproblem of a d x d matrix. A third pass adds up the covariance of the whitened vectors themselves, and the result is made by a fourth. All vectors are fitted on.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are left out, as are components that leave 64 bits when scaled
(an absolute value of 2**40 or more) and vectors that don't have the table's dimension, which is that of most of the others (of two equally frequent ones the larger). Null ids and repeated
rows are vectors of their own. Components beyond the number of dimensions are not there; one without variance has whitened value 0 and doesn't count for the
identity error. An empty table gives an empty result. Only the id and the vector column are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Fixed values of the integer form.
SCALE, SHIFT = 64, 1_000_000
#: Absolute components from here on are refused; vectors that are handled at once.
LARGEST, ROWS = float(1 << 40), 2048
#: An eigenvalue below this share of the largest is no variance.
FLAT = 1e-12


@dataclass(frozen=True)
class Model:
    """``basis`` takes centred integers to whitened components; ``mean`` is S / n, as whole part and remainder over n."""

    n: int
    whole: list[int]
    rest: list[int]
    basis: np.ndarray
    explained: list[float]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of the table's dimension, all of its components finite."""
    size = F.size(vector)
    whole = vectors.where(F.col(vector).isNotNull() & (size > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < LARGEST)))  # NaN is above all numbers
    most = whole.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(size == most.d) if most else whole.limit(0)


def integers(col: pa.Array) -> np.ndarray:
    """(rows, d) matrix of the integer form."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(len(col), -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def exact_sums(values: Callable[[np.ndarray], Iterator[np.ndarray]], count: int) -> Callable:
    """mapInArrow function: for integer matrices x, the sums over all rows of ``values(x)``, matrices of some columns one after another: rows (k, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, large, room, n = np.zeros(count, np.int64), [0] * count, 1 << 62, 0
        for b in _parts(batches):
            at, n = 0, n + b.num_rows
            for v in values(integers(b.column(0))):
                most, to = int(np.abs(v).max(initial=0)) * len(v), at + v.shape[1]
                if most >= 1 << 62:  # the sum of this part alone could leave 64 bits
                    for k, c in enumerate(v.astype(object).sum(axis=0)):
                        large[at + k] += int(c)
                else:
                    if room < most:
                        large, small, room = [p + int(q) for p, q in zip(large, small)], np.zeros(count, np.int64), 1 << 62
                    small[at:to] += v.sum(axis=0)
                    room -= most
                at = to
        if n:
            total = [Decimal(p + int(q)) for p, q in zip(large, small)]
            yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array([n] * count)], names=["k", "total", "n"])

    return run


def _added(rows: DataFrame, run: Callable) -> list:
    """[(total, n)] by k: as many rows as ``run`` counts, which depends on the dimension alone."""
    made = rows.mapInArrow(run, "k int, total decimal(38,0), n long")
    return [(int(r.total), r.n) for r in made.groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("k").collect()]


def squares(whole: list[int]) -> Callable[[np.ndarray], Iterator[np.ndarray]]:
    """Squares of each centred dimension i and of its sums with those after it, for one i after another."""
    centre = np.array(whole, np.int64)

    def run(x: np.ndarray) -> Iterator[np.ndarray]:
        y = x - centre
        if np.abs(y).max(initial=0) >= 1 << 30:
            y = y.astype(object)
        for i in range(y.shape[1]):
            z = y[:, i:] + y[:, i : i + 1]
            z[:, 0] = y[:, i]
            yield z * z

    return run


def covariance(rows: DataFrame, vector: str, dim: int) -> tuple[int, list[int], list[int], np.ndarray]:
    """n, whole parts and remainders of the means, and the covariance of the integer form, each entry rounded once."""
    rows = rows.select(vector)
    sums = _added(rows, exact_sums(lambda x: iter([x]), dim))
    n = sums[0][1]
    whole, rest = [s // n for s, _ in sums], [s % n for s, _ in sums]
    found = iter(_added(rows, exact_sums(squares(whole), dim * (dim + 1) // 2)))
    total = {(i, j): next(found)[0] for i in range(dim) for j in range(i, dim)}
    # n**3 times the variance of a dimension, or of a sum of two: squares of n * x - S, added up
    spread = {(i, j): n * n * q - n * (rest[i] + (rest[j] if j > i else 0)) ** 2 for (i, j), q in total.items()}
    v = np.zeros((dim, dim))
    for (i, j), s in spread.items():
        v[i, j] = v[j, i] = s / n**3 if i == j else (s - spread[i, i] - spread[j, j]) / (2 * n**3)
    return n, whole, rest, v


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 32) -> Model | None:
    """Model of the usable rows of ``vectors``; None if there are none."""
    first = vectors.select(F.size(vector).alias("d")).first()
    if first is None:
        return None
    n, whole, rest, v = covariance(vectors, vector, first.d)
    value, basis = np.linalg.eigh(v)
    value, basis = value[::-1][:components], basis[:, ::-1][:, :components]
    real = value > FLAT * max(value[0], 0)
    scale = np.where(real, 1 / np.sqrt(np.where(real, value, 1)), 0)
    trace = float(np.trace(v))
    return Model(n, whole, rest, basis * scale, [float(e) / trace if trace else 0.0 for e in value])


def _whitened(model: Model, x: np.ndarray) -> np.ndarray:
    return ((x - np.array(model.whole)) - np.array(model.rest) / model.n) @ model.basis


def _deviation(model: Model, x: np.ndarray) -> list[Decimal | None]:
    """The exact sum over dimensions of (n * x - S) ** 2, null from 10**38 on."""
    y, rest = x - np.array(model.whole), np.array(model.rest)
    if (int(np.abs(y).max(initial=0)) + 1) * model.n >= 1 << 62:
        d = y.astype(object) * model.n - rest.astype(object)
    else:
        d = y * model.n - rest
        if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 1 << 62:
            d = d.astype(object)
    return [Decimal(int(s)) if s < 10**38 else None for s in (d * d).sum(axis=1).tolist()]


def identity_error(vectors: DataFrame, model: Model, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    c = model.basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + 1, c))
        for b in _parts(batches):
            w = _whitened(model, integers(b.column(0)))
            total[:c] += w.T @ w
            total[c] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(c * (c + 1)), pa.int32()), pa.array(total.ravel())], names=["k", "total"])

    rows = vectors.select(vector).mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).orderBy("k").collect()
    total = np.array([r.total for r in rows]).reshape(c + 1, c) / model.n
    real = np.flatnonzero(model.basis.any(axis=0))
    off = (total[:c] - np.outer(total[c], total[c]) - np.eye(c))[np.ix_(real, real)]
    return float(np.abs(off).max(initial=0.0))


def whiten(vectors: DataFrame, model: Model, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``key``, deviation decimal, whitened array of doubles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            x = integers(b.column(1))
            w = _whitened(model, x)
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviation(model, x), pa.decimal128(38, 0)), lists], names=[key, "deviation", "whitened"])

    rows = vectors.select(key, vector)
    schema = rows.select(key).withColumn("deviation", F.lit(None).cast("decimal(38,0)")).schema.add("whitened", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened; one row a vector and component. A deviation that leaves 64 bits is null (``whiten`` has it as a decimal)."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding")
    model = fit(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    error, each = identity_error(rows, model), F.array(*[F.lit(e) for e in model.explained])
    flat = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "w"))
    deviation = F.expr("try_cast(deviation as bigint)")
    return flat.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), deviation.alias("deviation"), F.col("w").alias("whitened"), F.get(each, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
