"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Words are maximal runs of letters/digits/non-ASCII bytes, or of other printable bytes. Features are hashed 1- and 2-grams
of the words as written and of their shapes (case pattern, length class, repetition of the word before), so that junk
made of unseen words is still recognised. A feature's value is the square root of its share of the document's n-grams,
so every document has norm 1 whatever its length. Scoring is one sparse dot product per text against a weight table
of fixed size (2**BITS), which is broadcast.

Training uses labelled rows only, at most ``bound`` of them (documented parameter, default 6,000: the rows with the
smallest hash of doc_id, the same choice at every scale); they are featurised on the executors. The labelled sample of
that bounded size is fitted in one task by FTRL-proximal in hash order, in as many epochs (2 to 30) as make about 12,000 updates.

Defined results: null text counts as empty; an empty text has the intercept's score; labelled rows with a null label are
not used; without any labelled row every score is the prior 0.5. Rows that repeat, in ``docs`` or ``labels``, are used each; an empty table
gives an empty result. Other columns never enter a score; ``score`` adds one column and refuses input that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import textcore as T
from .base import fresh_names, slices, text_column

BITS = 18
#: Bytes of text that are featurised at once; some twenty arrays of 8 bytes a word are held meanwhile.
PART = 512 << 10
KIND = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 other
KIND[T.SPACE] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1
#: Byte classes of a shape.
SHAPE = np.full(256, ord("~"), np.uint8)
SHAPE[33:127] = np.arange(33, 127)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = ord("X"), ord("x"), ord("0"), ord("x")


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, offsets): distinct hashed n-grams of each row and their values."""
    data, offs = T.flat(col)
    kind = KIND[data]
    starts, ends = T.runs(kind > 0, offs, kind)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(len(offs), np.int64)
    at = np.searchsorted(starts, offs)
    h = T.span_hash(data, starts, ends)
    first, last = SHAPE[data[starts]], SHAPE[data[ends - 1]]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    with np.errstate(over="ignore"):
        size = np.minimum(ends - starts, 24) // 4
        shape = T.mix(first.astype(np.uint64) * np.uint64(1 << 24) + last.astype(np.uint64) * np.uint64(1 << 16) + size.astype(np.uint64) * np.uint64(2) + again)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        pair = np.flatnonzero(row[1:] == row[:-1])
        two = lambda x, salt: T.mix(x[pair] * np.uint64(0x9E3779B97F4A7C15) + x[pair + 1] + np.uint64(salt))
        grams = np.concatenate([h, two(h, 1), T.mix(shape + np.uint64(2)), two(shape, 3)])
    rows = np.concatenate([row, row[pair], row, row[pair]])
    code = rows.astype(np.int64) << BITS | (grams >> np.uint64(64 - BITS)).astype(np.int64)
    code.sort()
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    count = np.diff(np.append(new, len(code)))
    code = code[new]
    row = code >> BITS
    total = np.bincount(rows, minlength=len(offs) - 1)
    return (code & ((1 << BITS) - 1)).astype(np.int32), np.sqrt(count / total[row]).astype(np.float32), np.searchsorted(row, np.arange(len(offs)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 0, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> tuple[np.ndarray, float]:
    """FTRL-proximal logistic regression on sparse rows: (weights, intercept).

    The intercept is the log-odds of the labels and stays fixed, so a text of unknown words gets about the prior.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    for _ in range(epochs or min(30, max(2, -(-12_000 // max(1, len(rows)))))):
        for (ix, x), y in zip(rows, labels):
            zi, ni = z[ix], n[ix]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * x
            grown = np.sqrt(ni + g * g)
            z[ix] = zi + g - (grown - np.sqrt(ni)) / alpha * w
            n[ix] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 6000) -> tuple[np.ndarray, float]:
    """Weights and intercept from ``labels(doc_id, <label>)``, which must hold the rows to learn from only."""
    spark: SparkSession = docs.sparkSession
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # at most `bound` pairs of numbers

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", PART):
                ix, x, offs = features(text_column(b, "text"))
                lists = pa.array(offs.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(b.schema.get_field_index("y")), pa.ListArray.from_arrays(lists, pa.array(ix)), pa.ListArray.from_arrays(lists, pa.array(x))],
                    names=["doc_id", "y", "ix", "x"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            y += b.column(1).to_pylist()
            for i in range(b.num_rows):
                rows.append((b.column(2)[i].values.to_numpy(zero_copy_only=False), b.column(3)[i].values.to_numpy(zero_copy_only=False)))
        if rows:
            w, bias = ftrl(rows, np.array(y))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    made = rows.mapInArrow(featurise, "doc_id long, y double, ix array<int>, x array<float>")
    made = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "ix").select("doc_id", "y", "ix", "x")
    got = made.mapInArrow(fit, "w binary, bias double").collect()  # one row of 2**BITS floats
    return (np.frombuffer(got[0].w, np.float32), got[0].bias) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def scores(text: pa.Array, w: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text."""
    ix, x, offs = features(text)
    sums = np.concatenate([[0.0], np.cumsum(w[ix] * x.astype(np.float64))])
    return 1.0 / (1.0 + np.exp(-np.clip(sums[offs[1:]] - sums[offs[:-1]] + bias, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; all other columns pass through, and only the text goes to Python."""
    fresh_names(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def run(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        return pa.array(np.concatenate([np.zeros(0), *(scores(text_column(b, "text"), *shared.value) for b in slices(batch, "text", PART))]))

    return docs.withColumn("score", run("text"))


def held_out():
    """Rows of ``labels``/``documents`` that the query never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = train(docs, labels, "quality")
    return (
        score(docs, model)
        .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
    )
