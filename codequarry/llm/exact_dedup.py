"""Exact dedup by content-defined chunk recipes.

Each text, with A-Z lower-cased, is cut where a 32-byte gear hash of its own bytes says so (about 1 KiB a chunk, 16 KiB
at most). A chunk gets a 64-bit identifier that is verified over the whole corpus: identifiers that stand for more than
one SHA-256 of chunk bytes are found by a distinct count and get an ordinal per content. A document is then its recipe,
the ordered list of verified identifiers, and texts are equal exactly when their recipes are. Whole texts are read
once and never shuffled; the shuffles carry identifiers and digests only.

Defined results: null text counts as empty, and all empty texts are equal (their recipe is empty). The row with the
largest doc_id of a group stays. Rows that agree in doc_id and text form one group; one of them stays. A row whose doc_id
is null never stays before one with an id; keep_id is null if no row of the group has an id, and then none stays. An empty table gives an empty result.
Other columns are ignored by the operator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as T
from .base import Scratch, slices, small_side, text_column

WINDOW, MOST = 32, 16 << 10
MASK = np.uint32(((1 << 10) - 1) << 22)
GEAR = (T.BYTE >> np.uint64(20)).astype(np.uint32)


def chunk_ends(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of the rows in ``data``, and the n + 1 row offsets into them. Only a row's own bytes decide."""
    h = GEAR[data]
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8, 16):  # h[i] = sum of GEAR[data[i - j]] << j for j < 2k
            h[k:] += h[:-k] << np.uint32(k)
    cut = np.flatnonzero((h & MASK) == 0) + 1
    row = np.searchsorted(offs, cut, "left") - 1  # the row that ends at or holds the cut
    cut = cut[(cut - offs[np.maximum(row, 0)] >= WINDOW) & (row >= 0)]
    ends = np.unique(np.concatenate([cut, offs[1:][np.diff(offs) > 0]]))
    starts = np.concatenate([[0], ends[:-1]])
    pieces = (ends - starts + MOST - 1) // MOST
    if (pieces > 1).any():  # long stretches without a boundary: cut at fixed steps from their start
        at = np.repeat(starts, pieces)
        step = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
        ends = np.minimum(at + step * MOST, np.repeat(ends, pieces))
    return ends, np.searchsorted(ends, offs, "right")


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, ids, shas): digest of the normalised text, chunk identifiers and chunk digests in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                data, offs = T.flat(text_column(b, "text"))
                data = T.LOWER[data]
                ends, at = chunk_ends(data, offs)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = T.span_hash(data, starts, ends).view(np.int64)
                view = memoryview(data)
                shas = [hashlib.sha256(view[x:y]).digest() for x, y in zip(starts.tolist(), ends.tolist())]
                bounds = offs.tolist()
                lists = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(bounds[:-1], bounds[1:])], pa.string()),
                        pa.ListArray.from_arrays(lists, pa.array(ids)),
                        pa.ListArray.from_arrays(lists, pa.array(shas, pa.binary())),
                    ],
                    names=["doc_id", "text_sha256", "ids", "shas"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text_sha256 string, ids array<long>, shas array<binary>")


def verified(scratch: Scratch, made: DataFrame) -> DataFrame:
    """``made`` with ``recipe``: ids where each stands for one content, else ids and the contents' ordinals."""
    seen = made.select(F.explode(F.arrays_zip("ids", "shas")).alias("c")).select(F.col("c.ids").alias("id"), F.col("c.shas").alias("sha")).distinct()
    shared = seen.groupBy("id").agg(F.array_sort(F.collect_set("sha")).alias("contents")).where(F.size("contents") > 1)
    shared = scratch.table(shared, "clashes")  # 64-bit collisions: none in practice
    if shared.isEmpty():
        return made.withColumn("recipe", F.col("ids"))
    parts = made.select("doc_id", "text_sha256", F.posexplode(F.arrays_zip("ids", "shas")).alias("at", "c")).distinct()
    parts = parts.join(small_side(shared), F.col("c.ids") == F.col("id"), "left")
    parts = parts.withColumn("o", F.coalesce(F.array_position("contents", F.col("c.shas")), F.lit(0)))
    whole = parts.groupBy("doc_id", "text_sha256").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "c.ids", "o"))), lambda p: F.array(p["ids"], p["o"]))).alias("recipe"))
    same = made.alias("m").join(whole.alias("w"), F.col("m.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("m.text_sha256") == F.col("w.text_sha256")), "left")
    return same.select("m.*", F.coalesce("w.recipe", F.array().cast("array<long>")).alias("recipe"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    made = scratch.table(recipes(docs), "recipes")
    rows = scratch.table(verified(scratch, made).groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("copies")), "rows")
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).where("group_size > 1")
    groups = scratch.table(groups, "groups")  # written, so both sides of the join are plain exchanges that AQE can split
    scratch.keep_only(rows, groups)
    out = rows.join(groups, "recipe", "left")
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.coalesce((F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 1), F.lit(False))
    return out.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all ``documents``."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Letters A-Z only are lower-cased, as translate() does; group by the text itself.
OP9_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
