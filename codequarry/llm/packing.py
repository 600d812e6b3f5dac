"""Packing into optimal length buckets.

Lengths, in the query the ids of a byte-level BPE tokenizer, are counted over the whole corpus into one histogram (at most ``longest`` rows). Dynamic programming over it
finds the ``buckets`` boundaries with the least total padding, each sequence being padded to the boundary of its bucket.
Inside a bucket of boundary L, batches hold floor(budget / L) sequences. Texts of more than ``longest`` tokens become
several sequences: full ones of ``longest`` tokens and the rest, so nothing is cut off.

A sequence's place in its bucket is its rank in the order (shard, doc_id, seq), shard being a hash of the document: ranks
are counted inside (bucket, shard) groups of about ``shard_rows`` rows and offset by the sizes of the groups before, so
one bucket that holds most of the rows is still spread over many tasks.

Defined results: null text counts as empty; a text without tokens is one sequence of length 0, which goes to the smallest
bucket. A null doc_id is packed like any other and stays null. Rows that repeat a doc_id are packed each.
Other columns of the input are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Scratch
from .token_files import token_count

SHARD_ROWS = 50_000


def word_count(text: str = "text") -> Column:
    """Tokens of a text where a token is a word ``[^\\x20\\x09-\\x0D]+``."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(F.length(squeezed) == 0, 0).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` boundaries with the least padding: ``lengths`` ascending and distinct, ``counts`` of each.

    cost(i, j) pads lengths i..j-1 to lengths[j-1]; best[k][j] = min over i of best[k-1][i] + cost(i, j), a vector at a time.
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    best = np.concatenate([[0.0], lengths * rows[1:]])  # one bucket; padding and tokens together, as tokens are constant
    back = []
    for _ in range(1, min(buckets, n)):
        fresh, choice = np.empty(n + 1), np.zeros(n + 1, np.int64)
        fresh[0] = 0
        for j in range(1, n + 1):
            total = best[:j] + lengths[j - 1] * (rows[j] - rows[:j])
            choice[j] = int(np.argmin(total))
            fresh[j] = total[choice[j]]
        best = fresh
        back.append(choice)
    out, j = [], n
    for choice in reversed(back):
        out.append(int(lengths[j - 1]))
        j = int(choice[j])
        if j == 0:
            break
    if j > 0:
        out.append(int(lengths[j - 1]))
    return sorted(out)


def pack(docs: DataFrame, length: Column, budget: int = 16384, longest: int = 4096, buckets: int = 8) -> DataFrame:
    """(doc_id, seq, start, n_tokens, bucket, bucket_len, batch, slot) of every sequence of ``docs``."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "pack")
    sized = docs.select("doc_id", length.cast("long").alias("total"), F.xxhash64("doc_id", "text").alias("h"))
    parts = sized.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("total") - 1) / longest)).cast("long"))))
    start = F.col("seq") * longest
    parts = scratch.table(parts.select("doc_id", "h", "seq", start.alias("start"), F.least(F.col("total") - start, F.lit(longest)).alias("n_tokens")), "parts")
    histogram = parts.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # at most `longest` + 1 rows
    edges = boundaries(np.array([max(1, r.n_tokens) for r in histogram], np.float64), np.array([r["count"] for r in histogram]), buckets) or [1]
    rows = sum(r["count"] for r in histogram)
    shards = max(1, -(-rows // SHARD_ROWS))
    bucket = sum((F.when(F.col("n_tokens") > e, 1).otherwise(0) for e in edges[:-1]), F.lit(0))
    placed = parts.withColumn("bucket", bucket).withColumn("shard", F.pmod("h", F.lit(shards)))
    groups = placed.groupBy("bucket", "shard").count()
    # one row a group of about SHARD_ROWS rows: this running sum is over corpus rows / SHARD_ROWS rows
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    groups = scratch.table(groups.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before")), "groups")
    ranked = placed.withColumn("i", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "h", "seq")))
    joined = ranked.join(groups, ["bucket", "shard"])
    edge = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bucket") + 1).cast("long")
    joined = joined.withColumn("bucket_len", edge).withColumn("per", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long"))
    rank = F.col("before") + F.col("i") - 1
    return joined.select(
        F.col("doc_id").cast("long").alias("doc_id"), "seq", "start", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bucket_len",
        F.floor(rank / F.col("per")).cast("long").alias("batch"), F.pmod(rank, F.col("per")).cast("long").alias("slot"),
    )


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents, counted in byte-level BPE tokens, packed into batches."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, token_count(tokenizer))
