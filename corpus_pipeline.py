"""Document pipeline: quality filter, exact dedup, near dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; all but the last
return the columns of ``documents``, and other columns are left out. Near duplicates are taken on 5-word shingles at similarity 0.80. The secret stage
keeps every document and replaces what it finds. SQL can express neither the trained stages nor the minimum-padding search, so
``ORACLE_SQL`` is None and the stages are tested against brute-force versions.

Rows are told apart by doc_id and text together, so rows that share a doc_id but not the text, and rows without one, are documents of their own.
Null texts count as empty. An empty table goes through every stage and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import base, exact_dedup, minhash_dedup, packing, quality, secrets, token_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7. A null or empty text has the score of the intercept; repeated rows are scored each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    model = quality.train(docs, labels, "quality")
    return quality.score(docs.select(COLUMNS), model).where("score >= 0.7").select(COLUMNS)


def _one_of(rows: DataFrame, *key: str) -> DataFrame:
    """Of the rows of a key the least one, by text, lang, source and n_chars."""
    least = rows.groupBy(*key).agg(F.min(F.struct(*[c for c in COLUMNS if c not in key])).alias("row"))
    return least.select(*[c for c in key if c in COLUMNS], "row.*").select(COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty), one row with the largest doc_id, whole rows that repeat included.

    Where no row of a group has a doc_id, one of them stays; where several equal rows have the largest, the least by text and other columns.
    """
    found = exact_dedup.exact_duplicates(docs).where("not kept")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_once")).distinct()
    found = base.Scratch(spark, "stage").table(found, "exact")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = docs.select(*COLUMNS, F.sha2(lower.cast("binary"), 256).alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha"))
    left = keyed.join(base.small_side(found), same, "left_anti").select(COLUMNS)
    repeated = found.where("_once")
    if repeated.isEmpty():
        return left
    return left.unionByName(_one_of(keyed.join(base.small_side(repeated), same, "left_semi"), "doc_id", "_text"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates. Texts without words are kept.

    Rows that share a doc_id, and rows without one, are documents of their own here, larger than all others; of those that are equal one stays.
    """
    scratch = base.Scratch(spark, "stage")
    shared = scratch.table(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "shared-ids")
    docs, own = docs.select(COLUMNS), F.col("doc_id")
    if not shared.isEmpty():
        docs = docs.join(base.small_side(shared.withColumn("_odd", F.lit(True))), docs["doc_id"].eqNullSafe(F.col("_id")), "left")
        own = F.when(F.col("_odd"), F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))).otherwise(own)
    keyed = docs.withColumn("_row", own)
    found = scratch.table(minhash_dedup.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("_row")).distinct(), "near")
    left = keyed.join(base.small_side(found), "_row", "left_anti")
    if shared.isEmpty():
        return left.select(COLUMNS)
    return left.where("_odd is null").select(COLUMNS).unionByName(_one_of(left.where("_odd"), "_row"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and their length counted anew. Null and empty texts stay as they are; repeated rows are treated alike."""
    done = secrets.redact(secrets.scan(docs.select(COLUMNS), secrets.train(docs)))
    n = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.select("doc_id", "text", "lang", "source", n.alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of all documents, counted in byte-level BPE tokens, with their bucket, batch and slot. An empty text is one sequence of no tokens; repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), token_files.token_count(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = base.Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
