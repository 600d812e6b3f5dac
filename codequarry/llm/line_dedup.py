"""Line dedup by winnowing, on DataFrame functions only.

A run of lines that occurred earlier, in the order of (doc_id, line number), is deleted where it occurs again if it has at least
``window`` lines, or is one line of at least ``words`` words.

A line is named by 124 bits of two hashes. Every window of ``window`` names selects its least one (the rightmost of equals), so each run of that length has a selected
line in it: the fingerprints. Lines of ``words`` words or more are fingerprints too. Fingerprints that occur once are dropped by a count with map-side
combine. The others are extended both ways to the windows around them, a window's first place is a minimum per content, again
combined map-side, and all its later places are deleted, so the copies of a line are never paired with each other.
Windows that follow one another extend a deletion to the whole repeated run.

Defined results: null text counts as empty (one empty line) and stays as it is; rows with a null doc_id are left alone; rows that agree in doc_id
and text are one document and are treated alike. Lines of a window's first place are not deleted for a later place that overlaps it.
A text whose lines are all deleted becomes empty. An empty table gives an empty result. Columns of other names pass through; ``dedup_lines`` adds ``clean``
and ``n_deleted`` and refuses input that has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, fresh_names, small_side

WINDOW, WORDS = 2, 50


def repeated_lines(docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """(doc_id, h, lines): numbers, from 0, of the lines to delete in the document with text hash ``h``."""
    scratch = Scratch(docs.sparkSession, "lines")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"),
        F.transform(split, _name).alias("hashes"), F.transform(split, lambda x: (F.length(x) >= 2 * words - 1) & (_words(x) >= words)).alias("long"),
    ).dropDuplicates(["doc_id", "h"])
    n = F.size("hashes")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))

    def least(i):
        part = F.slice("hashes", i + 1, window)
        return i + F.lit(window) - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

    single = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("long", i))
    picked = F.array_distinct(F.concat(F.transform(starts, least), single))
    around = F.slice("hashes", F.greatest(F.col("pos") - window + 2, F.lit(1)), F.lit(2 * window - 1) - F.greatest(F.lit(window - 1) - F.col("pos"), F.lit(0)))
    prints = rows.select("doc_id", "h", "hashes", "long", n.alias("n"), F.explode(picked).alias("pos"))
    prints = prints.select("doc_id", "h", "pos", "n", F.get("hashes", F.col("pos")).alias("line"), F.get("long", F.col("pos")).alias("alone"), around.alias("around"))
    prints = scratch.table(prints, "prints")
    often = scratch.table(prints.groupBy("line").count().where("count > 1").select("line"), "often")
    near = prints.join(small_side(often), "line")
    before = F.least(F.col("pos"), F.lit(window - 1))  # lines in `around` before the fingerprint
    first = F.greatest(F.col("pos") - window + 1, F.lit(0))
    last = F.least(F.col("pos"), F.col("n") - window)
    at = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda s: F.struct(s.alias("start"), F.slice("around", s - F.col("pos") + before + 1, window).alias("key")))
    windows = F.concat(windows, F.when(F.col("alone"), F.array(F.struct(F.col("pos").alias("start"), F.array("line").alias("key")))).otherwise(F.array().cast("array<struct<start:int,key:array<struct<h:bigint,check:bigint>>>>")))
    places = scratch.table(near.select("doc_id", "h", F.explode(windows).alias("w")).select("doc_id", "h", "w.start", "w.key").distinct(), "places")
    firsts = scratch.table(places.groupBy("key").agg(F.min(F.struct("doc_id", "h", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "firsts")
    later = places.join(firsts, "key").where(F.struct("doc_id", "h", "start") > F.col("first"))
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    begin = F.when(same, F.greatest(F.col("start"), F.col("first.start") + F.size("key"))).otherwise(F.col("start"))
    lines = later.select("doc_id", "h", F.explode(F.sequence(begin, F.col("start") + F.size("key") - 1)).alias("line"))
    return lines.groupBy("doc_id", "h").agg(F.collect_set("line").alias("lines"))


def _name(line):
    """What stands for a line: a 64-bit hash, and 60 bits of another digest, so that a clash of the one deletes nothing."""
    return F.struct(F.xxhash64(line).alias("h"), F.conv(F.substr(F.md5(line.cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long").alias("check"))


def _words(line):
    """Words of a line: gaps between non-spaces, counted."""
    return F.size(F.split(F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")), " "))


def dedup_lines(docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """``docs`` with ``clean``, the text without its repeated runs, and ``n_deleted``, the number of lines they had."""
    fresh_names(docs, "clean", "n_deleted", "_id", "_h", "_lines", "_split")
    gone = Scratch(docs.sparkSession, "lines").table(repeated_lines(docs, window, words), "gone").toDF("_id", "_h", "_lines")
    split = docs.withColumn("_split", F.split(F.coalesce("text", F.lit("")), "\n", -1))  # before the join, so that it is done once a text
    out = split.join(small_side(gone), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "_lines")
    clean = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_split", i)), "\n"))
    return out.select(*docs.columns, clean.alias("clean"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_deleted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of lines deleted from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select(
        "doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.greatest("n_deleted", F.lit(0)).alias("n_deleted"),
        F.length(F.coalesce("clean", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("clean", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


#: Every window, without winnowing: a window's first place, and the lines of its later places.
OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
w AS (SELECT a.doc_id, a.i AS start, 2 AS size, a.line || chr(10) || b.line AS key FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i = a.i + 1
      UNION ALL
      SELECT doc_id, i, 1, line FROM l WHERE length(line) - length(replace(line, ' ', '')) >= 20 AND len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) >= 50),
f AS (SELECT *, min({'doc_id': doc_id, 'start': start}) OVER (PARTITION BY size, key) AS p FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = p.doc_id THEN greatest(start, p.start + size) ELSE start END, start + size)) AS i
      FROM f WHERE {'doc_id': doc_id, 'start': start} > p),
k AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i),
c AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS clean FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_deleted, length(clean) AS n_chars, sha256(clean) AS clean_sha256 FROM c
"""
