"""Adapters: the relations of the engine (files, statements, callables, sequences, snapshots, paths, owners) over the test tables.

They are a test harness for the operators, not operators themselves. Each reads a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
CONNECTORS = ("and", "or", "et", "ou", "und", "oder", "y", "o")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeeze(text):
    """Text with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def path_of(prefix=""):
    return F.concat(F.lit(prefix), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, language, text): documents as files."""
    return table(spark, sf_dir, "documents").select("doc_id", path_of().alias("path"), F.col("lang").alias("language"), "text")


def with_lines(df: DataFrame) -> DataFrame:
    """``df(text, ...)`` with ``lines``: array of (line, token) of the non-blank lines, numbered from 1 in the text."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("line"), squeeze(x).alias("token")))
    return df.withColumn("lines", F.filter(numbered, lambda x: x["token"] != ""))


def statements(df: DataFrame) -> DataFrame:
    """One row per non-blank line of ``df``: its columns without text, ix (from 1 in the file), line and token."""
    keep = [c for c in df.columns if c != "text"]
    out = with_lines(df).select(*keep, F.posexplode("lines").alias("ix", "s"))
    return out.select(*keep, (F.col("ix") + 1).cast("long").alias("ix"), F.col("s.line").alias("line"), F.col("s.token").alias("token"))


def decisions(token):
    """Number of connector words in squeezed text."""
    return F.size(F.filter(F.split(token, " ", -1), lambda w: F.lower(w).isin(*CONNECTORS))).cast("long")


def callables(df: DataFrame) -> DataFrame:
    """One callable per file: cc = 1 + connector words, sloc = non-blank lines."""
    keep = [c for c in df.columns if c != "text"]
    return with_lines(df).select(*keep, (decisions(squeeze(F.col("text"))) + 1).alias("cc"), F.size("lines").cast("long").alias("sloc"))


def orders_as_callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One callable per order: sloc = its lines, cc = 1 + returned lines + lines of a discount over 0.05."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("sloc"), (1 + F.count_if(F.col("l_returnflag") == "R") + F.count_if(F.col("l_discount") > 0.05)).alias("cc")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("language"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), "language", "cc", "sloc")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, ix, event_id, kind, second): events of a user's day in order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    at = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.row_number().over(at).cast("long").alias("ix"), "event_id", F.col("event_type").alias("kind"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))).cast("long").alias("second"),
    )


def snapshot(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(doc_id, path, language, text, oid): the base or the candidate tree.

    The candidate lacks src3 and has src7 new; src11 moved; French files grew by a line twice; src13 lost its first line; every line of src5 but the last changed;
    of src9, src10 and src12 only the first is left.
    """
    d = table(spark, sf_dir, "documents")
    if side == "base":
        d = d.where("source <> 'src7'").select("doc_id", path_of().alias("path"), F.col("lang").alias("language"), "text")
    else:
        text = F.when(F.col("source") == "src13", F.regexp_replace("text", "^[^\\n]*\\n", "")).otherwise(F.col("text"))
        text = F.when(F.col("source") == "src5", F.regexp_replace("text", "\n", " neu\n")).otherwise(text)
        text = F.when(F.col("source").isin("src9", "src10", "src12"), F.substring_index("text", "\n", 1)).otherwise(text)
        text = F.when(F.col("lang") == "fr", F.concat(text, F.lit("\nEt ou et ou et\nEt ou et ou et"))).otherwise(text)
        path = F.when(F.col("source") == "src11", path_of("moved/")).otherwise(path_of())
        d = d.where("source <> 'src3'").select("doc_id", path.alias("path"), F.col("lang").alias("language"), text.alias("text"))
    return d.withColumn("oid", F.sha2(F.col("text").cast("binary"), 256))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): page addresses as file paths, with an extension by the language segment."""
    at = F.regexp_replace(F.regexp_extract("url", "^https?://([^?#]*)", 1), "/$", "")
    lang = F.regexp_extract("url", "^https?://[^/]*/([a-z]{2})/", 1)
    ext = F.when(at.endswith(".html"), F.lit("")).when(lang == "en", F.lit(".java")).when(lang == "fr", F.lit(".ts")).when(lang == "de", F.lit(".rs")).otherwise(F.lit(".mjs"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(at, ext).alias("path"))


#: The same adapters in DuckDB SQL, as common table expressions.
SQL = {
    "files": "files AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, lang AS language, text FROM documents)",
    "base": "base AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, lang AS language, text, sha256(text) AS oid FROM documents WHERE source <> 'src7')",
    "cand": r"""cand0 AS (SELECT doc_id, CASE WHEN source = 'src11' THEN 'moved/' ELSE '' END || source || '/' || doc_id || '.' || lang AS path, lang AS language,
      (CASE WHEN source = 'src13' THEN regexp_replace(text, '^[^\n]*\n', '') WHEN source IN ('src9', 'src10', 'src12') THEN split_part(text, chr(10), 1) WHEN source = 'src5' THEN replace(text, chr(10), ' neu' || chr(10)) ELSE text END)
      || CASE WHEN lang = 'fr' THEN chr(10) || 'Et ou et ou et' || chr(10) || 'Et ou et ou et' ELSE '' END AS text
      FROM documents WHERE source <> 'src3'), cand AS (SELECT *, sha256(text) AS oid FROM cand0)""",
    "sequences": """sequences AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS ix, event_id,
      event_type AS kind, (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))::BIGINT AS second FROM events)""",
    "paths": r"""paths AS (SELECT page_id, p || CASE WHEN ends_with(p, '.html') THEN '' WHEN l = 'en' THEN '.java' WHEN l = 'fr' THEN '.ts' WHEN l = 'de' THEN '.rs' ELSE '.mjs' END AS path
      FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/$', '') AS p, regexp_extract(url, '^https?://[^/]*/([a-z]{2})/', 1) AS l FROM pages))""",
    "orders": """orders_c AS (SELECT l_orderkey AS id, o_orderpriority AS language, count(*) AS sloc, 1 + count_if(l_returnflag = 'R')::BIGINT + count_if(l_discount > 0.05)::BIGINT AS cc
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
}


def squeeze_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def statements_sql(source: str, name: str) -> str:
    """CTE ``name``: statements of CTE ``source``."""
    return f"""{name} AS (SELECT doc_id, path, language, row_number() OVER (PARTITION BY path ORDER BY line) AS ix, line::BIGINT AS line, token
      FROM (SELECT doc_id, path, language, line, {squeeze_sql('l')} AS token FROM (SELECT doc_id, path, language, unnest(string_split(text, chr(10))) AS l,
      generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {source})) WHERE token <> '')"""


def callables_sql(source: str, name: str) -> str:
    words = ", ".join(f"'{w}'" for w in CONNECTORS)
    return f"""{name} AS (SELECT doc_id, path, language, (1 + len(list_filter(string_split({squeeze_sql('text')}, ' '), lambda w: lower(w) IN ({words}))))::BIGINT AS cc,
      len(list_filter(string_split(text, chr(10)), lambda l: {squeeze_sql('l')} <> ''))::BIGINT AS sloc FROM {source})"""
