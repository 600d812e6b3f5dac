"""Queries of the engine's own operators over the test tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clones, lines, matching, metrics, policy, rules
from ..sources import discovery
from . import adapters as A
from .scratch import cut

LANGS = ["de", "en", "es", "fr"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GLOBS = {"user_exclude": ["m.*"], "generated_code": ["blog.*"], "dependency_or_build_output": ["*.net"], "test": ["**/9*"]}
REASONS = ["gitignore", "dependency_or_build_output", "generated_code", "test", "user_exclude", "nested_checkout", "unreadable"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Registers a query under its function's name, with its SQL over the named adapter expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


FILES, BASE, CAND, SEQ, PATHS, ORDERS = (A.SQL[k] for k in ("files", "base", "cand", "sequences", "paths", "orders"))
ST = A.statements_sql("files", "st")
CALL = A.callables_sql("files", "calls")
FAMILIES = "fam AS (SELECT unnest(['overall', 'de', 'en', 'es', 'fr']) AS family)"


# metrics


@query("SELECT path, count(DISTINCT line) AS sloc FROM st GROUP BY path", (FILES, ST))
def sloc_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.statements(A.files(spark, sf_dir)).groupBy("path").agg(F.count_distinct("line").alias("sloc"))


@query("SELECT path, list(line ORDER BY line) AS lines FROM st GROUP BY path", (FILES, ST))
def exec_line_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.with_lines(A.files(spark, sf_dir)).select("path", F.transform("lines", lambda x: x["line"]).alias("lines"))
    return out.where(F.size("lines") > 0)


@query("SELECT path, cc, sloc, round(cc * sqrt(sloc), 6) AS mass FROM calls", (FILES, CALL))
def callable_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_mass(A.callables(A.files(spark, sf_dir))).select("path", "cc", "sloc", F.round("mass", 6).alias("mass"))


EROSION = """SELECT family, round(CASE WHEN coalesce(sum(cc * sqrt(sloc)), 0) = 0 THEN 0.0
  ELSE sum(CASE WHEN cc > 10 THEN cc * sqrt(sloc) ELSE 0.0 END) / sum(cc * sqrt(sloc)) END, 6) AS erosion
FROM {fam} fam LEFT JOIN {calls} c ON fam.family = 'overall' OR fam.family = c.language GROUP BY family"""


@query(EROSION.format(fam="fam", calls="calls"), (FILES, CALL, FAMILIES))
def erosion_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.erosion(A.callables(A.files(spark, sf_dir)), LANGS)


@query(EROSION.format(fam="fam", calls="orders_c"), (ORDERS, f"fam AS (SELECT unnest({['overall', *PRIORITIES]}) AS family)"))
def erosion_orders_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.erosion(A.orders_as_callables(spark, sf_dir), PRIORITIES)


@query("SELECT path, cc, sloc, round(cc * sqrt(sloc), 6) AS mass FROM calls ORDER BY cc DESC, path LIMIT 25", (FILES, CALL))
def top25_callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_callables(A.callables(A.files(spark, sf_dir))).select("path", "cc", "sloc", F.round("mass", 6).alias("mass"))


@query("""SELECT language, path, cc, place, greatest(n - 10, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY cc DESC, path) AS place,
count(*) OVER (PARTITION BY language) AS n FROM calls) WHERE place <= 10""", (FILES, CALL))
def capped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.callables(A.files(spark, sf_dir)).select("language", "path", "cc")
    return metrics.capped_listing(rows, "language", [F.desc("cc"), "path"], 10).select("language", "path", "cc", "place", "omitted")


@query("SELECT path, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END::BIGINT AS lines FROM files", (FILES,))
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.files(spark, sf_dir).select("path", X.line_count(F.col("text")).alias("lines"))


# duplicates


@query("SELECT path, language, count(*) AS n FROM st GROUP BY 1, 2 HAVING count(*) >= 2", (FILES, ST))
def clone_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.containers(A.statements(A.files(spark, sf_dir)))


@query("SELECT path, count(*) AS n, sha256(string_agg(token, chr(1) ORDER BY ix)) AS digest FROM st GROUP BY path", (FILES, ST))
def statement_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.token_streams(A.with_lines(A.files(spark, sf_dir))).where("n > 0")


RUNS = (
    FILES, ST,
    "pr AS (SELECT path, language, ix, token || chr(1) || lead(token) OVER (PARTITION BY path ORDER BY ix) AS pair FROM st)",
    "hit AS (SELECT path, ix FROM pr WHERE pair IS NOT NULL AND (language, pair) IN (SELECT (language, pair) FROM pr WHERE pair IS NOT NULL GROUP BY language, pair HAVING count(*) >= 2))",
    "isl AS (SELECT path, min(ix) AS lo, max(ix) AS hi FROM (SELECT path, ix, ix - row_number() OVER (PARTITION BY path ORDER BY ix) AS g FROM hit) GROUP BY path, g)",
    "fl AS (SELECT path, language, list(token ORDER BY ix) AS tokens, list(line ORDER BY ix) AS ats FROM st GROUP BY 1, 2)",
    "ab AS (SELECT path, a, unnest(range(a + 1, hi + 2)) AS b FROM (SELECT path, unnest(range(lo, hi + 1)) AS a, hi FROM isl))",
    """cd AS (SELECT sha256('language:' || language || chr(1) || array_to_string(tokens[a:b], chr(1))) AS key, language, path, a AS first, ats[a] AS start, ats[b] AS end_, b - a + 1 AS n
    FROM ab JOIN fl USING (path) WHERE b - a + 1 >= 3)""",
    "mem AS (SELECT *, count(*) OVER (PARTITION BY key) AS members FROM cd QUALIFY members >= 2)",
    """mx AS (SELECT * FROM mem WHERE key NOT IN (SELECT ka FROM (SELECT a.key AS ka, b.key AS kb, a.members AS ma, count(DISTINCT (a.path, a.start)) AS c
    FROM mem a JOIN mem b ON a.path = b.path AND b.n > a.n AND b.start <= a.start AND a.end_ <= b.end_ GROUP BY 1, 2, 3) WHERE c = ma))""",
)


def _candidates(spark, sf_dir):
    return clones.candidates(A.with_lines(A.files(spark, sf_dir)))


def _maximal(spark, sf_dir, named=True):
    return clones.maximal_runs(A.with_lines(A.files(spark, sf_dir)), named=named)


def _members(spark, sf_dir):
    return clones.maximal_members(A.with_lines(A.files(spark, sf_dir)))


@query('SELECT key, language, path, first, start, end_ AS "end", n FROM cd', RUNS)
def clone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).drop("lines")


@query('SELECT key, language, path, first, start, end_ AS "end", n, members FROM mem', RUNS)
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.groups(_candidates(spark, sf_dir)).drop("lines")


@query('SELECT key, language, path, first, start, end_ AS "end", n, members FROM mx', RUNS)
def clone_maximal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maximal(spark, sf_dir).drop("lines")


@query("""SELECT key, language, count(*) AS members, max(n) AS statements, (sum(n) - arg_min(n, (path, start)))::BIGINT AS redundant_lines,
min(path) AS path, arg_min(start, (path, start)) AS start FROM mx GROUP BY key, language""", RUNS)
def clone_redundant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.redundancy(_maximal(spark, sf_dir)).orderBy(F.desc("redundant_lines"), "path", "start")


FLAG = RUNS + (
    "rep AS (SELECT path, language, line FROM (SELECT *, lag(token) OVER (PARTITION BY path ORDER BY ix) AS prev FROM st) WHERE token = prev)",
    """fg AS (SELECT language, path, line FROM rep UNION SELECT language, path, unnest(ats[first:first + n - 1]) FROM
    (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path, start) AS r FROM mx) JOIN (SELECT path, ats FROM fl) USING (path) WHERE r > 1)""",
    FAMILIES,
)


def _repeated(spark, sf_dir):
    """Findings: a statement equal to the one before."""
    return _repeats(A.files(spark, sf_dir))


def _repeats(files):
    """(path, language, ix, line, token) of the statements equal to the one before them, found inside each file's row: no text is shuffled."""
    same = lambda x, i: F.when(x["token"] == F.get("lines", i - 1)["token"], F.struct((i + 1).cast("long").alias("ix"), x["line"].alias("line"), x["token"].alias("token")))
    each = F.filter(F.transform("lines", same), lambda x: x.isNotNull())
    return A.with_lines(files).select("path", "language", F.explode(each).alias("s")).select("path", "language", "s.ix", "s.line", "s.token")


@query("""SELECT family, coalesce(flagged_lines, 0)::BIGINT AS flagged_lines, coalesce(scanned_lines, 0)::BIGINT AS scanned_lines,
round(CASE WHEN coalesce(scanned_lines, 0) = 0 THEN 0.0 ELSE coalesce(flagged_lines, 0) / scanned_lines END, 6) AS ratio, coalesce(complete, true) AS complete
FROM fam LEFT JOIN (SELECT coalesce(language, 'overall') AS family, sum(sloc) AS scanned_lines, bool_and(length(text) <= 1048576) AS complete FROM calls JOIN (SELECT doc_id, text FROM documents) USING (doc_id)
  GROUP BY GROUPING SETS ((language), ())) USING (family)
LEFT JOIN (SELECT coalesce(language, 'overall') AS family, count(*) AS flagged_lines FROM fg GROUP BY GROUPING SETS ((language), ())) USING (family)""", FLAG + (CALL,))
def verbosity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = A.with_lines(A.files(spark, sf_dir)).select("language", F.size("lines").alias("lines"), (F.length("text") > 1 << 20).alias("failed"))
    flagged = _repeated(spark, sf_dir).select("language", "path", "line").union(clones.redundant_lines(_maximal(spark, sf_dir, False))).distinct()
    return metrics.verbosity(scanned, flagged, LANGS)


# discovery

LANG_SQL = r"regexp_extract(path, '(?:^|/)[^/]+\.([^./]+)$', 1)"


@query(f"SELECT page_id, path, {LANG_SQL} AS extension, CASE WHEN {LANG_SQL} = 'java' THEN 'java' WHEN {LANG_SQL} IN ('js','jsx','mjs','cjs','ts','tsx') THEN 'js_ts' WHEN {LANG_SQL} = 'rs' THEN 'rust' END AS language FROM paths", (PATHS,))
def language_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return A.paths(spark, sf_dir).select("page_id", "path", discovery.extension(path).alias("extension"), discovery.language(path).alias("language"))


REASON_SQL = r"""rs AS (SELECT page_id, path, CASE WHEN regexp_matches(path, '^m\.[^/]*(/.*)?$') THEN 'user_exclude' WHEN regexp_matches(path, '^blog\.[^/]*(/.*)?$') THEN 'generated_code'
WHEN regexp_matches(path, '^[^/]*\.net(/.*)?$') THEN 'dependency_or_build_output' WHEN regexp_matches(path, '^(.*/)?9[^/]*(/.*)?$') THEN 'test' END AS reason FROM paths)"""


def _skips(spark, sf_dir):
    return A.paths(spark, sf_dir).withColumn("reason", discovery.skip_reason(F.col("path"), GLOBS))


@query("SELECT * FROM rs", (PATHS, REASON_SQL))
def skip_reason_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skips(spark, sf_dir)


@query(f"SELECT label, count(reason) AS n FROM (SELECT unnest({REASONS}) AS label) LEFT JOIN rs ON label = reason GROUP BY label", (PATHS, REASON_SQL))
def skip_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.zero_filled_counts(_skips(spark, sf_dir), "reason", REASONS)


@query(r"""SELECT page_id, path, CASE WHEN regexp_matches(path, '^blog\.the[^/]*(/.*)?$') THEN false WHEN regexp_matches(path, '^(.*/)?[^/]*\.mjs(/.*)?$') THEN true
WHEN regexp_matches(path, '^blog\.[^/]*(/.*)?$') THEN true ELSE false END AS ignored FROM paths""", (PATHS,))
def ignore_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.ignored(A.paths(spark, sf_dir), [("blog.*", False), ("**/*.mjs", False), ("blog.the*", True)])


@query(r"""SELECT p.path, NULL::VARCHAR AS reason FROM (SELECT DISTINCT path FROM paths) p WHERE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) NOT IN (SELECT prefix FROM roots)
UNION ALL SELECT DISTINCT prefix, 'nested_checkout' FROM roots""",
(PATHS, r"roots AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS prefix FROM paths WHERE path LIKE '%.org/%/7%' AND len(string_split(path, '/')) > 2)"))
def nested_prefix_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.paths(spark, sf_dir).select("path").distinct()
    parts = F.split("path", "/")
    roots = p.where(F.col("path").like("%.org/%/7%") & (F.size(parts) > 2)).select(F.array_join(F.slice(parts, 1, 2), "/").alias("prefix")).distinct()
    return discovery.prune_nested(p, roots)


@query("SELECT path, octet_length(encode(text)) AS size, CASE WHEN octet_length(encode(text)) > 4096 THEN NULL ELSE sha256(text) END AS oid FROM files", (FILES,))
def size_ceiling_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return A.files(spark, sf_dir).select("path", size.cast("long").alias("size"), F.when(size <= 4096, F.sha2(F.col("text").cast("binary"), 256)).alias("oid"))


@query("""SELECT folder, reason, n, sum(n) OVER (PARTITION BY folder)::BIGINT AS total, row_number() OVER (PARTITION BY folder ORDER BY n DESC, reason) AS place
FROM (SELECT folder, reason, count(*) AS n FROM (SELECT reason, unnest(list_transform(range(1, greatest(len(s) - 1, 1) + 1), lambda k: array_to_string(s[1:k], '/'))) AS folder
FROM (SELECT reason, string_split(path, '/') AS s FROM rs WHERE reason IS NOT NULL)) GROUP BY 1, 2)""", (PATHS, REASON_SQL))
def skipped_folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.folder_rollup(_skips(spark, sf_dir).where("reason is not null"))


@query("""SELECT s.folder, CASE WHEN a.above IS NULL THEN s.folder ELSE s.folder[len(a.above) + 2:] END AS name, s.total FROM sh s
LEFT JOIN (SELECT s.folder, arg_max(t.folder, len(t.folder)) AS above FROM sh s JOIN sh t ON starts_with(s.folder, t.folder || '/') GROUP BY 1) a USING (folder)""", (PATHS, REASON_SQL,
    "sk AS (SELECT string_split(path, '/') AS s FROM rs WHERE reason IS NOT NULL)",
    "fo AS (SELECT folder, count(*) AS total FROM (SELECT unnest(list_transform(range(1, len(s)), lambda k: array_to_string(s[1:k], '/'))) AS folder FROM sk) GROUP BY 1)",
    """sh AS (SELECT folder, total FROM fo WHERE folder IN (SELECT array_to_string(s[1:len(s) - 1], '/') FROM sk WHERE len(s) > 1)
    OR (SELECT count(*) FROM fo g WHERE regexp_replace(g.folder, '/[^/]*$', '') = fo.folder AND g.folder <> fo.folder) <> 1)""",
))
def skipped_folders_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.merged_folders(_skips(spark, sf_dir).where("reason is not null"))


# rules over sequences

DAY = ["user_id", "day"]
STOP = ["purchase", "error"]


@query("""SELECT user_id, day, min(ix) AS start, max(ix) AS "end", count(*) AS flagged FROM (SELECT *, min(CASE WHEN kind IN ('purchase', 'error') THEN ix END) OVER (PARTITION BY user_id, day) AS stop FROM sequences)
WHERE ix > stop AND kind <> 'signup' GROUP BY 1, 2""", (SEQ,))
def unreachable_after_terminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unreachable(A.sequences(spark, sf_dir), DAY, STOP, ["signup"])


@query("SELECT user_id, day FROM sequences GROUP BY 1, 2 HAVING count_if(kind IN ('click', 'view')) = 0", (SEQ,))
def empty_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.empty(A.sequences(spark, sf_dir), DAY, ["click", "view"])


@query("""SELECT user_id, day, max(CASE WHEN ix = 3 THEN event_id END) AS flagged FROM sequences GROUP BY 1, 2
HAVING count(*) = 3 AND max(CASE WHEN ix = 2 THEN kind END) IN ('purchase', 'error')""", (SEQ,))
def redundant_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.redundant_alternative(A.sequences(spark, sf_dir), DAY, STOP)


@query("SELECT rule, count(*) AS n, min(event_id) AS first_event FROM (SELECT CASE kind WHEN 'error' THEN 'R-ERROR' WHEN 'purchase' THEN 'R-PURCHASE' END AS rule, event_id FROM sequences) WHERE rule IS NOT NULL GROUP BY rule", (SEQ,))
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame([("error", "R-ERROR"), ("purchase", "R-PURCHASE")], "kind string, rule string")
    return A.sequences(spark, sf_dir).join(F.broadcast(catalog), "kind").groupBy("rule").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


SPANS = """spans AS (SELECT DISTINCT user_id, day, s * (second // s) AS start, s * (second // s) + s - 1 AS end_ FROM sequences, (SELECT unnest([86400, 21600, 3600]) AS s))"""


def _spans(spark, sf_dir):
    """Nested spans of a user's day: the day, its quarters and its hours that hold an event."""
    s = A.sequences(spark, sf_dir).select("user_id", "day", "second", F.explode(F.array(F.lit(86400), F.lit(21600), F.lit(3600))).alias("s"))
    start = (F.col("s") * F.floor(F.col("second") / F.col("s"))).cast("long")
    return s.select("user_id", "day", start.alias("start"), (start + F.col("s") - 1).cast("long").alias("end")).distinct()


@query("""SELECT event_id, start, end_ AS "end" FROM (SELECT event_id, start, end_, row_number() OVER (PARTITION BY event_id ORDER BY start DESC, end_) AS r FROM sequences JOIN spans USING (user_id, day)
WHERE kind = 'error' AND start <= second AND second <= end_) WHERE r = 1""", (SEQ, SPANS))
def innermost_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.sequences(spark, sf_dir).where("kind = 'error'").select("user_id", "day", "event_id", "second")
    return rules.innermost(points, _spans(spark, sf_dir), DAY, "event_id", "second")


@query("""SELECT user_id, day, start, end_ AS "end" FROM spans a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id, day, 3600 * (second // 3600) AS ds, 3600 * (second // 3600) + 3599 AS de FROM sequences WHERE kind = 'error') d
WHERE d.user_id = a.user_id AND d.day = a.day AND ds <= start AND end_ <= de)""", (SEQ, SPANS))
def exclusion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = (3600 * F.floor(F.col("second") / 3600)).cast("long")
    dirty = A.sequences(spark, sf_dir).where("kind = 'error'").select("user_id", "day", hour.alias("start"), (hour + 3599).alias("end")).distinct()
    return rules.excluded(_spans(spark, sf_dir), dirty, DAY)


@query("""SELECT user_id, day, min(start) AS start, max(e) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id, day ORDER BY start, e, event_id) AS g FROM (
SELECT user_id, day, event_id, second AS start, second + 7200 AS e, CASE WHEN max(second + 7200) OVER (PARTITION BY user_id, day ORDER BY second, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= second THEN 0 ELSE 1 END AS fresh FROM sequences)) GROUP BY user_id, day, g""", (SEQ,))
def gap_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sequences(spark, sf_dir).select("user_id", "day", F.col("second").alias("start"), (F.col("second") + 7200).alias("end"))
    return rules.islands(s, DAY)


@query("""SELECT c_custkey, sha256(n.d || length(c_name) || ':' || c_name) AS digest FROM customer JOIN (SELECT n_nationkey, sha256(r.d || length(n_name) || ':' || n_name) AS d
FROM nation JOIN (SELECT r_regionkey, sha256(length(r_name) || ':' || r_name) AS d FROM region) r ON n_regionkey = r_regionkey) n ON c_nationkey = n_nationkey""")
def owner_chain_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda parent, name: F.sha2(F.concat(parent, F.length(name).cast("string"), F.lit(":"), F.col(name)).cast("binary"), 256)
    r = A.table(spark, sf_dir, "region").select("r_regionkey", frame(F.lit(""), "r_name").alias("rd"))
    n = A.table(spark, sf_dir, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", frame(F.col("rd"), "n_name").alias("nd"))  # fixed small dimensions
    return A.table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", frame(F.col("nd"), "c_name").alias("digest"))


# snapshots

DIFF = (BASE, CAND, """df AS (SELECT coalesce(b.path, c.path) AS path, CASE WHEN b.oid IS NULL THEN 'added' WHEN c.oid IS NULL THEN 'deleted' ELSE 'modified' END AS status, b.oid AS base_oid, c.oid AS oid
FROM base b FULL JOIN cand c ON b.path = c.path WHERE b.oid IS DISTINCT FROM c.oid)""")
REN = DIFF + ("""rn AS (SELECT g.path AS from_path, n.path, g.oid FROM (SELECT path, base_oid AS oid, row_number() OVER (PARTITION BY base_oid ORDER BY path) AS k FROM df WHERE status = 'deleted') g
JOIN (SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS k FROM df WHERE status = 'added') n USING (oid, k))""",)


def _sides(spark, sf_dir):
    return A.snapshot(spark, sf_dir, "base"), A.snapshot(spark, sf_dir, "cand")


def _renames(spark, sf_dir):
    return matching.exact_renames(matching.tree_diff(*_sides(spark, sf_dir)))


@query("SELECT * FROM df", DIFF)
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.tree_diff(*_sides(spark, sf_dir))


@query("SELECT * FROM rn", REN)
def exact_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renames(spark, sf_dir)


@query("""SELECT sha256(string_agg(digest, '' ORDER BY bucket)) AS snapshot_id FROM (SELECT sha256(path)[1:3] AS bucket,
sha256(string_agg(octet_length(encode(path)) || ':' || path || ' ' || oid, chr(10) ORDER BY path)) AS digest FROM base GROUP BY 1)""", (BASE,))
def snapshot_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.snapshot_id(A.snapshot(spark, sf_dir, "base").select("path", "oid"))


@query("""SELECT c.path, b.path AS base_path, c.oid, b.oid AS base_oid FROM cand c LEFT JOIN rn ON rn.path = c.path LEFT JOIN base b ON b.path = coalesce(rn.from_path, c.path)
WHERE b.oid IS DISTINCT FROM c.oid""", REN)
def entities_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, cand = _sides(spark, sf_dir)
    return matching.changed_entities(base, cand, _renames(spark, sf_dir))


IDS = REN + (
    A.statements_sql("base", "bs"), A.statements_sql("cand", "cs"),
    "bi AS (SELECT path, ix, lower(split_part(token, ' ', 1)) AS name, sha256(token) AS fp FROM bs)", "ci AS (SELECT path, ix, lower(split_part(token, ' ', 1)) AS name, sha256(token) AS fp FROM cs)",
)


def _tier_sql(b: str, c: str, out: str) -> tuple[str, ...]:
    """CTEs of a tier over ``b``/``c`` (file, path, ix, name, fp)."""
    k = "row_number() OVER (PARTITION BY file, name, fp ORDER BY ix) AS k"
    p = "row_number() OVER (PARTITION BY file, name ORDER BY ix) AS k"
    return (
        f"{out}e AS (SELECT b.path AS base_path, b.ix AS base_ix, c.path, c.ix FROM (SELECT *, {k} FROM {b}) b JOIN (SELECT *, {k} FROM {c}) c USING (file, name, fp, k))",
        f"""{out}p AS (SELECT b.path AS base_path, b.ix AS base_ix, c.path, c.ix FROM (SELECT *, {p} FROM {b} WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM {out}e)) b
        JOIN (SELECT *, {p} FROM {c} WHERE (path, ix) NOT IN (SELECT (path, ix) FROM {out}e)) c USING (file, name, k))""",
        f"{out} AS (SELECT *, 'fingerprint_exact' AS pairing FROM {out}e UNION ALL SELECT *, 'positional' FROM {out}p)",
    )


T1 = IDS + ("b1 AS (SELECT *, path AS file FROM bi)", "c1 AS (SELECT *, path AS file FROM ci)") + _tier_sql("b1", "c1", "t1")
LEFT1 = T1 + ("bl AS (SELECT * FROM bi WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM t1))", "cl AS (SELECT * FROM ci WHERE (path, ix) NOT IN (SELECT (path, ix) FROM t1))")
T2 = LEFT1 + ("b2 AS (SELECT bl.*, rn.path AS file FROM bl JOIN rn ON bl.path = rn.from_path)", "c2 AS (SELECT *, path AS file FROM cl)") + _tier_sql("b2", "c2", "t2")
T3 = T2 + (
    "b3 AS (SELECT fp, count(*) AS nb, min(path) AS bp, arg_min(ix, (path, ix)) AS bx FROM bl WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM t2) GROUP BY fp)",
    "c3 AS (SELECT fp, count(*) AS nc, min(path) AS cp, arg_min(ix, (path, ix)) AS cx FROM cl WHERE (path, ix) NOT IN (SELECT (path, ix) FROM t2) GROUP BY fp)",
    "j3 AS (SELECT fp, coalesce(nb, 0) AS nb, coalesce(nc, 0) AS nc, bp, bx, cp, cx FROM b3 FULL JOIN c3 USING (fp))",
)


def _identities(files: DataFrame) -> DataFrame:
    return A.statements(files).select("path", "ix", F.lower(F.split_part("token", F.lit(" "), F.lit(1))).alias("name"), F.sha2(F.col("token").cast("binary"), 256).alias("fp"))


def _matched(spark, sf_dir):
    b, c = (_identities(x) for x in _sides(spark, sf_dir))
    one = matching.same_file(b, c)
    return b, c, one


@query("SELECT base_path, base_ix, path, ix, pairing FROM t1", T1)
def match_tier1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[2].select("base_path", "base_ix", "path", "ix", "pairing")


@query("SELECT path, count(*) AS n FROM t1 WHERE pairing = 'positional' GROUP BY path", T1)
def positional_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[2].where("pairing = 'positional'").groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT base_path, base_ix, path, ix, pairing FROM t2", T2)
def match_tier2_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c, one = _matched(spark, sf_dir)
    return matching.through_renames(b, c, one, _renames(spark, sf_dir)).select("base_path", "base_ix", "path", "ix", "pairing")


def _third(spark, sf_dir):
    b, c, one = _matched(spark, sf_dir)
    two = matching.through_renames(b, c, one, _renames(spark, sf_dir))
    return matching.by_fingerprint(b, c, one.unionByName(two))


@query("SELECT bp AS base_path, bx AS base_ix, cp AS path, cx AS ix FROM j3 WHERE nb = 1 AND nc = 1", T3)
def match_tier3_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _third(spark, sf_dir)[0]


@query("SELECT fp, nb, nc FROM j3 WHERE nb > 1 OR nc > 1", T3)
def match_ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _third(spark, sf_dir)[1]


#: Back from the candidate to the base, as only then unmatched lines of other files equal leftovers of a changed one.
BACK = tuple(x.replace("base AS (", "older AS (").replace("cand AS (", "newer AS (") for x in (BASE, CAND)) + ("base AS (SELECT * FROM newer)", "cand AS (SELECT * FROM older)")
DISPLACED = BACK + tuple(x for x in T2 if x not in (BASE, CAND)) + (
    """gb AS (SELECT 1 AS tier, file, name, path, ix, fp FROM b1 WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM t1e)
    UNION ALL SELECT 2, file, name, path, ix, fp FROM b2 WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM t2e))""",
    """gc AS (SELECT 1 AS tier, file, name, path, ix, fp FROM c1 WHERE (path, ix) NOT IN (SELECT (path, ix) FROM t1e)
    UNION ALL SELECT 2, file, name, path, ix, fp FROM c2 WHERE (path, ix) NOT IN (SELECT (path, ix) FROM t2e))""",
    "ds AS (SELECT gc.* FROM gc JOIN (SELECT tier, file, name, count(*) AS nb FROM gb GROUP BY ALL) USING (tier, file, name) JOIN (SELECT tier, file, name, count(*) AS nc FROM gc GROUP BY ALL) USING (tier, file, name) "
    "WHERE nb + nc > 2 AND fp IN (SELECT fp FROM bl WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM t2)))",
    "tg AS (SELECT DISTINCT tier, file, name FROM ds)",
    """pd AS (SELECT * FROM (SELECT 1 AS tier, * FROM t1 UNION ALL SELECT 2, * FROM t2) WHERE pairing = 'fingerprint_exact' OR (tier, path, ix) NOT IN (SELECT (tier, path, ix) FROM gc JOIN tg USING (tier, file, name))
    UNION ALL SELECT tier, b.path, b.ix, c.path, c.ix, 'positional' FROM (SELECT *, row_number() OVER (PARTITION BY tier, file, name ORDER BY ix) AS k FROM gb JOIN tg USING (tier, file, name)) b
    JOIN (SELECT *, row_number() OVER (PARTITION BY tier, file, name ORDER BY ix) AS k FROM gc JOIN tg USING (tier, file, name) WHERE (tier, path, ix) NOT IN (SELECT (tier, path, ix) FROM ds)) c USING (tier, file, name, k))""",
)


def _displaced(spark, sf_dir):
    older, newer = _sides(spark, sf_dir)
    renames = cut(matching.exact_renames(matching.tree_diff(newer, older)))
    b, c = (cut(_identities(x)) for x in (newer, older))
    one = cut(matching.same_file(b, c))
    return b, c, matching.displaced(b, c, one, cut(matching.through_renames(b, c, one, renames)), renames)


@query("SELECT tier, base_path, base_ix, path, ix, pairing FROM pd", DISPLACED)
def match_displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tiers one and two after displacement, from the candidate back to the base."""
    return _displaced(spark, sf_dir)[2]


@query("""SELECT b.path AS base_path, b.ix AS base_ix, c.path, c.ix FROM (SELECT fp, min(path) AS path, min(ix) AS ix FROM bi WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM pd) GROUP BY fp HAVING count(*) = 1) b
JOIN (SELECT fp, min(path) AS path, min(ix) AS ix FROM ci WHERE (path, ix) NOT IN (SELECT (path, ix) FROM pd) GROUP BY fp HAVING count(*) = 1) c USING (fp)""", DISPLACED)
def match_tier3_displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tier three, on what displacement leaves."""
    b, c, pairs = _displaced(spark, sf_dir)
    return matching.by_fingerprint(b, c, cut(pairs))[0]


# policy

VERDICT = """CASE WHEN cc <= 10 THEN 'pass' WHEN bcc IS NULL OR bcc <= 10 THEN 'E101' WHEN cc > bcc OR sloc > bsloc + greatest(1, bsloc // 10) THEN 'E102' ELSE 'pass' END"""
PAIRS = REN + (
    A.callables_sql("base", "bc"), A.callables_sql("cand", "cc_"),
    "pairs AS (SELECT c.path, c.language, c.cc, c.sloc, b.cc AS bcc, b.sloc AS bsloc FROM cc_ c LEFT JOIN rn ON rn.path = c.path LEFT JOIN bc b ON b.path = coalesce(rn.from_path, c.path))",
    f"""vd AS (SELECT path, language, cc, sloc, {VERDICT} AS verdict, CASE WHEN bcc IS NULL THEN 'new_callable' WHEN bcc <= 10 THEN 'threshold_crossed' WHEN cc > bcc AND sloc > bsloc + greatest(1, bsloc // 10) THEN 'cc_and_sloc_growth'
    WHEN cc > bcc THEN 'cc_growth' WHEN sloc > bsloc + greatest(1, bsloc // 10) THEN 'sloc_growth' ELSE 'complexity_growth' END AS reason FROM pairs)""",
)


def _verdicts(spark, sf_dir):
    base, cand = (A.callables(x.drop("oid")) for x in _sides(spark, sf_dir))
    ren = _renames(spark, sf_dir).select("path", "from_path")
    b = base.select(F.col("path").alias("bp"), F.col("cc").alias("bcc"), F.col("sloc").alias("bsloc"))
    both = cand.join(ren, "path", "left").join(b, F.col("bp") == F.coalesce("from_path", "path"), "left")
    args = [F.col(x) for x in ("cc", "sloc", "bcc", "bsloc")]
    return both.select("path", "language", "cc", "sloc", policy.verdict(*args).alias("verdict"), policy.reason(*args).alias("reason"))


@query("SELECT * FROM vd WHERE verdict <> 'pass'", PAIRS)
def complexity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where("verdict <> 'pass'")


@query(f"""SELECT path, CASE WHEN count(DISTINCT v) = 1 THEN min(v) ELSE 'G102' END AS verdict FROM (SELECT c.path, {VERDICT.replace('bcc', 'b.bcc').replace('bsloc', 'b.bsloc')} AS v
FROM cc_ c JOIN (SELECT DISTINCT language, cc AS bcc, sloc AS bsloc FROM bc) b ON b.language = c.language) GROUP BY path""", PAIRS)
def ambiguous_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over all base callables of the language as options."""
    base, cand = (A.callables(x.drop("oid")) for x in _sides(spark, sf_dir))
    made = policy.open_set_verdicts(cand.select("path", "language", "cc", "sloc", F.lit(False).alias("unmatched")), base.select("language", "cc", "sloc"), ["language"])
    return made.select("path", "verdict")


SETS = T3 + (
    A.callables_sql("base", "bc"), A.callables_sql("cand", "cc_"),
    "tk AS (SELECT bp, bx, cp, cx FROM j3 WHERE nb = 1 AND nc = 1)", "am AS (SELECT fp, nb, nc FROM j3 WHERE nb > 1 OR nc > 1)",
    "ab AS (SELECT 3 AS tier, fp AS file, '' AS name, path, ix FROM bl JOIN am USING (fp) WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM t2))",
    "ac AS (SELECT 3 AS tier, fp AS file, '' AS name, path, ix, nb, nc FROM cl JOIN am USING (fp) WHERE (path, ix) NOT IN (SELECT (path, ix) FROM t2))",
    """r0 AS (SELECT 1 AS tier, file, name, path, ix FROM b1 WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM t1e)
    UNION ALL SELECT 2, file, name, path, ix FROM b2 WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM t2e))""",
    """rc AS (SELECT * FROM (SELECT 1 AS tier, file, name, path, ix FROM c1 WHERE (path, ix) NOT IN (SELECT (path, ix) FROM t1e)
    UNION ALL SELECT 2, file, name, path, ix FROM c2 WHERE (path, ix) NOT IN (SELECT (path, ix) FROM t2e)) WHERE (tier, file, name) IN (SELECT (tier, file, name) FROM r0))""",
    "rb AS (SELECT * FROM r0 WHERE (path, ix) NOT IN (SELECT (bp, bx) FROM tk))",
    """op AS (SELECT tier, file, name, count(*) AS n FROM rc WHERE (path, ix) NOT IN (SELECT (cp, cx) FROM tk) AND (path, ix) NOT IN (SELECT (path, ix) FROM ac WHERE nb > 0) GROUP BY 1, 2, 3)""",
    "nb AS (SELECT tier, file, name, count(*) AS n FROM rb GROUP BY 1, 2, 3)",
    """pr AS (SELECT rc.*, coalesce(op.n, 0) > coalesce(nb.n, 0) AS unmatched FROM rc LEFT JOIN op USING (tier, file, name) LEFT JOIN nb USING (tier, file, name)
    WHERE (tier, path, ix) IN (SELECT (1, path, ix) FROM t1p UNION ALL SELECT (2, path, ix) FROM t2p))""",
    """su AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY path, ix ORDER BY tier DESC, file DESC, name DESC) AS k FROM rc WHERE (path, ix) NOT IN (SELECT (path, ix) FROM t1)
    AND (path, ix) NOT IN (SELECT (path, ix) FROM t2) AND (path, ix) NOT IN (SELECT (cp, cx) FROM tk) AND (path, ix) NOT IN (SELECT (path, ix) FROM ac)) WHERE k = 1)""",
    "ms AS (SELECT * FROM pr UNION ALL SELECT tier, file, name, path, ix, nc > nb FROM ac UNION ALL SELECT *, true FROM su)",
    "os AS (SELECT DISTINCT tier, file, name, bc.cc AS bcc, bc.sloc AS bsloc FROM (SELECT * FROM rb UNION ALL SELECT * FROM ab) JOIN bc USING (path))",
    f"""sv AS (SELECT ms.path, ms.ix, {VERDICT} AS v FROM ms JOIN cc_ USING (path) JOIN os USING (tier, file, name)
    UNION ALL SELECT ms.path, ms.ix, {VERDICT} FROM (SELECT ms.*, NULL::BIGINT AS bcc, NULL::BIGINT AS bsloc FROM ms WHERE unmatched) ms JOIN cc_ USING (path))""",
)


@query("SELECT path, ix, CASE WHEN count(DISTINCT v) = 1 THEN min(v) ELSE 'G102' END AS verdict FROM sv GROUP BY path, ix", SETS)
def match_set_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over all bases of each ambiguity and positional remainder; a statement has the numbers of its file's callable."""
    b, c = (cut(_identities(x)) for x in _sides(spark, sf_dir))  # each is read many times, so plans are cut
    ren = cut(_renames(spark, sf_dir))
    one = cut(matching.same_file(b, c))
    two = cut(matching.through_renames(b, c, one, ren))
    cands, bases = matching.set_members(b, c, one, two, ren)
    base, cand = (A.callables(x.drop("oid")).select("path", "cc", "sloc") for x in _sides(spark, sf_dir))
    made = policy.open_set_verdicts(cands.join(cand, "path"), bases.join(base, "path"), ["tier", "file", "name"])
    return made.select("path", "ix", "verdict")


FIND = REN + (
    A.statements_sql("base", "bs"), A.statements_sql("cand", "cs"),
    "bf AS (SELECT path, ix, line, token FROM (SELECT *, lag(token) OVER (PARTITION BY path ORDER BY ix) AS prev FROM bs) WHERE token = prev)",
    "cf AS (SELECT path, language, ix, line, token FROM (SELECT *, lag(token) OVER (PARTITION BY path ORDER BY ix) AS prev FROM cs) WHERE token = prev)",
)


def _findings(files: DataFrame) -> DataFrame:
    rows = A.statements(files)
    return rows.withColumn("prev", F.lag("token").over(Window.partitionBy("path").orderBy("ix"))).where("token = prev").select("path", "language", "ix", "line", "token")


def _new_findings(spark, sf_dir):
    base, cand = (_findings(x.drop("oid")) for x in _sides(spark, sf_dir))
    moved = _renames(spark, sf_dir).select(F.col("from_path"), F.col("path").alias("to"))
    base = base.join(moved, F.col("path") == F.col("from_path"), "left").select(F.coalesce("to", "path").alias("path"), "token")
    return policy.unmatched(base, cand, ["path", "token"])


UNM = FIND + ("""un AS (SELECT path, ix, line, token FROM (SELECT cf.*, row_number() OVER (PARTITION BY cf.path, token ORDER BY ix) AS k FROM cf)
LEFT JOIN (SELECT coalesce(rn.path, bf.path) AS path, token, count(*) AS known FROM bf LEFT JOIN rn ON rn.from_path = bf.path GROUP BY 1, 2) USING (path, token) WHERE k > coalesce(known, 0))""",)


@query("SELECT path, ix, line, token FROM un", UNM)
def unmatched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_findings(spark, sf_dir).select("path", "ix", "line", "token")


SUP = (FILES, ST, "fnd AS (SELECT path, line, 'REPEAT' AS rule FROM (SELECT *, lag(token) OVER (PARTITION BY path ORDER BY ix) AS prev FROM st) WHERE token = prev)",
       "dir AS (SELECT path, line, 'REPEAT' AS rule FROM st WHERE regexp_matches(token, '^[A-M]'))")


def _directives(spark, sf_dir):
    f = _repeated(spark, sf_dir).select("path", "line", F.lit("REPEAT").alias("rule"))
    d = A.statements(A.files(spark, sf_dir)).where(F.col("token").rlike("^[A-M]")).select("path", "line", F.lit("REPEAT").alias("rule"))
    return policy.suppress(f, d)


@query("SELECT f.path, f.rule, f.line FROM fnd f WHERE (f.path, f.rule, f.line) IN (SELECT (path, rule, line + 1) FROM dir)", SUP)
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directives(spark, sf_dir)[0]


@query("SELECT path, rule, line FROM dir WHERE (path, rule, line) NOT IN (SELECT (path, rule, line - 1) FROM fnd)", SUP)
def unused_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directives(spark, sf_dir)[1]


@query("SELECT path, CASE WHEN octet_length(encode(text)) > 4096 THEN 'too_large' WHEN language NOT IN ('en', 'fr') THEN 'unsupported_extension' END AS reason FROM files", (FILES,))
def coverage_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each file can't be analysed, with a ceiling of 4,096 bytes and two supported extensions."""
    path = F.col("path")
    return A.files(spark, sf_dir).select("path", policy.coverage_reason(F.octet_length("text"), F.is_valid_utf8(path), discovery.extension(path), ["en", "fr"], 4096).alias("reason"))


@query("""SELECT 'A102' AS code, path, reason FROM (SELECT c.path, b.oid IS DISTINCT FROM c.oid AS changed,
CASE WHEN octet_length(encode(c.text)) > 4096 THEN 'too_large' WHEN c.language NOT IN ('en', 'fr') THEN 'unsupported_extension' END AS reason
FROM cand c LEFT JOIN rn ON rn.path = c.path LEFT JOIN base b ON b.path = coalesce(rn.from_path, c.path)) WHERE reason IS NOT NULL AND (changed OR reason <> 'unsupported_extension')""", REN)
def coverage_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A102 of the candidate's files, with clone growth denied."""
    base, cand = _sides(spark, sf_dir)
    changed = matching.changed_entities(base, cand, _renames(spark, sf_dir)).select("path", F.lit(True).alias("changed"))
    reason = policy.coverage_reason(F.octet_length("text"), F.is_valid_utf8("path"), discovery.extension(F.col("path")), ["en", "fr"], 4096)
    return policy.coverage_gaps(cand.join(changed, "path", "left").select("path", F.coalesce("changed", F.lit(False)).alias("changed"), reason.alias("reason")))


def _diagnostics(spark, sf_dir):
    v = _verdicts(spark, sf_dir).where("verdict <> 'pass'").select(F.lit(3).alias("phase"), "path", F.lit(0).cast("long").alias("line"), F.col("verdict").alias("code"), F.lit("deny").alias("severity"))
    n = _new_findings(spark, sf_dir).select(F.lit(4).alias("phase"), "path", "line", F.lit("V101").alias("code"), F.lit("deny").alias("severity"))
    s = _directives(spark, sf_dir)[1].select(F.lit(5).alias("phase"), "path", "line", F.lit("S102").alias("code"), F.lit("warn").alias("severity"))
    return v.unionByName(n).unionByName(s)


DIAG = tuple(dict.fromkeys(PAIRS + UNM[len(REN):] + SUP)) + ("""dg AS (SELECT 3 AS phase, path, 0::BIGINT AS line, verdict AS code, 'deny' AS severity FROM vd WHERE verdict <> 'pass' UNION ALL SELECT 4, path, line, 'V101', 'deny' FROM un
UNION ALL SELECT 5, path, line, 'S102', 'warn' FROM dir WHERE (path, rule, line) NOT IN (SELECT (path, rule, line - 1) FROM fnd))""",)


@query("SELECT phase, path, line, code, severity FROM dg", DIAG)
def diagnostic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnostics(spark, sf_dir).orderBy("phase", "path", "line")


@query("SELECT bit_or(CASE WHEN severity = 'deny' THEN 1 ELSE 0 END)::BIGINT AS exit_status FROM dg", DIAG)
def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.exit_status(_diagnostics(spark, sf_dir))


@query("""SELECT code, '::notice file=' || replace(replace(replace(path, '%', '%25'), ':', '%3A'), ',', '%2C') || ',line=' || line || '::' || code || ' ' || replace(path, '%', '%25') AS annotation FROM dg""", DIAG)
def github_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("::notice file="), X.annotation_property(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit("::"), F.col("code"), F.lit(" "), X.annotation_data(F.col("path")))
    return _diagnostics(spark, sf_dir).select("code", text.alias("annotation"))


@query("""SELECT coalesce(b.path, c.path) AS path, coalesce(CASE WHEN coalesce(b.path, c.path) LIKE 'src1/%' THEN 'trusted' END, b.oid, 'default') AS effective, CASE WHEN b.oid IS DISTINCT FROM c.oid THEN 'C101' END AS code FROM base b FULL JOIN cand c ON b.path = c.path""", (BASE, CAND))
def config_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = _sides(spark, sf_dir)
    both = b.select("path", F.col("oid").alias("boid")).join(c.select("path", "oid"), "path", "full_outer")
    t = policy.trust(F.when(F.col("path").like("src1/%"), "trusted"), F.col("boid"), F.col("oid"), "default")
    return both.select("path", t["effective"].alias("effective"), t["code"].alias("code"))


@query("SELECT c.path, c.oid, c.language FROM cand c WHERE (c.oid, c.language) NOT IN (SELECT (oid, language) FROM base)", (BASE, CAND))
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = _sides(spark, sf_dir)
    return discovery.cache_misses(c.select("path", "oid", "language"), b).select("path", "oid", "language")


@query("""SELECT key, size, age, age > 15 OR sum(size) OVER (ORDER BY age, key) > 200000 AS evicted FROM (SELECT doc_id AS key, octet_length(encode(text)) AS size, replace(source, 'src', '')::BIGINT AS age FROM documents)""")
def lru_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    entries = d.select(F.col("doc_id").alias("key"), F.octet_length("text").cast("long").alias("size"), F.replace("source", F.lit("src"), F.lit("")).cast("long").alias("age"))
    return discovery.evict(entries, 200000, 15)


# names, links, totals


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[\p{L}\p{N}_$.#]+$') THEN p_name WHEN p_name = '' THEN '<anonymous>@' || p_size ELSE '<computed>@' || p_size END AS name FROM part")
def published_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select("p_partkey", X.published_name(F.col("p_name"), F.col("p_size")).alias("name"))


@query("SELECT path || '#L' || start || '-L' || end_ AS link FROM mx", RUNS)
def location_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select(X.location(F.col("path"), F.col("start"), F.col("end")).alias("link"))


@query("SELECT (SELECT count(*) FROM rep) AS findings, (SELECT count(DISTINCT key) FROM mx) AS groups, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM st) AS lines", FLAG)
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda df, name: df.select(F.lit(name).alias("what"))
    rows = part(_repeated(spark, sf_dir), "findings").union(part(_members(spark, sf_dir).select("key").distinct(), "groups")).union(part(A.files(spark, sf_dir), "files")).union(part(A.statements(A.files(spark, sf_dir)), "lines"))
    return rows.agg(*[F.count_if(F.col("what") == x).alias(x) for x in ("findings", "groups", "files", "lines")])


# built-in exclusions

PLACED = """placed AS (SELECT CASE source WHEN 'src1' THEN 'node_modules/' WHEN 'src2' THEN 'a/generated/' WHEN 'src4' THEN 'src/test/' WHEN 'src6' THEN 'x/META-INF/resources/webjars/' ELSE 'src/' END
  || doc_id || CASE lang WHEN 'de' THEN 'Test.java' WHEN 'es' THEN '.min.js' ELSE '.java' END AS path FROM documents)"""


def _placed(spark, sf_dir):
    """Documents as files of folders and names that built-in globs know."""
    folder = F.col("source")
    at = F.when(folder == "src1", "node_modules/").when(folder == "src2", "a/generated/").when(folder == "src4", "src/test/").when(folder == "src6", "x/META-INF/resources/webjars/").otherwise("src/")
    end = F.when(F.col("lang") == "de", "Test.java").when(F.col("lang") == "es", ".min.js").otherwise(".java")
    return A.table(spark, sf_dir, "documents").select(F.concat(at, F.col("doc_id").cast("string"), end).alias("path"))


@query("""SELECT path, CASE WHEN path LIKE 'node_modules/%' OR path LIKE '%/META-INF/resources/webjars/%' THEN 'dependency_or_build_output' WHEN path LIKE '%/generated/%' OR path LIKE '%.min.js' THEN 'generated_code'
WHEN path LIKE 'src/test/%' OR path LIKE '%Test.java' THEN 'test' END AS reason FROM placed""", (PLACED,))
def built_in_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).withColumn("reason", discovery.skip_reason(F.col("path"), discovery.built_in()))


# line maps


def _mapped(spark, sf_dir):
    """Line maps of the files of both snapshots, renamed ones under their new name, whose texts differ."""
    base, cand = _sides(spark, sf_dir)
    to = _renames(spark, sf_dir).select("from_path", F.col("path").alias("to"))
    names = lines.line_names(F.col("text"))
    old = base.select("path", F.col("oid").alias("base_oid"), names.alias("base_names")).join(to, F.col("path") == F.col("from_path"), "left").select(F.coalesce("to", "path").alias("path"), "base_oid", "base_names")
    return lines.line_map(old.join(cand.select("path", "oid", names.alias("names")), "path").where("base_oid <> oid"))


def _candidate_lines(spark, sf_dir, side):
    return A.with_lines(_sides(spark, sf_dir)[0 if side == "base" else 1])


def _runs(spark, sf_dir, side, named=True):
    return clones.maximal_runs(_candidate_lines(spark, sf_dir, side), named=named)


@query()
def line_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept, added and deleted in every changed file."""
    return lines.line_changes(_mapped(spark, sf_dir))


@query()
def clone_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of maximal groups of the candidate that hold added lines."""
    return lines.clone_subjects(_runs(spark, sf_dir, "cand").select("path", "key", "start", "end", "lines"), _mapped(spark, sf_dir)).drop("lines")


@query()
def extension_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the lines they may count as extended from, and whether they grew too much."""
    mapped = cut(_mapped(spark, sf_dir))
    subjects = lines.clone_subjects(_runs(spark, sf_dir, "cand").select("path", "key", "start", "end", "lines"), mapped)
    return lines.extension_grades(subjects, _runs(spark, sf_dir, "base", False).select("path", "start", "end", "lines"), mapped).drop("lines")


@query()
def deleted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base members of maximal groups all of whose lines were deleted."""
    return lines.deleted_runs(_runs(spark, sf_dir, "base").select("path", "key", "start", "end", "lines"), _mapped(spark, sf_dir)).drop("lines")


@query()
def damage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of the candidate's changed files, as damage, that are not the base's on unchanged lines."""
    side = lambda k: _findings(A.snapshot(spark, sf_dir, k).drop("oid")).select("path", F.col("line").alias("start"), F.col("line").alias("end"))
    mapped = cut(_mapped(spark, sf_dir))
    changed = mapped.select("path").distinct()
    moved = _renames(spark, sf_dir).select("from_path", F.col("path").alias("to"))
    base = side("base").join(moved, F.col("path") == F.col("from_path"), "left").select(F.coalesce("to", "path").alias("path"), "start", "end")
    return lines.damaged(side("cand").join(changed, "path", "left_semi"), base, mapped)


@query()
def new_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed repeats of the candidate whose repeat on the mapped base line was not suppressed, in changed files."""
    mapped, found = cut(_mapped(spark, sf_dir)), []
    for files in _sides(spark, sf_dir):
        rows = A.statements(files.drop("oid"))
        directives = rows.where(F.col("token").rlike("^[A-M]")).select("path", "line", F.lit("REPEAT").alias("rule"))
        repeats = _findings(files.drop("oid")).select("path", "line", F.lit("REPEAT").alias("rule"))
        found.append((repeats, policy.suppress(repeats, directives)[0]))
    (base, base_hit), (cand, hit) = found
    same = lines.matched_by_line(base, cand, mapped, ["rule"])
    changed = mapped.select("path").distinct()
    return lines.new_suppressions(hit.join(changed, "path", "left_semi"), base_hit, same)


# text for outputs


@query("SELECT page_id, array_to_string(list_transform(string_split(path, '/'), lambda x: url_encode(x)), '/') AS encoded FROM paths", (PATHS,))
def percent_encoded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paths(spark, sf_dir).select("page_id", X.percent_encoded(F.col("path")).alias("encoded"))


@query("SELECT doc_id, sha256('file/1/' || octet_length(encode(path)) || ':' || path || octet_length(encode(text)) || ':' || text) AS digest FROM files", (FILES,))
def framed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.files(spark, sf_dir).select("doc_id", X.framed_digest("file", 1, F.col("path"), F.col("text")).alias("digest"))


@query(r"""SELECT doc_id, replace(replace(replace(text, chr(10), '\u{a}'), chr(13), '\u{d}'), chr(9), '\u{9}') AS shown FROM files""", (FILES,))
def terminal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.files(spark, sf_dir).select("doc_id", X.terminal(F.col("text")).alias("shown"))


@query("""SELECT doc_id, coalesce(try(decode(b[1:4096])), try(decode(b[1:4095])), try(decode(b[1:4094])), try(decode(b[1:4093]))) AS excerpt, octet_length(b) > 4096 OR n > 21 AS truncated
FROM (SELECT doc_id, encode(array_to_string(string_split(text, chr(10))[2:21], chr(10))) AS b, len(string_split(text, chr(10))) AS n FROM files)""", (FILES,))
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty lines from the second one, 4,096 bytes at most."""
    return A.files(spark, sf_dir).select("doc_id", X.excerpt(F.col("text"), F.lit(2)).alias("e")).select("doc_id", F.col("e.text").alias("excerpt"), "e.truncated")


@query("SELECT path, ix, line, token, row_number() OVER (ORDER BY path, line, token) AS place FROM cf", FIND)
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the candidate by path, line and what repeats, with their place."""
    found = _findings(_sides(spark, sf_dir)[1].drop("oid")).select("path", "ix", "line", "token")
    return metrics.placed(found, ["path", "line", "token"])


RULE_NAMES = {("de", "REPEAT"): "DE-REPEAT", ("en", "REPEAT"): "EN-REPEAT", ("fr", "REPEAT"): "FR-REPEAT"}


@query("SELECT path, language, ix, line, token, upper(language) || '-REPEAT' AS rule FROM cf WHERE language <> 'es'", FIND)
def rules_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings under their family's rule name; Spanish files have no rules."""
    found = _findings(A.snapshot(spark, sf_dir, "cand").drop("oid")).withColumn("rule", F.lit("REPEAT"))
    return rules.by_family(found, RULE_NAMES).select("path", "language", "ix", "line", "token", "rule")


@query("""SELECT path, ix, sha256('finding/1/' || octet_length(encode(prev)) || ':' || prev || octet_length(encode(token)) || ':' || token) AS digest
FROM (SELECT *, lag(token) OVER (PARTITION BY path ORDER BY ix) AS prev FROM cs) WHERE token = prev""", FIND)
def finding_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax digests over the tokens of both flagged statements of a repeat."""
    found = _findings(A.snapshot(spark, sf_dir, "cand").drop("oid"))
    return found.select("path", "ix", X.framed_array_digest("finding", 1, F.array("token", "token")).alias("digest"))
