"""Queries of the operators on changes and nested structures, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import findings, matching, metrics, owners, policy, renames, spans
from ..sources import cache, discovery, ignore
from . import adapters as A
from .registry import DIFF, EROSION, FAMILIES, FIND, IDS, LANGS, PATHS, QUERIES, REN, SEQ, SQL, SUP, _findings, _identities, _renames, _sides, query
from .scratch import cut

__all__ = ["QUERIES", "SQL"]

# matching by context


def _with_context(files: DataFrame) -> DataFrame:
    return _identities(files).join(A.statements(files).select("path", "ix", F.coalesce(F.try_element_at(F.split("token", " "), F.lit(2)), F.lit("")).alias("context")), ["path", "ix"])


CONTEXT = IDS + (
    "b1 AS (SELECT bi.*, bi.path AS file, split_part(token, ' ', 2) AS context FROM bi JOIN bs USING (path, ix))", "c1 AS (SELECT ci.*, ci.path AS file, split_part(token, ' ', 2) AS context FROM ci JOIN cs USING (path, ix))",
    "ex AS (SELECT b.path AS base_path, b.ix AS base_ix, c.path, c.ix FROM (SELECT *, row_number() OVER (PARTITION BY file, name, fp ORDER BY ix) AS k FROM b1) b JOIN (SELECT *, row_number() OVER (PARTITION BY file, name, fp ORDER BY ix) AS k FROM c1) c USING (file, name, fp, k))",
    "rb AS (SELECT * FROM b1 WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM ex))", "rc AS (SELECT * FROM c1 WHERE (path, ix) NOT IN (SELECT (path, ix) FROM ex))",
    """ms AS (SELECT file, name, bool_and(n = 0) AS equal FROM (SELECT file, name, context, sum(n) AS n FROM (SELECT file, name, context, 1 AS n FROM rb UNION ALL SELECT file, name, context, -1 FROM rc) GROUP BY ALL) GROUP BY ALL)""",
    "xb AS (SELECT *, row_number() OVER (PARTITION BY file, name, ctx ORDER BY ix) AS k FROM (SELECT rb.*, CASE WHEN equal THEN context ELSE '' END AS ctx FROM rb JOIN ms USING (file, name)))",
    "xc AS (SELECT *, row_number() OVER (PARTITION BY file, name, ctx ORDER BY ix) AS k FROM (SELECT rc.*, CASE WHEN equal THEN context ELSE '' END AS ctx FROM rc JOIN ms USING (file, name)))",
    "po AS (SELECT xb.path AS base_path, xb.ix AS base_ix, xc.path, xc.ix FROM xb JOIN xc USING (file, name, ctx, k))",
)


@query("SELECT *, 'fingerprint_exact' AS pairing FROM ex UNION ALL SELECT *, 'positional' FROM po", CONTEXT)
def match_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier one where leftovers are parted by context, if both sides have the same ones; a statement's context is its second word."""
    b, c = (cut(_with_context(x)) for x in _sides(spark, sf_dir))
    return matching.same_file(b, c).select("base_path", "base_ix", "path", "ix", "pairing")


# findings

BLOCK = 8
FOUND = REN + (
    A.statements_sql("base", "bs"), A.statements_sql("cand", "cs"),
    f"bb AS (SELECT DISTINCT path, (ix - 1) // {BLOCK} AS own FROM bs)", f"cb AS (SELECT DISTINCT path, (ix - 1) // {BLOCK} AS own FROM cs)",
    "pairs AS (SELECT b.path AS base_path, cb.path, own FROM (SELECT bb.path, own, coalesce(rn.path, bb.path) AS file FROM bb LEFT JOIN rn ON rn.from_path = bb.path) b JOIN cb USING (own) WHERE cb.path = b.file)",
    "bl AS (SELECT coalesce(rn.path, bs.path) AS file, line, token, row_number() OVER (PARTITION BY bs.path, token ORDER BY line) AS k FROM bs LEFT JOIN rn ON rn.from_path = bs.path)",
    "mp AS (SELECT file, bl.line AS base_line, cl.line FROM bl JOIN (SELECT path AS file, line, token, row_number() OVER (PARTITION BY path, token ORDER BY line) AS k FROM cs) cl USING (file, token, k))",
    f"""bf AS (SELECT f.path, f.ix, f.file, sha256(split_part(f.token, ' ', 1)) AS digest, coalesce(p.path, f.file) AS ctx_path, coalesce(p.own, -1) AS ctx_ix, mp.line AS to_line
    FROM (SELECT w.*, coalesce(rn.path, w.path) AS file FROM (SELECT *, lag(token) OVER (PARTITION BY path ORDER BY ix) AS prev FROM bs) w LEFT JOIN rn ON rn.from_path = w.path WHERE split_part(w.token, ' ', 1) = split_part(w.prev, ' ', 1)) f
    LEFT JOIN pairs p ON p.base_path = f.path AND p.own = (f.ix - 1) // {BLOCK} LEFT JOIN mp ON mp.file = f.file AND mp.base_line = f.line)""",
    f"""cf AS (SELECT f.path, f.ix, f.line, sha256(split_part(f.token, ' ', 1)) AS digest, f.path AS ctx_path, coalesce(p.own, -1) AS ctx_ix
    FROM (SELECT *, lag(token) OVER (PARTITION BY path ORDER BY ix) AS prev FROM cs) f LEFT JOIN pairs p ON p.path = f.path AND p.own = (f.ix - 1) // {BLOCK} WHERE split_part(f.token, ' ', 1) = split_part(f.prev, ' ', 1))""",
    """pl AS (SELECT b.path AS base_path, b.ix AS base_ix, c.path, c.ix, ctx_ix FROM (SELECT *, row_number() OVER (PARTITION BY digest, ctx_path, ctx_ix, file, to_line ORDER BY path, ix) AS k FROM bf WHERE to_line IS NOT NULL) b
    JOIN (SELECT *, path AS file, line AS to_line, row_number() OVER (PARTITION BY digest, ctx_path, ctx_ix, path, line ORDER BY path, ix) AS k FROM cf) c USING (digest, ctx_path, ctx_ix, file, to_line, k))""",
    """pg AS (SELECT b.path AS base_path, b.ix AS base_ix, c.path, c.ix, ctx_ix FROM (SELECT *, row_number() OVER (PARTITION BY digest, ctx_path, ctx_ix ORDER BY path, ix) AS k FROM bf WHERE (path, ix) NOT IN (SELECT (base_path, base_ix) FROM pl)) b
    JOIN (SELECT *, row_number() OVER (PARTITION BY digest, ctx_path, ctx_ix ORDER BY path, ix) AS k FROM cf WHERE (path, ix) NOT IN (SELECT (path, ix) FROM pl)) c USING (digest, ctx_path, ctx_ix, k))""",
)


def _found(files: DataFrame) -> DataFrame:
    """Statements that begin like the one before them, found inside each file's row; a digest is that of their first word, an owner a block of some statements."""
    word = lambda x: F.split_part(x["token"], F.lit(" "), F.lit(1))
    one = lambda x, i: F.struct((i + 1).cast("long").alias("ix"), F.sha2(word(x).cast("binary"), 256).alias("digest"), x["line"].alias("line"))
    each = F.filter(F.transform("lines", lambda x, i: F.when(word(x) == word(F.get("lines", i - 1)), one(x, i))), lambda x: x.isNotNull())
    rows = A.with_lines(files).select("path", F.explode(each).alias("s")).select("path", "s.ix", "s.digest", "s.line")
    return rows.select("path", "ix", F.lit("REPEAT").alias("rule"), "digest", "line", F.floor((F.col("ix") - 1) / BLOCK).alias("owner"))


def _places(files: DataFrame) -> DataFrame:
    """(path, token, line, k): statements by MD5 of their text, numbered among equal ones of their file."""
    rows = A.with_lines(files).select("path", F.explode(F.transform("lines", lambda x: F.struct(F.unhex(F.md5(x["token"].cast("binary"))).alias("token"), x["line"].alias("line")))).alias("s"))
    return rows.select("path", "s.token", "s.line").withColumn("k", F.row_number().over(Window.partitionBy("path", "token").orderBy("line")))


def _matched_findings(spark, sf_dir):
    sides = [x.drop("oid") for x in _sides(spark, sf_dir)]
    ren = cut(_renames(spark, sf_dir))
    count = F.size("lines")
    blocks = [A.with_lines(x).where(count > 0).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / BLOCK))).alias("ix")).withColumns({"name": F.col("ix").cast("string"), "fp": F.lit("")}) for x in sides]
    one = cut(matching.same_file(*blocks))
    pairs = one.unionByName(matching.through_renames(*blocks, one, ren))
    old, new = _places(sides[0]), _places(sides[1])
    to = ren.select(F.col("from_path").alias("path"), F.col("path").alias("to"))
    old = old.join(to, "path", "left").withColumn("path", F.coalesce("to", "path"))
    mapped = old.select("path", "token", F.col("line").alias("base_line"), "k").join(new, ["path", "token", "k"])
    return findings.match(_found(sides[0]), _found(sides[1]), pairs, ren, mapped.select("path", "base_line", "line"))


@query("SELECT *, 'line' AS phase FROM (SELECT base_path, base_ix, path, ix, ctx_ix < 0 AS in_file_context FROM pl) UNION ALL SELECT *, 'order' FROM (SELECT base_path, base_ix, path, ix, ctx_ix < 0 FROM pg)", FOUND)
def finding_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of both snapshots matched inside rule, context and digest: by lines, the k-th of equal ones mapping to the k-th, then in order."""
    return _matched_findings(spark, sf_dir)[0]


@query("SELECT path, ix, line FROM cf WHERE (path, ix) NOT IN (SELECT (path, ix) FROM pl UNION ALL SELECT (path, ix) FROM pg)", FOUND)
def finding_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate findings without a partner in the base."""
    return _matched_findings(spark, sf_dir)[1].select("path", "ix", "line")


# owners

OWN = SEQ + """, ow0 AS (SELECT user_id, event_id, event_type AS kind, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ix FROM events),
ow AS (SELECT user_id, ix AS id, nullif(CASE WHEN kind IN ('click', 'view', 'error') THEN ix - 1 ELSE ix // 2 END, 0) AS parent, kind, CASE WHEN kind = 'error' THEN NULL ELSE 'e' || (event_id % 50) END AS name FROM ow0)"""
VALUE = "list_transform([0, 1, 2, 3], lambda i: ('0x' || sha256(octet_length(encode(kind)) || ':' || kind || coalesce('=' || name, '!'))[(1 + 15 * i):(15 + 15 * i)])::BIGINT % " + f"{list(owners.PRIMES)}[i + 1])"
STEP = f"list_transform([1, 2, 3, 4], lambda i: ({{h}}[i] * {owners.RADIX} + v[i]) % {list(owners.PRIMES)}[i])"
HEXED = "list_reduce(list_transform({h}, lambda x: lpad(lower(to_hex(x)), 8, '0')), lambda a, b: a || b)"


def _owners(spark, sf_dir):
    """A forest per user: most events hang on the one before, others on the one half as far, so chains are of many lengths."""
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("id"))
    parent = F.when(F.col("kind").isin("click", "view", "error"), F.col("id") - 1).otherwise(F.floor(F.col("id") / 2))
    name = F.when(F.col("kind") != "error", F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")))
    return e.select("user_id", "id", F.nullif(parent, F.lit(0)).cast("long").alias("parent"), "kind", name.alias("name"))


@query(f"""SELECT user_id, id, depth, {HEXED.format(h='h')} AS digest, {HEXED.format(h='ph')} AS plain FROM ch""", ("RECURSIVE " + OWN, f"ov AS (SELECT *, {VALUE} AS v, kind NOT IN ('view') AS counted FROM ow)",
    f"""ch AS (SELECT user_id, id, 1::BIGINT AS depth, v AS h, CASE WHEN counted THEN v ELSE [0, 0, 0, 0]::BIGINT[] END AS ph FROM ov WHERE parent IS NULL
    UNION ALL SELECT o.user_id, o.id, depth + 1, {STEP.format(h='h')}, CASE WHEN counted THEN {STEP.format(h='ph')} ELSE ph END FROM ov o JOIN ch ON o.user_id = ch.user_id AND o.parent = ch.id)"""))
def owner_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the chains of owners from the root, with and without those of a context kind."""
    return owners.chain_digests(_owners(spark, sf_dir), ["view"], "user_id")


@query("SELECT user_id, id, CASE WHEN parent IN (SELECT o.id FROM ow o WHERE o.user_id = ow.user_id AND o.kind = 'signup') THEN NULL ELSE parent END AS parent FROM ow WHERE kind <> 'signup'", (OWN,))
def owners_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners without the dropped ones (signups), whose children have no parent."""
    rows = _owners(spark, sf_dir)
    return owners.without(rows, rows.where("kind = 'signup'"), "user_id").select("user_id", "id", "parent")


# renames

GONE = DIFF + (
    "gn AS (SELECT d.path, d.base_oid AS oid, text FROM df d JOIN base USING (path) WHERE status = 'deleted')", "nw AS (SELECT d.path, d.oid, text FROM df d JOIN cand USING (path) WHERE status = 'added')",
    "rx AS (SELECT g.path AS from_path, n.path FROM (SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS k FROM gn) g JOIN (SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS k FROM nw) n USING (oid, k))",
    "gl AS (SELECT path, l, count(*) AS n FROM (SELECT path, unnest(string_split(text, chr(10))) AS l FROM gn WHERE text <> '' AND path NOT IN (SELECT from_path FROM rx)) GROUP BY ALL)",
    "nl AS (SELECT path, l, count(*) AS n FROM (SELECT path, unnest(string_split(text, chr(10))) AS l FROM nw WHERE text <> '' AND path NOT IN (SELECT path FROM rx)) GROUP BY ALL)",
    "gs AS (SELECT path, sum(n * (octet_length(encode(l)) + 1)) AS s FROM gl GROUP BY path)", "ns AS (SELECT path, sum(n * (octet_length(encode(l)) + 1)) AS s FROM nl GROUP BY path)",
    """sm AS (SELECT from_path, p.path, (c * 100 // greatest(gs.s, ns.s))::BIGINT AS similarity FROM (SELECT gl.path AS from_path, nl.path, sum(least(gl.n, nl.n) * (octet_length(encode(l)) + 1)) AS c FROM gl JOIN nl USING (l) GROUP BY 1, 2) p
    JOIN gs ON gs.path = from_path JOIN ns ON ns.path = p.path WHERE c * 100 >= 50 * greatest(gs.s, ns.s))""",
)


def _gone_and_new(spark, sf_dir):
    base, cand = _sides(spark, sf_dir)
    diff = cut(matching.tree_diff(base, cand))
    of = lambda side, status: cut(side.join(diff.where(F.col("status") == status).select("path"), "path", "left_semi").select("path", "oid", "text"))
    return of(base, "deleted"), of(cand, "added")


@query("SELECT * FROM sm", GONE)
def rename_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of deleted and added files of different content that share half their bytes in lines."""
    gone, new = _gone_and_new(spark, sf_dir)
    exact = renames.renames(gone, new, 101)
    return renames.similar(gone.join(exact.select(F.col("from_path").alias("path")), "path", "left_anti"), new.join(exact, "path", "left_anti"))


#: The walk down the pairs, one a step.
@query("""SELECT from_path, path, 100::BIGINT AS similarity FROM rx UNION ALL SELECT unnest(f), unnest(t), unnest(s) FROM (SELECT f, t, s FROM wk ORDER BY k DESC LIMIT 1)""",
    ("RECURSIVE " + GONE[0], *GONE[1:]) + ("rk AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, from_path, path) AS k FROM sm)",
    """wk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS f, []::VARCHAR[] AS t, []::BIGINT[] AS s UNION ALL
    SELECT rk.k, CASE WHEN ok THEN list_append(f, rk.from_path) ELSE f END, CASE WHEN ok THEN list_append(t, rk.path) ELSE t END, CASE WHEN ok THEN list_append(s, rk.similarity) ELSE s END
    FROM (SELECT rk.*, f, t, s, NOT list_contains(f, rk.from_path) AND NOT list_contains(t, rk.path) AS ok FROM wk JOIN rk ON rk.k = wk.k + 1) rk)"""))
def inexact_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames of the candidate, of equal and of similar content."""
    return renames.renames(*_gone_and_new(spark, sf_dir))


# spans

NEST = (SEQ, "sp AS (SELECT DISTINCT user_id, day, second - second % 3600 AS s, second AS e, kind FROM sequences)", "er AS (SELECT DISTINCT user_id, s AS s, e AS e FROM sp WHERE kind = 'error')", "cl AS (SELECT DISTINCT user_id, s, e FROM sp WHERE kind = 'click')")


def _kind_spans(spark, sf_dir, kind):
    """From the begin of an hour to an event in it, over all days of a user: spans that hold and overlap each other."""
    s = A.sequences(spark, sf_dir).where(F.col("kind") == kind)
    return s.select("user_id", (F.col("second") - F.col("second") % 3600).alias("start"), F.col("second").alias("end")).distinct()


@query("""SELECT user_id, s AS start, e AS "end", EXISTS (SELECT 1 FROM er WHERE er.user_id = cl.user_id AND er.s <= cl.e AND cl.s <= er.e) AS touched, EXISTS (SELECT 1 FROM er WHERE er.user_id = cl.user_id AND er.s <= cl.s AND cl.e <= er.e) AS held FROM cl""", NEST)
def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether spans of clicks share a second with one of errors, and whether one of these holds them whole."""
    clicks, errors = (_kind_spans(spark, sf_dir, k) for k in ("click", "error"))
    return spans.within(spans.overlapped(clicks, errors, ["user_id"]), errors, ["user_id"])


@query("""SELECT cl.user_id, cl.s AS start, cl.e AS "end", count(er.user_id) AS holders FROM cl JOIN er ON er.user_id = cl.user_id AND er.s <= cl.s AND cl.e <= er.e GROUP BY ALL""", NEST)
def span_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of errors hold each span of clicks."""
    clicks, errors = (_kind_spans(spark, sf_dir, k) for k in ("click", "error"))
    return spans.inside(clicks, errors, ["user_id"], []).groupBy("user_id", "start", "end").agg(F.count("*").alias("holders"))


GAPS = REN + (
    A.statements_sql("base", "bs"), A.statements_sql("cand", "cs"),
    "ls AS (SELECT coalesce(rn.path, bs.path) AS path, line, token, row_number() OVER (PARTITION BY bs.path, token ORDER BY line) AS k FROM bs LEFT JOIN rn ON rn.from_path = bs.path)",
    "mp AS (SELECT path, ls.line AS base_line, cl.line FROM ls JOIN (SELECT path, line, token, row_number() OVER (PARTITION BY path, token ORDER BY line) AS k FROM cs) cl USING (path, token, k))",
    "bg AS (SELECT DISTINCT coalesce(rn.path, bs.path) AS path, line AS s, line + length(token) % 4 AS e FROM bs LEFT JOIN rn ON rn.from_path = bs.path WHERE regexp_matches(token, '^[A-M]'))",
    "cg AS (SELECT DISTINCT path, line AS s, line + length(token) % 3 AS e FROM cs WHERE regexp_matches(token, '^[A-T]'))",
)


@query("""SELECT cg.path, cg.s AS start, cg.e AS "end", min((b.s, b.e))[1] AS base_start, min((b.s, b.e))[2] AS base_end, count(DISTINCT CASE WHEN b.s IS NOT NULL THEN mp.line END) = cg.e - cg.s + 1 AS tolerated
FROM cg LEFT JOIN mp ON mp.path = cg.path AND mp.line BETWEEN cg.s AND cg.e LEFT JOIN bg b ON b.path = cg.path AND mp.base_line BETWEEN b.s AND b.e GROUP BY cg.path, cg.s, cg.e""", GAPS)
def gap_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the candidate, spans at statements of some letters, with the first base gap that they map from, and whether it was all there before."""
    base, cand = _sides(spark, sf_dir)
    ren = _renames(spark, sf_dir).select(F.col("from_path").alias("path"), F.col("path").alias("to"))
    old = cut(A.statements(base.drop("oid")).join(ren, "path", "left").withColumn("path", F.coalesce("to", "path")).select("path", "line", "token"))
    new = cut(A.statements(cand.drop("oid")).select("path", "line", "token"))
    k = F.row_number().over(Window.partitionBy("path", "token").orderBy("line"))
    mapped = old.select("path", "token", F.col("line").alias("base_line"), k.alias("k")).join(new.select("path", "token", "line", k.alias("k")), ["path", "token", "k"]).select("path", "base_line", "line")
    gaps = lambda x, letters, n: x.where(F.col("token").rlike(letters)).select("path", F.col("line").alias("start"), (F.col("line") + F.length("token") % n).alias("end")).distinct()
    return spans.mapped_gaps(gaps(new, "^[A-T]", 3), gaps(old, "^[A-M]", 4), cut(mapped))


# trees of nodes

#: A tree a user: the hours of all days, each with its events, in pre-order.
NODES = (SEQ, """nd0 AS (SELECT user_id, day, second // 3600 AS hour, event_id, kind, second FROM sequences),
nd1 AS (SELECT user_id, day, hour, NULL AS event_id, 0 AS line, 'hour' AS kind, count(*) AS below FROM nd0 GROUP BY ALL UNION ALL SELECT user_id, day, hour, event_id, second, kind, 0 FROM nd0),
nd AS (SELECT user_id, kind, line, row_number() OVER (PARTITION BY user_id ORDER BY day, hour, event_id NULLS FIRST) AS node, below FROM nd1), ns AS (SELECT *, node + below AS last FROM nd),
pr AS (SELECT * FROM ns n WHERE NOT EXISTS (SELECT 1 FROM ns d WHERE d.user_id = n.user_id AND (d.kind = 'error' OR d.kind = 'hour' AND d.below > 3) AND d.node <= n.node AND n.last <= d.last))""")


def _nodes(spark, sf_dir):
    s = A.sequences(spark, sf_dir).withColumn("hour", F.floor(F.col("second") / 3600))
    hours = s.groupBy("user_id", "day", "hour").agg(F.count("*").alias("below")).select("*", F.lit(None).cast("long").alias("event_id"), F.lit(0).cast("long").alias("line"), F.lit("hour").alias("kind"))
    every = hours.unionByName(s.select("user_id", "day", "hour", F.lit(0).cast("long").alias("below"), "event_id", F.col("second").alias("line"), "kind"))
    node = F.row_number().over(Window.partitionBy("user_id").orderBy("day", "hour", F.col("event_id").asc_nulls_first())).cast("long")
    rows = cut(every.select("user_id", "kind", "line", node.alias("node"), "below").withColumn("last", F.col("node") + F.col("below")))
    return rows, rows.where("kind = 'error' or kind = 'hour' and below > 3").select("user_id", "node")


@query("SELECT user_id, node, last, kind FROM pr", NODES)
def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lie in no damaged subtree: those of errors, and of hours with more than three events."""
    rows, damaged = _nodes(spark, sf_dir)
    return owners.pruned(rows, damaged, "user_id").select("user_id", "node", "last", "kind")


@query("SELECT DISTINCT user_id, line FROM ns WHERE kind <> 'hour' AND (user_id, line) NOT IN (SELECT (user_id, line) FROM pr WHERE kind <> 'hour')", NODES)
def unanalyzed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that only pruned nodes have."""
    rows, damaged = _nodes(spark, sf_dir)
    rows = cut(rows.withColumn("lines", F.when(F.col("kind") != "hour", F.array("line")).otherwise(F.array().cast("array<bigint>"))))
    return owners.lost_lines(rows, owners.pruned(rows, damaged, "user_id"), "user_id")


# ignore files and the chain of filters of a check

#: Ignore files by folder, as a tree of the pages' paths might hold them.
IGNORE = [("", "*.mjs\n/blog.th*/es/\n!keep.mjs\n"), ("blog.tionsh.example.net", "en/*\n!en/1*\nde\n"), ("blog.tionsh.example.net/en", "[2-4]*.java\n"), ("blog.tiontion.example.com", "en/\n!853.java\n"), ("www.ththhe.example.com/en", "!*.java\n*.html\n# nothing\n\\#x\n")]
IGNORE_BASE = [*IGNORE[:2], ("", "")]
RULES_SQL = lambda files, name: f"{name}(folder, line, regex, negated, folders_only) AS (VALUES " + ", ".join(
    f"('{f}', {n}, '{r}', {str(g).lower()}, {str(d).lower()})" for f, text in files for n, r, g, d in ignore.parse(text)) + ")"
ENTRIES = """en AS (SELECT DISTINCT path, array_to_string(p[1:n], '/') AS entry, n < len(p) AS is_folder, n FROM (SELECT path, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM paths)),
ab AS (SELECT DISTINCT entry, is_folder, d AS depth, array_to_string(p[1:d], '/') AS folder, array_to_string(p[d + 1:], '/') AS rest FROM (SELECT entry, is_folder, string_split(entry, '/') AS p, unnest(range(0, len(string_split(entry, '/')))) AS d FROM en))"""
DECIDED = lambda rules, name: f"""{name} AS (SELECT DISTINCT path FROM en WHERE (entry, is_folder) IN (SELECT (entry, is_folder) FROM (SELECT entry, is_folder, arg_max(negated, (depth, line)) AS negated
FROM ab JOIN {rules} USING (folder) WHERE regexp_matches(rest, regex) AND (is_folder OR NOT folders_only) GROUP BY ALL) WHERE NOT negated))"""  # noqa: E731


def _rules(spark, files):
    rows = [(f"{folder}/{ignore.NAME}".lstrip("/"), text) for folder, text in files]
    return ignore.rules(spark.createDataFrame(rows, "path string, text string"))


@query("SELECT page_id, path, path IN (SELECT path FROM gone) AS ignored FROM paths", (PATHS, RULES_SQL(IGNORE, "ru"), ENTRIES, DECIDED("ru", "gone")))
def ignore_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that the ignore files of their folders ignore."""
    return ignore.ignored(A.paths(spark, sf_dir), _rules(spark, IGNORE)).select("page_id", "path", "ignored")


@query("SELECT page_id, path, path IN (SELECT path FROM gone) AND path IN (SELECT path FROM gone_b) AS ignored FROM paths", (PATHS, RULES_SQL(IGNORE, "ru"), RULES_SQL(IGNORE_BASE, "rb"), ENTRIES, DECIDED("ru", "gone"), DECIDED("rb", "gone_b")))
def ignored_by_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that the ignore files of the base and those of the candidate ignore."""
    return ignore.skipped(A.paths(spark, sf_dir), _rules(spark, IGNORE_BASE), _rules(spark, IGNORE)).select("page_id", "path", "ignored")


def _glob_sql(globs: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(path, '{discovery.glob_regex(discovery.anywhere(g))}')" for g in globs) + ")"


INCLUDE, EXCLUDE = ["blog.*", "m.*", "www.*", "*.example.org"], ["**/9*", "m.th*/fr/"]
KIND = "CASE WHEN starts_with(path, 'spam') THEN 'submodule' WHEN path LIKE '%/es/%' AND page_id > 100 THEN 'symlink' WHEN path LIKE '%/fr/%' AND page_id > 150 THEN 'special' WHEN path LIKE 'blog.ththon%' THEN 'nested_checkout' ELSE 'file' END"


@query(f"""SELECT page_id, path, CASE WHEN kind IN ('submodule', 'nested_checkout', 'symlink') THEN kind WHEN kind = 'special' THEN 'special_file' WHEN NOT {_glob_sql(INCLUDE)} THEN 'outside_include' WHEN {_glob_sql(EXCLUDE)} THEN 'config_exclude' END AS reason, size > 1048576 AS too_large
FROM (SELECT p.page_id, path, {KIND.replace('page_id', 'p.page_id')} AS kind, octet_length(encode(html)) * 300 AS size FROM paths p JOIN pages g ON g.page_id = p.page_id) WHERE kind IN ('submodule', 'nested_checkout') OR regexp_matches(path, '[.](java|js|jsx|mjs|cjs|ts|tsx|rs)$')""", (PATHS,))
def check_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check lists of the pages' paths, and why it leaves some out."""
    size = A.table(spark, sf_dir, "pages").select("page_id", (F.octet_length("html") * 300).cast("long").alias("size"))
    entries = A.paths(spark, sf_dir).join(size, "page_id").withColumn("kind", F.expr(KIND.replace("starts_with", "startswith")))
    return ignore.chain(entries, INCLUDE, EXCLUDE).select("page_id", "path", "reason", "too_large")


# the load plan of a check


@query("""SELECT side, path, oid, CASE WHEN (oid, language) IN (SELECT (oid, language) FROM base WHERE path NOT LIKE 'src2/%') THEN 'hit' ELSE 'miss' END AS action FROM (
SELECT 'base' AS side, path, oid, language FROM base WHERE path IN (SELECT path FROM df WHERE status <> 'added' UNION ALL SELECT from_path FROM rn) UNION ALL SELECT 'candidate', path, oid, language FROM cand)""", REN)
def load_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of both sides that a check analyses; the store has the base's contents but those of one folder."""
    base, cand = _sides(spark, sf_dir)
    diff = cut(matching.tree_diff(base, cand))
    return cache.load_plan(base, cand, diff, matching.exact_renames(diff), base.where("path not like 'src2/%'"))


# summaries of a check

CHANGED = FIND + (
    FAMILIES, A.callables_sql("cand", "cc_"), "ch AS (SELECT c.path FROM cand c LEFT JOIN rn ON rn.path = c.path LEFT JOIN base b ON b.path = coalesce(rn.from_path, c.path) WHERE b.oid IS DISTINCT FROM c.oid)",
    "c1 AS (SELECT * FROM cc_ WHERE path IN (SELECT path FROM ch))",
    """sc AS (SELECT 'changed' AS scope, path, language, sloc FROM c1 UNION ALL SELECT 'full', path, language, sloc FROM cc_)""",
    """fl AS (SELECT 'changed' AS scope, language, path, line FROM cf WHERE path IN (SELECT path FROM ch) UNION ALL SELECT 'full', language, path, line FROM cf)""",
    f"er AS (SELECT 'changed' AS scope, * FROM ({EROSION.format(fam='fam', calls='c1')}) UNION ALL SELECT 'full', * FROM ({EROSION.format(fam='fam', calls='cc_')}))",
    "sn AS (SELECT scope, coalesce(language, 'overall') AS family, sum(sloc) AS s FROM sc GROUP BY GROUPING SETS ((scope, language), (scope)))",
    "fn AS (SELECT scope, coalesce(language, 'overall') AS family, count(*) AS f FROM fl GROUP BY GROUPING SETS ((scope, language), (scope)))",
)


def _changed(spark, sf_dir):
    base, cand = _sides(spark, sf_dir)
    return cut(matching.changed_entities(base, cand, _renames(spark, sf_dir)).select("path"))


@query("""SELECT scope, family, erosion, coalesce(f, 0)::BIGINT AS flagged_lines, coalesce(s, 0)::BIGINT AS scanned_lines, round(CASE WHEN coalesce(s, 0) = 0 THEN 0.0 ELSE coalesce(f, 0) / s END, 6) AS ratio, true AS complete
FROM er LEFT JOIN sn USING (scope, family) LEFT JOIN fn USING (scope, family)""", CHANGED)
def check_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erosion and verbosity of the candidate, over its changed files and over all."""
    cand = A.snapshot(spark, sf_dir, "cand").drop("oid")
    scanned = A.with_lines(cand).select("path", "language", F.size("lines").cast("long").alias("lines"), F.lit(False).alias("failed"))
    return metrics.summaries(A.callables(cand), scanned, _findings(cand).select("language", "path", "line"), _changed(spark, sf_dir), LANGS)


@query("""SELECT ch.path, c.path IS NOT NULL AS analyzed, CASE WHEN c.path IS NULL THEN NULL WHEN c.failed THEN c.sloc ELSE coalesce(g.lost, 0) END::BIGINT AS unanalyzed_lines, c.path IS NOT NULL AND NOT c.failed AND g.path IS NULL AS complete, coalesce(g.spans, '') AS gaps
FROM ch LEFT JOIN (SELECT path, sloc, ends_with(path, '7.de') AS failed FROM cc_ WHERE language <> 'es') c USING (path) LEFT JOIN (SELECT path, sum(e - s + 1) AS lost, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM
(SELECT path, min(line) AS s, max(line) AS e FROM (SELECT path, line, line - dense_rank() OVER (PARTITION BY path ORDER BY line) AS g FROM (SELECT DISTINCT path, line FROM cf)) GROUP BY path, g) GROUP BY path) g USING (path)""", CHANGED)
def changed_file_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each changed file was analysed: Spanish files can't be read, some German ones fail, and repeats stand for damage."""
    cand = A.snapshot(spark, sf_dir, "cand").drop("oid")
    read = A.callables(cand).where("language <> 'es'").select("path", F.col("sloc").alias("lines"), F.endswith("path", F.lit("7.de")).alias("failed"))
    gaps = _findings(cand).select("path", F.col("line").alias("start"), F.col("line").alias("end"))
    made = metrics.file_coverage(_changed(spark, sf_dir), read, gaps)
    return made.withColumn("gaps", F.array_join(F.transform("gaps", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ","))


@query("""SELECT path, line, rule, CASE WHEN (path, rule, line) IN (SELECT (path, rule, line + 1) FROM dir) THEN 'suppressed' ELSE 'reported' END AS state FROM fnd
UNION ALL SELECT path, line, rule, 'unused' FROM dir WHERE (path, rule, line) NOT IN (SELECT (path, rule, line - 1) FROM fnd)""", SUP)
def suppression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of all files as reported or suppressed, and the directives that suppress nothing."""
    found = A.statements(A.files(spark, sf_dir)).withColumn("prev", F.lag("token").over(Window.partitionBy("path").orderBy("ix"))).where("token = prev").select("path", "line", F.lit("REPEAT").alias("rule"))
    directives = A.statements(A.files(spark, sf_dir)).where(F.col("token").rlike("^[A-M]")).select("path", "line", F.lit("REPEAT").alias("rule"))
    return policy.suppression_report(found, directives)
