"""Duplicate runs of statements: containers, tokens, candidates, groups, the maximal filter and redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut
from . import spans

SEP = "\x01"
#: Files whose hashes may be broadcast, so that the others' texts stay where they are.
FILES = 1 << 20


def containers(statements: DataFrame) -> DataFrame:
    """(path, language, n) of files with at least two statements."""
    return statements.groupBy("path", "language").agg(F.count("*").alias("n")).where("n >= 2")


def token_streams(files: DataFrame) -> DataFrame:
    """(path, n, digest): number of statements and SHA-256 of the tokens in order, of ``files(path, lines)``."""
    tokens = F.transform("lines", lambda x: x["token"])
    return files.select("path", F.size("lines").cast("long").alias("n"), F.sha2(F.array_join(tokens, SEP).cast("binary"), 256).alias("digest"))


def _pair_counts(base: DataFrame) -> DataFrame:
    """(path, ix, count, before, after) of adjacent pairs that repeat in their language: occurrences of the pair, and of it with the statement before and after.

    ``before`` and ``after`` are null at the ends of a file. Pairs and triples are counted with map-side combine; no text is shuffled.
    """
    digest = lambda i, n: F.sha2(F.concat_ws(SEP, *[F.element_at("tokens", i + k) for k in range(n)]).cast("binary"), 256)
    size = F.size("tokens")
    both = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.struct(digest(i, 2).alias("pair"), F.when(i < size - 1, digest(i, 3)).alias("triple")))
    rows = base.where(size >= 2).select("path", "language", F.posexplode(both).alias("ix", "p")).select("path", "language", "ix", "p.pair", "p.triple")
    often = rows.groupBy("language", "pair").agg(F.count("*").alias("count")).where("count >= 2")
    longer = rows.where("triple is not null").groupBy("language", "triple").agg(F.count("*").alias("after")).where("after >= 2")
    hits = rows.join(often, ["language", "pair"]).join(longer, ["language", "triple"], "left")
    after = F.when(F.col("triple").isNotNull(), F.coalesce("after", F.lit(1)))
    at = Window.partitionBy("path").orderBy("ix")
    near = F.lag("ix").over(at) == F.col("ix") - 1  # else the pair before does not repeat, and so neither does this one with it
    hits = hits.select("path", "ix", "count", after.alias("after")).withColumn("before", F.when(near, F.lag("after").over(at)))
    return hits.withColumn("island", F.col("ix") - F.row_number().over(at))


def candidates(files: DataFrame, min_lines: int = 3) -> DataFrame:
    """(key, language, path, first, start, end, n, lines): runs of at least two statements and ``min_lines`` lines that may repeat, all of them.

    Every adjacent pair of a repeated run is itself repeated in its language, so only stretches of repeated pairs are enumerated.
    """
    base = _base(files)
    places = _pair_counts(base).groupBy("path", "island").agg(F.collect_list("ix").alias("begins"))  # pairs of one file
    runs = places.select("path", F.explode("begins").alias("a"), "begins").select("path", "a", F.explode(F.filter("begins", lambda e: e - F.col("a") + 2 >= max(2, min_lines))).alias("e"))
    runs = runs.select("path", "a", (F.col("e") + 1).alias("b")).join(base, "path")
    n = F.col("b") - F.col("a") + 1
    line = lambda i: F.element_at("at", F.col(i) + 1).alias({"a": "start", "b": "end"}[i])
    return runs.select(_name(F.slice("tokens", F.col("a") + 1, n)).alias("key"), "language", "path", (F.col("a") + 1).cast("long").alias("first"), line("a"), line("b"), n.cast("long").alias("n"), F.slice("at", F.col("a") + 1, n).alias("lines"))


def _base(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.transform("lines", lambda x: x["token"]).alias("tokens"), F.transform("lines", lambda x: x["line"]).alias("at"))


def _name(tokens):
    """SHA-256 of a run of tokens in its language."""
    return F.sha2(F.concat_ws(SEP, F.concat(F.lit("language:"), F.col("language")), tokens).cast("binary"), 256)


def _windows(files: DataFrame, n: int) -> DataFrame:
    """(path, ix, x, y, before, after): name of each stretch of ``n`` statements in its language, 128 bits, and hashes of the statements beside it, null at the ends of a file. ``ix`` counts from 0."""
    base = _hashed(files).where(F.size("x") >= n)
    name = lambda c, i: F.xxhash64("language", *[F.get(c, i + k) for k in range(n)])
    each = F.transform(F.sequence(F.lit(0), F.size("x") - n), lambda i: F.struct(name("x", i).alias("x"), name("y", i).alias("y"), F.get("x", i - 1).alias("before"), F.get("x", i + n).alias("after")))
    return base.select("path", F.posexplode(each).alias("ix", "w")).select("path", "ix", "w.x", "w.y", "w.before", "w.after")


def _hashed(files: DataFrame) -> DataFrame:
    """(path, language, x, y, at): two hashes and the line of each statement. No text goes through a shuffle."""
    one = lambda name: F.transform("lines", lambda t: F.xxhash64(F.lit(name), t["token"])).alias(name)
    return files.select("path", "language", one("x"), one("y"), F.transform("lines", lambda t: t["line"].cast("int")).alias("at"))


def _open(rows: DataFrame) -> DataFrame:
    """(x, y, members, open_before, open_after): names that occur twice or more, and whether what stands beside them differs, as an end of a file does from all."""
    n, sides = F.count("*"), ("before", "after")
    made = rows.groupBy("x", "y").agg(n.alias("members"), *[(F.count(c) < n).alias(f"_end_{c}") for c in sides], *[f(c).alias(f"_{f.__name__}_{c}") for c in sides for f in (F.min, F.max)])
    return made.where("members >= 2").select("x", "y", "members", *[F.coalesce(F.col(f"_end_{c}") | (F.col(f"_min_{c}") != F.col(f"_max_{c}")), F.lit(True)).alias(f"open_{c}") for c in sides])


def _stretches(files: DataFrame, w: int) -> DataFrame:
    """(path, language, off, begins, ends, x, y, at), written: stretches of windows of ``w`` statements that repeat, with the statement on either side, its places counted from ``off``, and where runs may begin and end."""
    rows = _windows(files, w)
    hits = rows.join(_open(rows), ["x", "y"]).select("path", "ix", "open_before", "open_after")
    hits = hits.withColumn("island", F.col("ix") - F.row_number().over(Window.partitionBy("path").orderBy("ix")))
    listed = lambda side: F.collect_list(F.when(F.col(side), F.col("ix")))  # windows of one file
    places = hits.groupBy("path", "island").agg(listed("open_before").alias("begins"), listed("open_after").alias("ends")).where("size(begins) > 0 and size(ends) > 0")
    at = places.withColumns({"off": F.greatest(F.array_min("begins") - 1, F.lit(0)), "stop": F.array_max("ends") + w}).join(_hashed(files), "path")
    part = lambda c: F.slice(c, F.col("off") + 1, F.col("stop") - F.col("off") + 1).alias(c)
    moved = lambda c: F.transform(c, lambda i: i - F.col("off")).alias(c)
    return cut(at.select("path", "language", "off", moved("begins"), moved("ends"), part("x"), part("y"), part("at")))


def _listed(rows: DataFrame, w: int, beside: bool = False) -> DataFrame:
    """(x, y, language, path, first, start, end, n): all runs of ``_stretches`` from a begin to an end; ``beside`` adds the names of the runs of one more statement, (lx, ly) to the left and (rx, ry) to the right, null at the ends of a file."""
    longest = rows.select(F.max(F.array_max("ends") - F.array_min("begins")).alias("n")).first().n
    levels = ((longest or 0) + w + 1).bit_length()
    for name in ("x", "y"):
        rows = rows.withColumn(f"_{name}0", F.col(name))
        for k in range(1, levels):  # 2**k tokens from each place on: two halves; null where they don't fit
            before, half = F.col(f"_{name}{k - 1}"), 1 << (k - 1)
            later = F.slice(before, half + 1, F.greatest(F.size(before) - half, F.lit(0)))
            rows = rows.withColumn(f"_{name}{k}", F.zip_with(before, later, lambda p, q: F.when(q.isNotNull(), F.xxhash64(p, q))))
    rows = rows.select("path", "language", "off", "at", "begins", "ends", *[F.array(*[F.col(f"_{name}{k}") for k in range(levels)]).alias(name) for name in ("x", "y")])

    def name(a, n, *to):
        k = F.floor(F.log2(n.cast("double") + 0.5)).cast("int")
        last = a + n - F.call_function("shiftleft", F.lit(1), k)
        part = lambda c: F.xxhash64(F.col("language"), n, F.get(F.get(F.col(c), k), a), F.get(F.get(F.col(c), k), last))
        there = (a >= 0) & (a + n <= F.size("at"))
        return [F.when(there, part(c)).alias(c_to) for c, c_to in zip(("x", "y"), to)]

    def run(a, e):
        n = e - a + w
        more = [*name(a - 1, n + 1, "lx", "ly"), *name(a, n + 1, "rx", "ry")] if beside else []
        of = [(F.col("off") + a + 1).cast("long").alias("first"), F.get("at", a).cast("long").alias("start"), F.get("at", e + w - 1).cast("long").alias("end"), n.cast("long").alias("n")]
        return F.struct(*name(a, n, "x", "y"), *of, *more)

    each = F.flatten(F.transform("begins", lambda a: F.transform(F.filter("ends", lambda e: e >= a), lambda e: run(a, e))))
    names = ["x", "y", "first", "start", "end", "n"] + ["lx", "ly", "rx", "ry"] * beside
    return rows.select("language", "path", F.explode(each).alias("r")).select("language", "path", *[f"r.{c}" for c in names])


def open_candidates(files: DataFrame, min_lines: int = 3) -> DataFrame:
    """(key, language, path, first, start, end, n): the runs of ``candidates`` that can be in a maximal group.

    A run must begin where the statement before differs among the occurrences of its first window, and end where the one after its last window does: all others are
    contained, member by member, in a run of one more statement, so the maximal groups are the same, and a stretch of any length that two files share is one run. A window is the
    shortest run there may be. A run's key is 128 bits made of hashes of its first and its last 2**k tokens, which overlap, so it takes the same time for runs of any length, and no text and no list of lines goes with it.
    """
    w = max(2, min_lines)
    return _listed(_stretches(files, w), w).select(_key(), "language", "path", "first", "start", "end", "n")


def _key():
    return F.concat_ws("-", F.hex("x"), F.hex("y")).alias("key")


def _kept(runs: DataFrame) -> DataFrame:
    """(x, y, members) of the groups of ``_listed(..., beside=True)`` that no group of one more statement contains member by member.

    Such a group's name stands to the left or to the right of each member. Names beside are counted with map-side combine, so that a file of n equal lines, with
    n * n / 2 runs, sends some n rows; and as many members as a name has to one side, so often it occurs itself.
    """
    beside = lambda x, y, r, l: F.struct(F.col(x).alias("px"), F.col(y).alias("py"), F.lit(r).alias("r"), F.lit(l).alias("l"))  # noqa: E731, E741
    alike = F.col("lx").eqNullSafe(F.col("rx")) & F.col("ly").eqNullSafe(F.col("ry"))
    each = runs.select("x", "y", F.explode(F.when(alike, F.array(beside("rx", "ry", 1, 1))).otherwise(F.array(beside("rx", "ry", 1, 0), beside("lx", "ly", 0, 1)))).alias("b"))
    counts = each.groupBy("x", "y", "b.px", "b.py").agg(F.count("*").alias("c"), F.sum("b.r").alias("r"), F.sum("b.l").alias("l"))
    held = F.max(F.when(F.col("px").isNotNull() & (F.greatest("r", "l") >= 2), F.col("c")))
    return counts.groupBy("x", "y").agg(F.sum("r").alias("members"), held.alias("held")).where("members >= 2 and coalesce(held, 0) < members").select("x", "y", "members")


def maximal_members(files: DataFrame, min_lines: int = 3) -> DataFrame:
    """(key, language, path, first, start, end, n, members) of the maximal groups of ``files``; keys are those of ``open_candidates``."""
    w = max(2, min_lines)
    rows = _stretches(files, w)
    kept = _listed(rows, w).join(_kept(_listed(rows, w, True)), ["x", "y"])
    found = cut(kept.select(_key(), "language", "path", "first", "start", "end", "n", "members"))
    alike = found.select("key", "path").distinct().groupBy("key").agg(F.bit_xor(F.xxhash64("path")).alias("files"))
    found = cut(found.join(alike, "key"))
    # All places of a run's statements are here, so a group that holds another has the same files. The groups of the next length among those of equal files come first: in
    # periodic texts each holds the one before. What is left is compared with all longer ones, spans that begin a statement or two apart as one: whatever is shorter and lies in it lies in one of them.
    of = ["path", "files"]
    lengths = found.select("files", "n").distinct().withColumn("next", F.min("n").over(Window.partitionBy("files").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))).where("next is not null")
    a = found.join(lengths, ["files", "n"]).select(F.col("key").alias("ka"), *of, "first", "start", "end", F.col("next").alias("nb"), F.col("members").alias("ma"))
    b = found.select(F.col("key").alias("kb"), *of, "start", "end", F.col("n").alias("nb"))
    left = cut(found.join(_held(spans.inside(a, b, [*of, "nb"], ["kb"]).select("ka", "ma", "kb", "path", "first")), "key", "left_anti"))
    near = Window.partitionBy(*of)
    a = left.withColumn("_most", F.max("n").over(near)).where("n < _most").select(F.col("key").alias("ka"), *of, "first", "start", "end", F.col("n").alias("na"), F.col("members").alias("ma"))
    b = left.withColumn("_least", F.min("n").over(near)).where("n > _least")
    at = Window.partitionBy(*of, "key").orderBy("first")
    b = b.withColumn("_new", F.coalesce(F.col("first") - F.lag("first").over(at) > 2, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(at))
    b = b.groupBy(*of, F.col("key").alias("kb"), "_span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("n").alias("nb")).drop("_span")
    inside = spans.inside(a, b, of, ["kb", "nb"]).where("nb > na").select("ka", "ma", "kb", "path", "first")
    return left.join(_held(inside), "key", "left_anti").drop("files")


def maximal_runs(files: DataFrame, min_lines: int = 3, named: bool = True) -> DataFrame:
    """Members of the maximal groups of ``files``, as ``candidates`` gives runs, with ``members``. Unless ``named`` is false, the key is the text's digest, made from one member of a group."""
    found = cut(maximal_members(files, min_lines))
    out = with_lines(found, files)
    return out.join(_names(found, files), "key").select(F.col("name").alias("key"), *out.columns[1:]) if named else out


def with_lines(members: DataFrame, files: DataFrame) -> DataFrame:
    """``members`` with ``lines``, the lines of their statements."""
    at = files.select("path", F.transform("lines", lambda t: t["line"].cast("int")).alias("_at"))
    lines = F.slice("_at", F.col("first").cast("int"), F.col("n").cast("int")).cast("array<bigint>")
    return members.join(at, "path").select(*members.columns, lines.alias("lines"))


def _names(members: DataFrame, files: DataFrame) -> DataFrame:
    """(key, name): SHA-256 of the text of each group, from its first member. Only texts that hold one are shuffled, as long as their files are no more than ``FILES``."""
    first = members.groupBy("key").agg(F.min(F.struct("path", "first", "n")).alias("p")).select("key", "p.path", "p.first", "p.n")
    first = cut(first.groupBy("path").agg(F.collect_list(F.struct("key", "first", "n")).alias("groups")))  # of one file
    base = files.select("path", "language", F.transform("lines", lambda x: x["token"]).alias("tokens"))
    if first.count() <= FILES:
        base = base.withColumn("_h", F.xxhash64("path")).join(F.broadcast(first.select(F.xxhash64("path").alias("_h")).distinct()), "_h", "left_semi").drop("_h")
    name = lambda g: F.struct(g["key"].alias("key"), _name(F.slice("tokens", g["first"].cast("int"), g["n"].cast("int"))).alias("name"))
    return base.join(first, "path").select(F.explode(F.transform("groups", name)).alias("g")).select("g.key", "g.name")


def groups(found: DataFrame) -> DataFrame:
    """Candidates whose key occurs at least twice, with ``members``, the size of their group."""
    sizes = found.groupBy("key").agg(F.count("*").alias("members")).where("members >= 2")
    return found.join(sizes, "key")


def maximal(members: DataFrame) -> DataFrame:
    """Members of groups that no group of longer runs contains member by member.

    Group a falls away exactly if some b of more statements holds each member of a within one of its own in the same file. Containment is
    transitive and length strict, so greedy passes are not needed, and dropped groups need not be asked again. A first pass by equi-join
    drops what a group of one more statement contains, which is nearly all, also in periodic texts; an interval join by cells finds the rest.
    """
    wide = members.select(F.col("key").alias("kb"), "path", (F.col("n") - 1).alias("n"), F.col("first").alias("at"))
    near = members.select(F.col("key").alias("ka"), F.col("members").alias("ma"), "path", "n", "first", F.explode(F.array(F.col("first"), F.col("first") - 1)).alias("at"))
    left = members.join(_held(near.join(wide, ["path", "n", "at"]).select("ka", "ma", "kb", "path", "first")), "key", "left_anti")
    a = left.select(F.col("key").alias("ka"), "path", "first", "start", "end", F.col("n").alias("na"), F.col("members").alias("ma"))
    b = left.select(F.col("key").alias("kb"), "path", "start", "end", F.col("n").alias("nb"))
    inside = spans.inside(a, b, ["path"], ["kb", "nb"]).where("nb > na").select("ka", "ma", "kb", "path", "first")
    return left.join(_held(inside), "key", "left_anti")


def _held(inside: DataFrame) -> DataFrame:
    """Keys of groups all of whose members are in ``inside(ka, ma, kb, path, first)`` for some kb."""
    counts = inside.distinct().groupBy("ka", "kb", "ma").agg(F.count("*").alias("c"))
    return counts.where("c = ma").select(F.col("ka").alias("key")).distinct()


def redundancy(members: DataFrame) -> DataFrame:
    """One row per group: all executable lines but those of its first member, by path and start. Without a column ``lines`` each statement counts as one."""
    lines = F.size("lines").cast("long") if "lines" in members.columns else F.col("n")
    first = F.min_by(lines, F.struct("path", "start"))
    place = F.min(F.struct("path", "start"))
    return members.groupBy("key", "language").agg(
        F.count("*").alias("members"), F.max("n").alias("statements"), (F.sum(lines) - first).alias("redundant_lines"), place["path"].alias("path"), place["start"].alias("start")
    )


def redundant_lines(members: DataFrame) -> DataFrame:
    """(language, path, line): executable lines of every member but the first of its group."""
    first = members.groupBy("key").agg(F.min(F.struct("path", "start")).alias("place"))
    rest = members.join(first, "key").where(F.struct("path", "start") > F.col("place"))
    return rest.select("language", "path", F.explode("lines").alias("line")).distinct()
