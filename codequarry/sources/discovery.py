"""File discovery: languages, globs, skip reasons, pruning, ignore rules, size ceiling, caches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {"java": "java", "js": "js_ts", "jsx": "js_ts", "mjs": "js_ts", "cjs": "js_ts", "ts": "js_ts", "tsx": "js_ts", "rs": "rust"}
CEILING = 1 << 20
#: Globs that are excluded unless asked for, by reason. A glob without an inner slash matches at any depth, one with a last slash a folder.
DEPENDENCY_OR_BUILD = ["node_modules/", "target/", "build/", "dist/", "out/", "bin/", ".gradle/", ".mvn/", "vendor/", "coverage/", ".next/", ".nuxt/"]
WEBJARS = ["**/META-INF/resources/webjars/**"]
GENERATED = ["**/generated/**", "**/gen/**", "*.min.js", "*.bundle.js", "*_pb.js", "*.d.ts"]
TESTS = [
    "**/test/**", "**/tests/**", "**/__tests__/**", "**/__mocks__/**", "**/testFixtures/**", "**/src/test/**", "*Test.java", "*Tests.java", "*TestCase.java", "*.test.*", "*.spec.*", "**/fixture/**",
    "**/fixtures/**", "**/__fixtures__/**", "**/e2e/**", "**/qa/**", "*.e2e-spec.*",
]


def target_kind(target: Column) -> Column:
    """``remote`` for an address of a public repository host, else ``local``: a folder."""
    return F.when(target.startswith("https://github.com/") | target.startswith("http://github.com/"), "remote").otherwise("local")


def anywhere(glob: str) -> str:
    """A glob without an inner slash as one that matches at any depth."""
    return glob if "/" in glob.rstrip("/") else "**/" + glob.rstrip("/") + ("/**" if glob.endswith("/") else "")


def built_in(include_tests: bool = False, exclude: list[str] | None = None) -> dict[str, list[str]]:
    """Globs by skip reason, in order of precedence, for ``skip_reason``. A check gates test files too and includes them."""
    out = {"dependency_or_build_output": DEPENDENCY_OR_BUILD + WEBJARS, "generated_code": GENERATED} | ({} if include_tests else {"test": TESTS}) | ({"user_exclude": exclude} if exclude else {})
    return {reason: [anywhere(g) for g in globs] for reason, globs in out.items()}


def extension(path: Column) -> Column:
    """Extension of the last path segment, empty for none; a leading dot starts no extension."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """Language of a path or null."""
    ext = extension(path)
    out = F.when(ext.isin([e for e, x in LANGUAGES.items() if x == "java"]), "java").when(ext.isin([e for e, x in LANGUAGES.items() if x == "js_ts"]), "js_ts")
    return out.when(ext == "rs", "rust")


#: Named classes of a bracket, over ASCII.
CLASSES = {
    "alnum": "A-Za-z0-9", "alpha": "A-Za-z", "blank": " \\t", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": "!-/:-@\\[-`{-~", "space": " \\t\\n\\f\\r", "upper": "A-Z", "xdigit": "0-9A-Fa-f",
}
NEVER = "(?!)"
#: Tail of a glob's expression, for what lies below a match.
BELOW = "(?:/.*)?$"


def _bracket(glob: str, at: int) -> tuple[str, int] | None:
    """(expression, place after it) of the bracket that opens at ``at``; None if it never closes or names an unknown class: such a glob matches nothing."""
    quoted = lambda c: c if c.isalnum() else "\\" + c
    i = at + 1
    negated = glob[i : i + 1] in ("!", "^")
    i += negated
    first, body = i, ""
    while i < len(glob) and (glob[i] != "]" or i == first):
        end = glob.find("]", i + 2) if glob.startswith("[:", i) else 0
        if end < 0:
            return None
        if end > i + 2 and glob[end - 1] == ":":
            if glob[i + 2 : end - 1] not in CLASSES:
                return None
            body, i = body + CLASSES[glob[i + 2 : end - 1]], end + 1
            continue
        low, i = _member(glob, i)
        if glob[i : i + 1] == "-" and glob[i + 1 : i + 2] not in ("", "]"):
            high, i = _member(glob, i + 1)
            body += f"{quoted(low)}-{quoted(high)}" if low <= high else ""
        else:
            body += quoted(low)
    if i >= len(glob):
        return None
    return ("(?!/)[" + "^" * negated + body + "]" if body else "[^/]" if negated else NEVER), i + 1


def _member(glob: str, i: int) -> tuple[str, int]:
    """A character of a bracket, maybe behind a backslash, and the place after it."""
    i += glob[i] == "\\" and i + 1 < len(glob)
    return glob[i], i + 1


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob: ``*`` and ``?`` stay in a segment, ``**`` spans whole segments, ``[...]`` is a class, with ranges, escapes and named classes.

    The path or any of its ancestor folders may match, so a match may be followed by a slash and more.
    """
    out, i, n = "", 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == n or glob[i + 2] == "/"):
            out, i = (out + "(?:.*/)?", i + 3) if i + 2 < n else (out + ".*", i + 2)
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            made = _bracket(glob, i)
            if made is None:
                return NEVER
            out, i = out + made[0], made[1]
            continue
        elif c == "\\" and i + 1 < n:
            out, i = out + re.escape(glob[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}{BELOW}"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether the path or one of its folders matches any glob; one alternation, compiled once."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def skip_reason(path: Column, globs: dict[str, list[str]]) -> Column:
    """First reason, in the order of ``globs``, one of whose globs matches; null if none does."""
    out = None
    for label, patterns in globs.items():
        out = F.when(matches(path, patterns), label) if out is None else out.when(matches(path, patterns), label)
    return out


def ignored(paths: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """``paths`` with ``ignored``: the last rule (glob, negated) that matches decides; no match keeps the path."""
    last = F.greatest(*[F.when(matches(F.col("path"), [g]), F.lit(i + 1)).otherwise(F.lit(0)) for i, (g, _) in enumerate(rules)], F.lit(0), F.lit(0))
    drops = [i + 1 for i, (_, negated) in enumerate(rules) if not negated]
    return paths.withColumn("ignored", last.isin(drops))


def prune_nested(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths that lie under none of ``roots(prefix)``, and one row for each root that has any: (path, reason)."""
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")))
    under = paths.select("path", prefixes.alias("prefix")).join(roots, "prefix", "left_semi")
    kept = paths.join(under, "path", "left_anti").select("path", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(under.select(F.col("prefix").alias("path"), F.lit("nested_checkout").alias("reason")).distinct())


def folder_rollup(skipped: DataFrame) -> DataFrame:
    """(folder, reason, n, total, place): skipped files at or below each folder by reason, the most frequent first."""
    parts = F.split("path", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    counts = skipped.select(up.alias("folder"), "reason").groupBy("folder", "reason").agg(F.count("*").alias("n"))
    w = Window.partitionBy("folder")
    return counts.select("folder", "reason", "n", F.sum("n").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("n"), "reason")).cast("long").alias("place"))


def merged_folders(skipped: DataFrame) -> DataFrame:
    """(folder, name, total): folders with skipped files at or below them, chains of folders that hold nothing but one folder as one.

    ``name`` is the way from the next folder above that is shown, so ``a/b/c`` where ``a`` and ``a/b`` hold one folder only.
    """
    head = lambda path, n: F.array_join(F.slice(F.split(path, "/"), 1, n), "/")
    heads = lambda path, n: F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: head(path, k)))
    depth, level = F.size(F.split("path", "/")) - 1, F.size(F.split("folder", "/"))
    inside = skipped.where(depth > 0)
    counts = inside.select(heads("path", depth).alias("folder")).groupBy("folder").agg(F.count("*").alias("total"))
    own = inside.select(head("path", depth).alias("folder")).distinct().withColumn("own", F.lit(True))
    inner = counts.where(level > 1).select(head("folder", level - 1).alias("folder")).groupBy("folder").agg(F.count("*").alias("inner"))
    shown = counts.join(own, "folder", "left").join(inner, "folder", "left").where("own or coalesce(inner, 0) <> 1").select("folder", "total")
    above = shown.select("folder", heads("folder", level).alias("above")).where("above <> folder")
    nearest = above.join(shown.select(F.col("folder").alias("above")), "above", "left_semi").groupBy("folder").agg(F.max_by("above", F.length("above")).alias("above"))
    name = F.when(F.col("above").isNull(), F.col("folder")).otherwise(F.substr("folder", F.length("above") + F.lit(2)))
    return shown.join(nearest, "folder", "left").select("folder", name.alias("name"), "total")


def cache_misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose (oid, language) no cached analysis has."""
    return files.join(cached.select("oid", "language").distinct(), ["oid", "language"], "left_anti")


def evict(entries: DataFrame, budget: int, oldest: int) -> DataFrame:
    """``entries(key, size, age)`` with ``evicted``: too old, or beyond ``budget`` bytes counted from the youngest.

    The running sum is over sizes grouped by age bucket first, so the window sees one row per age.
    """
    by_age = entries.where(F.col("age") <= oldest).groupBy("age").agg(F.sum("size").alias("s"))
    total = by_age.select("age", F.sum("s").over(Window.orderBy("age").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.coalesce("before", F.lit(0)) + F.sum("size").over(Window.partitionBy("age").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    return entries.join(total, "age", "left").select("key", "size", "age", ((F.col("age") > oldest) | (inside > budget)).alias("evicted"))
