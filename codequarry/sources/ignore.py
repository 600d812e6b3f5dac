"""Ignore files at every folder level, the chain of filters of a check, and its masking of built-in exclusions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import discovery

NAME = ".gitignore"
RULES = "folder string, line long, regex string, negated boolean, folders_only boolean"


def parse(text: str) -> list[tuple[int, str, bool, bool]]:
    """(line, regular expression of a path below the file's folder, negated, for folders only) of the rules of an ignore file."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        rule = line.removesuffix("\r")
        while rule.endswith(" ") and not rule.endswith("\\ "):
            rule = rule[:-1]
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[negated:]
        folders = rule.endswith("/")
        rule = rule.rstrip("/") if folders else rule
        if not rule.strip("/"):
            continue
        glob = rule.removeprefix("/") if "/" in rule else "**/" + rule
        out.append((n, discovery.glob_regex(glob).removesuffix(discovery.BELOW) + "$", negated, folders))
    return out


def rules(files: DataFrame) -> DataFrame:
    """(folder, line, regex, negated, folders_only) of all ignore files among ``files(path, text)``; the root folder is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path.rpartition("/")[0], *r) for path, text in zip(*(c.to_pylist() for c in b.columns)) for r in parse(text or "")]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["folder", "line", "regex", "negated", "folders_only"])

    return files.where(F.element_at(F.split("path", "/"), -1) == NAME).select("path", "text").mapInArrow(run, RULES)


def _heads(path: Column, first: int) -> Column:
    """(n, head) of the first n segments of a path, n from ``first`` to all of them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(first), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("head")))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths(path, ...)`` with ``ignored``, by rules as ``rules`` gives them.

    Every folder on the way and the file itself is an entry. Of all rules of the folders above an entry that match it, the deepest folder's last line decides, and a folder that is ignored takes all
    below it along, whatever rules say there. Each different entry is decided once; it meets rules by an equi-join on their folder.
    """
    size = F.size(F.split("path", "/"))
    on_way = paths.select("path").distinct().select("path", F.explode(_heads(F.col("path"), 1)).alias("e"), size.alias("size"))
    on_way = on_way.select("path", F.col("e.head").alias("entry"), (F.col("e.n") < F.col("size")).alias("is_folder"))
    entries = on_way.select("entry", "is_folder").distinct()
    parts = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("rest")))
    each = entries.select("entry", "is_folder", F.explode(above).alias("a")).select("entry", "is_folder", "a.*")
    hit = each.join(rules, "folder").where(F.call_function("regexp_like", F.col("rest"), F.col("regex")) & (F.col("is_folder") | ~F.col("folders_only")))
    last = hit.groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct("depth", "line")).alias("negated")).where("not negated").select("entry", "is_folder")
    gone = on_way.join(last, ["entry", "is_folder"], "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return paths.join(gone, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def skipped(paths: DataFrame, base_rules: DataFrame, cand_rules: DataFrame) -> DataFrame:
    """``paths`` with ``ignored``: whether the rules of both sides ignore it, so that a candidate can't hide files by a rule of its own."""
    both = ignored(ignored(paths, base_rules).withColumnRenamed("ignored", "_base"), cand_rules)
    return both.withColumn("ignored", F.col("_base") & F.col("ignored")).drop("_base")


def built_in(path: Column) -> Column:
    """Whether a check leaves a path out always: below ``.git``, or a dependency, build output or generated code."""
    globs = [g for found in discovery.built_in(include_tests=True).values() for g in found]
    return path.rlike("(^|/)[.]git(/|$)") | discovery.matches(path, globs)


def chain(entries: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Entries that a check lists, of ``entries(path, kind, size, ...)``, with ``reason`` (null: analysed), ``language``, ``too_large`` and ``non_utf8_path``.

    ``kind`` is file, symlink, submodule, nested_checkout or special. Submodules and nested checkouts are listed whatever their name; of the rest only files of a known extension. The first of these holds:
    submodule, nested_checkout, symlink, special_file, builtin_exclusion, outside_include, config_exclude. ``path`` is text, or bytes as a file system gives them.
    """
    if dict(entries.dtypes)["path"] == "binary":
        entries = entries.withColumn("non_utf8_path", ~F.is_valid_utf8(F.col("path"))).withColumn("path", F.col("path").cast("string"))
    else:
        entries = entries.withColumn("non_utf8_path", ~F.is_valid_utf8("path"))
    path, kind, language = F.col("path"), F.col("kind"), discovery.language(F.col("path"))
    of = lambda globs: discovery.matches(path, [discovery.anywhere(g) for g in globs])
    reason = F.when(kind == "submodule", "submodule").when(kind == "nested_checkout", "nested_checkout").when(kind == "symlink", "symlink").when(kind == "special", "special_file")
    reason = reason.when(built_in(path), "builtin_exclusion")
    if include is not None:
        reason = reason.when(~of(include), "outside_include")
    if exclude:
        reason = reason.when(of(exclude), "config_exclude")
    listed = entries.where(kind.isin("submodule", "nested_checkout") | language.isNotNull())
    return listed.withColumns({"reason": reason, "language": language, "too_large": F.col("size") > discovery.CEILING})


def masked(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` without built-in exclusions. Applied to both sides of a comparison, so that what a check never reads is no deleted file either."""
    return files.where(~built_in(F.col("path")))
