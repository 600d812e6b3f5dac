"""The two programs over real sources: ``scan`` of one tree and ``check`` of a candidate against a base, and their reports.

Both take tables (path, content) as the readers of ``sources.trees`` give them, and return tables; reports are written from small aggregates and capped lists.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clones, findings, lines, matching, metrics, moves, policy, renames
from ..sources import cache, discovery, ignore, lowering, trees
from .scratch import cut

FAMILIES = ["java", "js_ts", "rust"]
MIN_CLONE_LINES = 10
#: Skip reasons of a scan, all of which a report counts.
REASONS = ["dependency_or_build_output", "generated_code", "gitignore", "nested_checkout", "parse_grammar_setup", "parse_syntax_error", "parse_unreadable", "parse_unsupported_extension", "test", "unreadable", "user_exclude"]


@dataclass
class Scan:
    """Tables of one tree: skipped (path, reason); lowered, one row a file; callables; findings; members of maximal duplicate groups; flagged (language, path, line); scores."""

    skipped: DataFrame
    lowered: DataFrame
    callables: DataFrame
    findings: DataFrame
    members: DataFrame
    flagged: DataFrame
    scores: DataFrame


def statement_lines(lowered: DataFrame) -> DataFrame:
    """``lowered`` as containers for ``clones.candidates``: one row a block of at least two statements, its path followed by ``#`` and the block."""
    each = lowered.select("path", "language", F.explode("statements").alias("s")).groupBy("path", "language", "s.block")
    rows = each.agg(F.array_sort(F.collect_list(F.struct(F.col("s.line").alias("line"), F.col("s.token").alias("token"), F.col("s.last").alias("last")))).alias("lines"))  # statements of one block
    return rows.where(F.size("lines") > 1).select(F.concat_ws("#", "path", F.col("block").cast("string")).alias("path"), "language", "lines")


def duplicates(lowered: DataFrame, min_lines: int = MIN_CLONE_LINES) -> DataFrame:
    """Members of the maximal groups of runs with at least ``min_lines`` executable lines: (key, language, path, container, start, end, first, n, members, lines), lines the executable ones."""
    blocks = statement_lines(lowered)
    found = clones.open_candidates(blocks, 2)
    ends = blocks.select("path", F.transform("lines", lambda x: x["last"]).alias("_last"))
    found = found.join(ends, "path").withColumn("end", F.element_at("_last", (F.col("first") + F.col("n") - 1).cast("int"))).drop("_last")
    able = lowered.select(F.col("path").alias("file"), "exec_lines")
    found = found.withColumn("file", F.regexp_replace("path", "#[0-9]+$", "")).join(able, "file")
    found = found.withColumn("lines", F.filter("exec_lines", lambda x: (x >= F.col("start")) & (x <= F.col("end")))).where(F.size("lines") >= min_lines)
    return clones.maximal(clones.groups(cut(found.drop("exec_lines").withColumnRenamed("path", "container").withColumnRenamed("file", "path"))))


def with_tokens(members: DataFrame, lowered: DataFrame) -> DataFrame:
    """``members`` of ``duplicates(lowered)`` with ``tokens``, digests of their statements."""
    each = F.transform("lines", lambda x: F.sha2(x["token"].cast("binary"), 256))
    rows = statement_lines(lowered).select(F.col("path").alias("container"), each.alias("_tokens"))
    return members.join(rows, "container").withColumn("tokens", F.slice("_tokens", F.col("first").cast("int"), F.col("n").cast("int"))).drop("_tokens")


def _moved(runs_b: DataFrame, added: DataFrame, mapped: DataFrame, gone: DataFrame, lb: DataFrame, lc: DataFrame) -> DataFrame:
    """Rows of ``added``, new duplicates, that are moves of base runs of which every line was deleted, or of files that were."""
    whole = runs_b.join(gone, "path", "left_semi")
    deleted = cut(with_tokens(lines.deleted_runs(runs_b, mapped).unionByName(whole).distinct(), lb))
    shape = lambda x, rank: x.select(rank, "language", F.col("container").alias("block"), "first", "tokens", F.size("lines").alias("lines"))
    entries = cut(moves.ranked(deleted, ["path", "start", "end"], "slot"))
    runs = cut(moves.ranked(with_tokens(added, lc), moves.longest_first(), "rank"))
    return runs.join(moves.moves(shape(entries, "slot"), shape(runs, "rank")), "rank", "left_semi").select("path", "key", "start")


def scan(files: DataFrame, include_tests: bool = False, exclude: list[str] | None = None, ignore: list[tuple[str, bool]] | None = None, min_clone_lines: int = MIN_CLONE_LINES, store: str | None = None) -> Scan:
    """Analyses ``files(path, content)``: what is skipped and why, callables with mass, findings, duplicate groups, and scores per family.

    With a folder as ``store``, contents that it has are not analysed again.
    """
    named = trees.texts(discovery.ignored(files.select("path", "content"), ignore or []))
    reason = F.when(F.col("ignored"), "gitignore").otherwise(discovery.skip_reason(F.col("path"), discovery.built_in(include_tests, exclude)))
    reason = F.coalesce(reason, F.when(F.col("language").isNull(), "parse_unsupported_extension").when(F.col("text").isNull(), "unreadable"))
    named = named.withColumn("reason", reason)
    wanted = named.where("reason is null")
    if store is None:
        lowered = cut(lowering.lower(wanted))
    else:
        keyed = cut(wanted.select("path", "language", "text", F.sha2(F.col("text").cast("binary"), 256).alias("oid")))
        lowered = cut(cache.lower(keyed, store, cache.profile()))
    skipped = named.where("reason is not null").select("path", "reason").unionByName(lowered.where("failed").select("path", F.lit("parse_syntax_error").alias("reason")))
    calls = metrics.with_mass(lowered.select("path", "language", F.explode("callables").alias("c")).select("path", "language", "c.*"))
    found = lowered.select("path", "language", F.explode("findings").alias("f")).select("path", "language", "f.*")
    members = cut(duplicates(lowered, min_clone_lines))
    flagged = found.select("language", "path", F.explode("lines").alias("line")).union(clones.redundant_lines(members)).distinct()
    erosion = metrics.erosion(calls, FAMILIES)
    verbose = metrics.verbosity(lowered.select("language", F.col("scanned_lines").alias("lines"), "failed"), flagged, FAMILIES)
    return Scan(skipped, lowered, calls, found, members, flagged, erosion.join(verbose, "family"))


#: Severities unless others are given.
SEVERITY = {"E101": "deny", "E102": "deny", "G102": "error", "V101": "deny", "V102": "deny", "S101": "deny", "S102": "warn", "A101": "deny", "A102": "deny"}
PHASES = {"E101": 3, "E102": 3, "G102": 3, "V101": 4, "S101": 5, "S102": 5, "A101": 6, "A102": 7, "V102": 8}


def _graded(eb: DataFrame, ec: DataFrame, one: DataFrame, two: DataFrame, pairs: DataFrame, renames_: DataFrame) -> DataFrame:
    """Candidate callables with ``code`` and ``reason``.

    One whose base is certain is compared with it, one without a base is new. Where several bases are possible, all of them must agree, else it is G102.
    """
    old = eb.select(F.col("path").alias("base_path"), F.col("ix").alias("base_ix"), F.col("cc").alias("bcc"), F.col("sloc").alias("bsloc"))
    both = ec.join(pairs, ["path", "ix"], "left").join(old, ["base_path", "base_ix"], "left")
    keys = ["path", "ix", "name", "fp"]
    cands, bases = matching.set_members(eb.select(keys), ec.select(keys), one, two, renames_)
    sizes = ["path", "ix", "cc", "sloc"]
    rows = cands.join(ec.select(sizes), ["path", "ix"])
    sets = policy.open_set_verdicts(rows, bases.join(eb.select(sizes), ["path", "ix"]), ["tier", "file", "name"])
    sets = sets.groupBy("path", "ix").agg(F.when(F.count_distinct("verdict") == 1, F.min("verdict")).otherwise("G102").alias("_set"))
    args = [F.col(x) for x in ("cc", "sloc", "bcc", "bsloc")]
    plain, why = policy.verdict(*args), policy.reason(*args)
    reason = F.when(F.col("_set").isNull() | (F.col("_set") == plain), why).when(F.col("_set") == "G102", "match_ambiguity").otherwise("complexity_growth")
    return both.join(sets, ["path", "ix"], "left").withColumns({"code": F.coalesce("_set", plain), "reason": reason}).where("code <> 'pass'")


def check(base: DataFrame, cand: DataFrame, keyword: str, severity: dict[str, str] | None = None) -> DataFrame:
    """Diagnostics (phase, code, path, line, name, reason, severity) of candidate ``files(path, content)`` against base ones. Built-in exclusions are masked on both sides.

    E101 and E102 for callables above the complexity limit that are new or grew, G102 where the bases that a callable may have disagree; V101 for findings that have no partner in the base (by rule, enclosing callable or file, and syntax),
    V102 for duplicates in changed files that gained lines and are no moves, S101 for suppressions that the base does not have, S102 for directives that suppress nothing or are not well formed. ``keyword`` begins a directive.
    A101 for changed files whose brackets don't balance, unless every line maps from such a base file; A102 for files of a known language that can't be read (content null, over the
    ceiling or not UTF-8): changed ones, and with V102 on also unchanged ones. Without content a file on both sides counts as unchanged. Renamed files may have changed by half.
    """
    severity = SEVERITY | (severity or {})
    base, cand = ignore.masked(base), ignore.masked(cand)
    kept = lambda files: trees.texts(files.select("path", "content")).where(F.col("language").isNotNull() & F.col("text").isNotNull()).withColumn("oid", F.sha2(F.col("text").cast("binary"), 256))
    b, c = kept(base), kept(cand)
    diff = cut(matching.tree_diff(b, c))
    of = lambda side, status: side.join(diff.where(F.col("status") == status).select("path"), "path", "left_semi").select("path", "oid", "text")
    renamed_files = cut(renames.renames(of(b, "deleted"), of(c, "added")).select("from_path", "path"))
    gone = diff.where("status = 'deleted'").select("path").join(renamed_files.select(F.col("from_path").alias("path")), "path", "left_anti")
    changed = diff.where("status <> 'deleted'").select("path")
    lb, lc = (cut(lowering.lower(x)) for x in (b, c))
    entity = lambda x: cut(x.select("path", F.posexplode("callables").alias("ix", "c")).select("path", F.col("ix").cast("long").alias("ix"), "c.name", "c.fp", "c.cc", "c.sloc", "c.start_line"))
    eb, ec = entity(lb), entity(lc)
    keys = ["path", "ix", "name", "fp"]
    one = cut(matching.same_file(eb.select(keys), ec.select(keys)))
    two = cut(matching.through_renames(eb.select(keys), ec.select(keys), one, renamed_files))
    both = cut(matching.displaced(eb.select(keys), ec.select(keys), one, two, renamed_files))
    three, _ = matching.by_fingerprint(eb.select(keys), ec.select(keys), both)
    pairs = cut(both.select("base_path", "base_ix", "path", "ix").unionByName(three))
    graded = _graded(eb, ec, one, two, pairs, renamed_files).join(changed, "path", "left_semi")
    out = [graded.select("code", "path", F.col("start_line").alias("line"), "name", "reason")]

    moved = F.coalesce("to", "path").alias("path")
    renamed = renamed_files.select("from_path", F.col("path").alias("to"))
    of_cand = lambda x: x.join(renamed, F.col("path") == F.col("from_path"), "left").select(moved, *[k for k in x.columns if k != "path"])
    texts = of_cand(b.select("path", F.col("text").alias("base_text"))).join(c.select("path", "text"), "path").where("base_text <> text")
    mapped = cut(lines.line_map(texts))
    finding = lambda x: x.select("path", F.posexplode("findings").alias("ix", "f")).select("path", F.col("ix").cast("long").alias("ix"), "f.rule", "f.digest", "f.owner", F.col("f.start_line").alias("line"))
    same = of_cand(b.select("path", "text")).join(c.select("path", "text"), ["path", "text"], "left_semi").select("path")
    back = same.join(renamed, F.col("path") == F.col("to"), "left").select(F.coalesce("from_path", "path").alias("path"))
    rows_b, rows_c = cut(finding(lb).join(back, "path", "left_anti")), cut(finding(lc).join(same, "path", "left_anti"))
    found_pairs, new = findings.match(rows_b, rows_c, pairs, renamed_files, mapped)
    at = lambda x, p, i, line: x.select(F.col("path").alias(p), F.col("ix").alias(i), F.col("line").alias(line))
    lined = found_pairs.join(at(rows_b, "base_path", "base_ix", "base_line"), ["base_path", "base_ix"]).join(rows_c.select("path", "ix", "rule", "line"), ["path", "ix"])
    kept_findings = cut(lined.select("path", "rule", "base_line", "line").distinct())
    fb, fc = of_cand(rows_b.select("path", "rule", "line")), rows_c.select("path", "rule", "line")

    db, dc = of_cand(lowering.suppressions(b, keyword)), cut(lowering.suppressions(c, keyword))
    hit_b, _ = policy.suppress(fb, db.where("rule is not null"))
    hit_c, unused = policy.suppress(fc, dc.where("rule is not null"))
    of_same = finding(lc).join(same, "path", "left_semi")
    unused = unused.join(of_same.select("path", "rule", (F.col("line") - 1).alias("line")), ["path", "rule", "line"], "left_anti")
    out.append(new.join(hit_c, ["path", "rule", "line"], "left_anti").select(F.lit("V101").alias("code"), "path", "line", F.col("rule").alias("name"), F.lit("new_finding").alias("reason")))
    s101 = lines.new_suppressions(hit_c, hit_b, kept_findings)
    out.append(s101.select(F.lit("S101").alias("code"), "path", F.col("directive_line").alias("line"), F.col("rule").alias("name"), F.lit("new_suppression").alias("reason")))
    problems = dc.where("rule is null").select("path", "line", F.lit("invalid").alias("reason")).union(unused.select("path", "line", F.lit("unused")))
    known = lines.matched_by_line(db.withColumn("key", F.trim("text")), dc.withColumn("key", F.trim("text")), mapped, ["key"]).select("path", "line")
    problems = problems.join(known, ["path", "line"], "left_anti").join(same, "path", "left_anti")
    out.append(problems.select(F.lit("S102").alias("code"), "path", "line", F.lit("").alias("name"), "reason"))

    members_b, runs_c = cut(duplicates(lb)), cut(duplicates(lc))
    runs_b = of_cand(members_b)
    subjects = lines.clone_subjects(runs_c.select("path", "key", "start", "end", "lines"), mapped.unionByName(_added_lines(c, changed.join(same, "path", "left_anti"), mapped)))
    graded_runs = cut(lines.extension_grades(subjects, runs_b.select("path", "start", "end", "lines"), mapped).where("fires"))
    fresh = runs_c.join(graded_runs.where("effective is null").select("path", "key", "start"), ["path", "key", "start"], "left_semi")
    no_growth = _moved(members_b, fresh, of_base(mapped, renamed), gone, lb, lc)
    fires = graded_runs.join(no_growth, ["path", "key", "start"], "left_anti")
    out.append(fires.select(F.lit("V102").alias("code"), "path", F.col("start").alias("line"), F.col("key").alias("name"), F.lit("clone_growth").alias("reason")))
    whole = lambda texts, lowered: texts.join(lowered.where("failed").select("path"), "path", "left_semi").select("path", F.lit(1).cast("long").alias("start"), X.line_count(F.col("text")).alias("end"))
    broken = whole(c, lc).join(changed, "path", "left_semi").join(same, "path", "left_anti")
    a101 = lines.damaged(broken, of_cand(whole(b, lb)), mapped)
    out.append(a101.select(F.lit("A101").alias("code"), "path", F.col("start").alias("line"), F.lit("").alias("name"), F.lit("parse_damage").alias("reason")))
    stamp = F.sha2(F.col("content"), 256)
    before = base.select("path", stamp.alias("was"), F.lit(True).alias("known"))
    entries = trees.texts(cand.select("path", "content", stamp.alias("now"), F.coalesce(F.octet_length("content") > discovery.CEILING, F.lit(True)).alias("large"))).where("language is not null").join(before, "path", "left")
    why = F.when(F.col("large"), "too_large").when(F.col("text").isNull(), "unreadable")
    gaps = policy.coverage_gaps(entries.select("path", (F.col("known").isNull() | ~F.col("was").eqNullSafe(F.col("now"))).alias("changed"), why.alias("reason")), severity["V102"])
    out.append(gaps.select("code", "path", F.lit(0).cast("long").alias("line"), F.lit("").alias("name"), "reason"))
    every = out[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    of_code = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("code")]
    every = every.select(of_code(PHASES).alias("phase"), "*", of_code(severity).alias("severity"))
    return every.where("severity <> 'off'")


def of_base(mapped: DataFrame, renamed: DataFrame) -> DataFrame:
    """A line map under the base's paths."""
    return mapped.join(renamed, F.col("path") == F.col("to"), "left").select(F.coalesce("from_path", "path").alias("path"), "base_line", "line")


def _added_lines(c: DataFrame, changed: DataFrame, mapped: DataFrame) -> DataFrame:
    """All lines of changed files that have no line map, those that are new, as added."""
    new = c.join(changed, "path", "left_semi").join(mapped.select("path").distinct(), "path", "left_anti").where(X.line_count(F.col("text")) > 0)
    return new.select("path", F.lit(None).cast("long").alias("base_line"), F.explode(F.sequence(F.lit(1).cast("long"), X.line_count(F.col("text")))).alias("line"))


#: The order of diagnostics of a check.
ORDER = ["phase", "path", "line", "code", "name"]


def describe(diagnostics: DataFrame) -> DataFrame:
    """Terminal lines, in order: ``path:line: code name: reason``, escaped."""
    text = F.format_string("%s:%d: %s %s: %s", X.terminal(F.col("path")), "line", "code", X.terminal(F.col("name")), "reason")
    return diagnostics.orderBy(*ORDER).select(text.alias("text"))


def agent_lines(diagnostics: DataFrame, cap: int = 50) -> DataFrame:
    """(place, code, path, line, name, reason, omitted): violations only, the first ``cap``, and how many more there are."""
    bad = diagnostics.where(policy.contribution(F.col("code"), F.col("severity")) != 0).withColumn("all", F.lit(0))
    return metrics.capped_listing(bad, "all", ORDER, cap).select("place", "code", "path", "line", "name", "reason", "omitted")


def annotations(diagnostics: DataFrame, cap: int = 10) -> DataFrame:
    """Workflow annotations, violations first and then in order, at most ``cap`` of each level."""
    level = F.when(policy.contribution(F.col("code"), F.col("severity")) != 0, "error").otherwise("warning")
    first = metrics.capped_listing(diagnostics.withColumn("level", level), "level", ORDER, cap)
    text = F.concat(F.lit("::"), "level", F.lit(" file="), X.annotation_property(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit(",title="), "code", F.lit("::"), X.annotation_data(F.concat_ws(": ", "name", "reason")))
    return first.orderBy(F.when(F.col("level") == "error", 0).otherwise(1), "place").select(text.alias("text"))


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def report(found: Scan, cap: int = 1000) -> dict:
    """The scan report as plain values: scores, skip counts, totals, the top 25 callables, and the first ``cap`` callables, findings and duplicate groups; longer lists say what they omit."""
    place = [F.col("path"), F.col("start_line"), F.col("end_line")]
    name = X.published_name(F.col("name"), F.col("start_line")).alias("name")
    calls = found.callables.withColumn("name", name)
    top = calls.orderBy(F.desc("cc"), "path", "start_line").limit(25)
    groups = clones.redundancy(found.members)
    totals = {"callables": calls.count(), "findings": found.findings.count(), "groups": groups.count(), "files": found.lowered.count()}
    fields = ["path", "language", "name", "start_line", "end_line", "cc", "sloc", "mass"]
    return {
        "schema_version": 1, "result_scope": "scan", "totals": totals,
        "scores": {r.pop("family"): r for r in _rows(found.scores)},
        "skipped": {r["label"]: r["n"] for r in _rows(metrics.zero_filled_counts(found.skipped, "reason", REASONS))},
        "top25": _rows(top.select(fields)),
        "callables": _rows(calls.orderBy(*place, "name").limit(cap).select(fields)),
        "findings": _rows(found.findings.orderBy("path", "start_line", "rule").limit(cap)),
        "clone_groups": _rows(groups.orderBy(F.desc("redundant_lines"), "path", "start").limit(cap)),
    }


def check_report(diagnostics: DataFrame, summaries: DataFrame | None = None, coverage: DataFrame | None = None, cap: int = 1000) -> dict:
    """The check report as plain values: exit status, numbers by code, the first ``cap`` diagnostics in order, summaries by scope and family (``metrics.summaries``), and the first ``cap`` files of ``metrics.file_coverage``."""
    rows = diagnostics.withColumn("violation", policy.contribution(F.col("code"), F.col("severity")) != 0)
    counts = _rows(rows.groupBy("code", "severity").agg(F.count("*").alias("n"), F.count_if("violation").alias("violations")).orderBy("code", "severity"))
    total = sum(r["n"] for r in counts)
    out = {
        "schema_version": 1, "result_scope": "check", "exit_status": policy.exit_status(diagnostics).first()[0], "counts": counts,
        "diagnostics": _rows(rows.orderBy(*ORDER).limit(cap)), "omitted": max(total - cap, 0),
    }
    if summaries is not None:
        out["summaries"] = _rows(summaries.orderBy("scope", "family"))
    if coverage is not None:
        out |= {"files": coverage.count(), "changed_files": _rows(coverage.orderBy("path").limit(cap))}
    return out


def canonical_json(document, pretty: bool = False) -> str:
    """Sorted keys, 0.0 for -0.0, control and direction characters as ``\\uXXXX``, one line end. Numbers that are not finite are refused."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x + 0.0 if isinstance(x, float) else x

    out = json.dumps(plain(document), sort_keys=True, ensure_ascii=False, allow_nan=False, indent=2 if pretty else None, separators=(",", ": ") if pretty else (",", ":"))
    unsafe = {c: f"\\u{c:04x}" for a, b in ((0x7F, 0x9F), *X.BIDI) for c in range(a, b + 1)}
    return out.translate(unsafe) + "\n"


def summary(found: Scan) -> str:
    """Terminal summary of a scan."""
    doc = report(found, 0)
    rows = [f"{k}: erosion {v['erosion']:.4f}, verbosity {v['ratio']:.4f} ({v['flagged_lines']} of {v['scanned_lines']} lines)" for k, v in sorted(doc["scores"].items())]
    skipped = ", ".join(f"{k} {n}" for k, n in sorted(doc["skipped"].items()) if n) or "none"
    totals = ", ".join(f"{n} {k}" for k, n in sorted(doc["totals"].items()))
    return "\n".join([totals, *rows, f"skipped: {skipped}"]) + "\n"
