"""Policy evaluators: complexity verdicts, findings, suppressions, coverage, exit status, ordering, config trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH, CEILING = 10, 1 << 20


def growth_limit(sloc: Column) -> Column:
    """Lines a callable may grow to: a tenth more, one at least."""
    return sloc + F.greatest(F.lit(1), F.floor(sloc / 10)).cast("long")


def verdict(cc: Column, sloc: Column, base_cc: Column, base_sloc: Column) -> Column:
    """pass, E101 (high without a high base) or E102 (high before and grown)."""
    grown = (cc > base_cc) | (sloc > growth_limit(base_sloc))
    return F.when(cc <= HIGH, "pass").when(base_cc.isNull() | (base_cc <= HIGH), "E101").when(grown, "E102").otherwise("pass")


def reason(cc: Column, sloc: Column, base_cc: Column, base_sloc: Column) -> Column:
    """Label of a verdict that is not pass."""
    more, longer = cc > base_cc, sloc > growth_limit(base_sloc)
    return (
        F.when(base_cc.isNull(), "new_callable").when(base_cc <= HIGH, "threshold_crossed")
        .when(more & longer, "cc_and_sloc_growth").when(more, "cc_growth").when(longer, "sloc_growth").otherwise("complexity_growth")
    )


def set_verdicts(cands: DataFrame, options: DataFrame, key: str) -> DataFrame:
    """Verdicts of candidates with several possible bases: the one all agree on, else G102."""
    each = cands.join(options.select(key, F.col("cc").alias("bcc"), F.col("sloc").alias("bsloc")), key)
    v = verdict(F.col("cc"), F.col("sloc"), F.col("bcc"), F.col("bsloc"))
    made = each.groupBy("path").agg(F.collect_set(v).alias("v"))  # at most three members
    return made.select("path", F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise("G102").alias("verdict"))


def open_set_verdicts(cands: DataFrame, options: DataFrame, key: list[str]) -> DataFrame:
    """``cands(key, cc, sloc, unmatched)`` with ``verdict`` over all ``options(key, cc, sloc)`` of its set: the one all agree on, else G102.

    A set is one row, an array of the largest limit for each complexity among its high bases, so candidates and bases are never paired.
    """
    high = F.col("cc") > HIGH
    steps = options.groupBy(*key, "cc").agg(F.max(growth_limit(F.col("sloc"))).alias("most"), F.min(growth_limit(F.col("sloc"))).alias("least"))
    sets = steps.groupBy(*key).agg(
        F.collect_list(F.when(high, F.struct("cc", "most"))).alias("steps"), F.min(F.when(high, F.col("cc"))).alias("low_cc"),
        F.min(F.when(high, F.col("least"))).alias("low_limit"), F.coalesce(F.bool_or(~high), F.lit(False)).alias("any_low"),
    )
    out = cands.join(sets, key, "left")
    e101 = F.col("unmatched") | F.coalesce("any_low", F.lit(False))
    e102 = F.coalesce((F.col("cc") > F.col("low_cc")) | (F.col("sloc") > F.col("low_limit")), F.lit(False))
    fine = F.coalesce(F.exists("steps", lambda x: (x["cc"] >= F.col("cc")) & (x["most"] >= F.col("sloc"))), F.lit(False))
    n = e101.cast("int") + e102.cast("int") + fine.cast("int")
    v = F.when(~high, "pass").when(n > 1, "G102").when(e102, "E102").when(fine, "pass").otherwise("E101")
    return out.withColumn("verdict", v).select(*cands.columns, "verdict")


def unmatched(base: DataFrame, cand: DataFrame, key: list[str]) -> DataFrame:
    """Candidate findings beyond the base's of the same key: k-th pairs with k-th, the surplus is new."""
    counts = base.groupBy(*key).agg(F.count("*").alias("known"))
    k = F.row_number().over(Window.partitionBy(*key).orderBy("ix"))
    return cand.withColumn("k", k).join(counts, key, "left").where(F.col("k") > F.coalesce("known", F.lit(0))).drop("k", "known")


def suppress(findings: DataFrame, directives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suppressed findings, unused directives): a directive on a line covers findings of its rule on the next."""
    at = directives.select("path", "rule", (F.col("line") + 1).alias("line"))
    hit = findings.join(at.distinct(), ["path", "rule", "line"], "left_semi")
    unused = directives.join(findings.select("path", "rule", (F.col("line") - 1).alias("line")), ["path", "rule", "line"], "left_anti")
    return hit, unused


def suppression_report(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """(path, line, rule, state) of one snapshot: its findings as ``reported`` or ``suppressed``, and its directives that are ``unused`` or, without a rule, ``invalid``."""
    hit, unused = suppress(findings, directives.where("rule is not null"))
    rows = lambda x, state: x.select("path", "line", "rule", F.lit(state).alias("state"))
    left = findings.join(hit.select("path", "rule", "line").distinct(), ["path", "rule", "line"], "left_anti")
    return rows(left, "reported").unionByName(rows(hit, "suppressed")).unionByName(rows(unused, "unused")).unionByName(rows(directives.where("rule is null"), "invalid"))


def coverage_reason(size: Column, utf8_path: Column, extension: Column, supported: list[str], ceiling: int = CEILING) -> Column:
    """Why a file can't be analysed, or null: size first, then path, then extension."""
    return F.when(size > ceiling, "too_large").when(~utf8_path, "non_utf8_path").when(~extension.isin(supported), "unsupported_extension")


def coverage_gaps(entries: DataFrame, severity: str = "deny") -> DataFrame:
    """A102 of ``entries(path, changed, reason)``: (code, path, reason) of files that can't be analysed, though they changed or clones are gated.

    ``severity`` is that of clone growth; an unchanged file of an unsupported extension is tolerated.
    """
    due = F.col("changed") | (F.lit(severity != "off") & (F.col("reason") != "unsupported_extension"))
    return entries.where(F.col("reason").isNotNull() & due).select(F.lit("A102").alias("code"), "path", "reason")


def contribution(code: Column, severity: Column) -> Column:
    """Exit bits of a diagnostic: 1 for a denied policy code and for a new suppression that is not allowed, 2 for an error or an unknown code, 0 otherwise."""
    return (
        F.when(code == "S101", F.when(severity == "allow", 0).otherwise(1)).when(code.isin("E101", "E102", "V101", "V102", "S102"), F.when(severity == "deny", 1).otherwise(0))
        .when(code == "C101", 0).otherwise(2)
    )


def exit_status(diagnostics: DataFrame) -> DataFrame:
    """One row: bitwise or of all contributions, 0 without any."""
    return diagnostics.agg(F.coalesce(F.bit_or(contribution(F.col("code"), F.col("severity"))), F.lit(0)).cast("long").alias("exit_status"))


def trust(trusted: Column, base: Column, cand: Column, default: str) -> Column:
    """(effective, code): trusted, else base, else default config; C101 if the candidate differs from the base."""
    return F.struct(F.coalesce(trusted, base, F.lit(default)).alias("effective"), F.when(~base.eqNullSafe(cand), "C101").alias("code"))
