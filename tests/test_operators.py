"""Boundary facts of the operators on small fixtures."""

import pytest
from oracle import shuffled
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators import clones, matching, metrics, policy, rules
from codequarry.sources import discovery


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def test_mass(spark):
    rows = spark.createDataFrame([(4, 9), (1, 1)], "cc long, sloc long")
    assert [r.mass for r in metrics.with_mass(rows).orderBy("cc").collect()] == [1.0, 12.0]


def test_erosion_boundary_and_empty_family(spark):
    rows = spark.createDataFrame([("java", 10, 4), ("java", 11, 9)], "language string, cc long, sloc long")
    got = {r.family: r.erosion for r in metrics.erosion(rows, ["java", "rust"]).collect()}
    assert got == {"overall": round(33 / 53, 6), "java": round(33 / 53, 6), "rust": 0.0}
    assert not str(got["rust"]).startswith("-")


@pytest.mark.parametrize(
    "cc, sloc, base, want",
    [(10, 99, None, "pass"), (11, 5, None, "E101"), (11, 5, (10, 5), "E101"), (11, 10, (11, 9), "pass"), (11, 11, (11, 9), "E102"), (11, 110, (11, 100), "pass"), (11, 111, (11, 100), "E102"), (12, 9, (11, 9), "E102")],
)
def test_verdict_boundaries(spark, cc, sloc, base, want):
    b = [F.lit(x).cast("long") for x in (base or (None, None))]
    assert spark.range(1).select(policy.verdict(F.lit(cc), F.lit(sloc), *b)).first()[0] == want


def test_verdicts_over_all_bases_of_a_set(spark):
    options = spark.createDataFrame([("a", 12, 30), ("a", 20, 40), ("b", 12, 30), ("c", 10, 9), ("c", 10, 9)], "s string, cc long, sloc long")
    rows = [("a", 12, 30, False, "pass"), ("a", 13, 30, False, "G102"), ("a", 21, 30, False, "E102"), ("a", 9, 99, True, "pass"), ("b", 12, 34, False, "E102"), ("b", 12, 33, True, "G102"), ("c", 11, 1, False, "E101"), ("d", 11, 1, True, "E101")]
    cands = spark.createDataFrame(rows, "s string, cc long, sloc long, unmatched boolean, want string")
    got = policy.open_set_verdicts(cands, options, ["s"]).collect()
    assert len(got) == len(rows) and [(r.s, r.cc, r.verdict) for r in got if r.verdict != r.want] == []


def test_exit_status_bits(spark):
    rows = [("E101", "deny"), ("C101", "info"), ("S102", "warn")]
    assert policy.exit_status(spark.createDataFrame(rows, "code string, severity string")).first()[0] == 1
    assert policy.exit_status(spark.createDataFrame([*rows, ("X999", "deny")], "code string, severity string")).first()[0] == 3
    assert policy.exit_status(spark.createDataFrame([], "code string, severity string")).first()[0] == 0


def members(spark, rows):
    made = spark.createDataFrame(rows, "key string, language string, path string, start long, end long, n long")
    return clones.groups(made.withColumn("first", F.col("start")))


def numbered(spark, texts):
    rows = [(p, "java", [(i + 1, t) for i, t in enumerate(ts)]) for p, ts in texts.items()]
    return spark.createDataFrame(rows, "path string, language string, lines array<struct<line:long,token:string>>")


def test_maximal_groups_from_ends_only(spark):
    import random

    rng = random.Random(5)
    block = [f"s{i}" for i in range(6)]
    texts = {f"f{n}": [rng.choice("abcd") if rng.random() < 0.4 else x for x in block * 3] for n in range(8)} | {"same1": list("xyxyxyx"), "same2": list("yxyxyx")}
    files = numbered(spark, texts)
    of = lambda found: sorted((r.key, r.path, r.first, r.start, r.end, r.n, r.members, r.lines) for r in found.collect())
    assert of(clones.maximal_runs(files, 2)) == of(clones.maximal(clones.groups(clones.candidates(files, 2)))) != []


def test_two_copies_of_a_long_file_are_one_run(spark):
    text = [f"statement {i}" for i in range(10_000)]
    files = numbered(spark, {"a": text, "b": text})
    assert [(r.path, r.first, r.n) for r in sorted(clones.open_candidates(files).collect(), key=lambda r: r.path)] == [("a", 1, 10_000), ("b", 1, 10_000)]
    assert [(r.path, r.first, r.n, len(r.lines)) for r in sorted(clones.maximal_runs(files).collect(), key=lambda r: r.path)] == [("a", 1, 10_000, 10_000), ("b", 1, 10_000, 10_000)]


def test_a_file_of_equal_lines(spark):
    found = clones.maximal_runs(numbered(spark, {"a": ["x"] * 800})).collect()
    assert sorted((r.first, r.n, r.members) for r in found) == [(1, 799, 2), (2, 799, 2)]


def test_a_periodic_file_is_not_compared_with_itself(spark, monkeypatch):
    """Two statements by turns: each run lies in many longer ones, and one of the next length is enough. Files of the same blocks in other company have no runs to compare."""
    files = numbered(spark, {"p": ["a"] + ["x", "y"] * 100, "q": ["x", "y"] * 3 + ["b"]})
    plain = clones.maximal(clones.groups(clones.candidates(files, 3)))
    of = lambda found: sorted((r.key, r.path, r.first, r.start, r.end, r.n, r.members, r.lines) for r in found.collect())
    want, pairs, inside = of(plain), [], clones.spans.inside
    monkeypatch.setattr(clones.spans, "inside", lambda *x: pairs.append(inside(*x)) or pairs[-1])
    assert of(clones.maximal_runs(files)) == want
    assert sum(x.count() for x in pairs) < 200 * 200


def test_no_text_is_shuffled_to_find_runs(spark, monkeypatch):
    """Only hashes of statements go to other tasks, as long as keys need not be digests of texts."""
    files = numbered(spark, {n: [f"{n} begins", *"abcdef", f"{n} ends"] for n in ("p", "q", "r")})
    moved, cut = set(), clones.cut
    monkeypatch.setattr(clones, "cut", lambda df: moved.update(shuffled(df)) or cut(df))
    found = clones.maximal_members(files)
    assert sorted((r.path, r.first, r.n, r.members) for r in found.collect()) == [(p, 2, 6, 3) for p in "pqr"]
    assert "path" in moved and not moved & {"lines", "tokens", "text"}


def test_contained_group_falls_away(spark):
    rows = [("big", "java", p, 1, 15, 5) for p in "ab"] + [("small", "java", p, 3, 10, 3) for p in "ab"]
    assert {r.key for r in clones.maximal(members(spark, rows)).collect()} == {"big"}


def test_partly_contained_group_stays(spark):
    rows = [("big", "java", p, 1, 15, 5) for p in "ab"] + [("small", "java", p, 3, 10, 3) for p in "abc"]
    assert {r.key for r in clones.maximal(members(spark, rows)).collect()} == {"big", "small"}


def test_periodic_text_leaves_the_longest_run(spark):
    rows = [(f"k{n}", "java", "a", s, s + n - 1, n) for n in range(2, 9) for s in range(1, 11 - n)]
    assert {r.key for r in clones.maximal(members(spark, rows)).collect()} == {"k8"}


def test_different_places_inside_a_longer_run(spark):
    rows = [("big", "java", p, 1, 5, 5) for p in "ab"] + [("small", "java", p, s, s, 1) for p in "ab" for s in (2, 4)]
    assert {r.key for r in clones.maximal(members(spark, rows)).collect()} == {"big"}


def test_redundancy_counts_all_but_the_first(spark):
    rows = [("k", "java", p, 1, 10, 10) for p in "abc"] + [("l", "java", p, 20, 34, 15) for p in "ab"]
    got = {r.key: r.redundant_lines for r in clones.redundancy(members(spark, rows)).collect()}
    assert got == {"k": 20, "l": 15}


def test_tree_diff_and_renames(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3")], "path string, oid string")
    c = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "3"), ("z", "3")], "path string, oid string")
    changes = matching.tree_diff(b, c)
    assert {r.path: r.status for r in changes.collect()} == {"b": "modified", "c": "deleted", "d": "deleted", "x": "added", "y": "added", "z": "added"}
    assert {(r.from_path, r.path) for r in matching.exact_renames(changes).collect()} == {("c", "x"), ("d", "y")}


def test_matching_tiers(spark):
    cols = "path string, ix long, name string, fp string"
    b = spark.createDataFrame([("a", 1, "f", "1"), ("a", 2, "f", "1"), ("a", 3, "f", "2"), ("b", 1, "g", "7"), ("c", 1, "h", "8")], cols)
    c = spark.createDataFrame([("a", 1, "f", "1"), ("a", 2, "f", "3"), ("d", 1, "g", "7"), ("e", 1, "k", "8"), ("e", 2, "k", "8")], cols)
    t1 = matching.same_file(b, c)
    assert {(r.base_ix, r.ix, r.pairing) for r in t1.collect()} == {(1, 1, "fingerprint_exact"), (2, 2, "positional")}
    ren = spark.createDataFrame([("b", "d")], "from_path string, path string")
    t2 = matching.through_renames(b, c, t1, ren)
    assert [(r.base_path, r.path) for r in t2.collect()] == [("b", "d")]
    t3, unclear = matching.by_fingerprint(b, c, t1.unionByName(t2))
    assert t3.count() == 0
    assert [(r.fp, r.nb, r.nc) for r in unclear.collect()] == [("8", 1, 2)]


def test_displaced_candidate_takes_the_free_base(spark):
    """Set (f, n) has two bases and three candidates; the second candidate's body is that of a deleted file, so it leaves and the third moves up."""
    rows = "path string, ix long, name string, fp string"
    b = spark.createDataFrame([("f", 1, "n", "1"), ("f", 2, "n", "2"), ("gone", 1, "m", "9"), ("g", 1, "o", "3"), ("late", 1, "p", "7")], rows)
    c = spark.createDataFrame([("f", 1, "n", "4"), ("f", 2, "n", "9"), ("f", 3, "n", "5"), ("g", 1, "o", "7")], rows)
    ren = spark.createDataFrame([], "from_path string, path string, oid string")
    one = matching.same_file(b, c)
    two = matching.through_renames(b, c, one, ren)
    assert {(r.base_ix, r.ix) for r in one.where("path = 'f'").collect()} == {(1, 1), (2, 2)}
    got = matching.displaced(b, c, one, two, ren)
    assert {(r.tier, r.base_path, r.base_ix, r.path, r.ix) for r in got.collect()} == {(1, "f", 1, "f", 1), (1, "f", 2, "f", 3), (1, "g", 1, "g", 1)}
    three, _ = matching.by_fingerprint(b, c, got)
    assert [(r.base_path, r.path, r.ix) for r in three.collect()] == [("gone", "f", 2)]


def test_unanalysed_files_are_due_if_changed_or_gated(spark):
    rows = spark.createDataFrame([("a", True, "too_large"), ("b", False, "too_large"), ("c", True, "unsupported_extension"), ("d", False, "unsupported_extension"), ("e", True, None)], "path string, changed boolean, reason string")
    due = lambda level: {r.path for r in policy.coverage_gaps(rows, level).collect()}
    assert due("deny") == due("warn") == {"a", "b", "c"} and due("off") == {"a", "c"}


def test_folders_of_one_folder_merge(spark):
    rows = spark.createDataFrame([("a/b/c/x",), ("a/b/c/d/e/y",), ("a/b/c/f/z",), ("top",), ("g/h",)], "path string")
    got = {(r.folder, r.name, r.total) for r in discovery.merged_folders(rows).collect()}
    assert got == {("a/b/c", "a/b/c", 3), ("a/b/c/d/e", "d/e", 1), ("a/b/c/f", "f", 1), ("g", "g", 1)}


@pytest.mark.parametrize("target, want", [("https://github.com/o/r", "remote"), ("http://github.com/o/r", "remote"), ("github.com/o/r", "local"), ("/srv/tree", "local"), ("https://example.org/r", "local")])
def test_target_kinds(spark, target, want):
    assert one(spark, t=target).select(discovery.target_kind(F.col("t"))).first()[0] == want


def test_framed_digest_of_an_array_equals_that_of_parts(spark):
    rows = one(spark, a="ab", b="c")
    assert rows.select(X.framed_array_digest("d", 1, F.array("a", "b")) == X.framed_digest("d", 1, F.col("a"), F.col("b"))).first()[0]


def test_islands_touch_and_nest(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 2, 3), ("a", 10, 12), ("a", 14, 15)], "k string, start long, end long")
    assert [(r.start, r.end, r.n) for r in rules.islands(rows, ["k"]).orderBy("start").collect()] == [(0, 12, 3), (14, 15, 1)]


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("**/node_modules/**", "a/node_modules/b.js", True), ("*.js", "a.js", True), ("*.js", "d/a.js", False), ("build", "build/x/y.java", True),
        ("Q[[:upper:]].rs", "QZ.rs", True), ("Q[[:upper:]].rs", "Qz.rs", False), ("Q[![:upper:]].rs", "Qz.rs", True), ("[[:digit:]k]", "k", True), ("[[:other:]]", "o", False), ("[[:digit:]", "4", False),
        ("[]a]", "]", True), ("[\\]b]", "b", True), ("[[:]", ":", True), ("x[z-a]", "xb", False), ("a[", "a[", False), ("[[:space:]]", "\x0b", False), ("[[:punct:]]", "[", True), ("a[!b]c", "a/c", False),
        ("**/[a-c]?.ts", "q/b1.ts", True), ("**/[!a-c]?.ts", "q/b1.ts", False), ("a/**/z", "a/z", True), ("a.b", "axb", False),
    ],
)
def test_globs(spark, glob, path, hit):
    assert one(spark, path=path).select(discovery.matches(F.col("path"), [glob])).first()[0] is hit


def test_last_ignore_rule_wins(spark):
    rows = spark.createDataFrame([("a/x.log",), ("a/keep.log",), ("b",)], "path string")
    got = {r.path: r.ignored for r in discovery.ignored(rows, [("**/*.log", False), ("**/keep.log", True)]).collect()}
    assert got == {"a/x.log": True, "a/keep.log": False, "b": False}


def test_extension_of_hidden_file(spark):
    assert one(spark, path="a/.ts").select(discovery.extension(F.col("path"))).first()[0] == ""
    assert one(spark, path="a/b.tsx").select(discovery.language(F.col("path"))).first()[0] == "js_ts"


def test_escaping(spark):
    row = one(spark, t="a%\r\n:,<&\"'").select(X.annotation_data(F.col("t")), X.annotation_property(F.col("t")), X.html(F.col("t"))).first()
    assert list(row) == ["a%25%0D%0A:,<&\"'", "a%25%0D%0A%3A%2C<&\"'", "a%\r\n:,&lt;&amp;&quot;&#39;"]


def test_suppression_reaches_the_next_line_only(spark):
    f = spark.createDataFrame([("p", "R", 5), ("p", "R", 7)], "path string, rule string, line long")
    d = spark.createDataFrame([("p", "R", 4), ("p", "R", 5)], "path string, rule string, line long")
    hit, unused = policy.suppress(f, d)
    assert [r.line for r in hit.collect()] == [5] and [r.line for r in unused.collect()] == [5]


def test_surplus_findings_are_new(spark):
    b = spark.createDataFrame([("p", "t", 1)], "path string, token string, ix long")
    c = spark.createDataFrame([("p", "t", 3), ("p", "t", 9), ("q", "t", 1)], "path string, token string, ix long")
    assert {(r.path, r.ix) for r in policy.unmatched(b, c, ["path", "token"]).collect()} == {("p", 9), ("q", 1)}
