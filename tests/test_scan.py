"""Scan and check over real sources, their readers and reports."""

import json
import random
import subprocess

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators import lines
from codequarry.plans import scan as S
from codequarry.sources import cache, discovery, lowering, trees

BODY = "\n".join(f"    x{i} = call{i}(x{i}, {i});" for i in range(12))
JAVA = "class A {\n  int f(int a) {\n    try { g(); } catch (E e) { }\n    if (a > 0) {\n      return 1;\n    } else {\n      a = 2;\n    }\n    return a;\n    a = 3;\n  }\n  void g() {\n" + BODY + "\n  }\n}\n"
OTHER = "class B {\n  void h() {\n" + BODY + "\n    last();\n  }\n}\n"
DEEP = "function deep(a) {\n" + "".join(f"  if (a > {i}) {{ b({i}); }}\n" for i in range(11)) + "}\n"


def files(spark, texts):
    return spark.createDataFrame([(p, bytearray(t if isinstance(t, bytes) else t.encode())) for p, t in texts.items()], "path string, content binary")


def test_scan_of_a_tree(spark, tmp_path):
    tree = {"src/A.java": JAVA, "src/B.java": OTHER, "web/deep.js": DEEP, "node_modules/x.js": "f()", "a/generated/g.ts": "f()", "src/ATest.java": "class T {}", "readme.md": "x", "bad.rs": b"\xff\xfe", "half.java": "class Q {"}
    for p, t in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t if isinstance(t, bytes) else t.encode())
    found = S.scan(trees.folder(spark, str(tmp_path)))
    assert {r.path: r.reason for r in found.skipped.collect()} == {
        "node_modules/x.js": "dependency_or_build_output", "a/generated/g.ts": "generated_code", "src/ATest.java": "test", "readme.md": "parse_unsupported_extension", "bad.rs": "unreadable", "half.java": "parse_syntax_error",
    }
    calls = {(r.path, r.name): (r.cc, r.sloc) for r in found.callables.collect()}
    assert calls == {("src/A.java", "f"): (3, 6), ("src/A.java", "g"): (1, 12), ("src/B.java", "h"): (1, 13), ("web/deep.js", "deep"): (12, 11)}
    assert {(r.rule, r.start_line, r.end_line) for r in found.findings.collect()} == {("JAVA-EMPTY-CATCH", 3, 3), ("JAVA-REDUNDANT-ELSE-AFTER-RETURN", 6, 8), ("JAVA-UNREACHABLE-AFTER-RETURN", 10, 10)}
    members = {(r.path, r.start, r.end, len(r.lines)) for r in found.members.collect()}
    assert members == {("src/A.java", 13, 24, 12), ("src/B.java", 3, 14, 12)}
    scores = {r.family: r for r in found.scores.collect()}
    mass = 3 * 6**0.5 + 12**0.5 + 13**0.5
    assert scores["overall"].erosion == pytest.approx(12 * 11**0.5 / (12 * 11**0.5 + mass), abs=1e-6) and scores["java"].erosion == 0.0
    flagged = {("src/B.java", i) for i in range(3, 15)} | {("src/A.java", 3), ("src/A.java", 7), ("src/A.java", 10)}
    assert {(r.path, r.line) for r in found.flagged.collect()} == flagged
    assert scores["java"].flagged_lines == 15 and scores["rust"].ratio == 0.0 and not scores["java"].complete
    doc = json.loads(S.canonical_json(S.report(found), pretty=True))
    assert doc["totals"] == {"callables": 4, "files": 4, "findings": 3, "groups": 1} and doc["skipped"]["test"] == 1 and doc["skipped"]["gitignore"] == 0
    assert [c["name"] for c in doc["top25"]][:2] == ["deep", "f"] and "overall: erosion" in S.summary(found)


def test_check_of_two_trees(spark):
    base = {"a.java": JAVA, "d.js": DEEP, "same.js": DEEP.replace("deep", "same"), "s.java": "class S {\n  void f() {\n    // keep[JAVA-EMPTY-CATCH]: known\n    try { g(); } catch (E e) { }\n  }\n}\n"}
    cand = dict(base)
    cand["a.java"] = "// first\n" + JAVA.replace("  void g() {", "  void k() {\n    try { g(); } catch (E e) { }\n  }\n  void g() {")
    cand["d.js"] = DEEP.replace("}\n}\n", "}\n  if (a && b) { c(); }\n}\n")
    cand["s.java"] = base["s.java"].replace("class S {\n", "class S {\n  // keep[JAVA-EMPTY-CATCH]: new\n  void e() { try { g(); } catch (E e) { } }\n  /* keep[X]: y */ // keep[JAVA-EMPTY-CATCH]: not alone\n")
    cand["n.js"] = DEEP.replace("deep", "fresh").replace("a >", "q >")
    cand["c.java"] = OTHER
    got = S.check(files(spark, base), files(spark, cand), "keep").collect()
    assert {(r.code, r.path, r.line, r.reason) for r in got if r.code[0] == "E"} == {("E102", "d.js", 1, "cc_growth"), ("E101", "n.js", 1, "new_callable")}
    assert {(r.path, r.line) for r in got if r.code == "V101"} == {("a.java", 14)}
    assert {(r.path, r.line) for r in got if r.code == "S101"} == {("s.java", 2)}
    assert {(r.path, r.line, r.reason) for r in got if r.code == "S102"} == {("s.java", 4, "invalid")}
    assert S.check(files(spark, base), files(spark, base), "keep").count() == 0
    rows = spark.createDataFrame(got)
    doc = json.loads(S.canonical_json(S.check_report(rows, cap=2)))
    assert doc["exit_status"] == 1 and len(doc["diagnostics"]) == 2 and doc["omitted"] == len(got) - 2 and sum(c["n"] for c in doc["counts"]) == len(got) and doc["diagnostics"][0]["code"] == "E102"
    assert S.describe(rows).count() == len(got) and S.annotations(rows).first().text.startswith("::error file=") and {r.omitted for r in S.agent_lines(rows, 1).collect()} == {sum(r.code != "S102" for r in got) - 1}


def test_clone_gate(spark):
    """A copy in a new file that touches no base file has no base run there: all of it is new."""
    base, cand = {"a.java": OTHER}, {"a.java": OTHER, "b.java": OTHER.replace("class B", "class C") + "class D { }\n"}
    mapped = lines.line_map(spark.createDataFrame([("b.java", "", cand["b.java"])], "path string, base_text string, text string"))
    members = S.duplicates(lowering.lower(trees.texts(files(spark, cand))))
    subjects = lines.clone_subjects(members.select("path", "key", "start", "end", "lines"), mapped)
    graded = lines.extension_grades(subjects, S.duplicates(lowering.lower(trees.texts(files(spark, base)))).select("path", "start", "end", "lines"), mapped).collect()
    assert [(r.path, r.added, r.fires) for r in graded] == [("b.java", 13, True)]


def test_check_of_broken_and_unreadable_files(spark):
    half = "class Q {\n  int a;\n  int b;\n"
    base = {"Same.java": half, "Shrunk.java": half, "Grown.java": half, "Ok.java": "class Q {\n}\n", "bad.rs": b"\xff", "note.md": "x"}
    cand = base | {"Shrunk.java": half.replace("  int b;\n", ""), "Grown.java": half + "  int c;\n", "Ok.java": "class Q {\n", "New.java": half, "new.rs": b"\xfe", "big.js": "a;" * (1 << 20), "note.md": b"\xff"}
    found = lambda **levels: {(r.code, r.path, r.reason) for r in S.check(files(spark, base), files(spark, cand), "keep", levels).collect()}
    damage = {("A101", p, "parse_damage") for p in ("Grown.java", "Ok.java", "New.java")}
    changed = {("A102", "new.rs", "unreadable"), ("A102", "big.js", "too_large")}
    assert found() == damage | changed | {("A102", "bad.rs", "unreadable")}
    assert found(V102="off") == damage | changed


def test_damage_spans_map_line_by_line(spark):
    span = "path string, start long, end long"
    mapped = spark.createDataFrame([("f", 1, 1), ("f", 2, 3), ("f", 3, 4), ("f", None, 2), ("f", 4, None)], "path string, base_line long, line long")
    cand = spark.createDataFrame([("f", 3, 4), ("f", 1, 3), ("f", 1, 1), ("g", 1, 2), ("g", 1, 2)], span)
    got = lines.damaged(cand, spark.createDataFrame([("f", 2, 3)], span), mapped).collect()
    assert sorted(tuple(r) for r in got) == [("f", 1, 1), ("f", 1, 3), ("g", 1, 2)]


def test_extension_grades(spark):
    """Ten old lines with one more are within a tenth or one; two more are not."""
    for more, fires in ((1, False), (2, True)):
        mapped = spark.createDataFrame([("p", i, i) for i in range(1, 11)] + [("p", None, 10 + i) for i in range(1, more + 1)], "path string, base_line long, line long")
        subjects = lines.clone_subjects(spark.createDataFrame([("p", "k", 1, 10 + more, list(range(1, 11 + more)))], "path string, key string, start long, end long, lines array<long>"), mapped)
        runs = spark.createDataFrame([("p", 1, 10, list(range(1, 11))), ("p", 2, 5, [2, 3, 4, 5])], "path string, start long, end long, lines array<long>")
        got = lines.extension_grades(subjects, runs, mapped).first()
        assert (got.added, got.effective, got.fires) == (more, 10, fires)


def common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_line_map_is_longest(spark, monkeypatch):
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        p = lines.align(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:])) and len(p) == common(a, b)
    many = [f"line {i}" for i in range(6000)]
    changed = [x if i % 2 else f"other {i}" for i, x in enumerate(many)]
    assert lines.align(many, changed) == [(i, i) for i in range(1, 6000, 2)]
    monkeypatch.setattr(lines, "KEPT", 30)  # split again and again
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        p = lines.align(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:])) and len(p) == common(a, b)
    rows = spark.createDataFrame([("p", "a\nb\nc\n", "a\nx\nc"), ("q", None, "n"), ("r", "same\n", "same\n")], "path string, base_text string, text string")
    assert {(r.path, r.base_line, r.line) for r in lines.line_map(rows).collect()} == {("p", 1, 1), ("p", 2, None), ("p", 3, 3), ("p", None, 2), ("q", None, 1), ("r", 1, 1)}
    runs = spark.createDataFrame([("p", [2]), ("p", [1, 2])], "path string, lines array<long>")
    assert [r.lines for r in lines.deleted_runs(runs, lines.line_map(rows)).collect()] == [[2]]


def test_line_maps_need_names_of_lines_only(spark, sf_dir):
    """Two versions of a file meet by hashes of their lines; the map is that of the texts."""
    from oracle import shuffled

    from codequarry.plans import registry

    texts = [("p", "a\nb\n\nc", "a\nx\n\nc\n"), ("q", None, "a"), ("r", "", "\n"), ("s", "a\r\nb", "a\nb")]
    rows = spark.createDataFrame(texts, "path string, base_text string, text string")
    named = rows.select("path", lines.line_names(F.col("base_text")).alias("base_names"), lines.line_names(F.col("text")).alias("names"))
    of = lambda x: sorted(lines.line_map(x).collect(), key=str)
    assert of(named) == of(rows) != []
    assert not shuffled(registry._mapped(spark, sf_dir)) & {"text", "base_text"}


def test_trees_of_a_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "é.java").write_text(JAVA)
    (tmp_path / "b.js").write_bytes(b"")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "b.js").write_text("changed()")
    git("add", "-A")
    head = {r.path: bytes(r.content) for r in trees.commit(spark, str(tmp_path)).collect()}
    index = {r.path: bytes(r.content) for r in trees.index(spark, str(tmp_path)).collect()}
    assert head == {"é.java": JAVA.encode(), "b.js": b""} and index == head | {"b.js": b"changed()"}
    assert len(trees.merge_base(str(tmp_path), "HEAD", "main")) == 40
    (tmp_path / "big.js").write_text("a;" * (1 << 20))
    folder = {r.path: (r.content is None, r.oid[:6]) for r in trees.folder(spark, str(tmp_path)).collect()}
    assert set(folder) == set(head) | {"big.js"} and folder["big.js"] == (True, "large:") and not folder["b.js"][0]
    blob = git("hash-object", "-w", "b.js").stdout.decode().strip()
    subprocess.run(["git", "-C", str(tmp_path), "update-index", "--index-info"], input=f"100644 {blob} 1\tb.js\n100644 {blob} 2\tb.js\n".encode(), check=True)
    with pytest.raises(ValueError, match="G101"):
        trees.index(spark, str(tmp_path))


def test_ignore_file_and_built_in_globs(spark):
    rules = trees.ignore_rules("# c\n*.log\n!keep.log\n/top\nlogs/\n")
    paths = spark.createDataFrame([(p,) for p in ("a/b.log", "keep.log", "top/x", "a/top/x", "a/logs/x", "logs")], "path string")
    assert {r.path for r in discovery.ignored(paths, rules).where("ignored").collect()} == {"a/b.log", "top/x", "a/logs/x"}
    reason = lambda p, **k: spark.range(1).select(discovery.skip_reason(F.lit(p), discovery.built_in(**k))).first()[0]
    assert (reason("x/target/A.java"), reason("x/A.min.js"), reason("src/test/A.java"), reason("src/test/A.java", include_tests=True), reason("src/Target.java")) == ("dependency_or_build_output", "generated_code", "test", None, None)


def test_directives():
    source = 'a(); // mark[JAVA-EMPTY-CATCH]: x\n// mark[JAVA-EMPTY-CATCH]: why\n// mark[NOPE]: why\n//mark[JAVA-EMPTY-CATCH]:  \nString s = "// mark[JAVA-EMPTY-CATCH]: no";\n/**\n * mark: x\n */\n/* mark is fine */\n'
    got = lowering.directives(source, "java", "mark", {"JAVA-EMPTY-CATCH"})
    assert [(n, r) for n, _, r in got] == [(1, None), (2, "JAVA-EMPTY-CATCH"), (3, None), (4, None), (7, None)]


def test_text_functions(spark):
    show = lambda c: spark.range(1).select(c).first()[0]
    assert show(X.percent_encoded(F.lit("a b/é~*+.java"))) == "a%20b/%C3%A9~%2A%2B.java"
    assert show(X.terminal(F.lit("a\x1b[0m‮b\x7f\n"))) == "a\\u{1b}[0m\\u{202e}b\\u{7f}\\u{a}" and show(X.terminal(F.lit("é b"))) == "é b"
    assert show(X.framed_digest("d", 1, F.lit("ab"), F.lit("c"))) != show(X.framed_digest("d", 1, F.lit("a"), F.lit("bc")))
    got = show(X.excerpt(F.lit("\n".join(["é" * 300] * 30)), F.lit(2)))
    assert len(got.text.encode()) in (4095, 4096) and got.truncated and show(X.excerpt(F.lit("a\nb"), F.lit(2))).asDict() == {"text": "b", "truncated": False}
    assert show(X.scrubbed(F.lit("at /a/b/c and /a"), ["/a", "/a/b"])) == "at <path>/c and <path>"
    assert show(lines.contained(F.array(F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) and not show(lines.contained(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert S.canonical_json({"b": -0.0, "a": "\x7f‮"}) == '{"a":"\\u007f\\u202e","b":0.0}\n'


def test_scan_with_a_store(spark, tmp_path, monkeypatch):
    tree = files(spark, {"A.java": JAVA, "copy/A.java": JAVA, "web/deep.js": DEEP})
    store = "file://" + str(tmp_path / "store")
    rows = lambda found: sorted(map(str, found.lowered.collect()))
    plain = rows(S.scan(tree))
    assert rows(S.scan(tree, store=store)) == plain
    keyed = trees.texts(tree).withColumn("oid", F.sha2(F.col("text").cast("binary"), 256))
    assert cache.stored(spark, store, cache.profile()).count() == 2 and cache.misses(keyed, store, cache.profile()).count() == 0
    assert cache.misses(keyed, store, cache.profile(other=1)).count() == 2
    monkeypatch.setattr(lowering, "lower", None)  # a second scan lowers nothing
    assert rows(S.scan(tree, store=store)) == plain
    monkeypatch.undo()
    folder = tmp_path / "store" / f"profile={cache.profile()}"
    for part in folder.glob("*.parquet"):  # a changed value is damage, and the content a miss
        t = pq.read_table(part)
        n = t.column_names.index("scanned_lines")
        pq.write_table(t.set_column(n, "scanned_lines", pa.array([x + 1 for x in t["scanned_lines"].to_pylist()], pa.int64())), part)
        for crc in folder.glob(f".{part.name}.crc"):
            crc.unlink()
    assert cache.stored(spark, store, cache.profile()).count() == 0 and cache.misses(keyed, store, cache.profile()).count() == 2
    assert rows(S.scan(tree, store=store)) == plain and cache.misses(keyed, store, cache.profile()).count() == 0
    assert cache.profile(a=1, b=2) == cache.profile(b=2, a=1) != cache.profile(a=1)
