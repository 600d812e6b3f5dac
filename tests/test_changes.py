"""Matching by context, owner chains, renames, move credit, spans and ignore files against plain versions."""

import collections
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from codequarry.operators import findings, matching, moves, owners, renames, spans
from codequarry.plans import scan as S
from codequarry.sources import ignore, lowering

EMPTY = "try { g(); } catch (E e) { }"
ROW = "path string, ix long, rule string, digest string, line long, owner long"
MAP = "path string, base_line long, line long"


def files(spark, texts):
    return spark.createDataFrame([(p, bytearray(t if isinstance(t, bytes) else t.encode())) for p, t in texts.items()], "path string, content binary")


# contexts


def test_equal_contexts_part_leftovers(spark):
    rows = "path string, ix long, name string, fp string, context string"
    base = spark.createDataFrame([("p", 1, "f", "a", "x"), ("p", 2, "f", "b", "y"), ("q", 1, "f", "a", "x"), ("q", 2, "f", "b", "y")], rows)
    cand = spark.createDataFrame([("p", 1, "f", "c", "y"), ("p", 2, "f", "d", "x"), ("q", 1, "f", "c", "y"), ("q", 2, "f", "d", "y")], rows)
    got = {(r.path, r.base_ix, r.ix) for r in matching.same_file(base, cand).collect()}
    assert got == {("p", 1, 2), ("p", 2, 1), ("q", 1, 1), ("q", 2, 2)}  # q's contexts differ, so order decides


def plain_match(base, cand, pairs, to, mapped):
    """The rule, one key after another."""
    of = {(p, o): (q, i) for p, o, q, i in pairs}
    known = set(of.values())
    groups = collections.defaultdict(lambda: ([], []))
    for p, i, rule, d, line, o in base:
        groups[rule, d, of.get((p, o), (to.get(p, p), None)) if o is not None else (to.get(p, p), None)][0].append((p, i, line))
    for p, i, rule, d, line, o in cand:
        groups[rule, d, (p, o) if (p, o) in known else (p, None)][1].append((p, i, line))
    out, left = set(), set()
    for (_, _, ctx), (b, c) in groups.items():
        c, rest = sorted(c), []
        for p, i, line in sorted(b):
            goal = (to.get(p, p), mapped.get((to.get(p, p), line)))
            hit = next((x for x in c if (x[0], x[2]) == goal), None)
            if hit:
                c.remove(hit)
                out.add((p, i, hit[0], hit[1], "line", ctx[1] is None))
            else:
                rest.append((p, i))
        for (p, i), x in zip(rest, c):
            out.add((p, i, x[0], x[1], "order", ctx[1] is None))
        left |= {x[:2] for x in c[len(rest) :]}
    return out, left


def test_finding_match_is_the_plain_rule(spark):
    rng = random.Random(4)
    to = {"old": "new"}
    side = lambda paths: [(p, i, rng.choice("RS"), rng.choice("de"), rng.randint(1, 8), rng.choice([None, 0, 1, 2])) for p in paths for i in range(rng.randint(10, 40))]
    base, cand = side(["a", "b", "old"]), side(["a", "b", "new"])
    pairs = [("a", 0, "a", 0), ("a", 1, "a", 2), ("old", 0, "new", 1), ("b", 0, "a", 1), ("b", 1, "b", 1)]
    mapped = {(p, i): i + rng.randint(0, 1) for p in ("a", "b", "new") for i in range(1, 8)}
    got, left = findings.match(
        spark.createDataFrame(base, ROW), spark.createDataFrame(cand, ROW), spark.createDataFrame(pairs, "base_path string, base_ix long, path string, ix long"),
        spark.createDataFrame([("old", "new")], "from_path string, path string"), spark.createDataFrame([(p, i, j) for (p, i), j in mapped.items()], MAP),
    )
    want = plain_match(base, cand, pairs, to, mapped)
    assert {tuple(r) for r in got.collect()} == want[0] and {(r.path, r.ix) for r in left.collect()} == want[1]
    assert {x[4] for x in want[0]} == {"line", "order"} and want[1]


def codes(spark, base, cand, **severity):
    return {(r.code, r.path, r.line, r.reason) for r in S.check(files(spark, base), files(spark, cand), "keep", severity).collect()}


def test_findings_of_tables_need_no_shuffled_text(spark, sf_dir, monkeypatch):
    from oracle import shuffled

    from codequarry.plans import change_queries as Q

    moved, cut = set(), Q.cut
    monkeypatch.setattr(Q, "cut", lambda df: moved.update(shuffled(df) | set(df.columns)) or cut(df))
    monkeypatch.setattr(Q.findings, "cut", Q.cut)
    moved |= shuffled(Q._found(Q.A.snapshot(spark, sf_dir, "cand")))
    assert Q.finding_surplus(spark, sf_dir).count()
    assert "path" in moved and not moved & {"text", "lines", "prev"}


def test_a_removed_finding_hides_no_new_one(spark):
    f = lambda body: "  void f() {\n    " + body + "\n  }\n"
    base = "class A {\n" + f(EMPTY) + "  void h() {\n    a();\n  }\n}\n"
    cand = "class A {\n" + f("g();") + "  void h() {\n    a();\n    " + EMPTY + "\n  }\n}\n"
    assert codes(spark, {"A.java": base}, {"A.java": cand}) == {("V101", "A.java", 7, "new_finding")}
    moved = "class A {\n  int x;\n" + f("b();\n    " + EMPTY) + "  void h() {\n    a();\n  }\n}\n"
    assert codes(spark, {"A.java": base}, {"A.java": moved}) == set()


def test_rules_on_source():
    rules = lambda text: [(f["rule"].split("-", 1)[1], f["start_line"]) for f in lowering.analyse("class A { void f() {\n" + text + "\n} }", "java")["findings"]]
    assert rules("while (x) {\n continue; g(); }") == []
    assert rules("if (a) { throw x; } else { b(); }") == rules("if (a) return 1; else return 2;") == rules("if (a) throw x;\nelse b();")[:0] + [("REDUNDANT-ELSE-AFTER-RETURN", 2)]
    assert rules("if (a) b(); else return 2;") == []
    assert rules("if (a) { return; } else if (b) { c(); } else { d(); }\n e();") == [("REDUNDANT-ELSE-AFTER-RETURN", 2)]
    assert rules("try { a(); } catch (E e) { /* fine */ }") == rules("try { a(); } catch (E e) {\n // fine\n }") == []
    assert rules("try { a(); } catch (E e) { }") == [("EMPTY-CATCH", 2)]
    nested = lowering.analyse("function f() { return `x ${ g(`}`) + `${ {a: '}'}.a }` } {`; }\nfunction h() { if (a) { b(); } }", "js_ts")
    assert not nested["failed"] and [c["name"] for c in nested["callables"]] == ["f", "h"]


def test_check_reports_open_choices_and_masks(spark):
    deep = lambda n, k=0: "function f() {\n" + "".join(f"  if (a > {i + k}) {{ b(); }}\n" for i in range(n)) + "}\n"
    base = {"x.js": deep(12), "y.js": deep(2), "node_modules/z.js": deep(30), "target/T.java": "class T { }"}
    base["x.js"] += deep(14, 40)  # two functions of one name, both high, and three that may come of them
    cand = {"x.js": deep(13, 5) + deep(16, 60) + deep(12, 90), "y.js": deep(2), "dist/new.js": deep(30)}
    got = codes(spark, base, cand)
    assert {(c, p, why) for c, p, _, why in got if c != "V102"} >= {("G102", "x.js", "match_ambiguity")}
    assert not any(p.startswith(("node_modules", "dist", "target")) for _, p, _, _ in got)


BODY = "\n".join(f"    x{i} = call{i}(x{i}, {i});" for i in range(14))
HOLD = lambda name, body=BODY: f"class {name} {{\n  void m() {{\n{body}\n  }}\n}}\n"


def test_moved_duplicates_are_no_growth(spark):
    base = {"a/A.java": HOLD("A"), "a/B.java": HOLD("B")}
    moved = {"a/A.java": HOLD("A"), "a/C.java": "interface I {\n  int k();\n  int l();\n  int q();\n}\n" + "\n".join(f"// {i} unlike anything before" * 3 for i in range(40)) + "\n" + HOLD("C")}
    v102 = lambda b, c: {(p, n) for code, p, n, _ in codes(spark, b, c) if code == "V102"}
    assert v102(base, moved) == set()
    assert v102(base, moved | {"a/B.java": HOLD("B")}) == {("a/C.java", 48)}
    assert v102(base, moved | {"a/D.java": moved["a/C.java"].replace("unlike", "hardly")}) == {("a/D.java", 48)}  # one credit, two copies


# owners


def test_chain_digests_of_deep_and_wide_forests(spark):
    chain = [("deep", i, i - 1 if i else None, "fn", f"n{i % 7}" if i % 3 else None) for i in range(3000)]
    other = [("copy", 10_000 - i, 10_001 - i if i else None, "fn", f"n{i % 7}" if i % 3 else None) for i in range(2000)]
    held = [("ctx", i, i - 1 if i else None, "arg" if i % 2 else "fn", None if i % 2 else "a") for i in range(9)] + [("bare", i, i - 1 if i else None, "fn", "a") for i in range(5)] + [("lost", 1, 99, "fn", "a")]
    got = {(r.path, r.id): r for r in owners.chain_digests(spark.createDataFrame(chain + other + held, "path string, id long, parent long, kind string, name string"), ["arg"]).collect()}
    assert all(got["deep", i].digest == got["copy", 10_000 - i].digest and got["deep", i].depth == i + 1 for i in range(2000))
    assert len({got["deep", i].digest for i in range(3000)}) == 3000
    assert all(got["ctx", 2 * i].plain == got["bare", i].plain == got["bare", i].digest and got["ctx", 2 * i].digest != got["bare", i].digest for i in range(1, 5))
    assert got["ctx", 3].plain == got["ctx", 2].plain and got["lost", 1].digest == got["bare", 0].digest
    with pytest.raises(ValueError):
        owners.chain_digests(spark.createDataFrame([("c", 1, 2, "fn", "a"), ("c", 2, 1, "fn", "b")], "path string, id long, parent long, kind string, name string"), [])


def test_pruning_by_subtrees(spark):
    rng, rows = random.Random(2), []

    def grow(depth):
        at = len(rows)
        rows.append(None)
        for _ in range(rng.randint(0, 3) if depth < 6 else 0):
            grow(depth + 1)
        rows[at] = (at, len(rows) - 1, [at // 2])

    while len(rows) < 300:
        grow(0)
    bad = rng.sample(range(len(rows)), 25)
    nodes = spark.createDataFrame([("p", *r) for r in rows], "path string, node long, last long, lines array<long>")
    left = owners.pruned(nodes, spark.createDataFrame([("p", b) for b in bad], "path string, node long"))
    want = {n for n, _, _ in rows if not any(b <= n <= rows[b][1] for b in bad)}
    assert {r.node for r in left.collect()} == want
    assert {r.line for r in owners.lost_lines(nodes, left).collect()} == {n // 2 for n, _, _ in rows} - {n // 2 for n in want}


def test_pruning_builds_no_table_on_the_driver(spark):
    """Rows that a join takes for few by their written bytes are not broadcast: a million pruned nodes were 136 MB on the driver."""
    nodes = spark.range(1000).selectExpr("concat('p', id % 3) as path", "id as node", "id + id % 7 as last", "array(id) as lines")
    left = owners.pruned(nodes, nodes.where("node % 5 = 0").select("path", "node"))
    for made in (left, owners.lost_lines(nodes, left)):
        assert made.count()
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


# renames


def similarity(a, b):
    x, y = collections.Counter(a.split("\n")), collections.Counter(b.split("\n"))
    size = lambda c: sum(n * (len(t.encode()) + 1) for t, n in c.items())
    return size(x & y) * 100 // max(size(x), size(y))


def test_inexact_renames_are_the_greedy_walk(spark):
    rng = random.Random(8)
    pool = ["common", "common", ""] + [f"line {i} " + "é" * (i % 5) for i in range(25)]
    text = lambda: "\n".join(rng.choices(pool, k=rng.randint(1, 12)))
    gone = [(f"g{i}", text()) for i in range(60)] + [("e1", "same"), ("e2", "same"), ("big", "x" * 90 + "\ny"), ("void", "")]
    new = [(f"n{i}", text()) for i in range(60)] + [("f1", "same"), ("big2", "x" * 90 + "\nz"), ("void2", "")]
    of = lambda rows: spark.createDataFrame([(p, str(hash(t)), t) for p, t in rows], "path string, oid string, text string")
    got = {tuple(r) for r in renames.renames(of(gone), of(new), ceiling=80).collect()}
    exact, used = set(), set()
    for p, t in sorted(gone):
        hit = next((q for q, u in sorted(new) if u == t and q not in used), None)
        if hit:
            used.add(hit)
            exact.add((p, hit, 100))
    taken = {p for p, _, _ in exact}
    pairs = [(-similarity(t, u), p, q) for p, t in gone for q, u in new if p not in taken and q not in used and 0 < len(t.encode()) <= 80 and 0 < len(u.encode()) <= 80]
    want, froms, tos = set(exact), set(), set()
    for s, p, q in sorted(x for x in pairs if x[0] <= -50):
        if p not in froms and q not in tos:
            want.add((p, q, -s))
            froms.add(p), tos.add(q)
    assert got == want and len(want) > len(exact) + 5


def test_lines_of_all_files_pair_nothing(spark):
    of = lambda name: spark.createDataFrame([(f"{name}{i}", f"{name}{i}", "license\n" * 3 + "\n".join(f"{name}{i} own line {j}" for j in range(6))) for i in range(300)], "path string, oid string, text string")
    assert renames.similar(of("g"), of("n")).count() == 0


# moves


def plain_moves(entries, runs):
    """The walk by rank."""
    spent, out = {}, set()
    for rank, language, block, first, tokens, n_lines in sorted(runs):
        best = None
        for slot, lang, b_block, b_first, b_tokens, b_lines in sorted(entries):
            if lang != language or n_lines > b_lines + max(1, b_lines // 10):
                continue
            for at in range(len(tokens) - len(b_tokens) + 1):
                if tokens[at : at + len(b_tokens)] != b_tokens:
                    continue
                onto = [spent.get((b_block, b_first + o)) for o in range(len(b_tokens))]
                here = [(block, first + at + o) for o in range(len(b_tokens))]
                if any(x is not None and x != y for x, y in zip(onto, here)):
                    continue
                key = (-sum(x is not None for x in onto), -b_lines, slot, at)
                best = min(best or (key, b_block, b_first, len(b_tokens)), (key, b_block, b_first, len(b_tokens)))
        if best:
            (_, _, slot, at), b_block, b_first, n = best
            out.add((rank, slot, at))
            spent |= {(b_block, b_first + o): (block, first + at + o) for o in range(n)}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_moves_are_the_walk_by_rank(spark, seed):
    rng = random.Random(seed)
    blocks = {f"{side}{i}": [rng.choice("abc") for _ in range(14)] for side in "bc" for i in range(3)}

    def some(side, n):
        for i in range(n):
            block = f"{side}{rng.randrange(3)}"
            first, size = rng.randrange(9), rng.randint(2, 5)
            yield (i + 1, rng.choice(["java", "java", "rust"]), block, first, blocks[block][first : first + size], rng.randint(3, 6))

    entries, runs = list(some("b", 14)), list(some("c", 16))
    schema = lambda x: f"{x} long, language string, block string, first long, tokens array<string>, lines int"
    got = moves.moves(spark.createDataFrame(entries, schema("slot")), spark.createDataFrame(runs, schema("rank")))
    assert {tuple(r) for r in got.collect()} == plain_moves(entries, runs)


# spans


def test_spans_against_all_pairs(spark):
    rng = random.Random(3)
    make = lambda n, wide: [(rng.choice("pq"), s, s + rng.choice([0, 1, 5, wide]) - rng.choice([0, 0, 0, 3])) for s in (rng.randrange(300) for _ in range(n))] + [("p", 7, 3_000_000), ("q", 2**21 - 1, 2**21)]
    a, b = make(150, 60), make(80, 90)
    of = lambda rows: spark.createDataFrame(sorted(set(rows)), "k string, start long, end long")
    full = [x for x in set(b) if x[1] <= x[2]]
    out = spans.within(spans.overlapped(of(a), of(b), ["k"]), of(b), ["k"]).collect()
    assert len(out) == len(set(a))
    for r in out:
        same = [x for x in full if x[0] == r.k]
        assert r.touched == (r.start <= r.end and any(s <= r.end and r.start <= e for _, s, e in same)), r
        if r.start <= r.end:
            assert r.held == any(s <= r.start and r.end <= e for _, s, e in same), r
    pairs = spans.inside(of([x for x in a if x[1] <= x[2]]), of(b).withColumn("name", F.concat_ws("-", "start", "end")), ["k"], ["name"]).collect()
    assert {(r.k, r.start, r.end, r.name) for r in pairs} == {(k, s, e, f"{t}-{f}") for k, s, e in a if s <= e for j, t, f in full if j == k and t <= s and e <= f}
    assert len(pairs) == len(set(pairs))


def test_many_spans_of_one_file(spark):
    rows = spark.range(100_000).select(F.lit("f").alias("k"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 4).alias("end"))
    assert spans.within(rows, rows.withColumn("end", F.col("end") + 1), ["k"]).where("held").count() == 100_000


def test_mapped_gaps(spark):
    span = "path string, start long, end long"
    mapped = spark.createDataFrame([("f", i, i + 1) for i in range(1, 8)] + [("f", None, 1), ("f", 9, None)], MAP)
    base = spark.createDataFrame([("f", 2, 4), ("f", 1, 2), ("f", 6, 6)], span)
    got = spans.mapped_gaps(spark.createDataFrame([("f", 3, 5), ("f", 2, 3), ("f", 2, 3), ("f", 5, 7), ("f", 1, 1), ("g", 1, 2)], span), base, mapped).collect()
    assert sorted(tuple(r) for r in got) == sorted([("f", 3, 5, 1, 2, True), ("f", 2, 3, 1, 2, True), ("f", 5, 7, 2, 4, False), ("f", 1, 1, None, None, False), ("g", 1, 2, None, None, False)])


# ignore files


def test_ignore_levels_are_gits(spark, tmp_path):
    rules = {"": "*.log\n!keep.log\n/top\nbuild/\n**/deep/*.txt\na/**/z\n# c\n\\!odd\ntrail  \n[ab]?.c\n", "a": "!*.log\n/only\nsub/\n!sub\n", "a/b": "*\n!*.c\n!in/\n", "x": "/*\n!/y\n!/y/**\nq/\n"}
    rng = random.Random(6)
    names = ["keep.log", "x.log", "top", "build", "deep", "n.txt", "z", "!odd", "trail", "a1.c", "ab.c", "only", "sub", "b", "in", "y", "q", "a", "x", "ä"]
    wanted = {"/".join(rng.choices(names, k=rng.randint(1, 5))) for _ in range(3000)}
    kept = []
    for folder in rules:
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
    for p in sorted(wanted):
        at = tmp_path / p
        try:
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text("")
            kept.append(p)
        except (FileExistsError, NotADirectoryError, IsADirectoryError):
            pass
    for folder, text in rules.items():
        (tmp_path / folder / ".gitignore").write_text(text)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    out = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(kept).encode(), capture_output=True).stdout
    want = {p.decode() for p in out.split(b"\0") if p}
    made = ignore.rules(spark.createDataFrame([(f"{f}/.gitignore".lstrip("/"), t) for f, t in rules.items()] + [("a/b.java", "*")], "path string, text string"))
    paths = spark.createDataFrame([(p,) for p in kept], "path string")
    got = {r.path for r in ignore.ignored(paths, made).where("ignored").collect()}
    assert got == want and len(want) > 40 and len(kept) - len(want) > 20
    none = made.where("false")
    assert ignore.skipped(paths, none, made).where("ignored").count() == 0


def test_check_chain(spark):
    rows = [("a.java", "file", 1), ("b.java", "symlink", 1), ("m", "submodule", 0), ("n/node_modules", "nested_checkout", 0), ("s.ts", "special", 0), ("node_modules/x.js", "file", 1), ("x/.git/h.js", "file", 1), ("readme.md", "file", 1), ("out.js", "file", 1), ("src/big.rs", "file", 1 << 21), ("src/no.rs", "file", 1)]
    got = {r.path: (r.reason, r.too_large) for r in ignore.chain(spark.createDataFrame(rows, "path string, kind string, size long"), ["src/", "*.java", "*.ts"], ["no.rs"]).collect()}
    assert got == {
        "a.java": (None, False), "b.java": ("symlink", False), "m": ("submodule", False), "n/node_modules": ("nested_checkout", False), "s.ts": ("special_file", False), "node_modules/x.js": ("builtin_exclusion", False),
        "x/.git/h.js": ("builtin_exclusion", False), "out.js": ("outside_include", False), "src/big.rs": (None, True), "src/no.rs": ("config_exclude", False),
    }
    raw = spark.createDataFrame([(bytearray(b"\xff.java"), "file", 1)], "path binary, kind string, size long")
    assert ignore.chain(raw).first().non_utf8_path
