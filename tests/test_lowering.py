"""Lexical lowering and configuration on small sources."""

import pytest

from codequarry.sources import lowering
from codequarry.sources.config import Config, ConfigError, parse


def by_name(source, family):
    rows, lines, failed = lowering.measure(source, family)
    assert not failed
    return {n: (cc, sloc) for n, _, _, cc, sloc in rows}, lines


def test_java_decisions():
    source = """class A {
  int f(int a, List<?> b) throws X {
    if (a > 0 && b != null) { a = 1; } else { a = 2; }
    for (int i = 0; i < a; i++) a++;
    do { a--; } while (a < 10);
    try { a = 1; } catch (E e) { a = 2; } finally { a = 3; }
    int t = a > 0 || a < -3 ? 1 : 2;
    switch (a) { case 1: break; case 2: break; default: break; }
    return switch (a) { case 1 -> 5; default -> 6; };
  }
  abstract int g(int a);
  A() { }
}"""
    got, _ = by_name(source, "java")
    assert got == {"f": (11, 7), "A": (1, 0)}


def test_java_lambda_is_apart():
    got, _ = by_name("class A { void f() { Runnable r = () -> { if (x) { y(); } };\n g(a -> a && b); new T() { void h() { } }; } }", "java")
    assert got == {"f": (1, 2), "r": (2, 1), "<anonymous>@2": (2, 1), "h": (1, 0)}


def test_js_decisions_and_names():
    source = """function decide(a, b) {
  // if (comment) {}
  for (const x of [1]) { a += x ?? 1; }
  const s = `if ${a}`, re = /if|while(/;
  return a?.b ? 1 : 2;
}
const arrow = async (x) => x || 1;
class C { get v() { return; } async *m(q) { while (q) q--; } }
"""
    got, lines = by_name(source, "js_ts")
    assert got == {"decide": (4, 3), "arrow": (2, 1), "v": (1, 1), "m": (2, 1)}
    assert lines == 6


def test_typescript_signatures():
    got, _ = by_name("class C { private f(a?: number, b: string | null): Promise<void> { return a ? 1 : 2; } abstract g(): void; }", "js_ts")
    assert got == {"f": (2, 1)}


def test_rust_decisions():
    source = """impl<'a> T for S<'a> {
    fn f(x: &&'a str) -> u8 {
        let Some(y) = g(x) else { return 1 };
        match y { 0 | 1 => 1, n if n > 3 && n < 9 => { 2 } _ => 3 };
        loop { break; }
        for i in 0..3 { if let Some(_) = h(i)? { } }
        v.iter().map(|c| c == 'x' || false).count()
    }
}
trait Q { fn sig(&self); }
"""
    got, _ = by_name(source, "rust")
    assert got["f"] == (8, 5) and got["<anonymous>@7"] == (2, 1) and "sig" not in got


def test_unbalanced_and_deep_sources():
    assert lowering.measure("class A { void f() { ", "java")[2]
    assert lowering.measure("function f() {" + "{" * 15000 + "}" * 15000 + "}", "js_ts")[0][0][0] == "f"


def test_lower_table(spark):
    rows = [("a.java", "java", "class A { void f() { if (x) { } } }"), ("b.rs", "rust", None), ("c.py", None, "x"), ("d.js", "js_ts", "x" * ((1 << 20) + 1))]
    got = {r.path: r for r in lowering.lower(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert set(got) == {"a.java", "b.rs"} and got["a.java"].callables[0].cc == 2 and got["b.rs"].callables == []


def test_config():
    assert parse('{"version": 1}') == Config()
    assert parse('{"version": 1, "caps": {"github": 0}, "severity": {"V102": "off"}}').caps["github"] == 0
    for bad in ("{}", '{"version": 2}', '{"version": 1, "x": 1}', '{"version": 1, "include": []}', '{"version": 1, "exclude": ["!a"]}', '{"version": 1, "exclude": null}', '{"version": 1, "version": 1}', '{"version": 1, "min_clone_lines": 0}', "["):
        with pytest.raises(ConfigError):
            parse(bad)
