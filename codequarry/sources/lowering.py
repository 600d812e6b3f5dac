"""Lexical lowering of Java, JavaScript/TypeScript and Rust: callables with complexity and executable lines, a row function turned into a table.

A tokeniser and bracket matching stand in for a grammar. Executable tokens are identifiers, literals, ``this``/``super``/``self``/constants and a bare
``break``, ``continue`` or ``return``; keywords, operators and punctuation are not. A callable's complexity is one plus the decisions in its body,
without those of callables inside it; its size is the number of different lines with an executable token there.
Files over 1 MiB are not read; an unbalanced file gives no callables and ``failed`` is set.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CEILING = 1 << 20
CONSTANTS = {"this", "super", "self", "Self", "null", "undefined", "true", "false"}
KEYWORDS = {
    "java": set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp switch synchronized throw throws transient try void volatile while".split()),
    "js_ts": set("async await break case catch class const continue debugger default delete do else enum export extends finally for function get if implements import in instanceof interface let new of private protected public readonly return set static switch throw try typeof var void while with yield".split()),
    "rust": set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while".split()),
}
_WORD = r"[^\W\d][\w$]*|[$@#][\w$]*"
_NUMBER = r"\d(?:[\w.]|(?<=[eE])[+-])*"
_OPS = r"=>|->|\?\?=?|\?\.(?!\d)|&&=?|\|\|=?|\.\.\.|::|\S"
SCANNERS = {
    "java": re.compile(rf'(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\')|(?P<number>{_NUMBER})|(?P<word>{_WORD})|(?P<op>{_OPS})', re.S),
    "js_ts": re.compile(rf'(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<number>{_NUMBER})|(?P<word>{_WORD})|(?P<op>{_OPS})', re.S),
    "rust": re.compile(rf'(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>b?r(?P<h>#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]+?|[^\'\\\n])\')|(?P<life>\'\w+)|(?P<number>{_NUMBER})|(?P<word>{_WORD})|(?P<op>{_OPS})', re.S),
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    last: int
    commented: bool = False


@dataclass
class Callable_:
    name: str
    start: int
    first: int
    last: int


def tokens(source: str, family: str) -> list[Token]:
    """Tokens without comments, with their first and last line and whether a comment stands before them."""
    lines = [m.start() for m in re.finditer("\n", source)]
    out: list[Token] = []
    at, scan, commented = 0, SCANNERS[family], False
    while m := scan.search(source, at):
        kind, text = m.lastgroup if m.lastgroup != "h" else "text", m[0]
        if family == "js_ts" and text == "/" and _starts_operand(out) and (r := _REGEX.match(source, m.start())):
            kind, text = "text", r[0]
        begin = m.start()
        if family == "js_ts" and text[0] == "`" and (end := _template_end(source, begin)):
            kind, text = "text", source[begin:end]
        at = begin + len(text)
        if kind == "word" and text in KEYWORDS[family] and not (out and out[-1].text == "." ):
            kind = "key"
        if kind != "comment":
            out.append(Token(kind, text, bisect_right(lines, begin - 1) + 1, bisect_right(lines, at - 1) + 1, commented))
        commented = kind == "comment"
    return out


def _template_end(source: str, start: int) -> int:
    """Place behind the template literal that begins at ``start``, whose expressions may hold strings, braces and templates; 0 if it doesn't end."""
    inside, i = ["`"], start + 1  # what the closing characters ahead belong to: a template, or an expression's or block's brace
    while i < len(source):
        c = source[i]
        if inside[-1] == "`":
            if c == "\\":
                i += 1
            elif c == "`":
                inside.pop()
                if not inside:
                    return i + 1
            elif source.startswith("${", i):
                inside.append("{")
                i += 1
        elif c in "`{":
            inside.append(c)
        elif c == "}":
            inside.pop()
        elif c in "\"'":
            quoted = re.compile(c + r"(?:\\.|[^\\\n" + c + "])*" + c).match(source, i)
            i = quoted.end() - 1 if quoted else i
        i += 1
    return 0


def _starts_operand(before: list[Token]) -> bool:
    """Whether an operand, not an operator, follows."""
    if not before:
        return True
    t = before[-1]
    return t.kind == "key" or t.kind == "op" and t.text not in (")", "]", "}")


def brackets(ts: list[Token]) -> dict[int, int] | None:
    """Partner of every bracket; None if they don't balance."""
    stack, out = [], {}
    for i, t in enumerate(ts):
        if t.kind != "op":
            continue
        if t.text in OPEN:
            stack.append(i)
        elif t.text in CLOSE:
            if not stack or OPEN[ts[stack[-1]].text] != t.text:
                return None
            out[i] = stack[-1]
            out[stack.pop()] = i
    return out if not stack else None


def _expression_end(ts: list[Token], pair: dict[int, int], i: int) -> int:
    """Last token of the expression that starts at i."""
    while i < len(ts):
        if ts[i].text in OPEN and ts[i].kind == "op":
            i = pair[i]
        elif ts[i].kind == "op" and (ts[i].text in CLOSE or ts[i].text in (",", ";")):
            return i - 1
        i += 1
    return len(ts) - 1


def _bound_name(ts: list[Token], start: int) -> str:
    """Name that the expression from ``start`` is bound to, else one by its line."""
    if start >= 2 and ts[start - 1].text in ("=", ":") and ts[start - 2].kind in ("word", "text"):
        return ts[start - 2].text.strip("'\"")
    return f"<anonymous>@{ts[start].line}"


def _params_start(ts: list[Token], pair: dict[int, int], arrow: int) -> int:
    i = pair[arrow - 1] if ts[arrow - 1].text == ")" else arrow - 1
    return i - 1 if i and ts[i - 1].text == "async" else i


def _body(ts: list[Token], pair: dict[int, int], i: int) -> tuple[int, int]:
    return (i, pair[i]) if i < len(ts) and ts[i].text == "{" else (i, _expression_end(ts, pair, i))


def _label(ts: list[Token], pair: dict[int, int], arrow: int) -> bool:
    """Whether a Java arrow ends a switch label."""
    i = arrow - 1
    while i >= 0 and ts[i].text not in (";", "{", "}", "->"):
        if ts[i].text in ("case", "default") and ts[i].kind == "key":
            return True
        i = pair[i] - 1 if ts[i].text in CLOSE and ts[i].kind == "op" else i - 1
    return False


def _after_params(ts: list[Token], pair: dict[int, int], i: int, family: str) -> int:
    """Index of the body's brace after a parameter list that ends at i, or -1."""
    j = i + 1
    while j < len(ts) and ts[j].text != "{":
        t = ts[j]
        allowed = t.kind in ("word", "text") or t.text in ("throws", ",", ".", "[", "]", "<", ">", "void", "extends")
        if family == "js_ts":
            allowed = allowed and j > i + 1 or t.text == ":" or t.text in ("|", "&") and j > i + 1
        elif j == i + 1 and t.text not in ("throws", "["):
            return -1
        if not allowed:
            return -1
        j += 1
    return j if j < len(ts) else -1


def callables(ts: list[Token], pair: dict[int, int], family: str) -> list[Callable_]:
    """Callables with a body, in order of their start."""
    out = []
    for i, t in enumerate(ts):
        before = ts[i - 1].text if i else ""
        if family == "rust":
            if t.kind == "key" and t.text == "fn" and i + 1 < len(ts) and ts[i + 1].kind == "word":
                j = i + 2
                while j < len(ts) and ts[j].text not in ("{", ";"):
                    j = pair[j] + 1 if ts[j].text in ("(", "[") else j + 1
                if j < len(ts) and ts[j].text == "{":
                    out.append(Callable_(ts[i + 1].text, i, j, pair[j]))
            elif t.kind == "op" and t.text in ("|", "||") and _starts_operand(ts[max(i - 1, 0) : i]):
                j = i
                if t.text == "|":
                    j = i + 1
                    while j < len(ts) and ts[j].text != "|":
                        j = pair[j] + 1 if ts[j].text in OPEN else j + 1
                if j < len(ts):
                    first = j + 1
                    if first < len(ts) and ts[first].text == "->":
                        while first < len(ts) and ts[first].text != "{":
                            first += 1
                    start = i - 1 if before == "move" else i
                    out.append(Callable_(_bound_name(ts, start), start, *_body(ts, pair, first)))
            continue
        if t.text == ("->" if family == "java" else "=>") and i:
            if ts[i - 1].text != ")" and ts[i - 1].kind != "word" or family == "java" and _label(ts, pair, i):
                continue
            start = _params_start(ts, pair, i)
            out.append(Callable_(_bound_name(ts, start), start, *_body(ts, pair, i + 1)))
        elif family == "java" and t.text == "static" and i + 1 < len(ts) and ts[i + 1].text == "{":
            out.append(Callable_("static", i, i + 1, pair[i + 1]))
        elif family == "js_ts" and t.kind == "key" and t.text == "function":
            j = i + 1 + (i + 1 < len(ts) and ts[i + 1].text == "*")
            named = j < len(ts) and ts[j].kind == "word"
            j += named
            while j < len(ts) and ts[j].text != "(":
                j += 1
            body = _after_params(ts, pair, pair[j], family) if j < len(ts) else -1
            if body > 0:
                start = i - 1 if before == "async" else i
                out.append(Callable_(ts[i + 1 + (ts[i + 1].text == "*")].text if named else _bound_name(ts, start), start, body, pair[body]))
        elif t.kind == "word" and i + 1 < len(ts) and ts[i + 1].text == "(" and before not in (".", "new", "function", "*" if family == "java" else "."):
            body = _after_params(ts, pair, pair[i + 1], family)
            if body < 0:
                continue
            previous = ts[i - 1] if i else None
            if family == "java":
                good = previous is not None and (previous.kind in ("word", "key") and before not in ("new", "return", "throw", "else", "case", "assert") or before in (">", "]", "{", "}", ";"))
                k = i - 1
                while k > 0 and (ts[k].text in (".", "<", ">", ",") or ts[k].kind == "word"):
                    k -= 1
                good = good and ts[k].text != "new"
            else:
                good = before in ("", "{", "}", ";", ",", "async", "get", "set", "static", "public", "private", "protected", "readonly", "*") and not (before == "function")
            if good:
                out.append(Callable_(t.text, i, body, pair[body]))
    return sorted(out, key=lambda c: (c.start, -c.last))


def decisions(ts: list[Token], pair: dict[int, int], family: str) -> set[int]:
    """Tokens that stand for a decision."""
    out: set[int] = set()
    closing: set[int] = set()
    for i, t in enumerate(ts):
        after = ts[i + 1].text if i + 1 < len(ts) else ""
        before = ts[i - 1].text if i else ""
        if t.kind == "key":
            if t.text == "do" and family != "rust":
                out.add(i)
                if after == "{":
                    closing.add(pair[i + 1] + 1)
                else:
                    j = _statement_end(ts, pair, i + 1)
                    closing.add(j + 1)
            elif t.text == "while" and i in closing:
                continue
            elif t.text in ("if", "while") or t.text == "for" and (family != "rust" or not _impl_for(ts, i)):
                out.add(i)
            elif family != "rust" and (t.text == "catch" and before != "." or t.text == "case"):
                out.add(i)
            elif family == "rust" and t.text == "else" and before != "}":
                out.add(i)
            elif family == "rust" and t.text == "match":
                out |= _arms(ts, pair, i)
        elif t.kind == "op":
            if t.text in ("&&", "||") and not _starts_operand(ts[max(i - 1, 0) : i]):
                out.add(i)
            elif t.text == "??" and family == "js_ts":
                out.add(i)
            elif t.text == "?" and family == "java" and not (before in ("<", ",") and after in (">", ",", "extends", "super")):
                out.add(i)
            elif t.text == "?" and family == "js_ts" and after not in (":", ")", ",", ";", "=", "("):
                out.add(i)
    return out


def _statement_end(ts, pair, i):
    while i < len(ts) and ts[i].text != ";":
        i = pair[i] + 1 if ts[i].text in OPEN and ts[i].kind == "op" else i + 1
    return i


def _impl_for(ts: list[Token], i: int) -> bool:
    """Whether ``for`` belongs to ``impl Trait for Type`` or a higher-ranked bound."""
    if i + 1 < len(ts) and ts[i + 1].text == "<":
        return True
    j = i - 1
    while j >= 0 and ts[j].text not in ("{", "}", ";", "impl"):
        j -= 1
    return j >= 0 and ts[j].text == "impl"


def _arms(ts: list[Token], pair: dict[int, int], i: int) -> set[int]:
    """Arrows of match arms whose pattern is not the bare wildcard."""
    j = i + 1
    while j < len(ts) and ts[j].text != "{":
        j = pair[j] + 1 if ts[j].text in ("(", "[") else j + 1
    out: set[int] = set()
    if j >= len(ts):
        return out
    end, k, start = pair[j], j + 1, j + 1
    while k < end:
        if ts[k].text == "=>":
            pattern = [t.text for t in ts[start:k]]
            if pattern and pattern != ["_"] and pattern[:2] != ["_", "if"]:
                out.add(k)
            k = k + 1
            if k < end and ts[k].text == "{":
                k = pair[k] + 1
            else:
                k = _expression_end(ts, pair, k) + 1
            if k < end and ts[k].text == ",":
                k += 1
            start = k
        else:
            k = pair[k] + 1 if ts[k].text in OPEN and ts[k].kind == "op" else k + 1
    return out


def executable(ts: list[Token], i: int, family: str) -> bool:
    t = ts[i]
    if t.kind in ("word", "text", "number"):
        return t.text[0] not in "@#"
    if t.kind == "key" and t.text in ("break", "continue", "return"):
        return i + 1 == len(ts) or ts[i + 1].text in (";", "}") or family == "js_ts" and ts[i + 1].line > t.line
    return t.text in CONSTANTS


def measure(source: str, family: str) -> tuple[list[tuple[str, int, int, int, int]], int, bool]:
    """(callables as (name, start line, end line, cc, sloc), executable lines of the file, failed)."""
    ts = tokens(source, family)
    lines = {n for i, t in enumerate(ts) if executable(ts, i, family) for n in range(t.line, t.last + 1)}
    pair = brackets(ts)
    if pair is None:
        return [], len(lines), True
    found, chosen = callables(ts, pair, family), decisions(ts, pair, family)
    owner = [-1] * len(ts)
    for n, c in enumerate(found):  # in order of start, outer first: the last writer is the innermost
        for i in range(c.start, c.last + 1):
            owner[i] = n if i >= c.first else -2
    cc, rows = [1] * len(found), [set() for _ in found]
    for i, n in enumerate(owner):
        if n >= 0:
            cc[n] += i in chosen
            if executable(ts, i, family):
                rows[n].update(range(ts[i].line, ts[i].last + 1))
    return [(c.name, ts[c.start].line, ts[c.last].last, cc[n], len(rows[n])) for n, c in enumerate(found)], len(lines), False


#: Behind these nothing is reached; an ``else`` is redundant behind the first two.
TERMINATORS, LEAVES = {"return", "throw", "break"}, {"return", "throw"}
#: Rules by family; Rust has none.
RULES = {
    "java": {"unreachable": "JAVA-UNREACHABLE-AFTER-RETURN", "catch": "JAVA-EMPTY-CATCH", "else": "JAVA-REDUNDANT-ELSE-AFTER-RETURN"},
    "js_ts": {"unreachable": "JSTS-UNREACHABLE-AFTER-RETURN", "catch": "JSTS-EMPTY-CATCH", "else": "JSTS-REDUNDANT-ELSE-AFTER-RETURN"},
}


def blocks(ts: list[Token], pair: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """Statements, as (first, last) token, of every brace that is not a literal, by the index of the brace."""
    out = {}
    for i, t in enumerate(ts):
        if t.kind != "op" or t.text != "{" or i and ts[i - 1].text in ("=", "(", ",", ":", "?", "[", "return", "&&", "||", "??"):
            continue
        k = start = i + 1
        found = []
        while k < pair[i]:
            inner = ts[k].text in OPEN and ts[k].kind == "op"
            k = pair[k] if inner else k
            follows = ts[k + 1]
            ends = ts[k].text == ";" or inner and ts[k].text == "}" and (follows.kind in ("word", "text", "number") or follows.text in ("{", "}", "@", "#") or follows.kind == "key" and follows.text not in ("else", "catch", "finally", "while", "instanceof", "in", "as"))
            k += 1
            if ends:
                found.append((start, k - 1))
                start = k
        if start < pair[i]:
            found.append((start, pair[i] - 1))
        out[i] = found
    return out


def _statement_last(ts: list[Token], pair: dict[int, int], i: int) -> int:
    """Last token of the statement that starts at ``i``."""
    while i < len(ts):
        t = ts[i]
        if t.text == "{" and t.kind == "op":
            return pair[i]
        if t.kind == "key" and t.text in ("if", "for", "while") and i + 1 < len(ts) and ts[i + 1].text == "(":
            last = pair[i + 1]
            if t.text != "if":
                i = last + 1
                continue
            last = _statement_last(ts, pair, last + 1)
            if last + 1 < len(ts) and ts[last + 1].text == "else":
                i = last + 2
                continue
            return last
        while i < len(ts) and ts[i].text != ";" and not (ts[i].kind == "op" and ts[i].text in CLOSE) and ts[i].text != "else":
            i = pair[i] + 1 if ts[i].text in OPEN and ts[i].kind == "op" else i + 1
        return i if i < len(ts) and ts[i].text == ";" else i - 1
    return len(ts) - 1


def findings(ts: list[Token], pair: dict[int, int], family: str, of_block: dict[int, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """(rule, first token, last token) of statements after a terminator, catch blocks without statement and comment, and else branches behind one that leaves."""
    rules, out = RULES.get(family), []
    if not rules:
        return out
    for rows in of_block.values():
        for n, (first, _) in enumerate(rows[:-1]):
            if ts[first].kind == "key" and ts[first].text in TERMINATORS:
                rest = list(itertools.takewhile(lambda r: ts[r[0]].text not in ("case", "default"), rows[n + 1 :]))
                rest = [r for r in rest if ts[r[0]].text not in ("function", "class")]
                if rest:
                    out.append((rules["unreachable"], rest[0][0], rest[-1][1]))
                break
    for i, t in enumerate(ts):
        if t.kind != "key":
            continue
        j = i + 1
        if j < len(ts) and ts[j].text == "(":
            j = pair[j] + 1
        if t.text == "catch" and j < len(ts) and ts[j].text == "{" and pair[j] == j + 1 and not ts[j + 1].commented:
            out.append((rules["catch"], i, pair[j]))
        elif t.text == "if" and i + 1 < j < len(ts):
            block = ts[j].text == "{"
            leaves = ts[of_block[j][-1][0]].text in LEAVES if block and of_block.get(j) else not block and ts[j].text in LEAVES
            end = _statement_last(ts, pair, j) + 1
            if leaves and end + 1 < len(ts) and ts[end].text == "else":
                out.append((rules["else"], end + 1, _statement_last(ts, pair, end + 1)))
    return sorted(out, key=lambda f: (f[1], f[0]))


def directives(source: str, family: str, keyword: str, rules: set[str]) -> list[tuple[int, str, str | None]]:
    """(line, text, rule) of the comments that begin with ``keyword``; rule is null where the form ``// keyword[RULE]: reason`` on a line of its own is not kept."""
    lines = [m.start() for m in re.finditer("\n", source)]
    out = []
    for m in SCANNERS[family].finditer(source):
        if m.lastgroup != "comment":
            continue
        line, text = bisect_right(lines, m.start() - 1) + 1, m[0]
        if text.startswith("//"):
            if text[2:].lstrip().startswith(keyword):
                form = re.fullmatch(re.escape(keyword) + r"\[([^\]]*)\]:(.*)", text[2:].lstrip(), re.S)
                alone = not source[source.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
                out.append((line, text, form[1] if form and alone and form[1] in rules and form[2].strip() else None))
        else:
            for n, row in enumerate(text[2:].split("\n")):
                if re.match(r"\s*\**\s*" + re.escape(keyword) + r"\s*[\[:]", row):
                    out.append((line + n, text, None))
                    break
    return out


def analyse(source: str, family: str) -> dict:
    """All relations of one file, as plain values in the order of SCHEMA."""
    rows, scanned, failed = measure(source, family)
    ts = tokens(source, family)
    able = [executable(ts, i, family) for i in range(len(ts))]
    lines = lambda a, b: sorted({n for i in range(a, b + 1) if able[i] for n in range(ts[i].line, ts[i].last + 1)})
    out = {"failed": failed, "scanned_lines": scanned, "exec_lines": lines(0, len(ts) - 1), "callables": [], "statements": [], "findings": []}
    pair = brackets(ts)
    if pair is None:
        return out
    digest = lambda a, b: hashlib.sha256("\x01".join(t.text for t in ts[a : b + 1]).encode()).hexdigest()
    calls = callables(ts, pair, family)
    out["callables"] = [dict(zip(("name", "start_line", "end_line", "cc", "sloc", "fp"), (*r, digest(c.first, c.last)))) for r, c in zip(rows, calls)]
    owner = lambda a, b: max((n for n, c in enumerate(calls) if c.start <= a and b <= c.last), default=None)
    found = blocks(ts, pair)
    for i, parts in found.items():
        for a, b in parts if len(parts) > 1 else ():
            out["statements"].append({"block": i, "line": ts[a].line, "last": ts[b].last, "token": " ".join(t.text for t in ts[a : b + 1])})
    out["findings"] = [{"rule": r, "start_line": ts[a].line, "end_line": ts[b].last, "lines": lines(a, b), "digest": digest(a, b), "owner": owner(a, b)} for r, a, b in findings(ts, pair, family, found)]
    return out


SCHEMA = (
    "path string, language string, failed boolean, scanned_lines long, exec_lines array<long>, callables array<struct<name:string,start_line:long,end_line:long,cc:long,sloc:long,fp:string>>, "
    "statements array<struct<block:long,line:long,last:long,token:string>>, findings array<struct<rule:string,start_line:long,end_line:long,lines:array<long>,digest:string,owner:long>>"
)


def lower(files: DataFrame) -> DataFrame:
    """One row per file of ``files(path, language, text)`` in a known language of at most 1 MiB, null text as empty."""
    wanted = files.where("language in ('java', 'js_ts', 'rust')").where(f"coalesce(octet_length(text), 0) <= {CEILING}").select("path", "language", "text")
    kinds = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, family, text in zip(*(c.to_pylist() for c in b.columns)):
                row = {"path": path, "language": family} | analyse(text or "", family)
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in kinds], schema=kinds)

    return wanted.mapInArrow(run, SCHEMA)


def suppressions(files: DataFrame, keyword: str) -> DataFrame:
    """(path, line, text, rule): directive comments of ``files(path, language, text)``; rule is null for an invalid one."""
    known = {r for rules in RULES.values() for r in rules.values()}
    wanted = files.where("language in ('java', 'js_ts', 'rust')").where(f"coalesce(octet_length(text), 0) <= {CEILING}").select("path", "language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *d) for p, f, t in zip(*(c.to_pylist() for c in b.columns)) for d in directives(t or "", f, keyword, known)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "line", "text", "rule"])

    return wanted.mapInArrow(run, "path string, line long, text string, rule string")
