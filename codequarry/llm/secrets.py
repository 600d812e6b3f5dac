"""Secret scans on DataFrame functions only: fixed patterns, and character Markov models of random strings.

Base spans come from three patterns (``assign``, ``access``, ``hex``). The method adds spans of kind ``random``: maximal runs
of 16 or more characters of ``[A-Za-z0-9+/_=-]`` that touch no base span and have a part of 16 or more whose character transitions are
likelier under a Markov model of random strings than under one of ordinary identifiers, by ``threshold`` nats a transition.

Both models are tables of transition counts. Random strings (label 1) are made from SHA-256 digests of a range. The ordinary sample (label 0) is a fixed list of
rulers, dates, numbers and identifier words, and the words of all texts of the corpus outside base spans, counted once per occurrence; each word also stands for
its forms in lower and upper case and for the snake, camel, dash and path names that it forms with itself. Words are counted with map-side combine before their
characters are, so at most 3 * 128 * 128 rows reach the driver. The model is a table of 128 * 128 log-likelihood ratios, a literal of fixed size.

Positions: ``split`` gives the stretches between matches and ``regexp_extract_all`` the matches; their lengths in code
points, summed in order, are the offsets. Patterns whose length limit may stand in the pattern have it there; for ``assign`` the
limit is applied to the matches, as a short match uses up its text.

Work grows with the length of a text and the number of its matches, in a straight line but for sorting: what a lambda reads is bound once, arrays that grow are
gathered in parts, and texts are cut out of pieces.

Defined results: null text counts as empty, with no spans. Rows with a null doc_id and rows that repeat are scanned each; an empty table gives an empty result
(``train`` then knows the fixed lists only). Columns of other names pass through ``scan``, which adds ``base`` and ``spans`` and refuses input that has them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh_names

# The patterns of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
LEAST = 16
KINDS = ("assign", "access", "hex", "random")
#: Labelled ordinary sample: words of which identifiers are often made.
ORDINARY = (
    "absolute access account action active address adapter admin aggregate algorithm allocate analysis annotation application argument array async attribute authentication "
    "background balance batch binary boolean boundary browser buffer builder button cache calculate callback cancel category certificate channel character client cluster collection "
    "command comment commit compiler component compress computer condition config connection constant container content context control controller convert counter create currency customer "
    "database default delete dependency description destination development device dictionary directory discovery document download dynamic element employee enable encoding environment error "
    "event exception execute expression external factory feature field filter finished folder foreground format function gateway generator global graph handler header history identifier image "
    "import index information initialize input instance integer interface international internationalisation iterator javascript keyboard language layout length library license limit listener location manager "
    "mapping maximum measure memory message method middleware minimum model module monitor network nothing notification number object operation option order organization output package parameter parent password "
    "performance permission platform policy position preference previous primary priority process product profile program property protocol provider public query random receive record reference register repository "
    "request resource response responsibilities result schedule schema search section security select sequence serializer server service session setting signature simple something source specification standard "
    "statement status storage strategy string structure subscription summary support synchronize system template terminal thread threshold timeout timestamp token transaction transform translation unique update "
    "upload user utility validation value variable version visible warning website window workflow wrapper"
)
SPAN = "struct<start:int,kind:int,stop:int>"
RANDOM = 3
#: Items that are gathered in one growing array; code points of a piece of a text that is cut out of it.
PART, PIECE = 256, 1024


def _bind(x: Column, f) -> Column:
    """``f`` of the value of ``x``, which is computed once; inside other lambdas a column would be computed for every element."""
    return F.get(F.transform(F.array(x), f), 0)


def _running(items: Column, state: Column, step, emit, kind: str) -> Column:
    """Array (of SQL type ``kind``) of ``emit(state, item)`` for each item, where ``step(state, item)`` is the next item's state.

    An array that grows is copied at every step, so results are gathered in parts of ``PART`` and the parts joined at the end.
    """

    def part(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out"))

    def run(all_items: Column) -> Column:
        def whole(acc: Column, k: Column) -> Column:
            begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
            done = F.aggregate(F.slice(all_items, k * PART + 1, F.lit(PART)), begin, part)
            return _bind(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        parts = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / PART).cast("int"))
        return F.when(F.size(all_items) > 0, F.flatten(F.aggregate(parts, begin, whole, lambda acc: acc["out"]))).otherwise(F.array().cast(f"array<{kind}>"))

    return _bind(items, run)


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of all matches in order; ``keep`` is an array of booleans, one a match."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size")), lambda x: x["size"].isNotNull())  # the last gap has no match behind it
    start = lambda at, x: at + x["gap"]
    span = lambda at, x: F.struct(start(at, x).alias("start"), F.lit(kind).alias("kind"), (start(at, x) + x["size"]).alias("stop"))
    found = _running(steps, F.lit(0), lambda at, x: start(at, x) + x["size"], span, SPAN)
    if keep is None:
        return found
    return F.transform(F.filter(F.arrays_zip(found.alias("span"), keep.alias("keep")), lambda x: x["keep"]), lambda x: x["span"])


def _free(runs: Column, base: Column) -> Column:
    """The ``runs`` that touch no span of ``base``; both in order of start.

    Of all spans in order, one to the right sees the farthest stop of the base spans before each run, one to the left the next base start behind it.
    """
    is_base = lambda x: x["kind"] != RANDOM
    seen = f"struct<x:{SPAN},free:boolean>"
    right = _running(
        F.sort_array(F.concat(base, runs)), F.lit(0), lambda far, x: F.when(is_base(x), F.greatest(far, x["stop"])).otherwise(far),
        lambda far, x: F.struct(x.alias("x"), (far <= x["start"]).alias("free")), seen,
    )
    left = _running(
        F.reverse(right), F.lit(2**31 - 1), lambda near, y: F.when(is_base(y["x"]), y["x"]["start"]).otherwise(near),
        lambda near, y: F.struct(y["x"].alias("x"), (y["free"] & (near >= y["x"]["stop"]) & ~is_base(y["x"])).alias("free")), seen,
    )
    return F.transform(F.filter(left, lambda y: y["free"]), lambda y: y["x"])


def _when(hit: Column, spans: Column) -> Column:
    return F.when(hit, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


#: What a pair of characters of a word is: next to each other inside it, its first two, its last and first.
INSIDE, BEGIN, AROUND = 0, 1, 2


def _transitions(strings: DataFrame) -> DataFrame:
    """(label, kind, a, b, n): counts of the character pairs of ``strings(label, s, n)``, as ASCII codes."""
    code = lambda i: F.ascii(F.substr("s", i, F.lit(1)))
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    inside = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: pair(INSIDE, code(i), code(i + 1)))
    ends = F.array(pair(BEGIN, code(F.lit(1)), code(F.lit(2))), pair(AROUND, code(F.length("s")), code(F.lit(1))))
    each = strings.where(F.length("s") >= 2).select("label", "n", F.explode(F.concat(inside, ends)).alias("p"))
    return each.groupBy("label", "p.kind", "p.a", "p.b").agg(F.sum("n").alias("n"))


def _outside(text: Column) -> Column:
    """The text with its base spans blanked out."""
    for pattern, hint in ((ASSIGN, text.rlike(ASSIGN)), (ACCESS, F.contains(text, F.lit("AKIA"))), (HEX, text.rlike(HEX))):
        text = F.when(hint, F.regexp_replace(text, F.lit(pattern), F.lit(" "))).otherwise(text)
    return text


def _forms(counts: list, kind: int, a: str, b: str, n: float) -> None:
    """Adds what a pair of an ordinary word's characters stands for: the word itself, five times as it is, and its other forms."""

    def add(x: str, y: str, times: float = 1) -> None:
        counts[ord(x)][ord(y)] += times * n

    if kind == INSIDE:
        add(a, b, 5)
        add(a.lower(), b.lower(), 3)  # lower case, and twice after a capital
        add(a.upper(), b.upper())
    elif kind == BEGIN:  # the two capitalised forms begin with a capital
        add(a.upper(), b.lower(), 2)
        add(a.lower(), b.lower(), -2)
    else:
        for x, y in ((a, "_"), ("_", b), (a, b.upper()), (a.lower(), b.upper()), (a.lower(), "-"), ("-", b), (a, "/"), ("/", b)):
            add(x, y)


def train(docs: DataFrame, strings: int = 4000) -> list[float]:
    """128 * 128 log-likelihood ratios, random over ordinary, of a character given the one before it."""
    spark = docs.sparkSession
    sha = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    wide = F.base64(F.unhex(F.concat(sha("a"), sha("b"))))
    made = spark.range(0, strings, 1, 4).select(
        F.explode(F.array(wide, F.translate(wide, "+/=", ""), F.translate(wide, "+/", "-_"), F.regexp_replace(F.upper(wide), "[^A-Z0-9]", ""), sha("c"), F.regexp_replace(F.lower(wide), "[^a-z0-9]", ""))).alias("s")
    )
    rulers = F.transform(F.split(F.lit("_ - = + / A a 0 x"), " "), lambda x: F.repeat(x, 40))
    day = F.expr("date_add(date'2000-01-01', int(id % 20000))")
    numbers = F.array(F.date_format(day, "yyyy-MM-dd-HH-mm-ss"), F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "yyyyMMdd"), F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string"))
    plain = spark.range(0, 100, 1, 1).select(F.explode(rulers).alias("s")).union(spark.range(0, strings, 1, 1).select(F.explode(numbers)))
    listed = spark.range(1).select(F.explode(F.split(F.lit(ORDINARY), " ")).alias("s")).select("s", F.lit(200).cast("long").alias("n"))
    words = F.filter(F.regexp_extract_all(_outside(F.col("text")), F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: F.length(w) <= 40)
    corpus = docs.where("text is not null").select(F.explode(words).alias("s")).groupBy("s").agg(F.count("*").alias("n")).union(listed)
    once = F.lit(1).cast("long").alias("n")
    every = made.select(F.lit(1).alias("label"), "s", once).union(plain.select(F.lit(0), "s", once)).union(corpus.select(F.lit(2), "s", "n"))
    counts = [[[0.0] * 128 for _ in range(128)] for _ in range(2)]
    for r in _transitions(every).where("a between 0 and 127 and b between 0 and 127 and (label = 2 or kind = 0)").collect():  # at most 5 * 128 * 128 rows
        if r.label == 2:
            _forms(counts[0], r.kind, chr(r.a), chr(r.b), float(r.n))
        else:
            counts[r.label][r.a][r.b] += r.n
    out = []
    alphabet = 67
    for a in range(128):
        total = [sum(counts[c][a]) for c in range(2)]
        for b in range(128):
            p = [(counts[c][a][b] + 0.5) / (total[c] + 0.5 * alphabet) for c in range(2)]
            out.append(math.log(p[1] / p[0]))
    return out


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, in order of start, then kind."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 12)
    found = F.concat(
        _when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, long_enough)),
        _when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)),
        _when(text.rlike(HEX), _spans(text, HEX, 2)),
    )
    return F.sort_array(found)


def _excess(s: Column, table: Column, threshold: float) -> Column:
    """The largest sum of transition ratios less the threshold over the parts of ``s``, an ASCII string, of at least 16 characters."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    pairs = lambda x: F.zip_with(F.slice(x, 1, F.length(s) - 1), F.slice(x, 2, F.length(s) - 1), lambda a, b: F.get(table, a * 128 + b) - threshold)
    begin = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("last"), F.lit(0.0).alias("before"), F.lit(float("-inf")).alias("best"))

    def step(acc: Column, t: Column) -> Column:
        n = acc["n"] + 1
        last = acc["last"] + t["x"] - t["y"]  # the last 15
        before = F.greatest(acc["before"] + t["y"], F.lit(0.0))  # the best that ends where they begin
        return F.struct(n.alias("n"), last.alias("last"), before.alias("before"), F.when(n >= LEAST - 1, F.greatest(acc["best"], last + before)).otherwise(acc["best"]).alias("best"))

    def best(each: Column) -> Column:
        late = F.slice(F.concat(F.array_repeat(F.lit(0.0), LEAST - 1), each), 1, F.size(each))  # what left the last 15 transitions
        return F.aggregate(F.zip_with(each, late, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), begin, step, lambda acc: acc["best"])

    return _bind(_bind(codes, pairs), best)


def scan(docs: DataFrame, ratios: list[float], threshold: float = 0.75) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind number, stop), in order of start, then kind."""
    fresh_names(docs, "base", "spans", "_runs")
    text = F.coalesce("text", F.lit(""))
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")
    likely = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda s: _excess(s, table, threshold) >= 0)
    found = docs.withColumn("base", base_spans(text)).withColumn("_runs", _when(text.rlike(RUN), _spans(text, RUN, RANDOM, likely)))
    spans = F.when(F.size("_runs") > 0, F.sort_array(F.concat("base", _free(F.col("_runs"), F.col("base"))))).otherwise(F.col("base"))
    return found.withColumn("spans", spans).drop("_runs")


def listed(spans: str) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _cut(pieces: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` of a text in pieces of ``PIECE``."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor((stop - 1) / PIECE).cast("int") - first + 1)

    def part(p: Column, i: Column) -> Column:
        before = (first + i) * PIECE
        low = F.greatest(start - before, F.lit(0))
        return F.substr(p, low + 1, F.least(stop - before, F.lit(PIECE)) - low)

    return F.when(stop > start, F.array_join(F.transform(some, part), "")).otherwise(F.lit(""))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` of ``scan`` with each span of ``text`` replaced by ``mark`` (overlapping spans by one)."""
    text = F.coalesce("text", F.lit(""))
    gap = "struct<start:int,stop:int,last:int>"
    kept = _running(F.col("spans"), F.lit(0), lambda at, x: F.greatest(at, x["stop"]), lambda at, x: F.struct(at.alias("start"), x["start"].alias("stop"), F.greatest(at, x["stop"]).alias("last")), gap)

    def joined(pieces: Column) -> Column:
        return _bind(kept, lambda gaps: F.concat(
            F.array_join(F.transform(F.filter(gaps, lambda g: g["stop"] >= g["start"]), lambda g: F.concat(_cut(pieces, g["start"], g["stop"]), F.lit(mark))), ""),
            _cut(pieces, F.element_at(gaps, -1)["last"], F.length(text)),
        ))

    whole = _bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), joined)
    return docs.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))


def _digest(found: DataFrame, *more: Column) -> DataFrame:
    """The counts of base spans of each kind and their digest."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), *more)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _digest(scan(docs, train(docs)), listed("spans").alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express, those of the base spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _digest(docs.withColumn("base", base_spans(F.coalesce("text", F.lit("")))))


#: Matches by ``regexp_extract_all``; each is found again from the end of the one before to get its place.
SECRET_BASE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k(k, name, pattern) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')),
m AS (SELECT doc_id, k, name, pattern, text, CASE k
        WHEN 0 THEN regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)')
        WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(text, '[0-9a-f]+') END AS found,
      CASE k
        WHEN 0 THEN regexp_split_to_array(text, '((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)')
        WHEN 1 THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]+') ELSE regexp_split_to_array(text, '[0-9a-f]+') END AS gaps FROM d, k),
s AS (SELECT doc_id, k, name, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM m WHERE len(found) > 0),
t AS (SELECT doc_id, k, name, found[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start FROM s),
b AS (SELECT doc_id, k, name, start::BIGINT AS start, (start + length(hit))::BIGINT AS stop FROM t WHERE CASE k
        WHEN 0 THEN length(regexp_extract(hit, '((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 12
        WHEN 1 THEN length(hit) >= 18 ELSE length(hit) >= 16 END),
g AS (SELECT doc_id, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, k) AS l FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
