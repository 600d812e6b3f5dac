"""String functions: published names, links, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def published_name(name: Column, line: Column) -> Column:
    """The name if it looks like an identifier, ``<anonymous>@line`` for an empty one, else ``<computed>@line``."""
    at = line.cast("string")
    return F.when(name.rlike(r"^[\p{L}\p{N}_$.#]+$"), name).when(name == "", F.concat(F.lit("<anonymous>@"), at)).otherwise(F.concat(F.lit("<computed>@"), at))


def location(path: Column, start: Column, end: Column) -> Column:
    """``path#Lstart-Lend``."""
    return F.concat(path, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def annotation_data(text: Column) -> Column:
    """Message text of a workflow annotation: percent and line ends escaped."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def annotation_property(text: Column) -> Column:
    """Property of a workflow annotation: also colon and comma."""
    return F.replace(F.replace(annotation_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def html(text: Column) -> Column:
    """Text for HTML content and attributes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def line_count(text: Column) -> Column:
    """Lines of a text; a last line end starts no line."""
    n = F.length(text) - F.length(F.translate(text, "\n", ""))
    return (n + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


#: Code points that turn the reading direction, as inclusive ranges.
BIDI = ((0x61C, 0x61C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069))
UNSAFE = "[\\x{00}-\\x{1F}\\x{7F}-\\x{9F}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in BIDI) + "]"


def percent_encoded(path: Column) -> Column:
    """Path with every byte of its segments but unreserved ones as ``%XX``; slashes stay."""
    one = lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def terminal(text: Column) -> Column:
    """Text whose control and direction characters are ``\\u{hex}``, so that it can't move a cursor or reorder a line."""
    code = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "^0+(?=.)", "")
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(UNSAFE), F.concat(F.lit("\\u{"), code(c), F.lit("}"))).otherwise(c))
    return F.when(text.rlike(UNSAFE), F.array_join(each, "")).otherwise(text)


def framed_digest(domain: str, version: int, *parts: Column) -> Column:
    """SHA-256 over a domain, a version and parts each behind its length in bytes, so that no two lists of parts are hashed alike."""
    framed = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(F.lit(f"{domain}/{version}/"), *framed).cast("binary"), 256)


def framed_array_digest(domain: str, version: int, parts: Column) -> Column:
    """``framed_digest`` over the members of an array, such as the tokens of flagged statements."""
    framed = F.transform(parts, lambda p: F.concat(F.octet_length(p).cast("string"), F.lit(":"), p))
    return F.sha2(F.concat(F.lit(f"{domain}/{version}/"), F.array_join(framed, "")).cast("binary"), 256)


def excerpt(text: Column, start: Column, lines: int = 20, size: int = 4096) -> Column:
    """(text, truncated): up to ``lines`` lines from line ``start`` and ``size`` bytes, cut at a character."""
    every = F.split(text, "\n", -1)
    some = F.array_join(F.slice(every, start.cast("int"), lines), "\n")
    raw = some.cast("binary")
    short = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, size - k).cast("string")) for k in range(4)])
    long = F.octet_length(some) > size
    return F.struct(F.when(long, short).otherwise(some).alias("text"), (long | (F.size(every) - start + 1 > lines)).alias("truncated"))


def scrubbed(message: Column, folders: list[str]) -> Column:
    """Message without local folders: the longest of ``folders`` first, each as ``<path>``."""
    for f in sorted(folders, key=len, reverse=True):
        message = F.replace(message, F.lit(f), F.lit("<path>"))
    return message
