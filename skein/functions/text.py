"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of a test file's path, and the verbs looked for in a call's text.
TEST_MARKS = ("src/test/", "tests/", "__tests__/", "Tests.java", ".test.", ".spec.")
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def slug(value: Column) -> Column:
    """A name for comparison: no blanks or quotes around, dashes for underscores, lower case, no scheme, no path."""
    bare = F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")
    return F.substring_index(F.regexp_replace(F.lower(F.replace(bare, F.lit("_"), F.lit("-"))), "^https?://", ""), "/", 1)


def first_string(value: Column) -> Column:
    """The first quoted literal, or ''."""
    return F.coalesce(F.nullif(F.regexp_extract(value, '"([^"]*)"', 1), F.lit("")), F.regexp_extract(value, "'([^']*)'", 1))


def join_paths(*parts: Column) -> Column:
    """One path from parts, each without its outer slashes; empty parts fall away."""
    cleaned = F.filter(F.array(*(F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", "") for p in parts)), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(cleaned, "/"))


def normalize_path(path: Column) -> Column:
    """A path with one leading slash, none at its end, and {} for every placeholder."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\{[^}]*\}", "{}"), "^/+|/+$", ""))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:https?://)?([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:https?://)?[^/?#]*(/[^?#]*)", 1)


def infer_http_method(text: Column) -> Column:
    """The first of the verbs that the text contains in any case, else GET."""
    upper = F.upper(text)
    out = F.lit("GET")
    for verb in reversed(VERBS):
        out = F.when(upper.contains(verb), verb).otherwise(out)
    return out


def xml_attr(attrs: Column, name: str) -> Column:
    return F.regexp_extract(attrs, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def xml_tag_value(body: Column, tag: str) -> Column:
    return F.trim(F.regexp_extract(body, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line, from 1, in which the character offset lies."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def sql_operation(text: Column) -> Column:
    """The statement's verb in upper case if a blank, a tab or a bracket follows it, else ''."""
    return F.upper(F.regexp_extract(text, r"(?i)^\s*(select|insert|update|delete|merge|call)[ \t(]", 1))


def strip_segments(path: Column, n: int) -> Column:
    """A path without its first n segments."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts), F.lit(1))), "/"))


def gateway_path(pattern: Column, n: int = 0) -> Column:
    """A gateway's target path: the first of its patterns, without the stars at its end and its first n segments."""
    return strip_segments(F.regexp_replace(F.trim(F.substring_index(pattern, ",", 1)), r"\*\*$", ""), n)


def extract_topics(text: Column) -> Column:
    """The literals of a list or a single value given as `topics`, else all quoted literals, else an unknown one."""
    quoted = lambda x: F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1))
    single = F.regexp_extract(text, r'topics\s*=\s*"([^"]+)"', 1)
    given = F.concat(quoted(F.regexp_extract(text, r"topics\s*=\s*\{([^}]+)\}", 1)), F.filter(F.array(single), lambda x: x != ""))
    found = F.when(F.size(given) > 0, given).otherwise(quoted(text))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("{unknown}")))


def group_id(text: Column) -> Column:
    """The literal given as `groupId`, or ''."""
    return F.regexp_extract(text, r'groupId\s*=\s*"([^"]+)"', 1)


def object_string_value(text: Column, key: str) -> Column:
    """The quoted value of a key of an object literal, or ''."""
    return F.regexp_extract(text, rf"""{key}\s*:\s*['"]([^'"]+)['"]""", 1)


def action_path(namespace: Column, name: Column, extension: Column) -> Column:
    """The path of an action: absolute as it stands, else below its namespace; with the extension unless it ends so."""
    action = F.trim(name)
    base = F.when(action.startswith("/"), action).otherwise(join_paths(namespace, action))
    return F.when((extension != "") & ~base.endswith(extension), F.concat(base, extension)).otherwise(base)


def sent_topic(text: Column, methods: list[str]) -> Column:
    """literal and variable: what follows the longest of the sending methods that the text has, as far as either can be read."""
    out = F.struct(F.lit(None).cast("string").alias("literal"), F.lit(None).cast("string").alias("variable"))
    for m in sorted(methods, key=len):
        tail = F.substring(text, F.locate(m, text) + len(m), F.length(text))
        literal, variable = F.nullif(F.regexp_extract(tail, r'^\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract(tail, r"^\s*(\w+)", 1), F.lit(""))
        found = F.struct(literal.alias("literal"), F.when(literal.isNull(), variable).alias("variable"))
        out = F.when(text.contains(m) & (literal.isNotNull() | variable.isNotNull()), found).otherwise(out)
    return out


def string_fields(text: Column) -> Column:
    """name -> value of string fields that a class's text sets; of a name set twice the last value."""
    found = F.regexp_extract_all(text, F.lit(r'\bString\s+(\w+\s*=\s*"[^"]+")'), F.lit(1))
    pair = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1), F.regexp_extract(x, r'"([^"]+)"', 1)))
    return F.aggregate(pair, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["col1"]), F.create_map(p["col1"], p["col2"])))


def previous_key(lines: Column, at: Column, key: str) -> Column:
    """Whether one of the four lines before line `at` (from 0) starts with the key and a colon."""
    start = F.greatest(at - 4, F.lit(0))
    return F.exists(F.slice(lines, start + 1, at - start), lambda x: x.rlike(rf"^\s*{key}\s*:"))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case; split before lowering, so that accented letters part words."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+"), lambda t: t != ""), lambda t: F.lower(t))


def is_test_path(path: Column) -> Column:
    out = F.lit(False)
    for mark in TEST_MARKS:
        out = out | F.coalesce(path, F.lit("")).contains(mark)
    return out


def source_family(source: Column) -> Column:
    """The kind of extractor that a node comes from."""
    s = F.coalesce(source, F.lit(""))
    return (
        F.when(s.startswith("pack:"), "pack").when(s.startswith("llm:"), "llm").when(s.startswith("otel-trace"), "trace")
        .when(s == "embedding-similarity", "embedding").when(s == "deterministic-search", "search").when(s == "cgc-import", "cgc")
        .when(s == "", "unknown").otherwise(s)
    )


def template(text: str, captures: dict[str, Column]) -> Column:
    """A template with {{a|b|literal}} parts: the first capture that is not empty, else the last part as it stands."""
    import re

    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{\{(.*?)\}\}", text)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
            continue
        names = [x.strip() for x in piece.split("|")]
        tried = [F.nullif(captures[x], F.lit("")) for x in names if x in captures]
        spare = F.lit(names[-1]) if len(names) > 1 and names[-1] not in captures else F.lit("")
        parts.append(F.coalesce(*tried, spare))
    return F.concat(*parts) if parts else F.lit("")
