"""Scalar functions over names, paths, signatures and numbers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Methods of resolution that readers admit.
ADMISSIBLE = ("same_file", "import", "name_match")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are alike, an empty and another aren't."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def name_parts(name: Column) -> Column:
    """Lower-case parts of a snake, kebab, dotted or camel case name; acronyms stay whole."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


def words(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of letters, digits and underscores of some length, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]{%d,}" % (least - 1)), F.lit(0)))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"))


def normalized_path(path: Column) -> Column:
    """Forward slashes, without leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def is_test_path(path: Column) -> Column:
    """Whether a path lies in a folder for tests or has a test's file name."""
    return path.rlike(r"(^|/)(tests?|__tests__|spec|testdata)/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*(_test|\.test|\.spec|_spec)\.[a-z]+)$")


def last_component(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def truncated(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def parameter_count(signature: Column) -> Column:
    """Parameters of a signature; commas within brackets (five deep at most) separate none."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    for _ in range(5):
        inner = F.regexp_replace(inner, r"[\[({<][^\[\](){}<>]*[\])}>]", "")
    return F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))


def component_overlap(a: Column, b: Column) -> Column:
    """Shared parts of two names by the larger number of parts."""
    x, y = F.array_distinct(name_parts(a)), F.array_distinct(name_parts(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def module_score(a: Column, b: Column) -> Column:
    """Shared parts of two paths by the smaller number of parts."""
    x, y = F.array_distinct(name_parts(a)), F.array_distinct(name_parts(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))


def has_keyword(text: Column, keyword: str) -> Column:
    """Whether a text holds a word, with no letter, digit or underscore beside it."""
    return text.rlike(r"(?i)(^|[^A-Za-z0-9_])" + keyword + r"($|[^A-Za-z0-9_])")


def assertion_kind(name: Column) -> Column:
    """equality, exception, truth, membership or other for the name of an assertion; null for other names."""
    low = F.lower(name)
    kind = F.when(low.rlike("raises|throws|error"), "exception").when(low.rlike("equal|same|is_eq|assert_eq|tobe|deep"), "equality").when(low.rlike("true|false|none|null|nil"), "truth").when(low.rlike("in$|contain|match"), "membership").otherwise("other")
    return F.when(low.rlike("^(assert|expect|should|require|must)"), kind)


def sanitized(text: Column, most: int = 2000) -> Column:
    """Without control characters but tab and line ends, cut to a length."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, most)


def json_list(text: Column) -> Column:
    """The strings of a JSON list; null where it is none."""
    return F.from_json(text, "array<string>")


def dig(text: Column, path: str) -> Column:
    """A value within JSON text by a path like ``a.b``; null where there is none."""
    return F.get_json_object(text, "$." + path)


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_critical(path: Column) -> Column:
    """Whether a path speaks of money, identity or safety."""
    return F.lower(path).rlike(r"auth|login|payment|billing|security|crypt|permission|migration|admin")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def is_source_path(path: Column) -> Column:
    """Whether a path is a source file outside of tests and documents."""
    return path.rlike(r"\.(py|js|jsx|ts|tsx|go|java|rs|rb|php|c|cc|cpp|h|cs|scala|kt|swift)$") & ~is_test_path(path) & ~is_docs_path(path)


def is_docs_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(docs?|documentation)/|\.(md|rst|txt)$")


def evidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "VERIFIED").when(confidence >= 0.5, "WARNING").otherwise("INFO")


def risk_tag(score: Column) -> Column:
    return F.when(score >= 0.7, "CRITICAL").when(score >= 0.45, "HIGH").when(score >= 0.25, "MODERATE").otherwise("LOW")


def api_path(url: Column) -> Column:
    """A URL's path without parameters: braces, colons, angle brackets, numbers and long identifiers leave out a segment."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^(\{.*\}|:.+|<.*>|[0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})$"))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of the Wilson interval, (0, 0) without trials."""
    p = successes / total
    middle = p + z * z / (2 * total)
    spread = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    scale = 1 + z * z / total
    low, high = F.greatest(F.lit(0.0), (middle - spread) / scale), F.least(F.lit(1.0), (middle + spread) / scale)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
