"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no query intent.
STOP_WORDS = [
    "the", "a", "an", "of", "to", "in", "is", "are", "how", "does", "do", "what",
    "where", "which", "that", "this", "it", "for", "on", "and", "or", "with",
    "i", "we", "get", "set", "use", "used", "using", "when", "why", "can",
]

# Fixed value: which paths count as tests.
TEST_PATH = (
    r"(?i)(^|/)(tests?|__tests__|spec)/|(_test|\.test|\.spec)\.[a-z]+$"
    r"|(^|/)(test_[^/]+|conftest)\.py$"
)
# Fixed value: a query that asks about tests.
TEST_QUERY = r"\b(tests?|specs?|coverage|assert(?:ion)?s?|fixtures?|mocks?)\b"
TEST_FACTOR = 0.35


def tokenize(text: Column) -> Column:
    """Lower-case subword tokens of prose or identifiers, as an array."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(F.lower(spaced), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order of first appearance."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query)
    words = re.split(r"[^a-z0-9]+", spaced.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in STOP_WORDS))


def plural_forms(term: str) -> list[str]:
    """The spellings that count as a match of ``term`` for coverage."""
    return [term, term + "s"] + ([term[:-1]] if term.endswith("s") else [])


def is_test_path(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(TEST_PATH)


def test_factor(path: Column, query: str) -> Column:
    """Rank factor of a path: tests sink unless the query asks for them."""
    if re.search(TEST_QUERY, query, re.IGNORECASE):
        return F.lit(1.0)
    return F.when(is_test_path(path), F.lit(TEST_FACTOR)).otherwise(F.lit(1.0))


def language_of(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.(tsx|jsx)$"), "tsx")
        .when(p.rlike(r"\.(ts|mts|cts|js|mjs|cjs)$"), "typescript")
        .when(p.rlike(r"\.pyi?$"), "python")
        .when(p.endswith(".go"), "go")
    )


def under_prefix(path: Column, prefix: str) -> Column:
    """Segment-aware test whether ``path`` lies at or under ``prefix``."""
    if prefix == "":
        return F.lit(True)
    return (path == prefix) | path.startswith(prefix + "/")


def scope_label(prefix: Column) -> Column:
    return F.when(prefix == "", F.lit("(root)")).otherwise(F.concat(prefix, F.lit("/")))


def slugify(name: Column) -> Column:
    flat = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    slug = F.regexp_replace(F.regexp_replace(flat, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("node")).otherwise(slug)


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest(path_and_hash: Column) -> Column:
    """Digest of an array of ``path:hash`` lines."""
    return F.sha2(F.concat_ws("\n", F.array_sort(path_and_hash)).cast("binary"), 256)


def dir_key(path: Column, depth: int) -> Column:
    return F.substring_index(path, "/", depth)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def qualified_name(id_: Column, name: Column) -> Column:
    """The part of an id after ``#``; the plain name when there is none."""
    pos = F.instr(id_, "#")
    return F.when(pos > 0, F.substring(id_, pos + 1, F.length(id_))).otherwise(name)


def to_tokens(chars: Column) -> Column:
    """Rough token count of a character count; halves round up."""
    return F.floor(chars / 4.0 + 0.5).cast("long")


def span(start: Column, end: Column) -> Column:
    return F.concat(F.lit("L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def pointer(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), span(start, end))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_body(text: Column, cap: int) -> Column:
    return F.substring(collapse(text), 1, cap)


def clean_signature(text: Column) -> Column:
    """A definition header on one line, without the token that opens its body."""
    flat = F.trim(F.regexp_replace(collapse(text), r"(=>|[{:=])\s*$", ""))
    return F.when(flat != "", flat)


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def first_prose(body: Column) -> Column:
    """First line that is neither blank, heading, comment nor list item."""
    lines = F.transform(F.split(body, "\n"), lambda s: F.trim(s))
    prose = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"^(#|<!--|-)"))
    return F.coalesce(F.get(prose, F.lit(0)), F.lit(""))


def snippet(summary: Column, signature: Column) -> Column:
    return F.coalesce(first_line(summary), signature, F.lit(""))


def literal_pattern(pattern: str) -> str:
    """Escape a literal for use as a regular expression."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", pattern)
