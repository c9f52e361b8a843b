"""Scalar text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(\S+)"
TERM = "([a-z0-9]+)"
CODE_TOKEN = r"([a-z0-9_./-]{2,})"


def bound(value: Column, step: Callable[[Column], Column]) -> Column:
    """A step over a value that is computed once, however often the step names it: a lambda binds it, also where a filter on the
    result is pushed down with its whole expression."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.regexp_extract_all(text, F.lit(WORD), 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def terms(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs: the unit of keyword search."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 1)


def code_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(CODE_TOKEN), 1)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def shingles(text: Column, size: int = 5) -> Column:
    """All substrings of `size` characters; none for a shorter text. A look-ahead keeps it linear in the text's length."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles and the like dropped, tags to spaces, the five common entities decoded, white space to single spaces."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0B]+", " "))


def preview(text: Column, size: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit(tail))).otherwise(text)


def chunk_id(url: Column, index: Column) -> Column:
    return F.sha2(F.concat(url, F.lit(":"), index.cast("string")).cast("binary"), 256)


def parent_id(url: Column, index: Column) -> Column:
    return F.sha2(F.concat(url, F.lit(":parent:"), index.cast("string")).cast("binary"), 256)


def child_id(parent: Column, index: Column) -> Column:
    return F.sha2(F.concat(parent, F.lit(":child:"), index.cast("string")).cast("binary"), 256)


def csv_list(text: Column) -> Column:
    """Comma-separated values, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def urls(text: Column, most: int | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(https://[^\s)>]+)"), 1)
    return found if most is None else F.slice(found, 1, most)


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute links as they are, root-relative ones on the host, others on the page's folder."""
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(link.rlike("^https?://"), link).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(folder, link))


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity of two numeric arrays in double precision."""
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot / (norm(x) * norm(y))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def prettified(name: Column) -> Column:
    """Metric class names for people: no `Metric` at the end, words of camel case set apart."""
    return F.regexp_replace(F.regexp_replace(name, "Metric$", ""), "([a-z])([A-Z])", "$1 $2")


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
