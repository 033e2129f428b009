"""Text: word tokens, collations, full-text match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindframe.errors import KindError

#: Fixed names of comparison strengths, with Spark's collation of the root locale. Spark has nothing stronger than tertiary, of
#: which quaternary differs in kana only; identical is built on it: texts are equal if all their characters are, and numbers in
#: them stand in order of their value.
COLLATIONS = {"primary": "UNICODE_CI_AI", "secondary": "UNICODE_CI", "tertiary": "UNICODE", "quaternary": "UNICODE", "identical": "IDENTICAL:UNICODE"}
TOKEN = r"[\p{L}\p{N}]+"


def collation(strength: str | None, locale: str | None = None) -> str | None:
    """The Spark collation of a strength; None for plain bytes. A locale such as fr replaces the root locale."""
    if strength is None:
        return None
    if strength not in COLLATIONS:
        raise KindError("InvalidCollation", strength)
    name = COLLATIONS[strength]
    return name.replace("UNICODE", locale, 1) if locale else name


def collated(c: Column, name: str | None) -> Column:
    """A key that compares as the collation does."""
    if name and name.startswith("IDENTICAL:"):
        return F.struct(F.collate(numeric(c), name.partition(":")[2]).alias("k"), c.alias("t"))
    return F.collate(c, name) if name else c


def numeric(c: Column) -> Column:
    """A text whose runs of digits are padded, so that they sort by value."""
    runs = F.regexp_extract_all(c, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.when((F.length(x) < 40) & x.rlike("^[0-9]"), F.lpad(x, 40, "0")).otherwise(x)), "")


def begins_with(c: Column, part: Column, name: str | None) -> Column:
    """Whether a text begins with another, in a collation."""
    plain = name is None or name.startswith("IDENTICAL:")
    return F.startswith(c, part) if plain else F.startswith(F.collate(c, name), F.collate(part, name))


def tokens(c: Column) -> Column:
    """The words of a text, without space and punctuation."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """Distinct words of a query; those that begin another are implied by it and left out."""
    words = sorted(set(re.findall(r"[^\W_]+", text)))
    return [w for w in words if not any(o != w and o.startswith(w) for o in words)]


def matches(token_arrays: Column, query: str, name: str | None = None) -> Column:
    """Whether each query word begins some token. No words match nothing."""
    words = query_tokens(query)

    def begins(word: str) -> Column:
        return F.exists(token_arrays, lambda t: begins_with(t, F.lit(word), name))

    found = [begins(w) for w in words]
    out = found[0] if found else F.lit(False)
    for f in found[1:]:
        out = out & f
    return out


def contains_ci(c: Column, part: str) -> Column:
    """Case-blind substring. The empty string is in the empty string only."""
    return c == "" if part == "" else F.contains(F.upper(c), F.upper(F.lit(part)))


def starts_ci(c: Column, part: str) -> Column:
    return F.startswith(F.upper(c), F.upper(F.lit(part)))


def pieces(c: Column, separator: str) -> Column:
    """A text's parts between separators, taken as plain text."""
    return F.split(c, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def equal_caseless(a: Column, b: Column) -> Column:
    return F.upper(a) == F.upper(b)


def compare_caseless(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a stands before, with or after b, whatever their case."""
    x, y = F.upper(a), F.upper(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
