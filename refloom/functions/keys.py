"""Citation keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.normalize import strip


def _text(fields: Column, name: str) -> Column:
    return F.coalesce(fields[name], F.lit(""))


def citation_key(fields: Column) -> Column:
    """Last name of the first author, year, initials of the journal, first word of the title.

    A key that doesn't begin with a letter gets a k in front; blank parts add nothing.
    """
    first = strip(F.split_part(_text(fields, "author"), F.lit(" and "), F.lit(1)))
    words = F.filter(F.split(first, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    last = F.when(F.contains(first, F.lit(",")), F.split_part(first, F.lit(","), F.lit(1))).otherwise(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
    last = F.regexp_replace(last, "[^A-Za-z]", "")
    year = F.regexp_replace(_text(fields, "year"), "[^0-9]", "")
    initials = F.array_join(
        F.filter(F.transform(F.split(_text(fields, "journal"), r"(?U)[\s\x1c-\x1f]+"), lambda w: F.substring(w, 1, 1)), lambda c: c.rlike(r"^\p{L}")), ""
    )
    title_words = F.filter(F.split(_text(fields, "title"), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    title = F.regexp_replace(F.coalesce(F.try_element_at(title_words, F.lit(1)), F.lit("")), "[^A-Za-z0-9]", "")
    key = F.concat(last, year, initials, title)
    return F.when((key != "") & ~key.rlike(r"^\p{L}"), F.concat(F.lit("k"), key)).otherwise(key)


def sanitized(key: Column) -> Column:
    """A key without characters that citations can't hold; one that would be empty stays."""
    clean = F.regexp_replace(key, "[^A-Za-z0-9_:-]", "")
    return F.when(clean == "", key).otherwise(clean)
