"""Scalar normalisers as Column expressions.

All but the Unicode normal forms stay in whole-stage code generation. Python
strips and splits on more blanks than Java's ``\\s`` knows, so the class is
spelled out once and used everywhere.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks as the record format's readers understand them.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The same blanks, one by one.
BLANKS = "".join(chr(n) for n in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column | str) -> Column:
    """Outer blanks removed, Unicode blanks included. NULL stays NULL. Linear, however long a run of blanks is."""
    return F.btrim(_col(c), F.lit(BLANKS))


def present(c: Column | str) -> Column:
    """NULL for the empty string: an empty field counts as absent."""
    return F.nullif(_col(c), F.lit(""))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize_unicode(c: Column | str) -> Column:
    """NFC; NULL and the empty string give NULL."""
    return _nfc(present(c))


def with_nfc(df: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with N1 of a column. ASCII values, nearly all of them, cross into Python as NULL and are taken as they are."""
    own = present(F.col(source))
    plain = own.rlike(r"^[\x00-\x7F]*$")
    return df.withColumn(target, F.coalesce(F.when(plain, own), _nfc(F.when(~plain, own))))


def normalize_doi(c: Column | str) -> Column:
    """Stripped, lower-cased DOI without the three known prefixes, removed in turn.

    Blank gives NULL; a bare prefix gives the empty string.
    """
    x = F.nullif(F.lower(strip(c)), F.lit(""))
    for prefix in ("doi:", "http://dx\\.doi\\.org/", "https://doi\\.org/"):
        x = F.regexp_replace(x, f"^{prefix}", "")
    return strip(x)


def normalize_url(c: Column | str) -> Column:
    """Stripped URL with a lower-cased scheme; NULL and blank give NULL."""
    x = strip(c)
    scheme = F.regexp_extract(x, "^[A-Za-z]+://", 0)
    return F.nullif(F.concat(F.lower(scheme), F.substring(x, F.length(scheme) + 1, F.length(x))), F.lit(""))


def normalize_keywords(c: Column | str) -> Column:
    """Comma list with each part stripped and lower-cased; nothing left gives NULL."""
    parts = F.filter(F.transform(F.split(_col(c), ","), lambda p: F.lower(strip(p))), lambda p: p != "")
    return F.nullif(F.array_join(parts, ","), F.lit(""))


def normalize_title(c: Column | str) -> Column:
    """Braces dropped, dashes and blanks folded to one space, stripped, lower-cased.

    Other punctuation is kept. NULL gives the empty string.
    """
    x = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[{}]", "")
    x = F.regexp_replace(x, r"[-–—]+", " ")
    x = F.regexp_replace(x, f"{BLANK}+", " ")
    return F.lower(F.trim(x))


def lookup(fields: Column | str, *names: str) -> Column:
    """The first non-empty of several spellings of a field name."""
    m = _col(fields)
    return F.coalesce(*[present(m[n]) for n in names])


SCORED_FIELDS = ("title", "author", "year", "journal", "doi", "pages", "volume")


def entry_score(fields: Column | str, n_fields: Column | str) -> Column:
    """Filled core fields, plus a tenth of the field count (pseudo-fields included)."""
    m = _col(fields)
    filled = sum((F.coalesce((m[f] != "").cast("double"), F.lit(0.0)) for f in SCORED_FIELDS), F.lit(0.0))
    return filled + F.lit(0.1) * F.coalesce(_col(n_fields), F.lit(0)).cast("double")


def key_score(c: Column | str) -> Column:
    """Capital first letter, the name-year shape and no underscore score; length costs."""
    k = _col(c)
    return (
        F.when(k.rlike(r"^\p{Lu}"), 10.0).otherwise(0.0)
        + F.when(k.rlike(r"^[A-Z][a-z]+\d{4}"), 20.0).otherwise(0.0)
        + F.when(F.contains(k, F.lit("_")), 0.0).otherwise(5.0)
        - F.lit(0.1) * F.length(k).cast("double")
    )
