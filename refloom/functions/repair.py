"""Repairs of single values and whole file texts as Column expressions.

All are built-in expressions, but for accent removal, which needs Unicode normal
forms. Each is NULL for NULL, so a repair can be applied to any column.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom import schema
from refloom.functions.normalize import strip

#: Two backslashes before a character, and what the four known cases become.
BROKEN_ACCENTS = (("\u0308", '"'), ("\u0301", "\\'"), ("ś", "\\'{s}"), ("ł", "\\l{}"))
#: HTML entities in the order of their replacement.
ENTITIES = (("&amp;", "\\&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
#: Month names and short forms.
MONTHS = {
    "jan": "1", "january": "1", "feb": "2", "february": "2", "mar": "3", "march": "3", "apr": "4", "april": "4", "may": "5", "jun": "6", "june": "6", "jul": "7", "july": "7",
    "aug": "8", "august": "8", "sep": "9", "sept": "9", "september": "9", "oct": "10", "october": "10", "nov": "11", "november": "11", "dec": "12", "december": "12",
}
#: Letters that the author repair writes as LaTeX commands.
AUTHOR_LETTERS = {"ń": "\\'{n}", "á": "\\'{a}", "é": "\\'{e}", "í": "\\'{i}", "ó": "\\'{o}", "ú": "\\'{u}", "ü": '\\"{u}', "ö": '\\"{o}', "ł": "\\l{}", "ć": "\\'{c}", "ś": "\\'{s}", "ź": "\\'{z}", "ą": "\\'{a}", "ę": "\\'{e}"}
NAME_FIELDS = ("author", "editor", "translator", "title", "booktitle", "journal")


def _all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def valid_text(content: Column) -> Column:
    """File bytes as text without what isn't UTF-8."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def fix_broken_accents(text: Column) -> Column:
    """doubled backslashes before four known characters, in the text of a file."""
    return _all(text, [("\\\\" + c, new) for c, new in BROKEN_ACCENTS])


def count_broken_accents(text: Column) -> Column:
    """How many places F1 changes."""
    return sum((F.floor((F.length(text) - F.length(F.replace(text, F.lit("\\\\" + c), F.lit("")))) / F.lit(3)).cast("long") for c, _ in BROKEN_ACCENTS), F.lit(0).cast("long"))


def fix_unicode(text: Column) -> Column:
    """box-drawing dashes and loose acute accents, line by line; lines that begin with a percent sign stay."""

    def line(x: Column) -> Column:
        y = F.regexp_replace(F.replace(x, F.lit("\u2500"), F.lit("--")), r"(\p{L})\x{301}", r"\\'{$1}")
        return F.when(F.startswith(strip(x), F.lit("%")), x).otherwise(y)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def fix_html(value: Column) -> Column:
    """entities in their order, then every ampersand that isn't escaped."""
    return F.regexp_replace(_all(value, ENTITIES), r"(?<!\\)&(?!amp;|lt;|gt;|quot;|apos;|\\&)", r"\\&")


def escape_percent(value: Column) -> Column:
    """a backslash before each percent sign that an even number of backslashes precedes; idempotent."""
    return F.regexp_replace(value, r"(?<!\\)((?:\\\\)*)%", r"$1\\%")


#: Patterns in author fields and what they become, in their order.
AUTHOR_PATTERNS = ((r"([A-Za-z])\\{4,}([a-z]+)", r'$1{\\"u}$2'), (r"\\{4,}", r"\\"), (r",\s*\\+\s*([,}])", ",$1"), (r"([A-Za-z])\s*\\+\s*$", "$1"))
#: Sequences that stand for letters, and the commands for these.
AUTHOR_SEQUENCES = (("\\ν", "\\'{n}"), ("\\μ", "\\'{u}"), ("\\149", "\\'{n}"))


def fix_author(value: Column) -> Column:
    """surplus backslashes, names that end in one, and letters that compilers stumble over."""
    for pattern, new in AUTHOR_PATTERNS:
        value = F.regexp_replace(value, pattern, new)
    return _all(value, [*AUTHOR_SEQUENCES, *AUTHOR_LETTERS.items()])


_COMMAND = re.compile(r"""\\['"`^~=]\{([^}]+)\}""")
_ANY = re.compile(r"\\.\{([^}]+)\}")


def plain_letters(text: str) -> str:
    """Accent commands unwrapped and accents taken off; letters such as the barred l have none and stay."""
    text = _ANY.sub(r"\1", _COMMAND.sub(r"\1", text))
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", bare)


@F.pandas_udf(T.StringType())
def remove_accents(s: pd.Series) -> pd.Series:
    """F6 as an Arrow function; ASCII values without a backslash are returned at once."""
    return s.map(lambda x: x if x.isascii() and "\\" not in x else plain_letters(x), na_action="ignore")


def _bare(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^[{}]+|[{}]+$", "")


def fix_year(value: Column) -> Column:
    """F8: the year of a date; whole numbers and all else stay."""
    y = _bare(value)
    return F.when(y.rlike(r"^[0-9]{4}[-/]"), F.substring(y, 1, 4)).otherwise(value)


def fix_month(value: Column) -> Column:
    """month names as numbers; unknown ones stay."""
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(_bare(value))), value)


def drop_fields(fields: Column, names: tuple[str, ...] = schema.DROPPED_FIELDS) -> Column:
    """fields without those of the given names, whatever their case."""
    low = [n.lower() for n in names]
    return F.map_filter(fields, lambda k, _: ~F.lower(k).isin(*low))


def repair_commented(raw: str | None) -> str | None:
    """a commented entry without its wrapper, commas put in, brackets balanced. None if there is no entry inside.

    The whole text is taken, however many lines it has; the parser has found its end.
    """
    m = re.match(r"@\s*comment\s*\{\s*(?=@\w+\s*\{)", raw or "", re.IGNORECASE)
    if not m or not re.match(r"@\w+\s*\{([^,}]+)", raw[m.end() :]):
        return None
    body = raw[m.end() :].rstrip()
    body = re.sub(r"\}(\s+)(?=[A-Za-z][\w-]*\s*=\s*[{\"\w])", r"},\1", body)
    depth = 0
    for i, c in enumerate(body):
        depth += {"{": 1, "}": -1}.get(c, 0)
        if depth == 0 and i and c == "}":
            return body[: i + 1]
    return body.rstrip(", \n") + "\n" + "}" * depth
