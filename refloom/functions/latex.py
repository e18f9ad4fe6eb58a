"""LaTeX accents and escapes in field values as plain characters.

Decoding composes characters, for which Spark has no built-in function; it runs
inside the parser, whose values are in Python anyway, or as an Arrow function.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accent commands and the combining marks they stand for, by code point.
ACCENTS = {"'": 0x301, "`": 0x300, '"': 0x308, "^": 0x302, "~": 0x303, "=": 0x304, ".": 0x307, "u": 0x306, "v": 0x30C, "H": 0x30B, "c": 0x327, "k": 0x328, "r": 0x30A}
#: Commands for letters without an accent.
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ"}

_ACCENT = re.compile(r"""\{?\\(?:(['`"^~=.])\s*|([uvHckr])(?=[\s{])\s*)(?:\{\s*\\?([A-Za-z])\s*\}|\\?([A-Za-z]))(\}?)""")
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?:\{\}|(?![A-Za-z])\s?)")
_ESCAPE = re.compile(r"\\([&%$#_{}])")


def decode(text: str | None) -> str | None:
    """A value with accent commands, letter commands and escaped signs decoded; NULL stays NULL."""
    if not text or "\\" not in text:
        return text

    def accent(m: re.Match) -> str:
        letter = m[3] or m[4]
        one = unicodedata.normalize("NFC", letter + chr(ACCENTS[m[1] or m[2]]))
        opened, closed = m[0].startswith("{"), bool(m[5])
        return ("{" if opened and not closed else "") + one + ("}" if closed and not opened else "")

    text = _ACCENT.sub(accent, text)
    text = _LETTER.sub(lambda m: LETTERS[m[1]], text)
    return _ESCAPE.sub(r"\1", text)


@F.pandas_udf(T.StringType())
def latex_to_unicode(s: pd.Series) -> pd.Series:
    """Column form of ``decode``."""
    return s.map(decode, na_action="ignore")
