"""Text cleaning and display expressions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.rules import NORMALIZATIONS

#: Well-formed UTF-8 sequences over bytes read as Latin-1.
_VALID = (
    r"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    r"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_REPLACEMENT_LATIN1 = "�".encode().decode("latin-1")


def latin1(data: Column) -> Column:
    """Bytes as a string of as many code points: byte b is code point b."""
    return F.decode(data, "ISO-8859-1")


def utf8_latin1(text: Column) -> Column:
    """The UTF-8 bytes of a text as a Latin-1 string."""
    return latin1(F.encode(text, "UTF-8"))


def sanitize_utf8(data: Column) -> Column:
    """Bytes as text: every lead byte that does not begin a well-formed sequence becomes one U+FFFD.

    The possessive run of well-formed sequences is anchored where the last match ended, so it is one pass and cannot backtrack.
    """
    fixed = F.regexp_replace(latin1(data), rf"\G((?:{_VALID})*+)[\x80-\xff]", f"$1{_REPLACEMENT_LATIN1}")
    return F.decode(F.encode(fixed, "ISO-8859-1"), "UTF-8")


def code_points(text: Column) -> Column:
    return F.length(text)


def utf8_char_bytes(text: Column) -> Column:
    """Bytes of the first character."""
    return F.octet_length(F.substring(text, 1, 1))


def normalize(text: Column, mode: str = "Identity") -> Column:
    """A Unicode normal form. Identity is the text itself; the others have no built-in function and go through Arrow."""
    if mode not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization mode {mode!r}")
    if mode == "Identity":
        return text

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(mode, t))

    return apply(text)


def hex_bytes(text: Column) -> Column:
    """Upper-case hex pairs with spaces between; '(empty)' for no bytes."""
    pairs = F.trim(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "))
    return F.when(F.length(text) == 0, F.lit("(empty)")).otherwise(pairs)


def _each_byte(latin: Column, escaped: dict[str, str], other) -> Column:
    """Concatenation over the bytes of a Latin-1 string; printable ASCII stays unless it is escaped."""

    def one(c: Column) -> Column:
        out = F.when(c.between(" ", "~"), c).otherwise(other(F.hex(F.encode(c, "ISO-8859-1"))))
        for raw, written in escaped.items():
            out = F.when(c == raw, F.lit(written)).otherwise(out)
        return out

    return F.when(F.length(latin) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.split(latin, ""), one), ""))


def display_escape(text: Column) -> Column:
    r"""One line of ASCII: \n \r \t \\ \" and \xNN for other bytes outside printable ASCII."""
    escaped = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", '"': '\\"'}
    return _each_byte(utf8_latin1(text), escaped, lambda h: F.concat(F.lit("\\x"), h))


def json_escape(latin: Column) -> Column:
    """The inside of an ASCII JSON string for bytes given as a Latin-1 string."""
    escaped = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", '"': '\\"'}
    return _each_byte(latin, escaped, lambda h: F.concat(F.lit("\\u00"), F.lower(h)))


def token_display(latin: Column, is_base: Column) -> Column:
    """Display name of a token: base tokens as <0xNN>, others with printable ASCII as it is, but for quotes and backslashes."""
    name = lambda h: F.concat(F.lit("<0x"), h, F.lit(">"))
    merged = _each_byte(latin, {'"': "<0x22>", "\\": "<0x5C>"}, name)
    return F.when(is_base, name(F.hex(F.encode(latin, "ISO-8859-1")))).otherwise(merged)


#: Regular expressions of the character classes.
CLASSES = {
    "letter": r"\p{L}",
    "number": r"\p{N}",
    "space": r"[\t-\r\x{85}\p{Z}]",
    "upper_word": r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]",
    "lower_word": r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]",
}


def class_count(text: Column, name: str) -> Column:
    """How many characters of a text are in a class."""
    return F.regexp_count(text, F.lit(CLASSES[name]))
