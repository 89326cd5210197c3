"""Pre-tokenisation: texts to arrays of chunks whose concatenation is the text."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.clean import normalize, sanitize_utf8
from corpusloom.functions.rules import DEFAULT_RULESET, pattern_of


def chunks(text: Column, ruleset: str = DEFAULT_RULESET) -> Column:
    """Chunks by a named rule set; null for null, none for the empty text. The named rule sets match every character."""
    return F.regexp_extract_all(text, F.lit(pattern_of(ruleset)), F.lit(0))


def chunks_by(text: Column, pattern: str) -> Column:
    """Chunks by any pattern. Text between two matches is a chunk, and so is the rest after the last one; where a match is empty, one character is.

    Built-in functions give matches but not the gaps between them, so this one goes through Arrow.
    """
    compiled = regex.compile(pattern)

    @F.pandas_udf("array<string>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else partition(compiled, t))

    return apply(text)


def partition(compiled: regex.Pattern, text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        match = compiled.search(text, at)
        if match is None:
            out.append(text[at:])
            break
        if match.end() == match.start():
            out.append(text[at])
            at += 1
            continue
        if match.start() > at:
            out.append(text[at : match.start()])
        out.append(match.group())
        at = match.end()
    return out


def pipeline(data: Column, mode: str = "Identity", ruleset: str = DEFAULT_RULESET) -> Column:
    """Bytes to chunks: sanitise, normalise, split. A normal form of well-formed text is well formed, so that it needs no second pass."""
    return chunks(normalize(sanitize_utf8(data), mode), ruleset)
