"""Special tokens: found in the raw text, longest first, never merged with what is around them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.rules import DEFAULT_RULESET, SPECIAL_TOKENS
from corpusloom.operators.encode import encode_native
from corpusloom.operators.vocabulary import Vocabulary


def alternation(tokens: tuple[str, ...] = SPECIAL_TOKENS) -> str:
    if not tokens or "" in tokens:
        raise ValueError("special tokens must be given and must not be empty")
    return "|".join(re.escape(t).replace("<", "\\x3c").replace(">", "\\x3e") for t in sorted(tokens, key=len, reverse=True))


def match_at(text: Column, at: Column, tokens: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    """Length of the special token that begins at a position (from 0), -1 if none does."""
    found = F.regexp_extract(F.substring(text, at + 1, F.length(text)), f"^({alternation(tokens)})", 1)
    return F.when(F.length(found) > 0, F.length(found)).otherwise(-1)


def id_at(text: Column, at: Column, tokens: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    """Index of the special token that begins at a position (from 0), -1 if none does."""
    found = F.regexp_extract(F.substring(text, at + 1, F.length(text)), f"^({alternation(tokens)})", 1)
    return index_of(found, tokens)


def index_of(piece: Column, tokens: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in tokens]), piece).cast("int") - 1


def find_first(text: Column, start: int = 0, tokens: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    """Position (from 0, in characters) of the first special token from ``start`` on, -1 if there is none."""
    at = F.regexp_instr(F.substring(text, F.lit(start + 1), F.length(text)), F.lit(alternation(tokens)))
    return F.when(at > 0, at - 1 + start).otherwise(-1)


def pieces(text: Column, tokens: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    """Ordered pieces (text, is_special, special_idx); special_idx is -1 for plain text."""
    marks = alternation(tokens)
    parts = F.filter(F.split(text, f"(?={marks})|(?<={marks})", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(p.alias("text"), (index_of(p, tokens) >= 0).alias("is_special"), index_of(p, tokens).alias("special_idx")),
    )


def encode_with_specials(text: Column, vocabulary: Vocabulary, allow: bool, ruleset: str = DEFAULT_RULESET) -> Column:
    """The token string; special tokens have the ids after all others, and raise an error unless they are allowed. Each plain piece is split on its own."""
    special = F.array(*[F.lit(chr(k)) for k in vocabulary.specials.values()])
    refused = F.raise_error(F.concat(F.lit("special token is not allowed in: "), F.substring(text, 1, 80))).cast("string")

    def one(p: Column) -> Column:
        known = F.element_at(special, F.greatest(p["special_idx"], F.lit(0)) + 1)
        return F.when(p["is_special"], known if allow else refused).otherwise(encode_native(p["text"], vocabulary, ruleset))

    return F.array_join(F.transform(pieces(text), one), "")
