"""SQL text for DuckDB, whose regular expressions have neither look-ahead nor possessive quantifiers.

The look-ahead of the rule sets is replaced by a mark: before the last white space of a run of two or more that something else
follows a private character is put; patterns stop at it, and it is taken out of the chunks again.
"""

from __future__ import annotations

from corpusloom.functions.rules import BASE_SIZE
from corpusloom.operators.vocabulary import Vocabulary

_WS = r"\t-\r\x{85}\p{Z}"
_MARK = "\\x{E000}"
_WORD_UP, _WORD_LOW = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
_TAIL = r"(?i:''s|''t|''re|''ve|''m|''ll|''d)?"

_PATTERNS = {
    "cl100k_base": "|".join(
        [
            r"''(?i:[sdmt]|ll|ve|re)", rf"[^\r\n\p{{L}}\p{{N}}{_MARK}]?\p{{L}}+", r"\p{N}{1,3}", rf" ?[^{_WS}\p{{L}}\p{{N}}{_MARK}]+[\r\n{_MARK}]*",
            rf"[{_WS}]+$", rf"[{_WS}{_MARK}]*[\r\n]", rf"[{_WS}]+{_MARK}", rf"[{_WS}]", _MARK,
        ]
    ),
    "o200k_base": "|".join(
        [
            rf"[^\r\n\p{{L}}\p{{N}}{_MARK}]?{_WORD_UP}*{_WORD_LOW}+{_TAIL}", rf"[^\r\n\p{{L}}\p{{N}}{_MARK}]?{_WORD_UP}+{_WORD_LOW}*{_TAIL}", r"\p{N}{1,3}",
            rf" ?[^{_WS}\p{{L}}\p{{N}}{_MARK}]+[\r\n/*{_MARK}]*", rf"[{_WS}{_MARK}]*[\r\n]+", rf"[{_WS}]+$", rf"[{_WS}]+{_MARK}", rf"[{_WS}]+", _MARK,
        ]
    ),
}


def chunks(text: str, ruleset: str) -> str:
    marked = f"regexp_replace({text}, '([{_WS}])([{_WS}][^{_WS}])', '\\1' || chr(57344) || '\\2', 'g')"
    cut = f"list_transform(regexp_extract_all({marked}, '{_PATTERNS[ruleset]}'), lambda c: replace(c, chr(57344), ''))"
    return f"list_filter({cut}, lambda c: c <> '')"


def lines(text: str) -> str:
    kept = f"string_split(regexp_replace({text}, '\\n\\z', ''), chr(10))"
    return f"CASE WHEN {text} = '' THEN [] ELSE list_transform({kept}, lambda x: regexp_replace(x, '\\r\\z', '')) END"


def latin1(chunk: str) -> str:
    """The UTF-8 bytes of a text as a string of as many characters."""
    pairs = f"regexp_extract_all(hex(encode({chunk})), '..')"
    return f"array_to_string(list_transform({pairs}, lambda h: chr(('0x' || h)::INTEGER)), '')"


def merges(vocabulary: Vocabulary) -> str:
    """The merge table as a list of pair and token, three characters each."""
    rules = ", ".join(f"chr({a}) || chr({b}) || chr({BASE_SIZE + k})" for k, (a, b) in enumerate(vocabulary.merges))
    return f"[{rules}]"


def encode(latin: str, table: str = "m.rules") -> str:
    return f"list_reduce(list_prepend({latin}, {table}), lambda done, m: replace(done, m[1:2], m[3]))"


def with_tokens(vocabulary: Vocabulary, ruleset: str, source: str, key: str, text: str = "text") -> str:
    """CTEs: chunk (key, nth, chunk), coded (chunk, tok) and tokens (key, text, tok)."""
    return f"""
m AS (SELECT {merges(vocabulary)} AS rules),
chunk AS (SELECT {key}, unnest(range(len(cs))) AS nth, unnest(cs) AS chunk FROM (SELECT {key}, {chunks(text, ruleset)} AS cs FROM {source})),
coded AS MATERIALIZED (SELECT chunk, {encode(latin1('chunk'))} AS tok FROM (SELECT DISTINCT chunk FROM chunk), m),
tokens AS MATERIALIZED (
  SELECT s.{key}, {text} AS text, coalesce(t.tok, '') AS tok FROM {source} s
  LEFT JOIN (SELECT {key}, string_agg(tok, '' ORDER BY nth) AS tok FROM chunk JOIN coded USING (chunk) GROUP BY {key}) t ON t.{key} = s.{key})
"""


def ids_text(tok: str) -> str:
    """Ids with blanks between them."""
    return f"array_to_string(list_transform(string_split({tok}, ''), lambda c: ascii(c)::VARCHAR), ' ')"
