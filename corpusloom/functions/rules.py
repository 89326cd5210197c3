"""Fixed values that results depend on: rule sets, special tokens, character classes.

The rule sets are the published patterns of two public tokenizers, for a regular-expression engine with possessive quantifiers and look-ahead.
"""

from __future__ import annotations

# Fixed values.
RULESETS = {
    "cl100k_base": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s",
    "o200k_base": "|".join(
        [
            r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
            r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
            r"\p{N}{1,3}",
            r" ?[^\s\p{L}\p{N}]+[\r\n/*]*",
            r"\s*[\r\n]+",
            r"\s+(?!\S)",
            r"\s+",
        ]
    ),
}
SPECIAL_TOKENS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|pad|>")
NORMALIZATIONS = ("Identity", "NFC", "NFD", "NFKC", "NFKD")
SPLIT_FILES = {"train": "train.txt", "valid": "valid.txt", "test": "test.txt"}
BASE_SIZE = 256

DEFAULT_RULESET = "cl100k_base"


def pattern_of(ruleset: str) -> str:
    """The pattern of a named rule set, with Unicode classes switched on."""
    if ruleset not in RULESETS:
        raise ValueError(f"unknown ruleset {ruleset!r}; known: {', '.join(RULESETS)}")
    return "(?U)" + RULESETS[ruleset]
