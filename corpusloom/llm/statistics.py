"""Dense statistics of texts, for the classifiers."""

from __future__ import annotations

import numpy as np

from corpusloom.llm.codepoints import CHUNK, joined, sums_by_text, table_of

#: Characters of running text, and characters of markup, tables and emphasis.
SENTENCE_MARKS = ".,;:?"
SYMBOLS = "#$%&*+<=>@[\\]^_`{|}~/"

STATISTICS = (
    "log_words", "log_chars", "word_length", "letters", "digits", "capitals", "spaces", "sentence_marks", "exclamations", "symbols", "bars",
    "line_length", "repeated_next", "distinct_words", "top_word", "long_words", "short_words", "marked_words", "repeated_lines", "run_length",
)


def _classes() -> np.ndarray:
    """For each code point the classes it is in, as bits."""
    out = table_of("isalpha").astype(np.uint8) | table_of("isdecimal").astype(np.uint8) << 1 | table_of("isupper").astype(np.uint8) << 2
    out |= table_of("isspace").astype(np.uint8) << 3
    for bit, marks in ((4, SENTENCE_MARKS), (5, "!"), (6, SYMBOLS), (7, "|")):
        out[[ord(c) for c in marks]] |= np.uint8(1 << bit)
    return out


_CACHED: list[np.ndarray] = []


def class_counts(texts: list[str]) -> np.ndarray:
    """(texts, 8): letters, digits, capitals, white space, sentence marks, exclamation marks, symbols, bars."""
    if not _CACHED:
        _CACHED.append(_classes())
    points, starts = joined(texts)
    out = np.zeros((len(texts), 8), np.int64)
    for at in range(0, len(points), CHUNK):
        bits = np.unpackbits(_CACHED[0][points[at : at + CHUNK], None], axis=1, bitorder="little")
        sums_by_text(bits, at, starts, out)
    out[:, 3] -= 1  # the line feed after each text
    return out


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, len(STATISTICS)); a text without words has zeros wherever the denominator is zero."""
    counts = class_counts(texts).astype(float)
    words_of = np.zeros((len(texts), 10))
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        seen: dict[str, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        same = np.fromiter(map(str.__eq__, words, words[1:]), bool, max(0, n - 1))
        lines = [x for x in text.split("\n") if x.strip()]
        alnum = sum(map(str.isalnum, words))
        words_of[i] = (
            n, lengths.sum(), same.sum(), len(seen), max(seen.values(), default=0), (lengths > 12).sum(), (lengths < 4).sum(),
            n - alnum, len(lines) - len(set(lines)), len(lines),
        )
    n, letters, same, distinct, top, long_, short, marked, again, lines = words_of.T
    chars = np.array([len(t) for t in texts], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        per_char = np.nan_to_num(counts / chars[:, None])
        per_word = lambda x: np.nan_to_num(x / n)
        return np.stack(
            [
                np.log1p(n), np.log1p(chars), per_word(letters), per_char[:, 0], per_char[:, 1], np.nan_to_num(counts[:, 2] / counts[:, 0]), per_char[:, 3],
                per_word(counts[:, 4]), per_word(counts[:, 5]), per_word(counts[:, 6]), per_word(counts[:, 7]),
                np.nan_to_num(chars / np.maximum(lines, 1)), np.nan_to_num(same / np.maximum(n - 1, 1)), per_word(distinct), per_word(top), per_word(long_), per_word(short), per_word(marked),
                np.nan_to_num(again / np.maximum(lines, 1)), np.nan_to_num(n / np.maximum(n - same, 1)),
            ],
            axis=1,
        )
