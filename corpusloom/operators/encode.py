"""Encoding and decoding.

Rules in rank order, each applied once from left to right, give exactly the encoder that always merges the lowest rank first: a merge
into id r only makes pairs with r, and those have higher ranks. So ``encode_native`` is one fold over the merge table, in built-in functions. Its work is chunks
times rules, so ``encode_arrow``, which merges the distinct chunks of a part of a batch all at once in arrays, is the fast path for many rules. ``encode_dictionary``
encodes each distinct chunk once and joins; it pays off only where chunks repeat much more than the shuffle of all of them costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.clean import utf8_latin1
from corpusloom.functions.rules import DEFAULT_RULESET
from corpusloom.functions.split import chunks
from corpusloom.operators.vocabulary import Vocabulary


def merge_array(vocabulary: Vocabulary) -> Column:
    pairs = [f"struct('{_sql(p)}' AS pair, '{_sql(t)}' AS token)" for p, t in vocabulary.merge_strings()]
    return F.expr(f"array({', '.join(pairs)})") if pairs else F.expr("cast(array() AS array<struct<pair:string,token:string>>)")


def _sql(text: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in text)


def fold(latin: Column, vocabulary: Vocabulary) -> Column:
    """The token string of a chunk that is given as a Latin-1 string of its bytes."""
    return F.aggregate(merge_array(vocabulary), latin, lambda done, m: F.replace(done, m["pair"], m["token"]))


def encode_native(text: Column, vocabulary: Vocabulary, ruleset: str = DEFAULT_RULESET) -> Column:
    """The token string of a text; merges never cross chunks."""
    each = F.transform(chunks(text, ruleset), lambda c: fold(utf8_latin1(c), vocabulary))
    return F.array_join(each, "")


def ids(tok: Column) -> Column:
    """A token string as an array of ids."""
    return F.when(F.length(tok) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(tok, ""), lambda c: F.ascii(c)))


def encode_chunk(data: bytes, ranks: dict[tuple[int, int], int]) -> list[int]:
    """Lowest rank first, until no pair is left."""
    word = list(data)
    while len(word) > 1:
        new, pair = min(((ranks[p], p) for p in zip(word, word[1:], strict=False) if p in ranks), default=(0, None))
        if pair is None:
            break
        out, at = [], 0
        while at < len(word):
            if at + 1 < len(word) and (word[at], word[at + 1]) == pair:
                out.append(new)
                at += 2
            else:
                out.append(word[at])
                at += 1
        word = out
    return word


class PairTable:
    """The id that two neighbouring ids merge into, for arrays of pairs; NONE where there is none."""

    NONE = np.uint16(0xFFFF)
    #: Up to so many ids the table is a matrix, beyond it sorted keys.
    SIDE = 4_096

    def __init__(self, merges: list[tuple[int, int]]):
        self.size = 256 + len(merges)
        pairs = np.array(merges, np.int64).reshape(-1, 2)
        keys, new = pairs[:, 0] * self.size + pairs[:, 1], np.arange(256, self.size, dtype=np.uint16)
        if self.size <= self.SIDE:
            self.matrix = np.full(self.size * self.size, self.NONE)
            self.matrix[keys] = new
        else:
            order = np.argsort(keys)
            self.keys, self.new = np.append(keys[order], -1), np.append(new[order], self.NONE)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        if self.size <= self.SIDE:
            return self.matrix[keys]
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, self.new[at], self.NONE)


def merge_words(ids: np.ndarray, word: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words after their merges, and the word of each; ``word`` says, in order, which word each of ``ids`` is in.

    A step merges in every word its lowest pair, from left to right; words without one are done. So there are as many steps as the word with
    the most different merges takes, rules at most, each of them array operations over the words that are left.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ids):
        found = np.append(table.find(ids[:-1], ids[1:]), table.NONE)
        last = np.append(word[1:] != word[:-1], True)
        found[last] = table.NONE
        first = np.flatnonzero(np.append(True, last[:-1]))
        sizes = np.diff(np.append(first, len(ids)))
        least = np.repeat(np.minimum.reduceat(found, first), sizes)
        going = least != table.NONE
        if not going.all():
            done.append((ids[~going], word[~going]))
            ids, word, found, least = ids[going], word[going], found[going], least[going]
        at = np.flatnonzero(found == least)
        if not len(at):
            break
        begin = np.append(True, at[1:] != at[:-1] + 1)  # of a run of places that overlap every other one counts
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0]
        ids[at] = found[at]
        ids, word = np.delete(ids, at + 1), np.delete(word, at + 1)
    if not done:
        return ids, word
    ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return ids[order], word[order]


def encode_strings(chunks: pa.StringArray, table: PairTable) -> pa.StringArray:
    """The token string of each chunk, from the buffers of the one array to those of the other."""
    n = len(chunks)
    starts = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + n + 1].astype(np.int64)
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    ids, word = merge_words(data.astype(np.uint16), np.repeat(np.arange(n, dtype=np.int32), np.diff(starts)), table)
    width = 1 + (ids >= 0x80).astype(np.int64) + (ids >= 0x800)
    ends = np.cumsum(np.bincount(word, width, n).astype(np.int64)) if n else np.zeros(0, np.int64)
    text = ids.astype("<u2").tobytes().decode("utf-16-le").encode()
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(text))


def encode_chunk_lists(lists: pa.ListArray, table: PairTable) -> pa.Array:
    """The token string of each list of chunks; distinct chunks are encoded once."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    tokens = encode_strings(coded.dictionary, table)
    back = pa.ListArray.from_arrays(offsets - offsets[0], tokens.take(coded.indices), mask=lists.is_null() if lists.null_count else None)
    return pc.binary_join(back, "")


#: Bytes of chunks that are encoded together, one list at least; bounds Python's working memory, whatever a batch holds.
SLICE_BYTES = 4 << 20


def list_slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Consecutive parts of ``lists`` with up to SLICE_BYTES each, or one list."""
    values = lists.values
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset + lists.offsets.to_numpy().astype(np.int64)] if len(values) else np.zeros(len(lists) + 1, np.int32)
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + SLICE_BYTES, "right")) - 1)
        yield lists.slice(start, stop - start)
        start = stop


def encode_arrow(text: Column, vocabulary: Vocabulary, ruleset: str = DEFAULT_RULESET) -> Column:
    """As ``encode_native``: split by the engine, encoded in Arrow batches. No shuffle."""
    vocabulary.require_native()
    merges = list(vocabulary.merges)

    @F.arrow_udf("string")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = PairTable(merges)
        for batch in batches:
            for part in list_slices(batch):
                yield encode_chunk_lists(part, table)

    return apply(chunks(text, ruleset))


def encode_dictionary(df: DataFrame, key: list[str], text: str, vocabulary: Vocabulary, ruleset: str = DEFAULT_RULESET) -> DataFrame:
    """``key`` and ``tok``: distinct chunks are encoded once, then joined back. ``key`` must tell the rows apart."""
    exploded = df.select(*key, F.posexplode(chunks(F.col(text), ruleset)).alias("at", "chunk"))
    words = exploded.groupBy("chunk").agg(F.count("*").alias("count"))
    coded = words.withColumn("tok", fold(utf8_latin1(F.col("chunk")), vocabulary)).select("chunk", "tok")
    joined = exploded.join(coded, "chunk").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "tok"))).alias("parts"))
    full = joined.select(*key, F.array_join("parts.tok", "").alias("tok"))
    rest = df.select(*key, text).join(full, key, "left")
    return rest.select(*key, F.when(F.col(text).isNotNull(), F.coalesce("tok", F.lit(""))).alias("tok"))


def decode_hex(token_ids: Column, vocabulary: Vocabulary, specials: bool = False) -> Column:
    """Ids to the hex of their bytes; ids out of range raise an error."""
    table = [vocabulary.bytes_of(k).hex().upper() for k in range(len(vocabulary))]
    if specials:
        table += [s.encode().hex().upper() for s in vocabulary.specials]
    known = F.expr("array(" + ", ".join(f"'{h}'" for h in table) + ")")
    inside = lambda i: (i >= 0) & (i < len(table))
    bad = F.raise_error(F.concat(F.lit("token id out of range in "), token_ids.cast("string")))
    hexed = F.array_join(F.transform(token_ids, lambda i: F.element_at(known, i + 1)), "")
    return F.when(token_ids.isNull(), F.lit(None)).when(F.forall(token_ids, inside), hexed).otherwise(bad)


def decode(token_ids: Column, vocabulary: Vocabulary, specials: bool = False) -> Column:
    """Ids to bytes, which need not be well-formed text."""
    return F.unhex(decode_hex(token_ids, vocabulary, specials))
