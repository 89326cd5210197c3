"""Byte-level vocabularies: ids 0..255 are the bytes, every merge adds the next id.

Inside the engine a token is a code point: id n is the character n, a sequence of ids is a string. A merge is then one string replacement, left to right and
without overlap. Ids from 0xD800 on are no characters, so that the string form holds up to MAX_NATIVE ids, specials included.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.clean import latin1, token_display
from corpusloom.functions.rules import BASE_SIZE, SPECIAL_TOKENS

MAX_NATIVE, MAX_PACKED = 0xD800, 65_536


@dataclass
class Vocabulary:
    """Merges in order as (a, b); the k-th makes the id 256 + k."""

    merges: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        given, self.merges = list(self.merges), []
        self._bytes = [bytes([b]) for b in range(BASE_SIZE)]
        self._by_bytes = {b: k for k, b in enumerate(self._bytes)}
        self._by_pair: dict[tuple[int, int], int] = {}
        for a, b in given:
            if (a, b) in self._by_pair:
                raise ValueError(f"the pair {a} {b} is listed twice")
            self.add_merge(a, b)

    def add_merge(self, a: int, b: int) -> int:
        """The id of a pair; a new one if it has none yet."""
        if not (0 <= a < len(self) and 0 <= b < len(self)):
            raise IndexError(f"merge of unknown ids {a} {b}")
        if (a, b) in self._by_pair:
            return self._by_pair[a, b]
        made = len(self)
        self.merges.append((a, b))
        self._bytes.append(self._bytes[a] + self._bytes[b])
        self._by_bytes.setdefault(self._bytes[-1], made)
        self._by_pair[a, b] = made
        return made

    def __len__(self) -> int:
        return BASE_SIZE + len(self.merges)

    def contains(self, data: bytes) -> bool:
        return data in self._by_bytes

    def id_of(self, data: bytes) -> int:
        return self._by_bytes[data]

    def bytes_of(self, token: int) -> bytes:
        if not 0 <= token < len(self):
            raise IndexError(f"token id {token} is out of range")
        return self._bytes[token]

    def id_of_pair(self, a: int, b: int) -> int:
        return self._by_pair.get((a, b), -1)

    def display_of(self, token: int) -> str:
        name = lambda b: f"<0x{b:02X}>"
        data = self.bytes_of(token)
        if token < BASE_SIZE:
            return name(data[0])
        return "".join(chr(b) if 0x20 <= b <= 0x7E and chr(b) not in '"\\' else name(b) for b in data)

    @property
    def specials(self) -> dict[str, int]:
        """Special tokens have the ids after all others."""
        return {s: len(self) + k for k, s in enumerate(SPECIAL_TOKENS)}

    def require_native(self) -> None:
        if len(self) + len(SPECIAL_TOKENS) > MAX_NATIVE:
            raise ValueError(f"vocabularies beyond {MAX_NATIVE} ids have no string form")

    def merge_strings(self) -> list[tuple[str, str]]:
        """(pair, token) as strings, in rank order."""
        self.require_native()
        return [(chr(a) + chr(b), chr(BASE_SIZE + k)) for k, (a, b) in enumerate(self.merges)]

    def tokens(self, spark: SparkSession) -> DataFrame:
        """(id, bytes, display)."""
        rows = [(k, bytearray(b)) for k, b in enumerate(self._bytes)]
        df = spark.createDataFrame(rows, "id int, bytes binary")
        return df.withColumn("display", token_display(latin1(F.col("bytes")), F.col("id") < BASE_SIZE))

    def merge_table(self, spark: SparkSession) -> DataFrame:
        """(a, b, c)."""
        return spark.createDataFrame([(a, b, BASE_SIZE + k) for k, (a, b) in enumerate(self.merges)], "a int, b int, c int")


def base_vocabulary(spark: SparkSession) -> DataFrame:
    """The 256 single bytes, made by the engine itself."""
    return spark.range(BASE_SIZE).select(
        F.col("id").cast("int").alias("id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("bytes")
    )


def rank_lookup(pairs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``pairs`` (a, b, ...) with ``rank``: the id of the merge, -1 where there is none. The merges (65,536 at most) are broadcast."""
    merges = vocabulary.merge_table(pairs.sparkSession)
    return pairs.join(F.broadcast(merges), ["a", "b"], "left").withColumn("rank", F.coalesce("c", F.lit(-1))).drop("c")


def from_triples(triples: Iterable[tuple[int, int, int]]) -> Vocabulary:
    """A vocabulary from (a, b, c) in rank order; c must be the next id each time."""
    made = Vocabulary()
    for a, b, c in triples:
        if c != len(made):
            raise ValueError(f"merge {a} {b} -> {c}: the id {len(made)} was expected")
        if made.id_of_pair(a, b) >= 0:
            raise ValueError(f"the pair {a} {b} is listed twice")
        made.add_merge(a, b)
    return made
