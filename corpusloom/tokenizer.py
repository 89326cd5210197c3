"""A tokenizer object over the engine, for single texts, lists and DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import __version__
from corpusloom.functions.rules import DEFAULT_RULESET, pattern_of
from corpusloom.operators.encode import decode, encode_arrow, ids
from corpusloom.operators.vocabulary import MAX_PACKED, Vocabulary
from corpusloom.sources import artefacts


class Tokenizer:
    """``Tokenizer(spark, 'vocab.bin')`` or ``from_json``. Special tokens in texts are ordinary text here."""

    version = __version__

    def __init__(self, spark: SparkSession, path: str | None = None, ruleset: str = DEFAULT_RULESET, vocabulary: Vocabulary | None = None):
        pattern_of(ruleset)
        self.spark, self.ruleset = spark, ruleset
        self.vocabulary = vocabulary if vocabulary is not None else artefacts.parse_vocabulary_binary(artefacts.read_bytes(spark, path))

    @classmethod
    def from_json(cls, spark: SparkSession, vocabulary_path: str, merges_path: str, ruleset: str = DEFAULT_RULESET) -> Tokenizer:
        texts = [artefacts.read_bytes(spark, p).decode("ascii") for p in (vocabulary_path, merges_path)]
        return cls(spark, ruleset=ruleset, vocabulary=artefacts.load_vocabulary(*texts))

    @property
    def vocab_size(self) -> int:
        return len(self.vocabulary)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of each text, in the order given."""
        df = self.spark.createDataFrame(list(enumerate(texts)), "k long, text string")
        return [list(r.ids) for r in self.encode_frame(df, "text").orderBy("k").select("ids").collect()]

    def encode_frame(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with an array column ``ids``."""
        return df.withColumn("ids", ids(encode_arrow(F.col(text), self.vocabulary, self.ruleset)))

    def decode(self, token_ids: Sequence[int]) -> bytes:
        if any(not 0 <= k < MAX_PACKED for k in token_ids):
            raise IndexError(f"ids must be from 0 to {MAX_PACKED - 1}")
        return b"".join(self.vocabulary.bytes_of(k) for k in token_ids)

    def decode_frame(self, df: DataFrame, token_ids: str) -> DataFrame:
        """``df`` with a binary column ``bytes``; ids out of range raise an error."""
        return df.withColumn("bytes", decode(F.col(token_ids), self.vocabulary))
