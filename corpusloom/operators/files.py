"""Encoding and packing of text files."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.clean import sanitize_utf8
from corpusloom.functions.rules import DEFAULT_RULESET
from corpusloom.operators.encode import encode_arrow
from corpusloom.operators.pack import check_packable, paged
from corpusloom.operators.specials import encode_with_specials
from corpusloom.operators.vocabulary import Vocabulary
from corpusloom.sources.lines import lines_with_ends, read_lines, read_whole, require_lines
from corpusloom.sources.streams import write_flat


def encode_lines(lines: DataFrame, vocabulary: Vocabulary, allow_specials: bool = False, text: str = "line", ruleset: str = DEFAULT_RULESET) -> DataFrame:
    """``lines`` with tok. Special tokens are looked for only where they are allowed; elsewhere one raises an error."""
    holds = F.col(text).rlike(r"<\|(im_start|im_end|endoftext|pad)\|>")
    special = encode_with_specials(F.col(text), vocabulary, allow_specials, ruleset)
    return lines.withColumn("tok", F.when(holds, special).otherwise(encode_arrow(F.col(text), vocabulary, ruleset)))


def encode_file(spark: SparkSession, path: str, vocabulary: Vocabulary, allow_specials: bool = False, ruleset: str = DEFAULT_RULESET) -> DataFrame:
    """(file, line, tok) of the lines of a file; an empty file raises an error. Ill-formed bytes are replaced."""
    lines = require_lines(read_lines(spark, path))
    clean = lines.withColumn("line", sanitize_utf8(F.col("line").cast("binary")))
    return encode_lines(clean.select("file", "line"), vocabulary, allow_specials, "line", ruleset)


@dataclass
class Packed:
    lines: int
    tokens: int
    seconds: float

    @property
    def tokens_per_second(self) -> float:
        return self.tokens / max(self.seconds, 1e-9)


def pack_file(spark: SparkSession, source: str, target: str, vocabulary: Vocabulary, ruleset: str = DEFAULT_RULESET, page_tokens: int = 1 << 20) -> Packed:
    """A text file to one flat stream of 16-bit ids: lines keep their ends, ill-formed UTF-8 is refused, order is that of the file."""
    check_packable(vocabulary)
    began = time.perf_counter()
    lines = read_whole(spark, source).select("file", F.posexplode(lines_with_ends(F.col("text"))).alias("line_no", "line"))
    coded = lines.withColumn("tok", encode_arrow(F.col("line"), vocabulary, ruleset))
    pages = paged(coded, ["file", "line_no"], page_tokens)
    write_flat(spark, pages, target)
    total = coded.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("tok")), F.lit(0)).alias("tokens")).first()
    return Packed(total.n, total.tokens, time.perf_counter() - began)
