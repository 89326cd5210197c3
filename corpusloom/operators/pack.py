"""Packed token streams: little-endian unsigned 16-bit ids without header or separators.

The UTF-16LE encoding of a token string is that very byte sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rules import DEFAULT_RULESET
from corpusloom.operators.encode import encode_arrow, encode_native
from corpusloom.operators.ordering import running_sum
from corpusloom.operators.vocabulary import MAX_PACKED, Vocabulary


def packed(tok: Column) -> Column:
    return F.encode(tok, "UTF-16LE")


def unpacked(data: Column) -> Column:
    """A packed stream as a token string."""
    return F.decode(data, "UTF-16LE")


def check_packable(vocabulary: Vocabulary) -> None:
    if len(vocabulary) > MAX_PACKED:
        raise ValueError(f"{len(vocabulary)} ids do not fit 16 bits")


def pack_lines(lines: DataFrame, vocabulary: Vocabulary, text: str = "line", ruleset: str = DEFAULT_RULESET, native: bool = False) -> DataFrame:
    """``lines`` with tok, n_tokens and the packed bytes. The order of rows is that of their own columns."""
    check_packable(vocabulary)
    encode = encode_native if native else encode_arrow
    coded = lines.withColumn("tok", encode(F.col(text), vocabulary, ruleset))
    return coded.withColumn("n_tokens", F.length("tok").cast("long")).withColumn("packed", packed(F.col("tok")))


def pack_stats(coded: DataFrame) -> DataFrame:
    return coded.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def paged(coded: DataFrame, order: list[str], page_tokens: int) -> DataFrame:
    """The stream in pages: (page, tok), where page p holds the tokens from p * page_tokens on, fewer only in the last.

    Each row's place in the stream is a running sum; rows are cut at page ends, and pages are put together from their parts.
    """
    placed = running_sum(coded.select(*order, "tok", F.length("tok").cast("long").alias("_n")), order, "_n", "_at").filter("_n > 0")
    first, last = F.floor(F.col("_at") / page_tokens), F.floor((F.col("_at") + F.col("_n") - 1) / page_tokens)
    cut = placed.select("tok", "_at", F.explode(F.sequence(first, last)).alias("page"))
    begin = F.greatest(F.lit(0), F.col("page") * page_tokens - F.col("_at"))
    end = (F.col("page") + 1) * page_tokens - F.col("_at")
    parts = cut.select(
        "page", (F.col("_at") + begin).alias("at"), F.substring(F.col("tok"), (begin + 1).cast("int"), (end - begin).cast("int")).alias("part")
    )
    return parts.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts")).select(
        F.col("page").cast("long").alias("page"), F.array_join("parts.part", "").alias("tok")
    )
