"""Packing by optimal length buckets.

Texts are counted in tokens and cut into pieces of MAX_LENGTH tokens at most. Dynamic programming over the global
histogram of piece lengths chooses the BUCKETS boundaries with the least padding in all; a piece is padded to the boundary of its bucket.
Inside each bucket batches of TOKEN_BUDGET tokens form: a batch has as many pieces as fit at the bucket's boundary, and
only the last batch of a bucket can have fewer.

The histogram has MAX_LENGTH + 1 rows at most, whatever the corpus. Batches are numbered across a bucket without sorting it in one task: pieces are dealt by hash to
groups of about GROUP_PIECES, ranked within them, and the ranks are moved on by the sizes of the groups before. The number of groups depends on the pieces alone, so that
the batches are the same on any cluster.

Long runs of white space, on which the tokenizer's pattern would go back character by character, are counted by themselves: what the pattern
makes of them is known (all but the last character are one piece, the whole run at the end of a text), and no other piece crosses their start.

Cases: null and empty texts are one piece of no tokens. Repeated rows each give their pieces; their order within a bucket is that of
(doc_id, piece). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import map_texts, materialize, table

MAX_LENGTH, BUCKETS, TOKEN_BUDGET = 8_192, 12, 65_536
GROUP_PIECES = 20_000
#: Fixed value: the pre-splitting pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: what ``\\s`` is in the pattern. Runs of SAFE_RUN of these or more do not go through the pattern.
SPACES, SAFE_RUN = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 1_000
_RUN = re.compile(f"[{SPACES}]{{{SAFE_RUN},}}")


def vocabulary_path() -> str:
    """The byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def counter(ranks: dict[bytes, int]) -> Callable[[str], int]:
    """The number of tokens of a text, whatever its runs of white space."""
    import tiktoken

    pieces = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(text: str) -> int:
        n = at = 0
        for run in _RUN.finditer(text):
            end = run.end() - (run.end() < len(text))  # the last character goes with what follows
            n += len(pieces(text[at : run.start()])) + len(whole(text[run.start() : end]))
            at = end
        return n + len(pieces(text[at:]))

    return count


def token_counts(docs: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; the file is read by the driver and broadcast (some MB, whatever the corpus)."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def make():
        count = counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines()) if a})
        return lambda texts: [list(map(count, texts))]

    return map_texts(docs, "text", [pa.field("n_tokens", pa.int64())], make, keep)


def pieces_of(counts: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens) from (doc_id, n_tokens)."""
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / max_length).cast("int") - 1)
    return (
        counts.select("doc_id", F.col("n_tokens").alias("total"))
        .select("doc_id", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .select(
            "doc_id", "piece", (F.col("piece").cast("long") * max_length).alias("start_token"),
            F.least(F.lit(max_length).cast("long"), F.col("total") - F.col("piece").cast("long") * max_length).alias("n_tokens"),
        )
    )


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of up to ``buckets`` buckets over the sorted lengths, with the least sum of count * (end - length).

    best[j] is the least padding of the first j lengths with k buckets; the last of them takes the lengths i..j-1.
    """
    m = len(lengths)
    if m == 0:
        return []
    n = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, m)):
        new, choice = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            i = int(np.argmin(cost))
            new[j], choice[j] = cost[i], i
        best = new
        choices.append(choice)
    ends, j = [], m
    for choice in reversed(choices):
        ends.append(int(lengths[j - 1]))
        j = int(choice[j])
    return ends[::-1]


def pack(pieces: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``pieces`` (doc_id, piece, start_token, n_tokens) with bucket_length, batch, slot and padding."""
    spark = pieces.sparkSession
    histogram = sorted((r.n_tokens, r["count"]) for r in pieces.groupBy("n_tokens").count().collect())  # max_length + 1 rows at most
    ends = boundaries(np.array([h[0] for h in histogram]), np.array([h[1] for h in histogram]), buckets)
    groups = max(1, -(-sum(h[1] for h in histogram) // GROUP_PIECES))
    bucket_of = spark.createDataFrame([(int(n), next(e for e in ends if e >= n)) for n, _ in histogram], "n_tokens long, bucket_length int")
    rows = pieces.join(F.broadcast(bucket_of), "n_tokens").withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = rows.groupBy("bucket_length", "group").count()
    before = Window.partitionBy("bucket_length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_length", "group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket_length", "group").orderBy("doc_id", "piece", "n_tokens")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["bucket_length", "group"])
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), "bucket_length"))).cast("long")
    place = F.col("offset") + F.col("rank")
    return ranked.select(
        "doc_id", "piece", "start_token", "n_tokens", "bucket_length",
        F.floor(place / fit).cast("long").alias("batch"), (place % fit).cast("long").alias("slot"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    counts = materialize(token_counts(docs, vocabulary or vocabulary_path(), ["doc_id"]))
    return pack(pieces_of(counts))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
