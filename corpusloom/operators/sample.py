"""Training windows over a paged stream, and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.encode import ids


def require_length(n_tokens: int, length: int) -> int:
    """The number of starts that a window of ``length`` and its shifted target have."""
    if n_tokens < length + 2:
        raise ValueError(f"only {n_tokens} tokens; {length + 2} are needed")
    return n_tokens - length - 1


def random_starts(spark: SparkSession, n_tokens: int, length: int, count: int, seed: int) -> DataFrame:
    """(window, start): uniform starts in [0, n_tokens - length - 1); the same for the same seed and partitioning."""
    starts = require_length(n_tokens, length)
    return spark.range(0, count, 1, 1).select(F.col("id").alias("window"), F.floor(F.rand(seed) * starts).cast("long").alias("start"))


def page_starts(spark: SparkSession, n_tokens: int, length: int, batches: int, batch: int, seed: int, page_tokens: int = 1 << 20, batches_per_page: int = 64) -> DataFrame:
    """(window, start): a random page of the stream serves ``batches_per_page`` batches of windows inside it."""
    size = min(page_tokens, n_tokens)
    inside = require_length(size, length)
    rows = spark.range(0, batches * batch, 1, 1).select(F.col("id").alias("window"), F.floor(F.col("id") / (batch * batches_per_page)).alias("turn"))
    share = F.pmod(F.xxhash64(F.lit(seed), "turn"), F.lit(1 << 40)) / float(1 << 40)
    base = F.floor(share * (n_tokens - size + 1))
    return rows.select("window", (base + F.floor(F.rand(seed) * inside)).cast("long").alias("start"))


def windows(pages: DataFrame, starts: DataFrame, length: int, page_tokens: int) -> DataFrame:
    """(window, start, x, y) with x the ids from start on and y those one further.

    A window needs the pages that it touches and no others: an equi-join on the page number.
    """
    touched = F.sequence(F.floor(F.col("start") / page_tokens), F.floor((F.col("start") + length) / page_tokens))
    needed = starts.select("window", "start", F.explode(touched).alias("page"))
    parts = needed.join(pages, "page").groupBy("window", "start").agg(
        F.sort_array(F.collect_list(F.struct("page", "tok"))).alias("parts")
    )
    offset = (F.col("start") - F.element_at("parts", 1)["page"] * page_tokens).cast("int")
    span = F.substring(F.array_join("parts.tok", ""), offset + 1, F.lit(length + 1))
    return parts.select("window", "start", span.alias("span")).filter(F.length("span") == length + 1).select(
        "window", "start", ids(F.substring("span", 1, length)).alias("x"), ids(F.substring("span", 2, length)).alias("y")
    )


def learning_rate(step: Column, warmup: int, max_steps: int, max_lr: float, min_lr: float) -> Column:
    """Linear warm-up, then half a cosine down."""
    t = F.least((step - warmup) / max(1, max_steps - warmup), F.lit(1.0))
    return F.when(step < warmup, max_lr * (step + 1) / max(warmup, 1)).otherwise(
        min_lr + 0.5 * (max_lr - min_lr) * (1.0 + F.cos(F.pi() * t))
    )


def tokens_per_step(batch: int, length: int, accumulate: int) -> int:
    return batch * length * accumulate


def teraflops(parameters: int, tokens_per_second: Column) -> Column:
    return 6.0 * parameters * tokens_per_second / 1e12
