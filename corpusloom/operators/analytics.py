"""Corpus tiers, benchmark statistics and training-log analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.ordering import running_sum

MIB = 1024 * 1024


def byte_sum(text: Column) -> Column:
    return F.sum(F.octet_length(text))


def tier(lines: DataFrame, order: list[str], text: str, target: int) -> DataFrame:
    """The first lines until their bytes reach ``target``, with ``cycle``; the corpus is repeated if it is too small.

    A corpus without bytes would never get there and raises an error.
    """
    total = lines.agg(byte_sum(F.col(text))).first()[0] or 0
    if total == 0:
        raise ValueError("the lines have no bytes")
    cycles = -(-target // total)
    sized = lines.withColumn("_bytes", F.octet_length(text).cast("long"))
    placed = running_sum(sized, order, "_bytes", "_before")
    repeated = placed.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cycles - 1).cast("long"))))
    return repeated.filter(F.col("cycle") * total + F.col("_before") < target).drop("_bytes", "_before")


def percentiles(value: Column, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> Column:
    """Exact percentiles, linear between neighbours."""
    return F.percentile(value, F.array(*[F.lit(s) for s in shares]))


def trimmed(repeats: DataFrame, keys: list[str], rate: str, repeat: str) -> DataFrame:
    """Without the slowest and the fastest repeat of each key, where there are three or more. Repeats are few: a row for each."""
    by = Window.partitionBy(*keys)
    ranked = repeats.withColumn("_rank", F.row_number().over(by.orderBy(rate, repeat))).withColumn("_n", F.count("*").over(by))
    return ranked.filter((F.col("_n") < 3) | ((F.col("_rank") > 1) & (F.col("_rank") < F.col("_n")))).drop("_rank", "_n")


def throughput(repeats: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, tokens, bytes, seconds): tok_per_s, mib_per_s and bytes_per_token over all repeats together."""
    seconds = F.when(F.sum("seconds") > 0, F.sum("seconds")).otherwise(1e-9)
    return repeats.groupBy(*keys).agg(
        (F.sum("tokens") / seconds).alias("tok_per_s"),
        (F.sum("bytes") / seconds / MIB).alias("mib_per_s"),
        (F.sum("bytes") / F.greatest(F.sum("tokens"), F.lit(1))).alias("bytes_per_token"),
    )


def winners(results: DataFrame, tier_col: str, rate: str, variant: str) -> DataFrame:
    """The fastest variant of each tier, the first by name on a tie."""
    best = F.min_by(F.struct(variant, rate), F.struct(-F.col(rate), F.col(variant))).alias("best")
    return results.groupBy(tier_col).agg(best).select(tier_col, f"best.{variant}", f"best.{rate}")


def parse_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """(kind, step, loss) of the training and evaluation lines of a log."""
    train, valid = r"step (\d+)/\d+ loss ([\d.]+)", r"\[eval\] step (\d+) val_loss ([\d.]+)"
    found = lambda kind, p: F.struct(
        F.lit(kind).alias("kind"), F.regexp_extract(text, p, 1).cast("int").alias("step"), F.regexp_extract(text, p, 2).cast("double").alias("loss")
    )
    both = F.array(F.when(F.col(text).rlike(train), found("train", train)), F.when(F.col(text).rlike(valid), found("valid", valid)))
    return lines.select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("r")).select("r.*")


def best_checkpoint(evaluations: DataFrame, step: str = "step", loss: str = "loss") -> DataFrame:
    """The step of the least loss, the earliest on a tie."""
    return evaluations.agg(F.min_by(step, F.struct(loss, step)).alias("best_step"), F.min(loss).alias("best_loss"))


def saved_checkpoints(evaluations: DataFrame, step: str = "step", loss: str = "loss", by: list[str] | None = None) -> DataFrame:
    """With ``saved``: whether the loss is less than all before, per run ``by`` (an evaluation log of one run is small)."""
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return evaluations.withColumn("saved", F.coalesce(F.col(loss) < F.min(loss).over(before), F.lit(True)))


def round_trip_gate(rows: DataFrame, original: Column, decoded: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.bool_and(original == decoded), F.lit(True)).alias("passed"))
