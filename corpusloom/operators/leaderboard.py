"""Benchmark of the encoder's plans over tiers of a corpus."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.split import chunks
from corpusloom.operators import analytics
from corpusloom.operators.encode import PairTable, decode, encode_arrow, encode_native, encode_strings, ids
from corpusloom.operators.vocabulary import Vocabulary
from corpusloom.session import ensure_checkpoint_dir

TIERS = {"small-1KB": 1 << 10, "medium-1MB": 1 << 20, "large-10MB": 10 << 20}
WARM_UPS, REPEATS, GATE_LINES = 2, 5, 50
PLANS: dict[str, Callable[[Column, Vocabulary, str], Column]] = {"arrow": encode_arrow, "native": encode_native}


def timed_encode(text: Column, vocabulary: Vocabulary, ruleset: str) -> Column:
    """(tokens, us) of each text, measured around the encoding of its chunks."""
    merges = list(vocabulary.merges)

    @F.pandas_udf("tokens long, us double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = PairTable(merges)
        for batch in batches:
            rows = []
            for row in batch:
                began = time.perf_counter()
                n = pc.sum(pc.utf8_length(encode_strings(pa.array(row, pa.string()), table))).as_py() or 0
                rows.append((n, 1e6 * (time.perf_counter() - began)))
            yield pd.DataFrame(rows, columns=["tokens", "us"])

    return apply(chunks(text, ruleset))


def gate(lines: DataFrame, vocabulary: Vocabulary, ruleset: str, text: str = "line") -> bool:
    """Whether some lines come back from their tokens."""
    some = lines.limit(GATE_LINES).select(F.col(text).alias("t"), encode_native(F.col(text), vocabulary, ruleset).alias("tok"))
    back = F.decode(decode(ids(F.col("tok")), vocabulary), "UTF-8")
    return analytics.round_trip_gate(some.withColumn("back", back), F.col("t"), F.col("back")).first().passed


def run(
    spark: SparkSession, lines: DataFrame, order: list[str], vocabulary: Vocabulary, rulesets: tuple[str, ...] = ("cl100k_base", "o200k_base"),
    tiers: dict[str, int] | None = None, warm_ups: int = WARM_UPS, repeats: int = REPEATS, text: str = "line",
) -> DataFrame:
    """A row for each variant (plan and rule set) and tier: rates over the repeats that trimming leaves, latencies of the lines, decoding, load and memory."""
    ensure_checkpoint_dir(spark)
    measured, latencies, more = [], [], []
    for tier, target in (tiers or TIERS).items():
        part = analytics.tier(lines, order, text, target).select(text).checkpoint()
        n_lines, n_bytes = part.agg(F.count("*"), analytics.byte_sum(F.col(text))).first()
        for plan, encode in PLANS.items():
            for ruleset in rulesets:
                if not gate(part, vocabulary, ruleset, text):
                    raise ValueError(f"{plan} {ruleset}: lines do not come back from their tokens")
                coded = part.select(encode(F.col(text), vocabulary, ruleset).alias("tok"))
                for repeat in range(-warm_ups, repeats):
                    began = time.perf_counter()
                    tokens = coded.agg(F.sum(F.length("tok"))).first()[0]
                    seconds = time.perf_counter() - began
                    if repeat >= 0:
                        measured.append((f"{plan} ({ruleset})", tier, repeat, tokens, n_bytes, seconds, tokens / seconds))
                kept = coded.checkpoint()
                began = time.perf_counter()
                size = kept.agg(F.sum(F.octet_length(decode(ids(F.col("tok")), vocabulary)))).first()[0]
                rate = size / (time.perf_counter() - began) / analytics.MIB
                more.append((f"{plan} ({ruleset})", tier, n_lines, n_bytes, rate, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024))
        for ruleset in rulesets:
            one = part.select(timed_encode(F.col(text), vocabulary, ruleset).alias("r")).select(F.lit(f"arrow ({ruleset})").alias("variant"), F.lit(tier).alias("tier"), "r.us")
            latencies.append(one)
    rows = spark.createDataFrame(measured, "variant string, tier string, repeat int, tokens long, bytes long, seconds double, rate double")
    rates = analytics.throughput(analytics.trimmed(rows, ["variant", "tier"], "rate", "repeat"), ["variant", "tier"])
    spent = latencies[0]
    for one in latencies[1:]:
        spent = spent.union(one)
    spent = spent.groupBy("variant", "tier").agg(analytics.percentiles(F.col("us")).alias("p"), F.avg("us").alias("mean_us")).select(
        "variant", "tier", *[F.col("p")[k].alias(n) for k, n in enumerate(("p50_us", "p90_us", "p99_us"))], "mean_us"
    )
    facts = spark.createDataFrame(more, "variant string, tier string, lines long, bytes long, decode_mib_per_s double, driver_rss_mb double")
    return facts.join(rates, ["variant", "tier"]).join(spent, ["variant", "tier"], "left")
