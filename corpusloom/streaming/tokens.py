"""The stateless expressions of the engine on streams, and counts that streams keep up to date."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rules import DEFAULT_RULESET
from corpusloom.functions.split import chunks
from corpusloom.operators.encode import encode_arrow
from corpusloom.operators.pack import packed
from corpusloom.operators.vocabulary import Vocabulary
from corpusloom.session import ensure_checkpoint_dir


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a Parquet folder, as files arrive, or of a single file.

    The path is given as a pattern, as a stream of one file is not taken otherwise.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def encode_stream(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ruleset: str = DEFAULT_RULESET) -> DataFrame:
    """Rows with n_tokens and the packed bytes; stateless, so that it is the same on streams and tables."""
    coded = docs.withColumn("tok", encode_arrow(F.col(text), vocabulary, ruleset))
    return coded.withColumn("n_tokens", F.length("tok")).withColumn("packed", packed(F.col("tok"))).drop("tok")


def count_chunks(docs: DataFrame, text: str = "text", ruleset: str = DEFAULT_RULESET) -> DataFrame:
    """Running counts of chunks; a stream of it has an entry of state for each distinct chunk (update or complete mode)."""
    return docs.select(F.explode(chunks(F.col(text), ruleset)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


def stream_totals(spark: SparkSession, path: str) -> DataFrame:
    """Documents, chunks and bytes by language, from a stream that ends when all files are read.

    The stream writes its per-row counts as Parquet in the shared folder, exactly once; the totals are read from there.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid4().hex}"
    rows = read_documents(spark, path).select(
        "lang", F.size(chunks(F.col("text"))).cast("long").alias("chunks"), F.octet_length("text").cast("long").alias("bytes")
    )
    query = (
        rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    done = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    return done.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"))
