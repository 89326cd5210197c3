"""Packed-stream files, leaderboard files and chunk listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.clean import display_escape, hex_bytes
from corpusloom.functions.rules import DEFAULT_RULESET
from corpusloom.functions.split import chunks
from corpusloom.operators.pack import packed, unpacked


def write_stream(pages: DataFrame, path: str) -> None:
    """Pages (page, tok) as Parquet in page order: many writers, one stream. ``stream_bytes`` gives the flat bytes of any part of it."""
    pages.select("page", packed(F.col("tok")).alias("packed")).repartitionByRange("page").sortWithinPartitions("page").write.parquet(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """(page, tok)."""
    return spark.read.parquet(path).select("page", unpacked(F.col("packed")).alias("tok"))


def write_flat(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """One flat file of 16-bit ids; pages pass through the driver one at a time."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    for row in pages.orderBy("page").select(packed(F.col("tok")).alias("packed")).toLocalIterator():
        out.write(bytearray(row.packed))
    out.close()


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """(file, tok) of flat files; one of odd length raises an error."""
    raw = spark.read.format("binaryFile").load(path)
    odd = F.raise_error(F.concat(F.lit("no stream of 16-bit ids: "), F.col("path")))
    return raw.select(F.col("path").alias("file"), F.when(F.octet_length("content") % 2 == 0, unpacked(F.col("content"))).otherwise(odd.cast("string")).alias("tok"))


def chunk_listing(docs: DataFrame, key: list[str], text: str, ruleset: str = DEFAULT_RULESET) -> DataFrame:
    """(key, pos, chars, bytes, text, hex) of every chunk."""
    rows = docs.select(*key, F.posexplode(chunks(F.col(text), ruleset)).alias("pos", "chunk"))
    return rows.select(
        *key, "pos", F.length("chunk").alias("chars"), F.octet_length("chunk").alias("bytes"), display_escape(F.col("chunk")).alias("text"), hex_bytes(F.col("chunk")).alias("hex")
    )


def listing_line(pos: Column, chars: Column, size: Column, text: Column, hexed: Column) -> Column:
    return F.format_string('[%d] chars=%d bytes=%d text="%s" hex=[%s]', pos, chars, size, text, hexed)


def write_leaderboard(results: DataFrame, path: str) -> None:
    """Results as JSON lines, stamped with the time in UTC."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    results.withColumn("stamp", stamp).write.json(path)


