"""Line sources with the two conventions in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rules import SPLIT_FILES


def read_lines(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(split, file, line) as binary: lines end at a line feed alone, one carriage return before it is stripped, empty lines stay.

    A missing file raises an error at once. ``split`` adds the name of the split's file to the path.
    """
    name = f"{path}/{SPLIT_FILES[split]}" if split else path
    raw = spark.read.option("lineSep", "\n").text(name)
    line = F.col("value")
    return raw.select(F.lit(split).alias("split"), F.input_file_name().alias("file"), F.when(line.endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(line).alias("line"))


def text_lines(text: Column) -> Column:
    """The lines of a text, by the same rule: none for the empty text, and none after a last line feed."""
    parts = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", "")))


def lines_with_ends(text: Column) -> Column:
    """Lines with their terminators, which are CR LF, CR or LF; they join to the text."""
    return F.regexp_extract_all(text, F.lit("[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+"), F.lit(0))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) with ill-formed UTF-8 refused."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.validate_utf8(F.decode(F.col("content"), "UTF-8")).alias("text"))


def explode_lines(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line_no, line) of the lines of each text."""
    return docs.select(*key, F.posexplode(text_lines(F.col(text))).alias("line_no", "line"))


def require_lines(lines: DataFrame) -> DataFrame:
    if lines.isEmpty():
        raise ValueError("no lines")
    return lines
