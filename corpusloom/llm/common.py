"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.session import ensure_checkpoint_dir, spread

#: Code points that one slice of a batch holds before a new slice starts; bounds Python's working memory.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpusloom-{uuid4().hex}"


def through_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: A key with more of ``total`` rows than one in so many, and more than HOT_ROWS, is hot: there are fewer hot keys than that.
HOT_SHARE, HOT_ROWS = 10_000, 100_000


def join_skewed(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` with the row of ``lookup`` for their key; the column ``weight`` of ``lookup`` has how many of the ``total`` rows have the key, and is dropped.

    Rows of hot keys stay where they are: their lookups, HOT_SHARE at most whatever the input, are broadcast. The rest is shuffled by key, as are all
    rows where there are too few for a hot key.
    """
    if total <= HOT_ROWS:
        return rows.join(lookup.drop(weight), key)
    lookup = materialize(lookup)
    hot = F.col(weight) > max(HOT_ROWS, total // HOT_SHARE)
    few, rest = F.broadcast(lookup.filter(hot).drop(weight)), lookup.filter(~hot).drop(weight)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def slices(texts: list[str]) -> Iterator[slice]:
    """Consecutive slices of a batch with about SLICE_CHARS code points each, at least one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def map_texts(
    df: DataFrame, text_col: str, added: list[pa.Field], make: Callable[[], Callable[[list[str]], list]], keep: list[str] | None = None
) -> DataFrame:
    """Append columns computed from one text column, in Arrow batches.

    ``make`` runs once per task and returns a function from a list of texts (null as '') to one
    list or array per added column. ``keep`` names the columns that stay (all when None), in order; the text
    column itself is only sent back if it is kept.
    """
    kept = list(df.columns if keep is None else keep)
    added_schema = pa.schema(added)
    out_schema = StructType(df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields + from_arrow_schema(added_schema).fields)
    names = kept + [f.name for f in added]
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_col])])

    def run(batches):
        apply = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for part in slices(texts):
                made = apply(texts[part])
                rows = batch.slice(part.start, part.stop - part.start)
                columns = [rows.column(c) for c in kept]
                columns += [m if isinstance(m, pa.Array) else pa.array(m, f.type) for m, f in zip(made, added, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, out_schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def private_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
