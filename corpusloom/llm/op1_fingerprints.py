"""SimHash document fingerprints, and all fingerprints within a Hamming radius.

A term is a word with its predecessor (the first word's is empty), lower-cased and split at white space; it weighs as
many votes as its two words have letters, 15 at most, each time it occurs. Its hash votes on BITS signed
bits; a bit of the fingerprint is 1 where the votes for it outweigh. Votes are integers, so equal texts have equal
fingerprints whatever the batch. Likeness is the cosine that the share of equal bits estimates, at least 0.

``within_radius`` finds all pairs of query and fingerprint at a distance of ``radius`` or less through permuted block tables: the bits fall into
radius + front blocks, and each table has ``front`` of them at its head; two fingerprints within the radius agree in that many blocks at least. Only different
fingerprints are compared, so that copies give no pairs; the documents of each are its members.

The query finds the next document by a global order that no task holds: ranges of ids, as many as the bytes of the texts ask for, each with the first row of
the range after it. Rows of one id that are many are split into ranges of their own by the hash of their text. It also searches: ``class_id`` is the smallest id
with the same fingerprint, and ``n_within`` has, for the ids divisible by QUERY_EVERY, the number of other documents at a distance of RADIUS or less.

Cases: null texts count as empty; a text without words has the fingerprint zero. Repeated rows each give a row. A null
id counts as larger than any, is no query, and is a class_id only where no document of the class has one. Rows with one id follow each other by the hash of their text. With a
single document the next document is itself. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusloom.llm.bits import bit_sums, mix, packed
from corpusloom.llm.common import join_skewed, map_texts, shared_folder, slices, table, through_parquet

BITS, RADIUS, QUERY_EVERY = 128, 3, 50
#: Bytes of text that a range of ids has about.
RANGE_BYTES = 32 << 20
#: Tasks that the fingerprints with one key of a block table are dealt to; each query goes to all of them.
SALTS = 16
#: Words whose hashes a task remembers before it forgets them all.
CACHED_WORDS = 400_000


class _Words(dict):
    """Word to its hash, with min(letters, 15) in the low four bits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        made = self[word] = xxh64_intdigest(word, 1) & ~15 | min(len(word), 15)
        return made


def fingerprint_words(texts: list[str], cache: dict, bits: int = BITS) -> np.ndarray:
    """Shape (texts, bits / 64), unsigned words with the first bit most significant."""
    words = [t.lower().split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    terms = np.fromiter((cache[x] for w in words for x in w), np.uint64, int(starts[-1]))
    before = np.concatenate([np.zeros(1, np.uint64), terms[:-1]])[: len(terms)]
    before[starts[:-1][starts[:-1] < starts[1:]]] = 0
    low = np.uint64(15)
    weights = np.minimum((terms & low) + (before & low), low)
    term = mix(terms) + before * np.uint64(0x9E3779B97F4A7C15)
    total = np.concatenate([[0], np.cumsum(weights.astype(np.int64))])
    total = (total[starts[1:]] - total[starts[:-1]])[:, None]
    return np.stack(
        [packed(2 * bit_sums(mix(term + np.uint64(k)), weights, starts) > total) for k in range(bits // 64)], axis=1
    )


def as_hex(words: np.ndarray) -> list[str]:
    return ["".join(f"{int(x):016x}" for x in row) for row in words]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count(a ^ b).sum(axis=1) / (64 * a.shape[1])
    return np.maximum(0.0, np.cos(np.pi * differ))


def fingerprint(df: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``df`` with a column ``fingerprint`` (hex), which replaces one of that name."""

    def make():
        cache = _Words()
        return lambda texts: [as_hex(fingerprint_words(texts, cache, bits))]

    keep = [c for c in df.columns if c.lower() != "fingerprint"]
    return map_texts(df, text_col, [pa.field("fingerprint", pa.string())], make, keep)


def _words(c: str, bits: int) -> list[Column]:
    """A fingerprint column as signed 64-bit integers."""
    return [F.conv(F.substring(F.col(c), 16 * k + 1, 16), 16, -10).cast("long") for k in range(bits // 64)]


def _signed(word: int) -> int:
    return word - 2**64 if word >= 2**63 else word


def table_masks(radius: int, bits: int = BITS, front: int = 1) -> list[list[int]]:
    """For each block table the bits at its head, as masks of the words."""
    blocks = radius + front
    edges = [round(k * bits / blocks) for k in range(blocks + 1)]
    block = [(1 << (bits - a)) - (1 << (bits - b)) for a, b in zip(edges, edges[1:], strict=False)]
    heads = [sum(block[b] for b in head) for head in combinations(range(blocks), front)]
    return [[_signed(head >> (bits - 64 * (k + 1)) & (2**64 - 1)) for k in range(bits // 64)] for head in heads]


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int, bits: int = BITS, front: int = 1) -> DataFrame:
    """All (query, found, distance) of different fingerprints in the columns ``fingerprint`` with distance <= radius; each with itself if both have it.

    A pair that agrees at the head of more tables than one is kept in the first of them. Fingerprints with one key are dealt to SALTS
    tasks, so that no task holds all of a dense group.
    """
    masks = table_masks(radius, bits, front)
    words = range(bits // 64)

    def keyed(df: DataFrame, c: str, salts: Column) -> DataFrame:
        own = [F.col(f"{c}{k}") for k in words]
        keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(*[w.bitwiseAND(F.lit(m)) for w, m in zip(own, mask, strict=True)]).alias("key")) for t, mask in enumerate(masks)]
        rows = df.select("fingerprint").distinct().select(*[w.alias(f"{c}{k}") for k, w in enumerate(_words("fingerprint", bits))])
        return rows.select(*own, F.explode(F.array(*keys)).alias("at")).select(*own, "at.t", "at.key", salts.alias("salt"))

    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    one = F.pmod(F.xxhash64(*[F.col(f"f{k}") for k in words]), F.lit(SALTS)).cast("int")
    differ = [F.col(f"q{k}").bitwiseXOR(F.col(f"f{k}")) for k in words]
    zero = lambda mask: reduce(and_, [d.bitwiseAND(F.lit(m)) == 0 for d, m in zip(differ, mask, strict=True)])
    first = F.coalesce(*[F.when(zero(mask), F.lit(t)) for t, mask in enumerate(masks)])
    distance = sum((F.bit_count(d) for d in differ[1:]), F.bit_count(differ[0]))
    hexed = lambda c: F.lower(F.concat(*[F.lpad(F.hex(f"{c}{k}"), 16, "0") for k in words]))
    pairs = keyed(queries, "q", every).join(keyed(fingerprints, "f", one), ["t", "key", "salt"]).filter(distance <= radius).filter(first == F.col("t"))
    return pairs.select(hexed("q").alias("query"), hexed("f").alias("found"), distance.alias("distance"))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of (doc_id, text, place, copy), dealt so that the row after each in its partition is the next document.

    Places are ranges of ids, from the highest down, and of hashes of the text where one id has more rows than a range; the first row of each
    place is also sent to the place before it (that of the first to the last), marked as a copy. So the order is global, yet no task holds more than a range. The driver
    gets some numbers for each range.
    """
    spark = docs.sparkSession
    h = F.xxhash64("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-(total.bytes or 0) // range_bytes))
    cuts = Counter(docs.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))
    inner = {*cuts, *(math.nextafter(c, math.inf) for c, n in cuts.items() if n > 1)}  # an id with the rows of a range is one alone
    splits = [-math.inf, *(sorted(inner) or [0.0]), math.inf]
    bucketed = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket", handleInvalid="keep").transform(
        docs.withColumn("_id", F.col("doc_id").cast("double"))
    ).select("doc_id", "text", F.coalesce(F.col("_bucket").cast("int"), F.lit(len(splits))).alias("bucket"))
    found = bucketed.groupBy("bucket").agg(F.max("doc_id").alias("top"), F.min("doc_id").alias("low"), F.count("*").alias("n")).collect()
    single = {r.bucket: max(1, round(r.n * ranges / total.rows)) for r in found if r.top == r.low and r.n > 1}  # rows of one id; none where it is null
    parts = F.create_map(*[F.lit(int(x)) for pair in single.items() for x in pair]) if single else None
    split = F.least(parts[F.col("bucket")] - 1, F.floor((h / F.lit(2.0**64) + 0.5) * parts[F.col("bucket")])).cast("int") if single else F.lit(None).cast("int")
    bucketed = bucketed.withColumn("part", F.coalesce(split, F.lit(0)))
    firsts = {}
    if single:
        alone = bucketed.filter(F.col("bucket").isin(list(single))).groupBy("bucket", "part").agg(F.min(h).alias("h"))
        firsts = {(r.bucket, r.part): r.h for r in alone.collect()}
    order = sorted([k for k in firsts] + [(r.bucket, 0) for r in found if r.bucket not in single], key=lambda k: (-k[0], k[1]))
    top = {r.bucket: r.top for r in found}
    places = spark.createDataFrame(
        [(b, p, k, (k - 1) % len(order), top[b], firsts.get((b, p))) for k, (b, p) in enumerate(order)], "bucket int, part int, place int, before int, top long, first long"
    )
    here, there = (F.struct(F.col(c).alias("place"), F.lit(copy).alias("copy")) for c, copy in (("place", False), ("before", True)))
    leads = F.when(F.col("first").isNull(), F.col("doc_id").eqNullSafe(F.col("top"))).otherwise(h == F.col("first"))
    return (
        bucketed.join(F.broadcast(places), ["bucket", "part"])
        .select("doc_id", "text", F.explode(F.when(leads, F.array(here, there)).otherwise(F.array(here))).alias("to")).select("doc_id", "text", "to.place", "to.copy")
        .repartitionById(max(1, len(order)), F.col("place"))
        .sortWithinPartitions("place", "copy", F.desc_nulls_first("doc_id"), h)
    )


def edited(text: str, following: str) -> str:
    """The last third of the code points, rounded down, replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [
        pa.field("doc_id", pa.int64()), pa.field("n_chars", pa.int64()), pa.field("edited_sha256", pa.string()), pa.field("fingerprint", pa.string()),
        pa.field("edited_fingerprint", pa.string()), pa.field("near_edited", pa.float64()), pa.field("near_next", pa.float64()),
    ]

    def compute(rows: list[tuple], cache: dict) -> pa.RecordBatch:
        """For all rows but the last, which is there as the next of the one before."""
        from hashlib import sha256

        texts = [r[1] for r in rows]
        own = fingerprint_words(texts, cache)
        at = [i for i, r in enumerate(rows[:-1]) if not r[3]]
        new = [edited(texts[i], texts[i + 1]) for i in at]
        other, then, own = fingerprint_words(new, cache), own[[i + 1 for i in at]], own[at]
        made = [
            [rows[i][0] for i in at], [len(texts[i]) for i in at], [sha256(t.encode()).hexdigest() for t in new],
            as_hex(own), as_hex(other), likeness(own, other), likeness(own, then),
        ]
        return pa.RecordBatch.from_arrays([pa.array(m, f.type) for m, f in zip(made, fields, strict=True)], schema=pa.schema(fields))

    def run(batches):
        cache, held = _Words(), []
        for batch in batches:
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "place", "copy")), strict=True))
            held = rows[-1:]
            for part in slices([r[1] for r in rows[:-1]]):
                yield compute(rows[part.start : part.stop + 1], cache)
        # what is held at the end is a copy: each place ends with one

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    made = with_next(table(spark, sf_dir, "documents")).mapInArrow(run, schema)
    rows = through_parquet(made, f"{shared_folder(spark)}/fingerprints")  # searched and returned
    asked = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max(asked).alias("asked"))
    pairs = within_radius(classes.filter("asked"), classes, RADIUS)
    within = pairs.join(classes.select(F.col("fingerprint").alias("found"), "copies"), "found").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("copies").alias("all"))
    known = classes.join(within, "fingerprint", "left").select("fingerprint", "class_id", "copies", "all")
    joined = join_skewed(rows, known, "fingerprint", "copies", rows.count())
    return joined.select(*[f.name for f in fields], "class_id", F.when(asked, F.col("all") - 1).alias("n_within"))
