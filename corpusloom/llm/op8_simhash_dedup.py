"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A fingerprint has 64 bits; bit b is 1 if it is set in over half of the XXH64 values (seed 42) of the text's 3-word
shingles, repeats included. Fingerprints at ``radius`` differing bits or fewer are linked, and documents take the smallest id that links reach.

Only distinct fingerprints are compared. Their bits fall into radius + 1 blocks; linked ones agree in a block
at least, so that each (block, value) is a group in which the comparison is exact: numpy exclusive-or and bit counts over tiles,
ordered by population count, and tile pairs whose population counts differ beyond the radius are
skipped. Small groups share a task; a group beyond TILE fingerprints is dealt by tile pairs to as many tasks as it needs. A task returns a
spanning forest of the links that it has found, so that a dense group does not give all its pairs. Components are joined by rounds of
distributed minima.

Cases: null text counts as empty; texts without words have the fingerprint zero and are linked like any other. Repeated
rows and rows with one id each give a row. A null id never is the component's id unless it is alone. An empty table gives no
rows. Extra columns are ignored in the query; ``drop_copies`` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusloom.llm.bits import bit_sums, packed
from corpusloom.llm.common import join_skewed, map_texts, materialize, private_name, shared_folder, table, through_parquet
from corpusloom.llm.components import components, forest

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints in a tile; a task compares two tiles at most.
TILE = 8_192
#: Rows of small groups that a task compares at once; bounds its memory, whatever its share of the groups.
CELL = 300_000
#: Groups of up to this many are compared by shifting, all at once.
SMALL = 48
_BLOCK = 256


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of every shingle of a text; bytes.lower and bytes.split are exactly A-Z and the ASCII white space."""
    words = text.encode().lower().split()
    if len(words) < SHINGLE:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))]


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    hashes = [np.array(shingle_hashes(t), np.uint64) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    return packed(2 * bit_sums(flat, None, starts) > np.diff(starts)[:, None])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and fp as a signed 64-bit integer."""
    made = lambda: lambda texts: [fingerprint_texts(texts).view(np.int64)]
    return map_texts(docs, "text", [pa.field("fp", pa.int64())], made, list(keep))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks of a word."""
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def link_labels(fps: np.ndarray, radius: int = RADIUS, split: int | None = None) -> np.ndarray:
    """The least position that links among ``fps`` (unsigned) reach; with ``split`` only links across it count.

    Tiles go by population count, so that those too far apart are skipped.
    """
    ones = np.bitwise_count(fps).astype(np.int64)
    side = np.zeros(len(fps), bool) if split is None else np.arange(len(fps)) >= split
    order = np.argsort(ones, kind="stable")
    word, count, far = fps[order], ones[order], side[order]
    label = np.arange(len(fps))
    for a in range(0, len(word), _BLOCK):
        b = min(a + _BLOCK, len(word))
        last = np.searchsorted(count, count[b - 1] + radius, "right")
        near = np.bitwise_count(word[a:b, None] ^ word[None, a:last]) <= radius
        if split is not None:
            near &= far[a:b, None] != far[None, a:last]
        rows, cols = np.nonzero(near)
        away = rows != cols
        label = _join(label, rows[away] + a, cols[away] + a)
    out = np.empty(len(fps), np.int64)
    root = np.full(len(fps), len(fps), np.int64)
    np.minimum.at(root, label, order)
    out[order] = root[label]
    return out


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` after the links i-j as well."""
    return forest(len(label), np.concatenate([np.arange(len(label)), i]), np.concatenate([label, j])) if len(i) else label


def _cell_links(block: np.ndarray, key: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of whole groups, which are equal (block, key)."""
    order = np.lexsort((fps, key, block))
    block, key, fps = block[order], key[order], fps[order]
    fresh = np.concatenate([[True], (block[1:] != block[:-1]) | (key[1:] != key[:-1])])
    group = np.cumsum(fresh) - 1
    first = np.nonzero(fresh)[0]
    size = np.diff(np.append(first, len(fps)))
    small = size[group] <= SMALL
    i, j = [], []
    for d in range(1, min(SMALL, int(size.max(initial=1)))):
        at = np.nonzero((group[:-d] == group[d:]) & small[:-d])[0]
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= radius]
        i.append(at), j.append(at + d)
    for g in np.nonzero(size > SMALL)[0]:
        a = first[g]
        label = link_labels(fps[a : a + size[g]], radius)
        at = np.nonzero(label != np.arange(size[g]))[0]
        i.append(at + a), j.append(label[at] + a)
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (i, j))
    label = forest(len(fps), i, j)
    at = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[at], fps[label[at]]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(distinct_fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp): links whose components are those of all links."""
    shifted = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))
    rows = distinct_fps.select(
        "fp", F.bit_count("fp").alias("ones"),
        F.explode(F.array(*[F.struct(F.lit(b).alias("block"), shifted(s, w).alias("key")) for b, (s, w) in enumerate(_blocks(radius))])).alias("g"),
    ).select("g.block", "g.key", "ones", "fp")
    sizes = rows.groupBy("block", "key", "ones").agg(F.count("*").alias("n"))
    hot = sizes.groupBy("block", "key").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int")))).alias("parts")
    ).filter(F.col("size") > tile)
    marked = rows.join(hot, ["block", "key"], "left")
    return _small_links(marked.filter("parts IS NULL"), radius).union(
        _tile_links(marked.filter("parts IS NOT NULL"), radius)
    )


def _small_links(rows: DataFrame, radius: int) -> DataFrame:
    """Whole groups of up to a tile of fingerprints: a task sees them one after the other, and compares about CELL rows at once."""

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        a, b = _cell_links(rows[0], rows[1], rows[2].view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], schema=_EDGES)

    def run(batches):
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("block", "key", "fp")])], axis=1)
            if held.shape[1] >= CELL:
                last = np.nonzero((held[:2] != held[:2, -1:]).any(axis=0))[0]
                if len(last):  # all but the group that may go on
                    yield compare(held[:, : last[-1] + 1])
                    held = held[:, last[-1] + 1 :]
        if held.shape[1]:
            yield compare(held)

    dealt = rows.select(F.col("block").cast("long").alias("block"), "key", "fp").repartition("block", "key").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(run, "a long, b long")


def _tile_links(rows: DataFrame, radius: int) -> DataFrame:
    """Groups of more: tiles are (population count, part); each pair of tiles within the radius is a group of its own."""
    part: Column = F.pmod(F.xxhash64("fp"), F.element_at("parts", F.col("ones"))).cast("int")
    own = F.struct(F.col("ones").alias("ones"), F.col("part").alias("part"))
    others = F.flatten(F.transform(
        F.filter(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda q: F.map_contains_key("parts", q)),
        lambda q: F.transform(F.sequence(F.lit(0), F.element_at("parts", q) - 1), lambda p: F.struct(q.alias("ones"), p.alias("part"))),
    ))
    dealt = rows.withColumn("part", part).select("block", "key", "fp", own.alias("own"), F.explode(others).alias("other")).select(
        "block", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).alias("second"), "fp",
    )

    def run(table_):
        fps, second = table_.column("fp").to_numpy().view(np.uint64), table_.column("second").to_numpy()
        order = np.argsort(second, kind="stable")
        fps, split = fps[order], int((~second).sum())
        label = link_labels(fps, radius, split if split < len(fps) else None)
        at = np.nonzero(label != np.arange(len(fps)))[0]
        return pa.table([fps[at].view(np.int64), fps[label[at]].view(np.int64)], schema=_EDGES)

    return dealt.groupBy("block", "key", "low", "high").applyInArrow(run, "a long, b long")


def _roots(prints: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fp, n, root, least): how many rows each distinct fingerprint has, its component, and the least of its rows."""
    nodes = prints.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp"), radius))
    return nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _with_least(prints: DataFrame, least: Column, name: str, radius: int) -> DataFrame:
    """``prints`` and the least row of the component, as ``name``; rows of a fingerprint that very many have are not shuffled."""
    labelled = _roots(prints, least, radius)
    named = labelled.groupBy("root").agg(F.min("least").alias(name))
    by_fp = labelled.select("fp", "root", "n").join(named, "root").select("fp", name, "n")
    return join_skewed(prints, by_fp, "fp", "n", prints.count())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    found = _with_least(materialize(fingerprints(docs)), F.col("doc_id"), "component_id", radius)
    return found.select("doc_id", "fp", "component_id")


def drop_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null last; of more texts with that id the one of the least hash.

    Equal texts are in one component, so that (id, hashes of the text) tell which rows go; a row that repeats both stays once. What goes is written as a table
    of these keys and anti-joined by one shuffle of the texts, at every size: how many rows go has no bound, so they are not broadcast.
    """
    hashes = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    names = [private_name(docs, f"_gone_{c}") for c in ("id", "a", "b")]
    key = ["doc_id", *names[1:]]
    keyed = docs.select("doc_id", "text", *[h.alias(n) for h, n in zip(hashes, names[1:], strict=True)])
    prints = materialize(fingerprints(keyed, key))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), *key)
    folder = shared_folder(docs.sparkSession)
    gone = _with_least(prints, row, "least", radius).filter(row != F.col("least")).select(*key).distinct()
    gone = through_parquet(gone.toDF(*names), f"{folder}/gone").hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & (hashes[0] == F.col(names[1])) & (hashes[1] == F.col(names[2]))
    out = docs.join(gone, same, "left_anti")
    repeated = through_parquet(prints.groupBy(*key).count().filter("count > 1").select(*key).toDF(*names), f"{folder}/repeated").hint("merge")
    if repeated.isEmpty():
        return out
    again = docs.join(repeated, same, "left_semi").join(gone, same, "left_anti").withColumns(dict(zip(names[1:], hashes, strict=True)))
    return out.join(repeated, same, "left_anti").unionByName(again.dropDuplicates(key).drop(*names[1:]))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
