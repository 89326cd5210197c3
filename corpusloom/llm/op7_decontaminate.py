"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. Every item of the benchmark gives seeds, runs of SEED words that are rare: their
chance to begin at a word of the corpus, by the frequencies of their words in all documents, is RARE or less; and of every
WINDOW neighbouring runs the rarest one, so that an item of common words has seeds as well. A copied passage makes its words only slightly more frequent, so that
items stay searchable however often they were copied. Where a document has a seed, the words around it and the item are aligned
locally (+1 for equal words, -1 for others and gaps). A document holds an item if the alignment reaches SHARE of the item's words but
LEAST at least (the whole item if it is shorter), or LONG at all. Items of fewer than SEED words have no seeds; their exact runs of words are looked up.

Documents are never joined with items by a shuffle: items are taken in blocks of BLOCK_WORDS words, one after the other. A block is broadcast for two passes over all whole
texts, one that counts its words and one that finds its items; what it finds is written to the shared folder and its broadcast destroyed before the next block
comes. So the driver and the executors hold one block, however large the benchmark is. An item is held whole.

Cases: null texts count as empty and hold nothing. Items that are null or without words match nothing. Repeated rows each give their rows; an
item that is listed twice is found twice. Empty tables give no rows. Extra columns are ignored in the query; ``keep_clean`` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import map_texts, private_name, remove, shared_folder, table, through_parquet

SEED, WINDOW, RARE = 3, 2, 1e-9
SHARE, LEAST, LONG = 0.35, 6, 50
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def least_score(size: int) -> float:
    """What an alignment must reach for an item of so many words."""
    return min(LONG, max(SHARE * size, min(LEAST, size)))


@dataclass
class Block:
    """Items as arrays of word numbers, and their seeds: sorted keys with the (item, position) of each.

    ``short`` has the items of fewer than SEED words: for each size, the key of the whole item and the items that it stands for.
    """

    ids: list
    items: list[np.ndarray]
    numbers: dict[str, int]
    keys: np.ndarray | None = None
    item: np.ndarray | None = None
    position: np.ndarray | None = None
    short: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    def numbered(self, text: str) -> np.ndarray:
        words = words_of(text)
        get = self.numbers.get
        return np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))

    def runs(self, numbers: np.ndarray, size: int = SEED) -> np.ndarray:
        """Keys of the runs of ``size`` words, -1 where a word is unknown."""
        n = max(0, len(numbers) - size + 1)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            key = key * len(self.numbers) + numbers[k : k + n]
            known &= numbers[k : k + n] >= 0
        return np.where(known, key, -1)

    def plant(self, chance: np.ndarray) -> None:
        """Choose the seeds by the chance of each word."""
        keys, item, position = [], [], []
        for i, numbers in enumerate(self.items):
            n = len(numbers) - SEED + 1
            if n <= 0:
                self.short.setdefault(len(numbers), {}).setdefault(int(self.runs(numbers, len(numbers))[0]), []).append(i)
                continue
            odds = np.sum([np.log(chance[numbers[k : k + n]]) for k in range(SEED)], axis=0)
            chosen = odds <= np.log(RARE)
            for at in range(max(1, n - WINDOW + 1)):
                chosen[at + int(np.argmin(odds[at : at + WINDOW]))] = True
            at = np.nonzero(chosen)[0]
            keys.append(self.runs(numbers)[at]), item.append(np.full(len(at), i)), position.append(at)
        keys, item, position = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, item, position))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.position = keys[order], item[order], position[order]

    def windows(self, numbers: np.ndarray) -> dict[int, list[list[int]]]:
        """For each item with a seed in the text, the spans of words to align it with."""
        runs = self.runs(numbers)
        low, high = np.searchsorted(self.keys, runs, "left"), np.searchsorted(self.keys, runs, "right")
        spans: dict[int, list[list[int]]] = {}
        for at in np.nonzero((high > low) & (runs >= 0))[0]:
            for k in range(low[at], high[at]):
                i = int(self.item[k])
                size = len(self.items[i])
                a = max(0, int(at - self.position[k]) - size // 2)
                b = min(len(numbers), int(at - self.position[k]) + size + size // 2)
                own = spans.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        return spans

    def matches(self, text: str) -> list[tuple]:
        """(item number, score, first word, end) of the items that a text holds; the best place of each."""
        numbers = self.numbered(text)
        found = []
        for i, spans in self.windows(numbers).items():
            item = self.items[i]
            least, best = least_score(len(item)), (0, 0, 0, 0)
            for a, b in spans:
                there = set(numbers[a:b].tolist())
                if sum(map(there.__contains__, item.tolist())) >= least:  # no alignment scores more than the words in common
                    best = max(best, (*smith_waterman(item, numbers[a:b]), a), key=lambda x: x[0])
            score, first, end, a = best
            if score >= least:
                found.append((i, score / len(item), a + first, a + end))
        for size, items in self.short.items():
            keys, first = np.unique(self.runs(numbers, size), return_index=True)
            found += [(i, 1.0, int(at), int(at) + size) for key, at in zip(keys.tolist(), first, strict=True) for i in items.get(key, ())]
        return found


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two number arrays; (score, first, end) in ``text``. Match +1, mismatch and gap -1.

    A row of the table at a time: what comes from the left is a running maximum of value plus position.
    """
    n = len(text)
    at = np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for number in item:
        step = np.where((text == number) & (text >= 0), 1, -1)
        diagonal, up = score[:-1] + step, score[1:] - 1
        value = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        origin = np.concatenate([[0], np.where(value[1:] == 0, at[1:], np.where(diagonal >= up, start[:-1], start[1:]))])
        raised = value + at
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, at, 0))
        score, start = top - at, origin[source]
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
    return best


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items in blocks of about BLOCK_WORDS words; the driver holds one block at a time."""
    rows, total = [], 0
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    for row in items.toLocalIterator():
        words = words_of(row.text)
        if not words:
            continue
        rows.append((row.item_id, words))
        total += len(words)
        if total >= BLOCK_WORDS:
            yield _block(rows)
            rows, total = [], 0
    if rows:
        yield _block(rows)


def _block(rows: list[tuple]) -> Block:
    numbers = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in rows for w in words))}
    if len(numbers) ** SEED >= 2**63:
        raise ValueError("too many different words in one block")
    return Block([i for i, _ in rows], [np.array([numbers[w] for w in words]) for _, words in rows], numbers)


def planted(docs: DataFrame, benchmark: DataFrame) -> Iterator[Block]:
    """The blocks with their seeds, chosen by the counts of their words over all documents; each is made when the one before is done with."""
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            block = shared.value
            counts, total = np.zeros(len(block.numbers), np.int64), 0
            for batch in batches:
                for text in batch.column("text"):
                    numbers = block.numbered(text.as_py() or "")
                    counts += np.bincount(numbers[numbers >= 0], minlength=len(counts))
                    total += len(numbers)
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))], names=["word", "n"])

        counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        n = {r.word: r.n for r in counted.collect()}  # a row for each word of the block
        shared.destroy()
        block.plant((np.array([n.get(k, 0) for k in range(len(block.numbers))]) + 0.5) / (n.get(-1, 0) + 1))
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) for each item that a document holds."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, score double, first_word long, end_word long"
    found, folder = spark.createDataFrame([], schema), None
    arrow, names = to_arrow_schema(found.schema), found.columns
    for block in planted(docs, benchmark):
        shared, folder = spark.sparkContext.broadcast(block), folder or shared_folder(spark)

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
                rows = [(ids[k], block.ids[i], score, first, end) for k, t in enumerate(texts) for i, score, first, end in block.matches(t)]
                made = pa.table({n: [r[j] for r in rows] for j, n in enumerate(names)}, schema=arrow)
                yield from made.to_batches()

        docs.select("doc_id", "text").mapInArrow(run, found.schema).write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.schema(found.schema).parquet(folder) if folder else found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; nothing is shuffled. With several blocks, what is left after each but the last is written and read again."""
    out, shared, path = docs, None, None
    for block in planted(docs, benchmark):
        if shared is not None:
            before, path = path, shared_folder(docs.sparkSession)
            out = through_parquet(out, path)
            shared.destroy()
            if before:
                remove(docs.sparkSession, before)
        shared, name = docs.sparkSession.sparkContext.broadcast(block), private_name(out, "held_items")
        make = lambda shared=shared: lambda texts: [[len(shared.value.matches(t)) for t in texts]]
        out = map_texts(out, "text", [pa.field(name, pa.int64())], make).filter(F.col(name) == 0).drop(name)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
