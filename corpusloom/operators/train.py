"""Byte-pair training: weighted pair counts, the most frequent pair, rewrite, repeat.

Spark does what grows with the corpus: splitting and counting distinct chunks. Their number decides how the merges are found. Up to
``driver_words`` of them, the driver updates pair counts incrementally; beyond, each round is a distributed aggregation over the words that gives all the merges
which its counts already settle (see ``settled``); lineage is cut after ``CUT_EVERY`` merges. Both give the same merges: most frequent first, the smallest (a, b) on a
tie; pairs that occur once count as well.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.clean import utf8_latin1
from corpusloom.functions.rules import BASE_SIZE, DEFAULT_RULESET
from corpusloom.functions.split import chunks
from corpusloom.operators.vocabulary import MAX_NATIVE, Vocabulary
from corpusloom.session import ensure_checkpoint_dir

DRIVER_WORDS, CUT_EVERY = 2_000_000, 20
#: Pairs that a round sends to the driver, and merges that it makes, at most; neither changes the merges, only the number of rounds.
TOP_PAIRS, ROUND_MERGES = 4_096, 64


def word_counts(lines: DataFrame, text: str = "line", ruleset: str = DEFAULT_RULESET) -> DataFrame:
    """(tok, count): distinct chunks as token strings of base ids, and how often each occurs."""
    rows = lines.select(F.explode(chunks(F.col(text), ruleset)).alias("chunk"))
    return rows.groupBy("chunk").agg(F.count("*").alias("count")).select(utf8_latin1(F.col("chunk")).alias("tok"), "count")


def adjacent_pairs(tok: Column) -> Column:
    """All neighbouring pairs of a token string, overlapping ones as well."""
    return F.when(F.length(tok) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(tok) - 1), lambda i: F.substring(tok, i, F.lit(2)))
    )


def pair_counts(words: DataFrame, weight: str | None = "count") -> DataFrame:
    """(pair, n): pairs of neighbouring ids, weighted by the words' counts or not at all."""
    weighted = F.sum("w") if weight else F.count("*")
    rows = words.select(F.col(weight).alias("w") if weight else F.lit(1).alias("w"), F.explode(adjacent_pairs(F.col("tok"))).alias("pair"))
    return rows.groupBy("pair").agg(weighted.alias("n"))


def best_pairs(pairs: DataFrame, most: int = 1) -> DataFrame:
    """The most frequent pairs; on a tie the smallest (a, b) first, which is the order of the strings."""
    return pairs.orderBy(F.desc("n"), "pair").limit(most)


def settled(top: list[tuple[str, int]], whole: bool, most: int = ROUND_MERGES) -> list[str]:
    """The next merges, in order, that counting again after each could not change.

    ``top`` has the most frequent pairs and their counts, best first; ``whole`` if there are no others. Merging (a, b) touches only places where a pair (x, a) or
    (b, y) was: what such a pair keeps, and any pair with the new id, counts at most as much as that pair did. So the next pair of the list stays the best one
    while it counts more than all pairs beside the merged ones, and more than what the list does not show.
    """
    ending: dict[str, int] = {}
    starting: dict[str, int] = {}
    for pair, n in top:  # best first, so that the first is the greatest
        starting.setdefault(pair[0], n)
        ending.setdefault(pair[1], n)
    found, bound = [], 0 if whole or not top else top[-1][1]
    for pair, n in top[:most]:
        if found and n <= bound:
            break
        found.append(pair)
        bound = max(bound, ending.get(pair[0], 0), starting.get(pair[1], 0))
    return found


def rewrite(words: DataFrame, pair: str, token: str) -> DataFrame:
    return words.withColumn("tok", F.replace("tok", F.lit(pair), F.lit(token)))


def train_words(words: DataFrame, target: int, driver_words: int = DRIVER_WORDS) -> Vocabulary:
    """Merges from (tok, count) until the vocabulary has ``target`` ids or no word has two."""
    if not BASE_SIZE <= target < MAX_NATIVE:
        raise ValueError(f"the vocabulary size must be from {BASE_SIZE} to {MAX_NATIVE - 1}")
    ensure_checkpoint_dir(words.sparkSession)
    several = words.select("tok", "count").filter(F.length("tok") > 1).checkpoint()  # the corpus is read once
    if several.count() <= driver_words:
        return train_locally([(r.tok, r["count"]) for r in several.collect()], target)
    return train_distributed(several, target)


def train(lines: DataFrame, target: int, text: str = "line", ruleset: str = DEFAULT_RULESET) -> Vocabulary:
    return train_words(word_counts(lines, text, ruleset), target)


def train_distributed(words: DataFrame, target: int, top_pairs: int = TOP_PAIRS) -> Vocabulary:
    """A round counts all pairs, sends the ``top_pairs`` best to the driver, and makes the merges that these settle, one at least."""
    ensure_checkpoint_dir(words.sparkSession)
    made, now, uncut = Vocabulary(), words.select("tok", "count").checkpoint(), 0
    while len(made) < target:
        top = [(r.pair, r.n) for r in best_pairs(pair_counts(now), top_pairs).collect()]
        if not top:
            break
        for pair in settled(top, len(top) < top_pairs)[: target - len(made)]:
            now, uncut = rewrite(now, pair, chr(made.add_merge(ord(pair[0]), ord(pair[1])))), uncut + 1
        now = now.filter(F.length("tok") > 1)
        if uncut >= CUT_EVERY:
            now, uncut = now.checkpoint(), 0
    return made


def train_locally(words: list[tuple[str, int]], target: int) -> Vocabulary:
    """Counts change only around the merged pair: each pair knows the words that may hold it, and a heap has every count that was ever current."""
    made = Vocabulary()
    ids, weight = [[ord(c) for c in tok] for tok, _ in words], [n for _, n in words]
    count: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, word in enumerate(ids):
        for pair in zip(word, word[1:], strict=False):
            count[pair] += weight[k]
            where[pair].add(k)
    heap = [(-n, *pair) for pair, n in count.items()]
    heapq.heapify(heap)
    while len(made) < target and heap:
        n, a, b = heapq.heappop(heap)
        if count.get((a, b), 0) != -n or n == 0:
            continue
        new = made.add_merge(a, b)
        changed: dict[tuple[int, int], int] = defaultdict(int)
        for k in where.pop((a, b)):
            old, word, at = ids[k], [], 0
            while at < len(old):
                if at + 1 < len(old) and old[at] == a and old[at + 1] == b:
                    word.append(new)
                    at += 2
                else:
                    word.append(old[at])
                    at += 1
            if len(word) == len(old):
                continue
            for pair in zip(old, old[1:], strict=False):
                changed[pair] -= weight[k]
            for pair in zip(word, word[1:], strict=False):
                changed[pair] += weight[k]
                where[pair].add(k)
            ids[k] = word
        for pair, by in changed.items():
            if by:
                count[pair] += by
                if count[pair] > 0:
                    heapq.heappush(heap, (-count[pair], *pair))
        count.pop((a, b), None)
    return made
