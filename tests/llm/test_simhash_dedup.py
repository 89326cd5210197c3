import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusloom.llm import common
from corpusloom.llm import op8_simhash_dedup as m
from corpusloom.llm.components import components, forest


def brute_fingerprint(text):
    import re

    lowered = re.sub("[A-Z]", lambda x: x[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (id, fingerprint); the smallest id reachable of each."""
    at = np.array([p for _, p in prints], np.uint64)
    i, j = np.nonzero(np.bitwise_count(at[:, None] ^ at[None, :]) <= 2)
    label = forest(len(prints), i, j)
    least = {}
    for (d, _), r in zip(prints, label):
        least[r] = min(least.get(r, d), d)
    return [least[r] for r in label]


def test_fingerprints(spark):
    texts = ["", "one", "One TWO", "a b c", "a\u00a0b c\x0bd\x0ce  f", "ÀÉ Straße\n\tx y", "the the the the the", " ".join(map(str, range(500)))]
    got = [int(x) for x in m.fingerprint_texts(texts)]
    assert got == [brute_fingerprint(t) for t in texts] and got[0] == 0


def test_query_on_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    want = {d: (f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in m.op8_simhash_dedup(spark, small).collect()} == want


def cloud(rng, n):
    """Chains and clouds of near words, and words that only share blocks."""
    out = []
    while len(out) < n:
        word = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(word)
            word ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
    return out[:n]


def grouped(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    by = {}
    for x in parent:
        by.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, (s for s in by.values() if len(s) > 1)))


@pytest.mark.parametrize("cell", [300_000, 5])
def test_links_for_small_and_hot_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(m, "CELL", cell)
    rng = random.Random(8)
    low = [x & ~((1 << 22) - 1) for x in cloud(rng, 150)]  # all share a block
    words = sorted({*cloud(rng, 150), *low, *(1 << b for b in range(64)), 0, 2**64 - 1})
    signed = [w - 2**64 if w >= 2**63 else w for w in words]
    df = spark.createDataFrame([(w,) for w in signed], "fp long")
    want = grouped((a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    for tile in (8_192, 40, 7):
        assert grouped((r.a, r.b) for r in m.links(df, 2, tile).collect()) == want


def test_link_labels_dense_and_split():
    rng = random.Random(3)
    for n, split in ((700, None), (700, 300), (40, 39)):
        fps = np.array([sum(1 << b for b in rng.sample(range(9), rng.randint(0, 9))) for _ in range(n)], np.uint64)
        fps = np.unique(fps)
        rng.shuffle(fps)
        split = None if split is None else min(split, len(fps) - 1)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
        if split is not None:
            side = np.arange(len(fps)) >= split
            near &= side[:, None] != side[None, :]
        assert (m.link_labels(fps, 2, split) == forest(len(fps), *np.nonzero(near))).all()


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (7, 300)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {300: 0} | {k: 100 for k in range(100, 160)} | {200: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark, odd, folder):
    got = m.op8_simhash_dedup(spark, folder(documents=odd)).collect()
    assert len(got) == 9 and {r.component_id for r in got if r.doc_id in (2, 3)} == {2}
    kept = m.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()).count("1") == 1
    assert m.drop_copies(odd.limit(0)).count() == 0


def test_joins_of_hot_keys_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    test_components_of_paths_stars_and_loops(spark)
    test_drop_copies_goes_by_component_not_by_id(spark)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 7, k) for k in range(90)], "key int, v int")
    lookup = rows.groupBy("key").count().selectExpr("key", "key * 10 AS w", "count AS n")
    got = common.join_skewed(rows, lookup, "key", "n", 90)
    assert got.columns == ["key", "v", "w"] and sorted(map(tuple, got.collect())) == sorted((r.key, r.v, 10 * r.key) for r in rows.collect())


def test_drop_copies_keeps_different_texts_of_null_and_repeated_ids(spark):
    texts = ["".join(f"{w}{k} " for k in range(60)) for w in "abcd"]
    docs = spark.createDataFrame(list(zip((None, None, 5, 5), texts, "wxyz")), "doc_id long, text string, _kept_id string").withColumn("_gone_id", F.lit(1))
    kept = m.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == texts


def test_drop_copies_broadcasts_nothing_unbounded(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = m.drop_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_drop_copies_keeps_one_of_each(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r.doc_id: r.component_id for r in m.near_duplicates(docs).collect()}
    assert {r.doc_id for r in m.drop_copies(docs).collect()} == {d for d, c in found.items() if d == c}


def test_drop_copies_goes_by_component_not_by_id(spark):
    a, b, c, x, y, z = ("".join(f"{w}{k} " for k in range(60)) for w in "abcxyz")
    rows = [(None, a), (None, a), (None, b), (None, c), (1, c), (6, x), (6, y), (2, x), (7, z), (7, z), (8, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len({int(f) for f in m.fingerprint_texts([a, b, c, x, y, z])}) == 6
    want = [(None, a), (None, b), (1, c), (6, y), (2, x), (7, z), (8, None)]
    assert sorted(map(tuple, m.drop_copies(docs).collect()), key=str) == sorted(want, key=str)
    unique = docs.dropDuplicates(["doc_id", "text"])
    assert sorted(map(tuple, m.drop_copies(unique).collect()), key=str) == sorted(want, key=str)
