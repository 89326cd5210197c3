import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from corpusloom.llm import op1_fingerprints as m
from corpusloom.llm.bits import bit_sums, mix, packed

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_bit_sums_equals_counting():
    rng = np.random.default_rng(1)
    for sizes in ([0, 3, 0, 40_000, 0], [1], [0], [], [33_000, 33_000]):
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        h = rng.integers(0, 2**63, int(starts[-1]), dtype=np.uint64) * np.uint64(2)
        w = rng.integers(1, 16, len(h)).astype(np.uint64)
        bits = (h[:, None] >> np.arange(63, -1, -1, dtype=np.uint64)) & np.uint64(1)
        for weights in (None, w):
            full = bits.astype(np.int64) * (1 if weights is None else w[:, None].astype(np.int64))
            want = np.array([full[a:b].sum(axis=0) for a, b in zip(starts, starts[1:])]).reshape(-1, 64)
            assert (bit_sums(h, weights, starts) == want).all()


def test_packed_is_big_endian():
    assert packed(np.array([[1] + [0] * 63, [0] * 63 + [1]], bool)).tolist() == [1 << 63, 1]


def naive(text, bits=m.BITS):
    """The same votes, one term at a time."""
    words, cache = text.lower().split(), m._Words()
    terms = [cache[w] for w in words]
    out = []
    for k in range(bits // 64):
        votes = [0] * 64
        for before, term in zip([0, *terms], terms):
            weight = min((term & 15) + (before & 15), 15)
            value = (int(mix(np.array([term], np.uint64))[0]) + before * 0x9E3779B97F4A7C15 + k) % 2**64
            value = int(mix(np.array([value], np.uint64))[0])
            for b in range(64):
                votes[b] += weight if value >> (63 - b) & 1 else -weight
        out.append(sum(1 << (63 - b) for b in range(64) if votes[b] > 0))
    return "".join(f"{x:016x}" for x in out)


def test_fingerprint_equals_naive():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "The", "longer", "word", "ÉTÉ", "notwithstanding"], k=rng.randint(0, 30))) for _ in range(25)]
    together = m.as_hex(m.fingerprint_words(texts, m._Words()))
    assert together == [naive(t) for t in texts]
    assert together == [m.as_hex(m.fingerprint_words([t], m._Words()))[0] for t in texts]


def check(spark, sf, rows):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in m.op1_fingerprints(spark, sf).collect()), key=str)
    want = []
    for (i, text), (_, then) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        new = text[: len(text) - cut] + then[:cut]
        a, b, c = (m.fingerprint_words([t], m._Words()) for t in (text, new, then))
        want.append((i, len(text), sha256(new.encode()).hexdigest(), m.as_hex(a)[0], m.as_hex(b)[0], float(m.likeness(a, b)[0]), float(m.likeness(a, c)[0])))
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want, key=str)]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in sorted(want, key=str)])


def test_query_on_documents(spark, small):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    check(spark, small, rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_documents(spark, folder, n):
    rows = [(7 - k, f"text number {k} with some words") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, folder(documents=df), rows)


def test_odd_documents(spark, odd, folder):
    got = m.op1_fingerprints(spark, folder(documents=odd)).collect()
    assert len(got) == 9
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[2, 0].fingerprint == by[3, 0].fingerprint == "0" * 32
    assert by[4, 38 * 40_000].near_edited > 0.9
    again = m.fingerprint(odd, "text")
    assert again.columns == [c for c in odd.columns if c != "fingerprint"] + ["fingerprint"]
    assert {r.fingerprint for r in again.filter("doc_id = 1").collect()} == {by[1, 41].fingerprint}


def test_edits_are_near_and_others_are_not(spark, small):
    rows = m.op1_fingerprints(spark, small).collect()
    long = [r for r in rows if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98
    assert np.median([r.near_edited for r in long]) > 0.55 and np.median([r.near_next for r in long]) < 0.2


@pytest.mark.parametrize("front", [1, 2])
def test_within_radius_equals_brute_force(spark, front):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(12)] + [2**128 - 1, 0, 1 << 127]
    prints = [b ^ sum(1 << x for x in rng.sample(range(128), rng.randint(0, 6))) for b in base for _ in range(8)] + base[:3]
    df = spark.createDataFrame([(k, f"{p:032x}") for k, p in enumerate(prints)], "doc_id long, fingerprint string")
    queries = df.filter("doc_id % 5 = 0")
    for radius in (0, 1, 3):
        got = sorted(map(tuple, m.within_radius(queries, df, radius, front=front).collect()))
        want = {(f"{q:032x}", f"{d:032x}", (q ^ d).bit_count()) for q in prints[::5] for d in prints if (q ^ d).bit_count() <= radius}
        assert got == sorted(want)


def test_copies_give_no_pairs(spark):
    df = spark.createDataFrame([("0" * 32,)] * 3_000 + [("0" * 31 + "1",)] * 3_000, "fingerprint string")
    assert m.within_radius(df, df, 3).count() == 4


def test_table_masks_cover_the_bits():
    for radius in range(6):
        for front in (1, 2):
            heads = [sum((w % 2**64) << (64 * (1 - k)) for k, w in enumerate(mask)) for mask in m.table_masks(radius, 128, front)]
            union = 0
            for head in heads:
                union |= head
            assert union == 2**128 - 1 and len(set(heads)) == len(heads)


def test_search_columns_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(m, "QUERY_EVERY", 3)
    rows = m.op1_fingerprints(spark, small).collect()
    by = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows:
        assert r.class_id == min(d for d, p in by.items() if p == by[r.doc_id])
        assert r.n_within == (None if r.doc_id % 3 else sum((p ^ by[r.doc_id]).bit_count() <= 3 for p in by.values()) - 1)
    assert sum(r.n_within or 0 for r in rows) > 0 and len({r.class_id for r in rows}) < len(rows)


@pytest.mark.parametrize("range_bytes", [400, 1 << 20])
def test_rows_of_one_id_are_split(spark, range_bytes):
    """A third of the rows under a null id, a third under one id: each row is followed by the next of the whole order."""
    rng = random.Random(9)
    rows = [(rng.choice([None, 7, k]), f"text {rng.randint(0, 500)} " + "w " * rng.randint(0, 30)) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = m.with_next(df, range_bytes)
    parts = dealt.selectExpr("*", "spark_partition_id() AS p", "monotonically_increasing_id() AS at").collect()
    h = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), h[r[1]]))
    seen, follows = sorted(parts, key=lambda r: r.at), []
    for a, b in zip(seen, seen[1:]):
        if not a.copy:
            assert a.p == b.p
            follows.append(((a.doc_id, a.text), b.text))
    assert sorted(follows, key=str) == sorted(((a, b[1]) for a, b in zip(order, order[1:] + order[:1])), key=str)
    assert max(Counter(r.p for r in parts).values()) < 120
