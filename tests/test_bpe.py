"""Training, encoding, decoding, specials and artefacts."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import encode, specials, train
from corpusloom.operators.vocabulary import Vocabulary, base_vocabulary, from_triples, rank_lookup
from corpusloom.plans import catalog
from corpusloom.sources import artefacts

TRICKY = [
    "hello world", "they're 2024", "IT'S", "a\n\nb", "   hello  world", "2024/01/15", "a b", "hello世界", "hi😀there", "   \n  ", "", "aaa", "aaaa", "abc", "a!b", "x�y",
]


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


@pytest.mark.parametrize(
    ("corpus", "target", "merges"),
    [
        (["aaa"], 300, [(97, 97), (256, 97)]),
        (["a\nb"], 300, []),
        (["ab", "cd"], 257, [(97, 98)]),
        (["ab", "cd"], 258, [(97, 98), (99, 100)]),
        (["aaa", "b"], 300, [(97, 97), (256, 97)]),
    ],
)
def test_train_cases(spark, corpus, target, merges):
    words = train.word_counts(lines(spark, *corpus))
    assert train.train_words(words, target).merges == merges
    assert train.train_distributed(words.filter(F.length("tok") > 1), target).merges == merges


def test_target_too_small(spark):
    with pytest.raises(ValueError):
        train.train(lines(spark, "a"), 255)


def brute_train(words, target):
    made, words = Vocabulary(), [(list(map(ord, w)), n) for w, n in words]
    while len(made) < target:
        counts = {}
        for w, n in words:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + n
        if not counts:
            break
        pair = min(counts, key=lambda p: (-counts[p], p))
        new, out = made.add_merge(*pair), []
        for w, n in words:
            x, i = [], 0
            while i < len(w):
                if tuple(w[i : i + 2]) == pair:
                    x.append(new)
                    i += 2
                else:
                    x.append(w[i])
                    i += 1
            out.append((x, n))
        words = out
    return made.merges


def test_incremental_trainer_equals_recounting():
    rng = random.Random(4)
    for _ in range(60):
        words = {"".join(rng.choices("abc", k=rng.randint(2, 9))): rng.randint(1, 4) for _ in range(rng.randint(1, 12))}
        assert train.train_locally(list(words.items()), 256 + 14).merges == brute_train(list(words.items()), 256 + 14)


@pytest.mark.parametrize("most", [2, 5, 4096])
def test_settled_merges_equal_recounting(most):
    """Rounds of settled merges, in plain Python, against one merge a count; a list cut short settles less, not otherwise."""
    rng, rounds, merges = random.Random(most), 0, 0
    for _ in range(200):
        words = {"".join(rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(2, 9))): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        made, now = Vocabulary(), dict(words)
        while len(made) < 256 + 14:
            counts = {}
            for w, n in now.items():
                for p in map("".join, zip(w, w[1:])):
                    counts[p] = counts.get(p, 0) + n
            top = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:most]
            if not top:
                break
            rounds += 1
            for pair in train.settled(top, len(top) < most)[: 256 + 14 - len(made)]:
                token = chr(made.add_merge(*map(ord, pair)))
                now = {w.replace(pair, token): n for w, n in now.items()}
        merges += len(made.merges)
        assert made.merges == brute_train(list(words.items()), 256 + 14)
    assert rounds < merges or most == 2  # of two, cut short, only the first is settled


def test_settled_stops_at_what_a_merge_touches():
    assert train.settled([("ab", 9), ("cd", 8), ("xa", 7), ("ef", 7), ("gh", 6)], True) == ["ab", "cd"]
    assert train.settled([("ab", 9), ("cd", 8), ("ef", 7)], True) == ["ab", "cd", "ef"]
    assert train.settled([("ab", 9), ("cd", 8), ("ef", 7)], False) == ["ab", "cd"]
    assert train.settled([("aa", 9), ("cd", 8)], True) == ["aa"]
    assert train.settled([], True) == []


def test_distributed_trainer_equals_local(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20).select(F.col("text").alias("line"))
    words = train.word_counts(docs)
    want = train.train_words(words, 256 + 30).merges
    assert train.train_distributed(words, 256 + 30).merges == want
    assert train.train_distributed(words, 256 + 6, top_pairs=3).merges == want[:6]


def test_distributed_query_goes_beyond_its_cut(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(20).write.parquet(f"file://{tmp_path}/documents.parquet")
    words = train.word_counts(spark.read.parquet(f"file://{tmp_path}/documents.parquet").select(F.col("text").alias("line")))
    rows = catalog.queries()["merges_24_distributed"](spark, f"file://{tmp_path}").collect()
    assert len(rows) > train.CUT_EVERY and "merges_24_distributed" in catalog.oracle_sql()
    assert [(r.a, r.b) for r in rows] == train.train_words(words, 256 + len(rows)).merges


def test_pair_counts_overlap(spark):
    words = spark.createDataFrame([("aaa", 2), ("b", 5), ("", 1)], "tok string, count long")
    assert [tuple(r) for r in train.pair_counts(words).collect()] == [("aa", 4)]
    assert [tuple(r) for r in train.pair_counts(words, None).collect()] == [("aa", 2)]


VOCABULARIES = {"aaa": ["aaa"], "abcd": ["ab", "cd"], "mixed": ["hello world", "abc"]}


@pytest.fixture(scope="module")
def trained(spark):
    return {k: train.train(lines(spark, *c), 300) for k, c in VOCABULARIES.items()}


@pytest.mark.parametrize(
    ("corpus", "text", "ids"),
    [
        (["aaa"], "aaa", [257]), (["aaa"], "aa", [256]), (["aaa"], "a", [97]), (["aaa"], "aaaa", [256, 256]), (["abc"], "abc", [257]), (["abc"], "ab", [256]),
        (["abc"], "bc", [98, 99]), (["ab"], "ab", [256]), (["ab"], "a\nb", [97, 10, 98]), (["ab"], "", []),
    ],
)
def test_encodings(spark, corpus, text, ids):
    v = train.train(lines(spark, *corpus), 300)
    df = spark.createDataFrame([(text,)], "t string")
    for f in (encode.encode_native, encode.encode_arrow):
        row = df.select(encode.ids(f(F.col("t"), v)).alias("i")).select("i", encode.decode(F.col("i"), v).alias("b")).first()
        assert list(row.i) == ids and bytes(row.b) == text.encode()


def test_all_encoders_agree_and_round_trip(spark, trained):
    df = spark.createDataFrame(list(enumerate([*TRICKY, None])), "k int, t string")
    for v in trained.values():
        native = {r.k: r.tok for r in df.select("k", encode.encode_native(F.col("t"), v).alias("tok")).collect()}
        arrow = {r.k: r.tok for r in df.select("k", encode.encode_arrow(F.col("t"), v).alias("tok")).collect()}
        dictionary = {r.k: r.tok for r in encode.encode_dictionary(df, ["k"], "t", v).collect()}
        assert native == arrow == dictionary
        back = df.select("t", F.decode(encode.decode(encode.ids(encode.encode_native(F.col("t"), v)), v), "UTF-8").alias("b")).collect()
        assert all(r.t == r.b for r in back)


def test_native_fold_is_lowest_rank_first():
    rng = random.Random(9)
    for _ in range(200):
        v = Vocabulary()
        for _ in range(rng.randint(1, 12)):
            v.add_merge(*(rng.choice([97, 98, 99, *range(256, len(v))]) for _ in range(2)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 15)))
        ranks = {p: 256 + k for k, p in enumerate(v.merges)}
        folded = text
        for pair, token in v.merge_strings():
            folded = folded.replace(pair, token)
        assert [ord(c) for c in folded] == encode.encode_chunk(text.encode(), ranks)


@pytest.mark.parametrize("side", [4_096, 0])
def test_words_merged_together_equal_words_merged_alone(monkeypatch, side):
    monkeypatch.setattr(encode.PairTable, "SIDE", side)
    rng = random.Random(4)
    for _ in range(40):
        merges = []
        while len(merges) < 60:
            pair = tuple(rng.choice([97, 98, 99, 0xC3, 0xA9, *range(256, 256 + len(merges))]) for _ in range(2))
            if pair not in merges:
                merges.append(pair)
        ranks = {pair: 256 + k for k, pair in enumerate(merges)}
        words = ["".join(rng.choices("abcé", k=rng.choice([1, 2, 3, 7, 30, 200]))) for _ in range(rng.randint(0, 50))] + ["a" * 101, "ab" * 50, "", "z"]
        want = ["".join(map(chr, encode.encode_chunk(w.encode(), ranks))) for w in words]
        table = encode.PairTable(merges)
        assert encode.encode_strings(pa.array(words, pa.string()), table).to_pylist() == want
        assert encode.encode_strings(pa.array(["x", *words], pa.string())[1:], table).to_pylist() == want
        lists = pa.array([words, None, [], words[::-1]], pa.list_(pa.string()))
        assert encode.encode_chunk_lists(lists, table).to_pylist() == ["".join(want), None, "", "".join(want[::-1])]
    assert encode.encode_strings(pa.array([], pa.string()), encode.PairTable([])).to_pylist() == []


def test_one_long_run_does_not_stall():
    merges = [(97, 97), *((256 + k, 256 + k) for k in range(12))]
    began = time.perf_counter()
    assert len(encode.encode_strings(pa.array(["a" * 2_000_000]), encode.PairTable(merges))[0].as_py()) <= 2_000_000 // 4_096
    assert time.perf_counter() - began < 10


def test_decode_out_of_range(spark, trained):
    for bad in (99999, -1, 258):
        with pytest.raises(Exception, match="out of range"):
            spark.sql(f"SELECT array({bad}) i").select(encode.decode(F.col("i"), trained["aaa"])).collect()


def test_vocabulary(spark, trained):
    base, v = Vocabulary(), trained["aaa"]
    assert len(v) == 258 and v.display_of(0) == "<0x00>" and v.display_of(0x41) == "<0x41>" and v.display_of(257) == "aaa"
    with pytest.raises(IndexError):
        base.bytes_of(256)
    with pytest.raises(KeyError):
        base.id_of(b"ab")
    assert base.id_of_pair(97, 97) == -1 and not base.contains(b"ab") and v.contains(b"aa") and v.id_of(b"aa") == 256
    assert v.add_merge(97, 97) == 256
    with pytest.raises(IndexError):
        v.add_merge(0, 9999)
    pairs = spark.createDataFrame([(97, 97), (256, 97), (97, 98), (0, 1), (-1, 97), (9999, 0), (0, 9999)], "a int, b int")
    assert {(r.a, r.b): r["rank"] for r in rank_lookup(pairs, v).collect()} == {
        (97, 97): 256, (256, 97): 257, (97, 98): -1, (0, 1): -1, (-1, 97): -1, (9999, 0): -1, (0, 9999): -1
    }
    assert [bytes(r.bytes) for r in base_vocabulary(spark).orderBy("id").collect()] == [bytes([b]) for b in range(256)]
    assert {r.id: r.display for r in v.tokens(spark).collect()} == {k: v.display_of(k) for k in range(258)}


def test_specials(spark, trained):
    v = trained["aaa"]
    one = lambda t, *c: spark.createDataFrame([(t,)], "t string").select(*c).first()
    t = F.col("t")
    assert tuple(one("<|im_start|>", specials.match_at(t, F.lit(0)), specials.id_at(t, F.lit(0)))) == (12, 0)
    assert tuple(one("<|endoftext|>", specials.match_at(t, F.lit(0)), specials.id_at(t, F.lit(0)))) == (13, 2)
    assert tuple(one("<|pad|>", specials.match_at(t, F.lit(0)), specials.id_at(t, F.lit(0)))) == (7, 3)
    assert tuple(one("<|im_ x", specials.match_at(t, F.lit(0)), specials.find_first(t))) == (-1, -1)
    assert one("ab<|im_end|>cd", specials.find_first(t))[0] == 2 and one("<|pad|><|pad|>", specials.find_first(t, 1))[0] == 7
    assert [tuple(p) for p in one("a<|pad|>b", specials.pieces(t))[0]] == [("a", False, -1), ("<|pad|>", True, 3), ("b", False, -1)]
    tok = specials.encode_with_specials(t, v, True)
    ids = list(one("<|im_start|>hello", encode.ids(tok))[0])
    assert len(ids) == 6 and ids[0] == 258
    assert bytes(one("<|im_start|>hello", encode.decode(encode.ids(tok), v, specials=True))[0]) == b"<|im_start|>hello"
    assert bytes(spark.sql("SELECT array(260) i").select(encode.decode(F.col("i"), v, specials=True)).first()[0]) == b"<|endoftext|>"
    with pytest.raises(Exception, match="not allowed"):
        one("<|pad|>", specials.encode_with_specials(t, v, False))
    with pytest.raises(ValueError):
        specials.alternation(())
    with pytest.raises(ValueError):
        specials.alternation(("",))


def test_artefacts(spark, trained, tmp_path):
    for v in trained.values():
        folder = f"file://{tmp_path}/{len(v)}"
        artefacts.save(spark, v, folder)
        assert artefacts.load(spark, folder).merges == v.merges
        for version in (1, 2):
            assert artefacts.parse_vocabulary_binary(artefacts.vocabulary_binary(v, version)).merges == v.merges
        assert artefacts.parse_vocabulary_json(artefacts.vocabulary_json(v), strict=True)[255] == b"\xff"
    with pytest.raises(FileNotFoundError):
        artefacts.load(spark, f"file://{tmp_path}/none")


def test_artefact_errors(trained):
    v = trained["aaa"]
    data = artefacts.vocabulary_binary(v)
    for bad in (b"", b"X" * 40, data[:100], data[:1200], data[:-1]):
        with pytest.raises(ValueError):
            artefacts.parse_vocabulary_binary(bad)
    for bad in ("97 97 -> 257\n", "97 97 256\n", "97 97 -> 256\n97 97 -> 257\n", "97 300 -> 256\n"):
        with pytest.raises((ValueError, IndexError)):
            artefacts.parse_merges(bad)
    assert artefacts.parse_merges("# note\n\n97 97 -> 256\n").merges == [(97, 97)]
    text = artefacts.vocabulary_json(v)
    for bad in (text.replace('"id":257', '"id":256'), text.replace('"text":"aaa"', '"text":"aab"'), text.replace("\\u00ff", "\\u0100")):
        with pytest.raises(ValueError):
            artefacts.load_vocabulary(bad, artefacts.merges_text(v))
    with pytest.raises(ValueError):
        from_triples([(97, 97, 300)])
    with pytest.raises(ValueError):
        artefacts.vocabulary_binary(Vocabulary([(0, b) for b in range(256)] + [(1, b) for b in range(256)] + [(k, b) for k in range(2, 8) for b in range(256)]), 2)
