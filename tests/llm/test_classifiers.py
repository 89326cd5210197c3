import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import learning, op2_language, op4_quality, op10_toxicity
from corpusloom.llm.common import fold_of
from corpusloom.llm.statistics import STATISTICS, class_counts, statistics

SF = "sf0.01"


@pytest.fixture(scope="session")
def mid(small):
    return small.replace("sf0.001", SF)


def test_fold(spark):
    df = spark.createDataFrame([(k,) for k in (0, 7, 123456789, -5)], "d long")
    assert {r.d: r.f for r in df.select("d", fold_of(F.col("d"), 4).alias("f")).collect()} == {k: zlib.crc32(str(k).encode()) % 4 for k in (0, 7, 123456789, -5)}


def test_sample_is_bounded_and_deduplicated(spark):
    docs = spark.createDataFrame([(k, f"text {min(k, 150)}") for k in range(1_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1_000)] * 2 + [(None, 1), (5, None)], "doc_id long, label int")
    s = learning.labelled_sample(docs, labels, 40)
    rows = s.rows.collect()
    assert len({(r.text, r.label) for r in rows}) == len(rows) <= 80 and {r.label for r in rows} == {0, 1}
    assert len(rows) >= 4 and all(r.doc_id % 2 == r.label for r in rows)
    everything = learning.labelled_sample(docs.limit(150), labels.filter("doc_id < 150"), 500).rows
    assert everything.count() == 150


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(0)
    s = rng.random(500)
    y = (rng.random(500) < s).astype(float)
    at, value = learning.isotonic(s, y, np.ones(500))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()
    assert abs(np.interp(s, at, value) - s).mean() < 0.1


def test_boost_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    start, trees = learning.boost(x, y, np.ones(800), 60, 3, 0.3, 1, columns_share=1.0)
    assert (((start + sum(t.predict(x) for t in trees)) > 0) == y).mean() > 0.95


def test_lasso_drops_noise():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (600, 10)).astype(float)
    y = x[:, 3]
    beta = op4_quality.lasso_logistic(x, y, np.ones(600), 0.02)
    assert beta[4] > 1 and np.abs(np.delete(beta[1:], 3)).max() < 0.05


def test_statistics_of_known_texts():
    x = statistics(["", "AB cd! cd\ncd ||", "   "])
    by = dict(zip(STATISTICS, x[1]))
    assert (x[0] == 0).all() or dict(zip(STATISTICS, x[0]))["letters"] == 0
    assert np.isfinite(x).all()
    assert by["capitals"] == 2 / 8 and by["bars"] == 2 / 5 and by["exclamations"] == 1 / 5 and by["repeated_next"] == 1 / 4
    assert class_counts(["a1 A!"]).tolist() == [[2, 1, 1, 1, 0, 1, 0, 0]]


def test_statistics_do_not_depend_on_the_batch():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab AB1!|\n", k=rng.randint(0, 60))) for _ in range(40)]
    assert np.array_equal(statistics(texts), np.concatenate([statistics([t]) for t in texts]))


def test_rules_compiled_equal_rules_evaluated(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.6)).astype(float)
    model = op4_quality.fit(x, y, np.ones(300))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k int, s array<double>")
    got = [r.p for r in df.select("k", model.column(F.col("s")).alias("p")).orderBy("k").collect()]
    assert np.allclose(got, model.scores(x)) and ((model.scores(x) > 0.5) == y).mean() > 0.95 and model.text()


def test_subword_logits_do_not_depend_on_the_batch():
    rng = random.Random(2)
    rows = np.random.default_rng(4).normal(size=(op2_language.BUCKETS, 3)).astype(np.float32)
    texts = ["".join(rng.choices("abcé dE1.\n", k=rng.randint(0, 50))) for _ in range(50)] + ["", "x", "été"]
    sums, n = op2_language.logits(texts, rows)
    for k, t in enumerate(texts):
        c = op2_language.bucket_counts(t)
        assert c.sum() == n[k] and np.allclose(c @ rows, sums[k], atol=1e-3)
    long = "some words here " * 60_000  # more than a chunk
    assert np.allclose(op2_language.logits([long], rows)[0][0], op2_language.bucket_counts(long) @ rows, rtol=1e-3)


def test_language_held_out(spark, mid):
    docs = spark.read.parquet(f"{mid}/documents.parquet")
    got = op2_language.op2_language_id(spark, mid).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and np.mean([r.lang_pred == r.lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


def test_language_rejects_junk_and_strangers_and_keeps_mixtures(spark, mid):
    docs = spark.read.parquet(f"{mid}/documents.parquet")
    model = op2_language.train(docs, op2_language.training_labels(docs), strange=True)
    assert 0 < model.threshold < 1 and model.rejects["shuffled"] > 0.95 and model.rejects["foreign"] > 0.9
    by = {r.lang: r.text for r in docs.filter("length(text) > 400 AND length(text) < 900").collect()}
    texts = {**by, "mixed": f"{by['en']} {by['fr']}", "junk": op2_language.shuffled(by["en"]), "cyrillic": "Это русский текст для проверки. " * 5, "digits": "12 34", "none": None}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r.doc_id for r in op2_language.keep_languages(df, model).collect()} == {*by, "mixed"}


def test_predictions_equal_the_definition(spark, mid):
    """Subword by subword: the mean of their embeddings' logits, the softmax, the best language."""
    docs = spark.read.parquet(f"{mid}/documents.parquet").limit(60)
    model = op2_language.train(docs, docs.select("doc_id", F.col("lang").alias("label")))
    texts = [r.text for r in docs.collect()][:12] + ["é", "a b", ""]

    def bucket(window):
        h = len(window)
        for c in window:
            h = (h ^ (ord(c) if c.isalpha() else 32)) * 0x01000193 % 2**32
            h ^= h >> 15
        return (h * 2654435761) % 2**32 >> (32 - op2_language.BITS)

    for text, lang, score in zip(texts, *model.predict(texts)):
        marked = f" {text.lower()}\n"
        windows = [marked[i : i + k] for k in op2_language.SIZES for i in range(len(marked) - k + 1)]
        inner = [w for w in windows if all(c.isalpha() for c in w[1:-1]) and (len(w) > 2 or w[0].isalpha() or w[-1].isalpha())]
        if not inner:
            assert (lang, score) == ("und", 0)
            continue
        z = (np.mean([model.rows[bucket(w)].astype(float) for w in inner], axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p[:-1].argmax())
        assert lang == model.languages[best] and abs(score - p[best]) < 1e-4


def test_quality_held_out(spark, mid):
    labels = spark.read.parquet(f"{mid}/labels.parquet")
    got = op4_quality.op4_quality(spark, mid).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_toxicity_held_out(spark, mid):
    labels = spark.read.parquet(f"{mid}/labels.parquet")
    got = op10_toxicity.op10_toxicity(spark, mid).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.93
    assert sum(r.predicted and not r.toxic for r in got) <= 1


def test_obfuscated_words_are_read():
    tokens = op10_toxicity._Tokens({"idiot": 5.0})
    assert tokens["1d10t"] & op10_toxicity.READ and tokens["i.d.i.o.t"] & op10_toxicity.READ and tokens["IDIOT!!"] & op10_toxicity.WORD
    assert not tokens["table"] and tokens["you"] & op10_toxicity.SECOND
    near = dict(zip(op10_toxicity.FEATURES, op10_toxicity.features(["you are an idiot " + "x " * 50], {"idiot": 5.0})[0]))
    assert near["near_second_person"] > 0 and near["word_share"] > 0


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_documents(spark, odd, folder, labelled):
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(7)] if labelled else [], "doc_id long, quality int, toxic int")
    sf = folder(documents=odd, labels=labels)
    for query in (op2_language.op2_language_id, op4_quality.op4_quality, op10_toxicity.op10_toxicity):
        got = query(spark, sf).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    languages = {(r.doc_id, r.lang_pred) for r in op2_language.op2_language_id(spark, sf).collect()}
    assert (2, "und") in languages and (3, "und") in languages and (5, "und") in languages and (4, "en") in languages


def test_filters_keep_columns(spark, odd, folder):
    model = op2_language.train(odd, op2_language.training_labels(odd))
    kept = op2_language.keep_languages(odd, model)
    assert kept.columns == odd.columns and {2, 3, 5}.isdisjoint(r.doc_id for r in kept.collect())
    good = op4_quality.keep_good(odd, op4_quality.RuleModel(3.0, [(((0, False, 0.5),), -9.0)]))
    assert good.columns == odd.columns and {r.doc_id for r in good.collect()} == {1, 4, None, 5, 6}


def test_empty_tables(spark, odd, folder):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = folder(documents=odd.limit(0), labels=labels)
    for query in (op2_language.op2_language_id, op4_quality.op4_quality, op10_toxicity.op10_toxicity):
        assert query(spark, sf).count() == 0
