"""Language identification by averaged embeddings of hashed subwords with a linear softmax.

A subword is a run of SIZES letters of a lower-cased word, its ends marked by what is not a letter; it is hashed to
one of BUCKETS embeddings. The mean embedding of a text goes through a linear softmax. Embeddings and weights are learned by stochastic
gradient descent in numpy from SAMPLE_PER_LANGUAGE texts of each language at most (see ``labelled_sample``), each also as a short piece, so that
short texts are told apart as well. The softmax has one class more than there are languages, for what is none: it learns from pieces of the same texts with
their letters shuffled (JUNK characters, as shuffled letters fill nearly every bucket and the driver holds them). It is never predicted, but takes its share of the score.

A fifth of the texts is left out to fit the temperature of the softmax and the rejection threshold, the score that all but REJECTED of what must be kept
reach: left-out texts that are told right, and texts of two languages (halves of two left-out ones joined), which are no junk. So the threshold follows the scores
and has no bound set by hand. ``LanguageModel.rejects`` tells which share of the left-out shuffled texts lies below it and, where a second model is learned without
the last language (``strange``), which share of its texts that one rejects.

Since the layers are linear, a bucket's embedding times the weights is one row of logits: prediction gathers and sums rows.

Cases: null texts, and those without letters, are ``und`` with score 0. Repeated rows each give a row. Without any labelled text
everything is ``und``. An empty table gives no rows. Extra columns are ignored in the query; ``keep_languages`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import CHUNK, joined, sums_by_text, table_of
from corpusloom.llm.common import fold_of, map_texts, private_name, table
from corpusloom.llm.learning import labelled_sample, sample_order

SIZES, BITS, WIDTH = (2, 3, 4), 13, 16
BUCKETS = 1 << BITS
SAMPLE_PER_LANGUAGE = 800
PIECE, JUNK = 48, 150
EPOCHS, BATCH, RATE = 12, 32, 8.0
#: Share of the texts to be kept that may lie below the rejection threshold.
REJECTED = 0.002
UNKNOWN = "und"


def subwords(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the window of ``size`` at each position, and whether that window is a subword."""
    letter = table_of("isalpha")[points]
    marked = np.where(letter, points, np.uint32(32))
    n = max(0, len(points) - size + 1)
    h = np.full(n, size, np.uint32)
    for k in range(size):
        h = (h ^ marked[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    valid = letter[:n] | letter[size - 1 : size - 1 + n] if size == 2 else np.ones(n, bool)
    for k in range(1, size - 1):
        valid = valid & letter[k : k + n]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - BITS), valid


def logits(texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows (buckets, k) over the subwords of each text, and their number."""
    points, starts = joined([t.lower() for t in texts])
    points = np.concatenate([np.full(1, 32, np.uint32), points])  # a text begins at the mark before its first word
    starts[-1] += 1
    total = np.zeros((len(texts), rows.shape[1] + 1))
    padded = np.concatenate([rows, np.ones((len(rows), 1), rows.dtype)], axis=1)
    for at in range(0, len(points), CHUNK):
        for size in SIZES:
            bucket, valid = subwords(points[at : at + CHUNK + size - 1], size)
            if len(bucket):
                values = padded[bucket]
                values[~valid] = 0
                sums_by_text(values, at, starts, total)
    return total[:, :-1], total[:, -1]


def bucket_counts(text: str) -> np.ndarray:
    points = np.concatenate([np.full(1, 32, np.uint32), joined([text.lower()])[0]])
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), CHUNK):
        for size in SIZES:
            bucket, valid = subwords(points[at : at + CHUNK + size - 1], size)
            out += np.bincount(bucket[valid], minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    rows: np.ndarray  # (BUCKETS, languages + 1): a subword's logits; the last class is no language
    bias: np.ndarray
    temperature: float
    threshold: float
    rejects: dict[str, float] = field(default_factory=dict)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums, n = logits(texts, self.rows)
        p = softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)[:, :-1]
        best = p.argmax(axis=1)
        score = np.where(n > 0, p[np.arange(len(p)), best], 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(counts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent over (buckets, counts) of each text; (bucket logits, bias)."""
    rng = np.random.default_rng(seed)
    embed, weight, bias = rng.normal(0, WIDTH**-0.5, (BUCKETS, WIDTH)), np.zeros((WIDTH, k)), np.zeros(k)
    share = 1 / np.maximum(np.bincount(y, minlength=k), 1)
    share *= k / share.sum()
    steps, step = EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = np.zeros((len(rows), BUCKETS))
            for r, i in enumerate(rows):
                bucket, count = counts[i]
                x[r, bucket] = count / max(1, count.sum())
            hidden = x @ embed
            slope = softmax(hidden @ weight + bias)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope *= share[y[rows], None] / len(rows)
            rate = RATE * (1 - step / steps)
            back = slope @ weight.T
            weight -= rate * (hidden.T @ slope)
            bias -= 0.1 * rate * slope.sum(axis=0)
            embed -= 20 * rate * (x.T @ back)
            step += 1
    return embed @ weight, bias


def shuffled(text: str) -> str:
    """The text with its letters in an order that their number decides; words keep their lengths."""
    points = np.array(joined([text.lower()])[0][:-1])
    at = np.nonzero(table_of("isalpha")[points])[0]
    points[at] = points[np.random.default_rng(len(at)).permutation(at)]
    return points.tobytes().decode("utf-32-le", "surrogatepass")


#: A text as the model sees it: its buckets and how often each occurs.
Counts = tuple[np.ndarray, np.ndarray]


def _halved(a: Counts, b: Counts) -> Counts:
    """A text of which one half is like a and one like b."""
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1] * max(1, b[1].sum()), b[1] * max(1, a[1].sum())])


def _scores(texts: list[Counts], rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.array([(c @ rows[b]) / max(1, c.sum()) + bias for b, c in texts]).reshape(len(texts), len(bias))


def fit(whole: list[Counts], pieces: list[Counts], junk: list[Counts], y: np.ndarray, names: list[str], strange: bool = False) -> LanguageModel:
    """From texts, short pieces of them and shuffled ones, in the order of ``y``, the numbers of their languages."""
    held = np.arange(len(y)) % 5 == 4
    if not held.any():
        held = np.ones(len(y), bool)
    learn, check = np.nonzero(~held)[0] if not held.all() else np.arange(len(y)), np.nonzero(held)[0]
    k = len(names)

    def learned(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the texts of ``known`` alone, and as many shuffled ones as a language has on average."""
        none = known[:: max(1, k)]
        return descend([c[i] for c in (whole, pieces) for i in known] + [junk[i] for i in none], np.concatenate([y[known], y[known], np.full(len(none), k)]), k + 1)

    rows, bias = learned(learn)
    z, t = _scores([c[i] for c in (whole, pieces) for i in check], rows, bias), np.concatenate([y[check], y[check]])
    loss = lambda heat: -np.log(np.maximum(softmax(z / heat)[np.arange(len(t)), t], 1e-12)).mean()
    heat = float(min(np.geomspace(0.05, 5, 60), key=loss))
    sure = lambda z: softmax(z / heat)[:, :k].max(axis=1)
    right = sure(z)[softmax(z / heat)[:, :k].argmax(axis=1) == t]
    others = [(i, j) for i, j in zip(check, np.roll(check, -1), strict=True) if y[i] != y[j]]
    mixed = sure(_scores([_halved(whole[i], whole[j]) for i, j in others], rows, bias))
    kept = np.concatenate([right, mixed])
    threshold = float(np.quantile(kept, REJECTED)) if len(kept) else 0.0
    model = LanguageModel(names, rows.astype(np.float32), bias, heat, threshold)
    model.rejects["shuffled"] = float((sure(_scores([junk[i] for i in check], rows, bias)) < threshold).mean())
    if strange:
        rows, bias = learned(learn[y[learn] != k - 1])
        model.rejects["foreign"] = float((sure(_scores([whole[i] for i in check if y[i] == k - 1], rows, bias)) < threshold).mean())
    return model


def train(docs: DataFrame, labels: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, strange: bool = False) -> LanguageModel:
    """Learn from labelled texts; ``labels`` has (doc_id, label) of rows of ``docs``. ``strange`` measures how a language that is not learned is rejected."""
    sample = labelled_sample(docs, labels, per_language)

    def make():
        def sparse(texts: list[str]) -> list:
            out = []
            for text in texts:
                at = len(text) // 3
                for t in (text, text[at : at + PIECE], shuffled(text[at : at + JUNK])):
                    c = bucket_counts(t)
                    b = np.nonzero(c)[0]
                    out.append((b.astype(np.int32), c[b].astype(np.float32)))
            return [[x[n] for x in out[k::3]] for k in range(3) for n in range(2)]

        return sparse

    fields = [pa.field(f"{c}{k}", pa.list_(t)) for k in range(3) for c, t in (("b", pa.int32()), ("c", pa.float32()))]
    got = map_texts(sample.rows, "text", fields, make, ["label", "h"]).toArrow()
    names, order = sorted(set(got.column("label").to_pylist())), sample_order(got).tolist()
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 1.0)
    y = np.array([names.index(x) for x in got.column("label").to_pylist()])[order]
    counts = []
    for k in range(3):
        given = [(np.asarray(b.values), np.asarray(c.values)) for b, c in zip(got.column(f"b{k}"), got.column(f"c{k}"), strict=True)]
        counts.append([given[i] for i in order])
    return fit(*counts, y, names, strange)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, then the predicted language and its score under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages
    fields = [pa.field(names[0], pa.string()), pa.field(names[1], pa.float64())]
    return map_texts(docs, "text", fields, lambda: lambda texts: list(shared.value.predict(texts)), keep)


def training_labels(docs: DataFrame) -> DataFrame:
    return docs.filter(fold_of(F.col("doc_id"), 4) != 2).select("doc_id", F.col("lang").alias("label"))


def keep_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows with a recognised language: not ``und``, and a score of the rejection threshold or more."""
    names = private_name(docs, "lang_pred"), private_name(docs, "lang_score")
    sure = (F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= model.threshold)
    return predict(docs, model, names=names).filter(sure).drop(*names)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(docs))
    out = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
