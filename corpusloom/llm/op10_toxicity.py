"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings (STEMS letters) that occur in texts marked toxic far more often than in
others. Features of a text are densities of lexicon words, of lexicon beginnings and of words that match only once digits and signs that stand for letters are read as such,
how near such hits are to second-person words, capitals, punctuation, and obfuscation rates.

Learned from SAMPLE_PER_LABEL texts of each label at most (see ``labelled_sample``), weighted to stand for all labelled texts. The
lexicon is crossed: each half of the sample gets its features from the lexicon of the other half, so that the trees do not see words that only their own texts hold;
scoring takes the lexicon of both halves. What a word must reach to be an entry is chosen among CHOICES by the loss of margins of trees that were grown without the
text, over FOLDS folds of the sample; rows that no label may be learned from decide nothing. The calibration is fitted to the same margins.

Cases: null texts count as empty; empty texts are scored by their features, which are zero. Repeated rows each give a row. With labels of one kind only,
or none, the score is a constant. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold_of, map_texts, materialize, table
from corpusloom.llm.learning import Tree, boost, isotonic, labelled_sample, sample_order, sigmoid
from corpusloom.llm.statistics import class_counts

SAMPLE_PER_LABEL = 3_000
STEMS = (4, 5, 6)
#: What a lexicon entry must reach: how much more likely it is in toxic texts (log odds), and how little chance its split between toxic and other texts has
#: (log likelihood ratio against the split of all texts; 8 comes up by chance once in about 3,000). The pair with the least out-of-fold loss is taken.
CHOICES = ((1.5, 8.0), (2.5, 8.0), (3.5, 8.0), (2.5, 4.0))
#: Entries of a lexicon, the likeliest first.
LEXICON = 20_000
NEAR = 6
TREES, DEPTH, RATE, FOLDS = 60, 3, 0.3, 4
CACHED_WORDS = 400_000
TOXIC = 0.5

#: Second-person words of the languages in use, and signs that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer eure tú ti tus usted ustedes vosotros vuestro".split()
)
LEET = str.maketrans("013457@$!|€", "oieastasile")

FEATURES = (
    "words", "word_hits", "word_share", "stem_hits", "stem_share", "odds", "greatest_odds", "near_second_person", "second_person", "capitals", "shouted_words", "exclamations", "marks",
    "symbols", "mixed_words", "read_hits", "spaced_letters",
)
_EDGE = re.compile(r"^\W+|\W+$")
_MIXED = re.compile(r"\w[\d@$!*.|€_-]+\w")
_SPACED = re.compile(r"(?<!\S)(?:\w[\s.*_-]){3,}\w(?!\S)")

WORD, STEM, SECOND, MIXED, READ, SHOUT = 1, 2, 4, 8, 16, 32


def terms(text: str) -> set[str]:
    """Words, and beginnings marked ``^``, of a text."""
    words = {_EDGE.sub("", w) for w in text.lower().split()}
    words.discard("")
    return words | {f"^{w[:k]}" for w in words for k in STEMS if len(w) >= k}


class _Tokens(dict):
    """Token to its kinds; ``odds`` has the log odds of the lexicon entries among them. Forgets all when there are many."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.odds = lexicon, {}

    def __missing__(self, token: str) -> int:
        kinds, odds = self.judge(token)
        if odds:
            self.odds[token] = odds
        self[token] = kinds
        return kinds

    def found(self, word: str) -> tuple[int, float]:
        if (odds := self.lexicon.get(word)) is not None:
            return WORD | STEM, odds
        for k in reversed(STEMS):
            if len(word) >= k and (odds := self.lexicon.get(f"^{word[:k]}")) is not None:
                return STEM, odds
        return 0, 0.0

    def judge(self, token: str) -> tuple[int, float]:
        word = _EDGE.sub("", token.lower())
        kinds, odds = self.found(word)
        if word in SECOND_PERSON:
            kinds |= SECOND
        if len(word) > 1 and token.isupper():
            kinds |= SHOUT
        if _MIXED.search(token):
            kinds |= MIXED
        if not kinds & STEM and not word.isalpha():
            for read in (_EDGE.sub("", token.lower().translate(LEET)), re.sub(r"[\W\d_]+", "", word)):
                hit, odds = self.found(read)
                if hit:  # as good as the plain word; training texts need not have it written so
                    kinds |= hit | READ
                    break
        return kinds, odds


def features(texts: list[str], lexicon: dict[str, float], tokens: _Tokens | None = None) -> np.ndarray:
    """(texts, len(FEATURES)). Hits are capped at no number; densities are per word."""
    tokens = _Tokens(lexicon) if tokens is None else tokens
    counts = class_counts(texts).astype(float)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if len(tokens) > CACHED_WORDS:
            tokens.clear(), tokens.odds.clear()
        words = text.split()
        at = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
        kinds, odds = at, np.array([tokens.odds.get(w, 0.0) for w in words]) if (at & (STEM | READ)).any() else np.zeros(len(at))
        hit = (kinds & STEM) > 0
        n, chars, letters = max(1, len(words)), max(1, len(text)), max(1.0, counts[i, 0])
        sums = [((kinds & k) > 0).sum() for k in (WORD, STEM, SECOND, SHOUT, MIXED, READ)]
        near = 0.0
        if hit.any() and sums[2]:
            you = np.nonzero(kinds & SECOND)[0]
            where = np.nonzero(hit)[0]
            k = np.searchsorted(you, where)
            gap = np.minimum(np.abs(where - you[np.maximum(k - 1, 0)]), np.abs(where - you[np.minimum(k, len(you) - 1)]))
            near = float((gap <= NEAR).sum())
        out[i] = (
            np.log1p(len(words)), np.log1p(sums[0]), sums[0] / n, np.log1p(sums[1]), sums[1] / n, odds[hit].sum() / n, odds.max(initial=0.0), near / n, sums[2] / n, counts[i, 2] / letters,
            sums[3] / n, counts[i, 5] / chars, counts[i, 4] / chars, counts[i, 6] / chars, sums[4] / n, np.log1p(sums[5]), sum(map(len, _SPACED.findall(text))) / chars,
        )
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    start: float
    trees: list[Tree]
    at: np.ndarray
    value: np.ndarray
    choice: tuple[float, float] | None = None
    loss: float | None = None  # out of fold, before calibration

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(sigmoid(self.margins(x)), self.at, self.value)


Lexicon = dict[str, float]


def _lexicons(rows: DataFrame) -> list[tuple[Lexicon, Lexicon, Lexicon]]:
    """For each of CHOICES the lexicons of both halves of the sample, and of all of it: log odds by entry."""
    field = pa.field("terms", pa.list_(pa.string()))
    listed = map_texts(rows.select("text", "label", "h"), "text", [field], lambda: lambda texts: [[sorted(terms(t)) for t in texts]], ["label", "h"])
    half = F.pmod("h", F.lit(2))
    kinds = {f"{name}{k}": (half == k) & (F.col("label") == y) for k in (0, 1) for name, y in (("pos", 1), ("neg", 0))}
    totals = rows.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in kinds.items()]).first()
    counted = materialize(listed.select("label", "h", F.explode("terms").alias("term")).groupBy("term").agg(
        *[F.count(F.when(c, 1)).alias(n) for n, c in kinds.items()]
    ))
    found = []
    for parts in (("0",), ("1",), ("0", "1")):
        pos, neg = (sum((F.col(f"{n}{k}") for k in parts), F.lit(0)) for n in ("pos", "neg"))
        n_pos, n_neg = (sum(totals[f"{n}{k}"] for k in parts) for n in ("pos", "neg"))
        odds = F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))
        share = (n_pos + 0.5) / (n_pos + n_neg + 1)
        part = lambda n, expected: F.when(n > 0, n * F.log(n / ((pos + neg) * expected))).otherwise(0.0)
        judged = counted.select("term", odds.alias("odds"), (part(pos, share) + part(neg, 1 - share)).alias("ratio"))
        likely = lambda o, r: judged.filter((F.col("odds") >= o) & (F.col("ratio") >= r)).orderBy(F.desc("odds"), "term").limit(LEXICON)
        found.append([{r.term: r.odds for r in likely(*choice).collect()} for choice in CHOICES])
    return list(zip(*found, strict=True))


def log_loss(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=w))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """``labels`` has (doc_id, label), the label 0 or 1."""
    sample = labelled_sample(docs, docs.select("doc_id").join(labels, "doc_id"), per_label)
    rows = materialize(sample.rows)  # bounded; read three times
    lexicons = _lexicons(rows)
    shared = docs.sparkSession.sparkContext.broadcast([x for first, second, _ in lexicons for x in (second, first)])  # a half takes the other's; LEXICON entries at most

    def make():
        return lambda texts: [list(features(texts, lexicon)) for lexicon in shared.value]

    fields = [pa.field(f"x{k}", pa.list_(pa.float64())) for k in range(2 * len(CHOICES))]
    got = map_texts(rows, "text", fields, make, ["label", "h"]).toArrow()
    order = sample_order(got)
    y, half = np.array(got.column("label").to_pylist(), float)[order], np.array(got.column("h").to_pylist(), np.int64)[order] % 2
    w = np.array([sample.shares[int(v)] for v in y])
    knots = np.array([0.0, 1.0])
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel({}, 0.0, [], knots, np.full(2, float(y[0]) if len(y) else 0.0))
    fold, tried = np.arange(len(y)) % FOLDS, []
    for c, (_, _, both) in enumerate(lexicons):
        x0, x1 = (np.array(got.column(f"x{2 * c + k}").to_pylist(), float).reshape(len(y), len(FEATURES))[order] for k in (0, 1))
        x, margins = np.where(half[:, None] == 0, x0, x1), np.zeros(len(y))
        for k in range(FOLDS):
            rest = fold != k if len(set(y[fold != k])) == 2 else fold >= 0
            margins[fold == k] = ToxicityModel(both, *_grown(x, y, w, rest), knots, knots).margins(x[fold == k])
        tried.append((log_loss(sigmoid(margins), y, w), c, x, margins))
    loss, c, x, margins = min(tried, key=lambda t: t[:2])
    model = ToxicityModel(lexicons[c][2], *_grown(x, y, w, fold >= 0), knots, knots, CHOICES[c], loss)
    model.at, model.value = isotonic(sigmoid(margins), y, w)
    return model


def _grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray) -> tuple[float, list[Tree]]:
    return boost(x[rows], y[rows], w[rows], TREES, DEPTH, RATE, seed=5)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 5) != 0)
    return labels.filter("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label"))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        tokens = _Tokens(model.lexicon)
        return lambda texts: [model.scores(features(texts, model.lexicon, tokens))]

    return map_texts(docs, "text", [pa.field("score", pa.float64())], make, keep)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, training_labels(spark, sf_dir)), ["doc_id"])
    return out.select(
        "doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )
