"""What the classifiers share: bounded labelled samples, histogram trees, isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes that a sample takes at most, most rows first; languages and 0/1 labels stay far below.
MAX_CLASSES = 512


@dataclass
class Sample:
    """rows: doc_id, text, label, h (the hash of the text); shares: how many labelled documents a sampled one of the class stands for."""

    rows: DataFrame
    shares: dict


#: A first cut of the ids keeps so many times the wanted number, so that it hardly ever keeps too few.
_SPARE = 3


def labelled_sample(docs: DataFrame, labelled: DataFrame, per_class: int) -> Sample:
    """Up to ``per_class`` documents of each label, those with the smallest hashes of their ids; of copies of a text one stays.

    ``labelled`` has (doc_id, label) of rows of ``docs``. Whole texts are read once, of the chosen ids alone; what is counted and cut before has
    ids and labels only. ``per_class`` times the number of classes bounds what the driver gets (_SPARE times that in between).
    """
    spark, known = docs.sparkSession, labelled.filter("label IS NOT NULL AND doc_id IS NOT NULL")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_CLASSES).collect()}
    kind = labelled.schema["label"].dataType.simpleString()
    cuts = spark.createDataFrame(
        [(c, min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, _SPARE * per_class / n)))) for c, n in sizes.items()], f"label {kind}, cut long"
    )
    order = F.xxhash64("doc_id").alias("order")
    near = known.join(F.broadcast(cuts), "label").filter(F.xxhash64("doc_id") <= F.col("cut")).select("doc_id", "label", order).distinct()
    by_class: dict = {}
    for r in sorted(near.collect(), key=lambda r: (r.order, r.doc_id)):
        if len(own := by_class.setdefault(r.label, [])) < per_class:
            own.append((r.doc_id, r.label))
    ids = spark.createDataFrame([x for own in by_class.values() for x in own], f"doc_id long, label {kind}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "label"]).repartition(spark.sparkContext.defaultParallelism)  # long work on few rows
    return Sample(rows, {c: n / min(n, per_class) for c, n in sizes.items()})


def sample_order(got: pa.Table) -> np.ndarray:
    """The places of the sample's rows by (h, label), so that what is learned does not depend on the order in which they come."""
    return np.lexsort((np.array(got.column("label").to_pylist()), np.array(got.column("h").to_pylist(), np.int64)))


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. Rows with x[feature] <= threshold go left."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = (np.asarray(c) for c in (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows, node = np.nonzero(inner)[0], at[inner]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        return value[at]


class Binned:
    """Feature values as bin numbers between quantile cuts; a cut is the midpoint of two neighbouring values."""

    def __init__(self, x: np.ndarray, bins: int = 64):
        self.x, self.bins, self.cuts = x, bins, []
        self.bin = np.zeros(x.shape, np.int64)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            mids = (values[1:] + values[:-1]) / 2
            if len(mids) >= bins:
                at = np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])
                mids = np.unique(mids[np.clip(np.searchsorted(mids, at), 0, len(mids) - 1)])
            self.cuts.append(mids)
            self.bin[:, f] = np.searchsorted(mids, x[:, f], "left")
        self.width = 1 + max(map(len, self.cuts), default=0)
        self.real = np.arange(self.width) < np.array([[len(c)] for c in self.cuts]).reshape(-1, 1)  # (features, bins): is there a cut after the bin

    def sums(self, rows: np.ndarray, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(features, bins): the weights of the rows up to each bin."""
        at = self.bin[np.ix_(rows, features)] + np.arange(len(features)) * self.width
        return np.bincount(at.ravel(), np.repeat(weights, len(features)), len(features) * self.width).reshape(len(features), -1).cumsum(axis=1)


def grow(data: Binned, rows: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, depth: int, least: float = 4.0, ridge: float = 1.0, leaf_rows: int = 5) -> Tree:
    """A tree that steps against the gradients g with curvatures h."""
    tree = Tree()

    def build(rows: np.ndarray, depth: int) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        me = tree.leaf(-gs / (hs + ridge))
        if depth == 0 or len(rows) < 2 * leaf_rows:
            return me
        gl, hl, nl = (data.sums(rows, features, w) for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
        gain[(nl < leaf_rows) | (len(rows) - nl < leaf_rows) | ~data.real[features]] = -1
        at = int(np.argmax(gain)) if gain.size else 0
        if not gain.size or gain.flat[at] <= 1e-6:
            return me
        f, k = int(features[at // data.width]), at % data.width
        tree.feature[me], tree.threshold[me] = int(f), float(data.cuts[f][k])
        low = data.bin[rows, f] <= k
        tree.left[me] = build(rows[low], depth - 1)
        tree.right[me] = build(rows[~low], depth - 1)
        return me

    build(rows, depth)
    return tree


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int, depth: int, rate: float, seed: int, rows_share: float = 0.7, columns_share: float = 0.7) -> tuple[float, list[Tree]]:
    """Logistic gradient boosting; (first margin, trees whose values hold the rate)."""
    rng, data = np.random.default_rng(seed), Binned(x)
    mean = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin, made = np.full(len(y), start), []
    for _ in range(trees):
        p = sigmoid(margin)
        rows = np.sort(rng.permutation(len(y))[: max(1, round(rows_share * len(y)))])
        columns = np.sort(rng.permutation(x.shape[1])[: max(1, round(columns_share * x.shape[1]))])
        tree = grow(data, rows, w * (p - y), np.maximum(w * p * (1 - p), 1e-6), columns, depth)
        tree.value = [rate * v for v in tree.value]
        margin += tree.predict(x)
        made.append(tree)
    return start, made


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; knots (score, probability) to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t, v in zip(score[order], y[order], w[order], strict=True):
        blocks.append([t * v, v, s, s])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([[b[2], b[3]] for b in blocks]).ravel()
    value = np.repeat([b[0] / b[1] for b in blocks], 2)
    return at, value
