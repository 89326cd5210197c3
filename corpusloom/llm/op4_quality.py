"""Quality scores by a sparse ensemble of rules.

Boosted trees of small depth over the statistics of a text propose rules: each path from a root to a node is a conjunction of
thresholds. A logistic model with an L1 penalty, fitted by accelerated proximal steps, gives most rules no weight; the penalty is the
one with the least loss on the fifth of the sample that is held back. The rules left are compiled into Spark column expressions over the statistics, so the model
can be read, and scoring them needs no Python. Only the statistics are computed in Arrow batches.

Learned from SAMPLE_PER_LABEL texts of each label at most (see ``labelled_sample``), weighted to stand for all labelled texts.

Cases: null texts count as empty; empty texts are scored by their statistics, which are zero. Repeated rows each give a row. With labels of one kind only,
or none, the score is a constant. An empty table gives no rows. Extra columns are ignored in the query; ``keep_good`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold_of, map_texts, private_name, table
from corpusloom.llm.learning import Tree, boost, labelled_sample, sample_order, sigmoid
from corpusloom.llm.statistics import STATISTICS, statistics

SAMPLE_PER_LABEL = 3_000
TREES, DEPTH, RATE = 40, 3, 0.3
PENALTIES = np.geomspace(0.1, 0.0005, 12)
GOOD = 0.7

#: A conjunction: (statistic, is it above, threshold), and so on.
Rule = tuple[tuple[int, bool, float], ...]


def paths(trees: list[Tree]) -> list[Rule]:
    """Every path from a root to a node below it as a rule; the tightest bound on each side of a statistic stays."""
    found: dict[Rule, None] = {}

    def walk(tree: Tree, node: int, bounds: dict) -> None:
        if bounds:
            found[tuple((f, up, t) for (f, up), t in sorted(bounds.items()))] = None
        f = tree.feature[node]
        if f >= 0:
            t = tree.threshold[node]
            walk(tree, tree.left[node], bounds | {(f, False): min(t, bounds.get((f, False), t))})
            walk(tree, tree.right[node], bounds | {(f, True): max(t, bounds.get((f, True), t))})

    for tree in trees:
        walk(tree, 0, {})
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, up, t in rule:
        out &= x[:, f] > t if up else x[:, f] <= t
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 400) -> np.ndarray:
    """Weights of a constant and the columns of x; accelerated proximal gradient, the constant unpenalised."""
    x1, w = np.concatenate([np.ones((len(x), 1)), x], axis=1), w / w.sum()
    step = 4 / max(np.linalg.norm(x1 * np.sqrt(w)[:, None], 2) ** 2, 1e-9)
    beta = np.zeros(x1.shape[1]) if start is None else start.copy()
    ahead, pace = beta.copy(), 1.0
    for _ in range(steps):
        slope = x1.T @ (w * (sigmoid(x1 @ ahead) - y))
        new = ahead - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, beta, pace = new + (pace - 1) / faster * (new - beta), new, faster
    return beta


@dataclass
class RuleModel:
    constant: float
    rules: list[tuple[Rule, float]]

    def column(self, statistic: Column) -> Column:
        """The score from an array column of statistics, in built-in functions."""
        total = F.lit(self.constant)
        for rule, weight in self.rules:
            tests = [statistic[f] > t if up else statistic[f] <= t for f, up, t in rule]
            both = tests[0]
            for test in tests[1:]:
                both = both & test
            total = total + F.when(both, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.constant + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))

    def text(self) -> str:
        told = lambda r: " and ".join(f"{STATISTICS[f]} {'>' if up else '<='} {t:.4g}" for f, up, t in r)
        return "\n".join([f"{self.constant:+.3f}", *(f"{w:+.3f} if {told(r)}" for r, w in self.rules)])


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(0.0 if len(y) == 0 else (3.0 if y[0] else -3.0), [])
    held = np.arange(len(y)) % 5 == 4
    if not held.any() or len(set(y[~held])) < 2:
        held[:] = False
    learn, check = ~held, held if held.any() else ~held
    _, trees = boost(x[learn], y[learn], w[learn], TREES, DEPTH, RATE, seed=11)
    rules = paths(trees)
    if not rules:
        share = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))), [])
    on = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    _, first = np.unique(on[learn], axis=1, return_index=True)  # rules that agree everywhere are one
    first = np.sort(first[(on[learn][:, first].min(axis=0) < on[learn][:, first].max(axis=0))])
    on, rules = on[:, first], [rules[k] for k in first]
    beta, tried = None, []
    for penalty in PENALTIES:
        beta = lasso_logistic(on[learn], y[learn], w[learn], penalty, beta)
        p = np.clip(sigmoid(beta[0] + on[check] @ beta[1:]), 1e-6, 1 - 1e-6)
        tried.append((-np.average(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p), weights=w[check]), beta))
    beta = min(tried, key=lambda t: t[0])[1]
    return RuleModel(float(beta[0]), [(r, float(b)) for r, b in zip(rules, beta[1:], strict=True) if abs(b) > 1e-6])


def _statistics(docs: DataFrame, keep: list[str], name: str = "statistics") -> DataFrame:
    field = pa.field(name, pa.list_(pa.float64()))
    return map_texts(docs, "text", [field], lambda: lambda texts: [list(statistics(texts))], keep)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> RuleModel:
    """``labels`` has (doc_id, label), the label 0 or 1."""
    sample = labelled_sample(docs, docs.select("doc_id").join(labels, "doc_id"), per_label)
    got = _statistics(sample.rows, ["label", "h"]).toArrow()
    order = sample_order(got)
    y = np.array(got.column("label").to_pylist(), float)[order]
    x = np.array(got.column("statistics").to_pylist(), float).reshape(len(y), len(STATISTICS))[order]
    return fit(x, y, np.array([sample.shares[int(v)] for v in y]))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 4) != 2)
    return labels.filter("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))


def score(docs: DataFrame, model: RuleModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score``."""
    rows = _statistics(docs, keep)
    return rows.select(*[F.col(f"`{c}`") for c in keep], model.column(F.col("statistics")).alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, least: float = GOOD) -> DataFrame:
    name = private_name(docs, "statistics")
    return _statistics(docs, docs.columns, name).filter(model.column(F.col(name)) >= least).drop(name)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, training_labels(spark, sf_dir)), ["doc_id"])
    return out.select(
        "doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
