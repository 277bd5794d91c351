"""Quality classifier: a sparse ensemble of conjunctive rules over document statistics.

Boosted trees are fitted on a bounded labelled sample, each of their paths becomes a rule (a
conjunction of comparisons), a lasso logistic regression gives most rules a weight of zero, and
the rest are compiled into one Spark column expression. Statistics cover the whole text.

Cases: null and empty texts have zero statistics and get a score like any other; texts of any length are read whole; a
score equal to the threshold is predicted good; repeated rows are scored each and alike; no documents give no rows; no or one-sided
labels give a constant score; other columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import _stats, _trees

#: Most labelled documents that a model is fitted on.
SAMPLE = 6000
#: Score from which a document is predicted good.
THRESHOLD = 0.3


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: list[float]

    def column(self, names: dict[str, str]) -> Column:
        """The score as a Spark expression over the statistics' columns."""
        of = [F.col(names[k]) for k in _stats.FEATURES]
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            hold = F.lit(True)
            for f, below, t in rule:
                hold = hold & ((of[f] <= t) if below else (of[f] > t))
            total = total + F.when(hold, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        names = list(_stats.FEATURES)
        return [f"{w:+.3f} if " + " and ".join(f"{names[f]} {'<=' if b else '>'} {t:.4g}" for f, b, t in r) for r, w in zip(self.rules, self.weights)]


def _holds(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, t in rule:
        out &= (x[:, f] <= t) if below else (x[:, f] > t)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept (free) and weights minimising mean logistic loss + penalty * |weights|, by accelerated proximal steps."""
    z1 = np.column_stack([np.ones(len(z)), z])
    # a quarter of the largest eigenvalue of z'z / n bounds the curvature
    v = np.ones(z1.shape[1])
    for _ in range(30):
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(z1 @ v) ** 2 / len(y) + 1e-9)
    w = np.zeros(z1.shape[1])
    ahead, t = w, 1.0
    for _ in range(steps):
        new = ahead - step * (z1.T @ (_trees.sigmoid(z1 @ ahead) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, n_trees: int = 24, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    trees = _trees.fit(x, y, n_trees, depth, [0] * x.shape[1])
    rules, seen = [], set()
    for rule in trees.paths():
        mark = _holds(x, rule)
        key = mark.tobytes()
        if key not in seen and (~mark).tobytes() not in seen and mark.any() and not mark.all():
            seen.add(key)
            rules.append(rule)
    if not rules:
        return RuleModel(trees.base, [], [])
    intercept, weights = lasso_logistic(np.stack([_holds(x, r) for r in rules], axis=1).astype(float), y, penalty)
    kept = [i for i, w in enumerate(weights) if abs(w) > 1e-6]
    return RuleModel(intercept, [rules[i] for i in kept], [float(weights[i]) for i in kept])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleModel:
    return fit_rules(*_stats.labelled_sample(documents, labels, label, sample))


def _scored(documents: DataFrame, model: RuleModel) -> tuple[DataFrame, Column]:
    stats, names = _stats.append(documents, dict.fromkeys(_stats.FEATURES, "double"), lambda x: {k: np.asarray(x[k], np.float64) for k in _stats.FEATURES})
    return stats, model.column(names)


def scores(documents: DataFrame, model: RuleModel) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    stats, score = _scored(documents.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return stats.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def accepted(documents: DataFrame, model: RuleModel) -> DataFrame:
    """The documents (all columns) that the classifier predicts good."""
    stats, score = _scored(documents, model)
    return stats.where(score >= THRESHOLD).select(*(F.col(f"`{c}`") for c in documents.columns))
