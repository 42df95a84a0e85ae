"""Quality classifier as a sparse rule ensemble.

Boosted trees are grown on text statistics of a bounded labelled sample, every path through them becomes a rule (a
conjunction of comparisons), a lasso-penalised logistic regression gives most rules the weight 0, and the remaining
ones are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import held_out, labelled_sample

SAMPLE = 20_000     # labelled documents the model is fitted on, at most
LASSO = 5e-4


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, null as empty. All are 0 for the empty text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.split(t, " ")
    per_char = lambda n: F.coalesce(n / F.nullif(chars, F.lit(0)), F.lit(0.0))
    return {
        "chars": chars.cast("double"),
        "word_chars": F.when(chars > 0, chars / F.size(words)).otherwise(0.0),
        "distinct_words": F.when(chars > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0),
        "upper": per_char(F.regexp_count(t, F.lit(r"\p{Lu}"))),
        "digits": per_char(F.regexp_count(t, F.lit("[0-9]"))),
        "symbols": per_char(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]"))),
        "stops": per_char(F.regexp_count(t, F.lit("[.,]"))),
        "lines": per_char(F.regexp_count(t, F.lit("\n"))),
    }


@dataclass
class RuleEnsemble:
    """``weights`` are those of ``rules``; a rule is a tuple of (statistic, at most, cut)."""

    names: list[str]
    rules: list[boosting.Rule]
    weights: list[float]
    intercept: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * boosting.holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))

    def score(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1 as an expression over columns named as the statistics."""
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            parts = [(stats[self.names[f]] <= cut) if low else (stats[self.names[f]] > cut) for f, low, cut in rule]
            both = parts[0]
            for p in parts[1:]:
                both = both & p
            margin = margin + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(30.0)), F.lit(-30.0))))


def fit(rows: np.ndarray, y: np.ndarray, names: list[str], lasso: float = LASSO) -> RuleEnsemble:
    """With no rows, or labels of one kind only, the model has no rule and a constant score."""
    if not len(rows):
        return RuleEnsemble(names, [], [], 0.0)
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    if y.min() == y.max():
        return RuleEnsemble(names, [], [], float(np.log(rate / (1 - rate))))
    weight = np.ones(len(rows))
    found = boosting.rules(boosting.fit(rows, y, weight, trees=30, depth=3, rate=0.2, least=5.0))
    x = np.stack([boosting.holds(r, rows) for r in found], 1).astype(float)
    w, intercept = boosting.logistic(x, y, weight, lasso=lasso)
    kept = np.flatnonzero(w)
    return RuleEnsemble(names, [found[k] for k in kept], [float(w[k]) for k in kept], intercept)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Fitted on at most ``sample`` labelled documents outside the fold crc32(doc_id) mod 3 = 1."""
    stats = statistics(F.col("text"))
    taught = labelled_sample(documents, labels, "quality", 3, 1, sample)
    rows = taught.select(*(c.alias(n) for n, c in stats.items()), F.col("y").cast("double")).toPandas()
    values = rows.to_numpy(dtype=float, copy=True)
    values = values[np.lexsort(values.T)]     # the order of rows from Spark differs from run to run
    return fit(values[:, :-1], values[:, -1], list(stats))


def score_quality(documents: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null texts score as empty ones, repeated rows alike."""
    stats = statistics(F.col("text"))
    measured = documents.select("doc_id", *(c.alias(n) for n, c in stats.items()))
    score = model.score({n: F.col(n) for n in stats})
    scored = measured.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(documents, train(documents, labels))
