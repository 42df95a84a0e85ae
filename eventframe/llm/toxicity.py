"""Toxicity by weak supervision.

Lexicon and pattern voters look at every document. A generative model of their votes, fitted by expectation
maximisation without labels, estimates how often each voter fires on toxic and on clean documents, and which voters repeat
each other given the class; repeated votes count less. A linear classifier is then trained on the model's posterior.

The lexicon itself is learned: words and word beginnings that labelled toxic documents of the training folds have far more
often than the others. Single terms are voters together with patterns over all terms.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import held_out, labelled_sample

SAMPLE = 20_000     # labelled documents the lexicon is learned from, and documents the classifier is fitted on, at most
TERMS = 96          # lexicon size
GROUPS = 8          # lexicon voters: terms are dealt over so many
ODDS = 50           # how many times more frequent a term is in toxic documents than in others
PREFIXES = (4, 5)   # lengths of word beginnings that can be terms
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """Distinct lower-case words, and ``abcd*`` for beginnings of longer words."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[str, list[int]] = {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            for term in terms_of(text or ""):
                held.setdefault(term, [0, 0])[y > 0] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(held, pa.string()), "clean": pa.array([v[0] for v in held.values()], pa.int64()),
                                          "toxic": pa.array([v[1] for v in held.values()], pa.int64())})


def learn_lexicon(taught: DataFrame, size: int = TERMS) -> list[str]:
    """Terms in at least 0.5 % of the toxic documents of the sample, with large log-odds for these, strongest first.

    The candidates are bounded by the distinct terms of a document times 200. A word that begins with a chosen term
    adds nothing and is left out; a beginning counts only for the toxic documents that its chosen words leave over.
    """
    n = {bool(r["y"]): r["count"] for r in taught.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic or not clean:
        return []
    least = max(2, math.ceil(toxic * 0.005))
    counts = taught.mapInArrow(_term_rows, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = counts.where((F.col("toxic") >= least) & (F.col("toxic") * clean > ODDS * F.col("clean") * toxic)).collect()

    def odds(t: int, c: int) -> float:
        return math.log((t + 0.5) / toxic) - math.log((c + 0.5) / clean)

    chosen: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (-odds(r["toxic"], r["clean"]) * math.log1p(r["toxic"]), r["term"])):
        term, stem = r["term"], r["term"].rstrip("*")
        if any(c.endswith("*") and term != c and stem.startswith(c[:-1]) for c in chosen):
            continue
        inside = [t for c, t in chosen.items() if term.endswith("*") and c.startswith(stem)]
        left = r["toxic"] - max(inside, default=0)
        if left >= least and odds(left, r["clean"]) > math.log(ODDS):
            chosen[term] = r["toxic"]
        if len(chosen) == size:
            break
    return list(chosen)


@dataclass(frozen=True)
class Hits:
    """Counts of one text: distinct terms found per lexicon group, all found, words found and words in all."""

    groups: tuple[int, ...]
    terms: int
    spots: int
    words: int


class Lexicon:
    def __init__(self, terms: list[str]) -> None:
        self.terms = list(terms)
        self.group = {t: i % GROUPS for i, t in enumerate(terms)}
        self.lengths = tuple(sorted({len(t) - 1 for t in terms if t.endswith("*")}))

    def hits(self, text: str | None) -> Hits:
        words = _WORD.findall((text or "").lower())
        found: set[str] = set()
        hit: set[str] = set()
        for w in set(words):
            own = [w] if w in self.group else []
            own += [t for n in self.lengths if len(w) > n and (t := w[:n] + "*") in self.group]
            if own:
                found.update(own)
                hit.add(w)
        groups = [0] * GROUPS
        for t in found:
            groups[self.group[t]] += 1
        return Hits(tuple(groups), len(found), sum(w in hit for w in words) if hit else 0, len(words))


#: Pattern voters over all terms of the lexicon.
PATTERNS = ("any", "two_words", "four_words", "dense", "spread")
VOTERS = GROUPS + len(PATTERNS)


def votes(h: Hits) -> tuple[bool, ...]:
    used = sum(g > 0 for g in h.groups)
    return (*(g > 0 for g in h.groups), h.spots >= 1, h.spots >= 2, h.spots >= 4,
            h.spots > 0 and h.spots * 100 >= h.words, used >= 2)


def features(h: Hits) -> list[float]:
    return [math.log1p(h.spots), math.log1p(h.terms), 100 * h.spots / max(h.words, 1) / (1 + 100 * h.spots / max(h.words, 1)),
            *(float(v) for v in votes(h))]


FEATURES = 3 + VOTERS


@dataclass
class LabelModel:
    """P(toxic), the voters' rates of firing by class, their weights against repetition, and conditional correlations."""

    prior: float
    rates: np.ndarray         # [2, voters]: on clean and on toxic documents
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        r = self.rates
        gain = np.log(r[1] / r[0]) * v + np.log((1 - r[1]) / (1 - r[0])) * (1 - v)
        return boosting.sigmoid(math.log(self.prior / (1 - self.prior)) + gain @ self.weight)


def fit_label_model(v: np.ndarray, n: np.ndarray, rounds: int = 60) -> LabelModel:
    """``v`` are the distinct vote patterns, ``n`` how many documents have each. No labels are used.

    A voter with the residual correlations c (given the class) to the others weighs 1 / (1 + sum of its positive c).
    Documents start as toxic in proportion to the share of voters that fire.
    """
    v, n = v.astype(float), n.astype(float)
    voters = v.shape[1]
    model = LabelModel(0.1, np.vstack([np.full(voters, 0.05), np.full(voters, 0.6)]), np.ones(voters), np.eye(voters))
    if not n.sum():
        return model
    q = np.clip(v.mean(1) * 2, 0.001, 0.999)
    for k in range(rounds):
        sums = np.array([(n * (1 - q)).sum(), (n * q).sum()]) + 1
        rates = np.vstack([((n * (1 - q)) @ v + 0.02) / sums[0], ((n * q) @ v + 0.5) / sums[1]])
        model.rates = np.clip(rates, 1e-4, 1 - 1e-4)
        model.prior = float(np.clip(sums[1] / sums.sum(), 1e-3, 0.5))
        if k % 10 == 9:
            total = np.zeros((voters, voters))
            for c, share in enumerate((n * (1 - q), n * q)):
                e = (v - model.rates[c]) / np.sqrt(model.rates[c] * (1 - model.rates[c]))
                total += (e * share[:, None]).T @ e / max(share.sum(), 1) * (sums[c] / sums.sum())
            model.correlation = np.clip(total, -1, 1)
            off = np.clip(model.correlation - np.eye(voters), 0, None)
            model.weight = 1 / (1 + off.sum(1))
        q = model.posterior(v)
    return model


@dataclass
class Toxicity:
    terms: list[str]
    weights: list[float]
    intercept: float
    label_model: LabelModel | None = None

    def score_hits(self, h: Hits) -> float:
        m = self.intercept + sum(w * x for w, x in zip(self.weights, features(h), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))


def _pattern_counts(documents: DataFrame, terms: list[str]) -> DataFrame:
    lexicon = Lexicon(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[float]] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                h = lexicon.hits(text)
                key = votes(h)
                own = held.setdefault(key, [0.0] * (1 + FEATURES))
                own[0] += 1
                for i, x in enumerate(features(h)):
                    own[1 + i] += x
        codes = [sum(1 << i for i, x in enumerate(key) if x) for key in held]
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(codes, pa.int64()), "n": pa.array([v[0] for v in held.values()], pa.float64()),
                                          "x": pa.array([v[1:] for v in held.values()], pa.list_(pa.float64()))})

    partial = documents.select("text").mapInArrow(count, "pattern long, n double, x array<double>")
    return partial.groupBy("pattern").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("x")[i]) for i in range(FEATURES))).alias("x"))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """The lexicon comes from at most ``sample`` labelled documents outside the fold crc32(doc_id) mod 5 = 0.

    Votes are counted over all documents: there are at most 2^13 patterns of votes, whatever the corpus, so what the
    driver gathers is bounded. The classifier is fitted on the patterns' mean features and posteriors, weighted by
    their numbers of documents.
    """
    terms = learn_lexicon(labelled_sample(documents, labels, "toxic", 5, 0, sample))
    if not terms:
        return Toxicity([], [0.0] * FEATURES, -5.0)
    rows = sorted(tuple(r) for r in _pattern_counts(documents, terms).collect())
    v = np.array([[r[0] >> i & 1 for i in range(VOTERS)] for r in rows], float).reshape(-1, VOTERS)
    n = np.array([r[1] for r in rows])
    if not len(rows):
        return Toxicity([], [0.0] * FEATURES, -5.0)
    model = fit_label_model(v, n)
    x = np.array([r[2] for r in rows]) / n[:, None]
    w, b = boosting.logistic(x, model.posterior(v), n, ridge=1e-4, steps=800)
    return Toxicity(terms, [float(a) for a in w], b, model)


def score_toxicity(documents: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts score as a text without any hit."""
    lexicon = Lexicon(model.terms)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score_hits(lexicon.hits(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(documents, train(documents, labels))
