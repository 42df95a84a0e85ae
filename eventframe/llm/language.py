"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the 300 most frequent n-grams (1 to 3 letters, with one mark for any gap between words) in order of
frequency. A document's own profile is compared with each language's: every n-gram adds the difference of its two
ranks, or the profile length where the language lacks it. The language with the least sum is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out
from .words import tidy

PROFILE = 300
UNKNOWN = "und"
CHUNK_CHARS = 1_000_000     # characters whose n-grams are sorted together
FLUSH = 250_000           # distinct n-grams a training task holds before it hands them on
SHARPNESS = 25.0            # how fast the score falls with a language's distance


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def sequence(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; every stretch of other characters, and both ends, become one 1."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    seq = np.where(_letters()[points], points, 1).astype(np.int64)
    seq = np.concatenate([[1], seq, [1]])
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != 1) | (seq[:-1] != 1)
    return seq[keep]


def grams(seq: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams: 21 bits a letter, so that n-grams of different length never coincide."""
    two = (seq[:-1] << 21) | seq[1:]
    inner = seq[1:-1] != 1
    three = ((two[:-1] << 21) | seq[2:])[inner]
    return np.concatenate([seq[seq != 1], two, three])


def top(codes: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The ``n`` most frequent codes, most frequent first, ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:n]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush(lang: str, parts: list) -> pa.RecordBatch:
        codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": codes, "n": n})

    def add(lang: str, texts: list[str]) -> None:
        codes, n = np.unique(grams(sequence(" ".join(texts))), return_counts=True)
        held.setdefault(lang, []).append((codes, n))

    waiting: dict[str, tuple[int, list[str]]] = {}
    for batch in batches:
        for text, lang in zip((t.as_py() for t in batch.column("text")), batch.column("lang").to_pylist(), strict=True):
            size, texts = waiting.get(lang, (0, []))
            texts.append(text)
            waiting[lang] = (size + len(text), texts)
            if size + len(text) >= CHUNK_CHARS:
                add(lang, waiting.pop(lang)[1])
                if sum(len(p[0]) for p in held[lang]) > FLUSH:
                    yield flush(lang, held.pop(lang))
    for lang, (_, texts) in waiting.items():
        add(lang, texts)
    for lang, parts in held.items():
        yield flush(lang, parts)


def profiles(documents: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) from (text, lang) rows; rows with a null text or language teach nothing."""
    known = documents.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = (known.mapInArrow(tidy(_count), "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counts.select("lang", "gram", (F.row_number().over(order) - 1).alias("rank"))
            .where(F.col("rank") < size))


class Profiles:
    """All profiles as one matrix of ranks: rows are languages, columns the n-grams that occur in any of them."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for lang, gram, rank in rows:
            self.ranks[self.langs.index(lang), np.searchsorted(self.codes, gram)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and its share among all; ties go to the first language by name."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        seq = sequence(text)
        if not (seq != 1).any():
            return UNKNOWN, 0.0
        own = top(grams(seq), self.size)
        place = np.searchsorted(self.codes, own)
        place[(place == len(self.codes)) | (self.codes[np.minimum(place, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[:, place]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(1) / (self.size * len(own))
        share = np.exp(-SHARPNESS * (away - away.min()))
        best = int(np.argmin(away))
        return self.langs[best], float(share[best] / share.sum())


def learn(documents: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of all (text, lang) rows; the result has ``size`` rows per language, whatever the corpus."""
    return Profiles([tuple(r) for r in profiles(documents, size).collect()], size)


def identify(documents: DataFrame, model: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row. Null texts and texts without a letter are ``und`` with score 0."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(tidy(predict), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: Profiles) -> DataFrame:
    """The rows, with all their columns, whose language is not ``und``; one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.predict(t.as_py())[0] != UNKNOWN for t in batch.column("text")], pa.bool_()))

    return documents.mapInArrow(tidy(run), documents.schema)


def teachers(documents: DataFrame) -> DataFrame:
    """The rows languages may be learned from: a remainder of crc32(doc_id) mod 4 other than 2."""
    return documents.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))


def language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; profiles come from the documents outside the fold.

    Repeated rows each get a row; an empty table gives an empty one; other columns are not looked at. If no document
    teaches a language, every prediction is ``und``.
    """
    return identify(documents, learn(teachers(documents))).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
