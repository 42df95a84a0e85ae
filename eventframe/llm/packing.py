"""Mixture-controlled packing: deficit round-robin over the sources' token queues fills windows of one length.

A document's tokens are its ids plus one separator. All tokens of a source, in storage order, are its queue. In every
round each queue is served once, in a fixed order, with its quantum: the window length times the queue's weight over the
sum of weights. A round's service is whole tokens; what is left of the quantum is the queue's deficit (or credit), carried
into the next round. Rounding is shared by neighbouring queues - after w rounds the first s queues together have had
floor(w * length * weight of those s / all weights) tokens - so every round serves exactly one window, no queue is ever a
token off its quantum, and a queue's deficit after any number of rounds is known without walking through them. That is
what carries deficits across windows and partitions: a task finds the window, offset and deficit of any queue position by
arithmetic on integers, and no task sees more than its own documents.

When a queue runs dry the others share on with their weights (a new phase). Windows that the quanta of the remaining queues
cannot fill take the rest from whatever is left, in order. Only the very last window is short.

A queue needs a quantum of a token or more, so there are at most ``length`` of them. All smaller sources share one queue, in
which they are interleaved by storage order.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored

LENGTH = 1024
SEPARATOR = 0
BATCH_CHARS = 2_000_000     # characters handed on together; a longer text is handed on alone
KNOWN_PARTS = 500_000       # parts of texts whose ids a worker remembers
LONG_PART = 64              # characters beyond which a part is not remembered
STARTS = 500_000            # rows of queue starts (some 50 bytes each) up to which they are broadcast, else joined
SMALL = "small"             # name of the queue of the sources with less than a token a window


@dataclass
class Phase:
    """Windows ``first`` on, ``rounds`` of them, in which the queues ``names`` with running sums of weights ``upto`` are served.

    ``served`` tokens of each queue went before. Without rounds it is one window with the given ``amounts``.
    """

    first: int
    rounds: int
    names: list[str]
    served: dict[str, int]
    upto: list[int] = field(default_factory=list)
    amounts: list[int] = field(default_factory=list)

    def after(self, s: int, w: int, length: int) -> int:
        """Tokens the first ``s`` queues have had in this phase after ``w`` rounds."""
        if self.amounts:
            return sum(self.amounts[:s]) * min(w, 1)
        return w * length * self.upto[s] // self.upto[-1]

    def had(self, s: int, w: int, length: int) -> int:
        return self.after(s + 1, w, length) - self.after(s, w, length)


def schedule(totals: dict[str, int], weights: dict[str, int], length: int = LENGTH) -> list[Phase]:
    """The phases that serve all tokens of all queues. Queues are served in the order of ``totals``; there are at most ``length``."""
    left = {q: n for q, n in totals.items() if n > 0}
    served = dict.fromkeys(left, 0)
    phases: list[Phase] = []
    window = 0
    while left:
        names = list(left)
        upto = [0]
        for q in names:
            upto.append(upto[-1] + weights[q])
        phase = Phase(window, 1 << 62, names, {q: served[q] for q in names}, upto)
        for s, q in enumerate(names):       # the most rounds after which no queue has been asked for more than it holds
            low, high = 0, left[q] * upto[-1] // (length * weights[q]) + 2
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if phase.had(s, middle, length) <= left[q] else (low, middle - 1)
            phase.rounds = min(phase.rounds, low)
        if phase.rounds == 0:               # one window by what there is: the quanta first, then the rest in order
            amounts = [min(left[q], phase.had(s, 1, length)) for s, q in enumerate(names)]
            spare = length - sum(amounts)
            for s, q in enumerate(names):
                more = min(spare, left[q] - amounts[s])
                amounts[s], spare = amounts[s] + more, spare - more
            phase.rounds, phase.amounts = 1, amounts
        phases.append(phase)
        window += phase.rounds
        for s, q in enumerate(names):
            n = phase.had(s, phase.rounds, length)
            served[q] += n
            left[q] -= n
            if not left[q]:
                del left[q]
    return phases


def stretches(phases: list[Phase], length: int = LENGTH) -> dict[str, list[tuple[int, int, Phase, int]]]:
    """For every queue the (first token, end, phase, place in the round) of the phases that serve it."""
    out: dict[str, list[tuple[int, int, Phase, int]]] = {}
    for phase in phases:
        for s, q in enumerate(phase.names):
            n = phase.had(s, phase.rounds, length)
            if n:
                out.setdefault(q, []).append((phase.served[q], phase.served[q] + n, phase, s))
    return out


def cuts(served: list[tuple[int, int, Phase, int]], at: int, n: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(start, size, window, offset) of the pieces that tokens ``at`` to ``at + n`` of a queue fall into."""
    here, end = at, at + n
    for base, last, phase, s in served[max(0, bisect_right(served, at, key=lambda x: x[0]) - 1):]:
        if here >= end:
            return
        low, high = 0, phase.rounds - 1     # the round that serves the next token
        if not phase.amounts:
            guess = (here - base) * phase.upto[-1] // (length * (phase.upto[s + 1] - phase.upto[s]))
            low, high = max(0, min(guess - 3, high)), max(0, min(guess + 3, high))
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if base + phase.had(s, middle + 1, length) > here else (middle + 1, high)
        w, before = low, base + phase.had(s, low, length)
        while here < min(end, last):
            upto = base + phase.had(s, w + 1, length)
            size = min(upto, end) - here
            if size > 0:
                ahead = phase.after(s, w + 1, length) - phase.after(s, w, length)
                yield here - at, size, phase.first + w, ahead + here - before
                here += size
            w, before = w + 1, upto


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, others from 256 on."""
    printable = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of texts as the tokenizer file gives them, as little-endian unsigned 32-bit numbers.

    Pre-tokens never hold a space behind a character that is not white space, so a text may be cut before such spaces and
    its parts encoded one by one. Parts that come again are looked up; the memory of parts is emptied when it is full. Byte pairs
    of a part are merged by tiktoken, with the ranks of the same file (the ids of a byte-level vocabulary are in the order of its
    merges), which gives the ids of ``tokenizers`` in a third of the time; parts with an added token go through ``tokenizers``.
    """

    SPACES = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200c))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
    RUNS = tuple(c + " " for c in SPACES)
    CUT = re.compile(f"(?<![{SPACES}]) ")

    def __init__(self, tokenizer: str, pattern: str):
        super().__init__()
        self.model = Tokenizer.from_file(tokenizer)
        added = {t.content for t in self.model.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or "(?!)")
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in self.model.get_vocab(with_added_tokens=False).items() if t not in added}
        self.merge = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        ids = self.encoded(" " + part)
        if len(part) <= LONG_PART:
            if len(self) >= KNOWN_PARTS:
                self.clear()
            self[part] = ids
        return ids

    def encoded(self, text: str) -> bytes:
        ids = self.model.encode(text, add_special_tokens=False).ids if self.added.search(text) else self.merge(text)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        first, *parts = self.CUT.split(text) if any(c in text for c in self.RUNS) else text.split(" ")
        return self.encoded(first) + b"".join(map(self.__getitem__, parts))


@lru_cache(maxsize=1)
def encoder(tokenizer: str, pattern: str) -> Encoder:
    """One for all tasks that a worker process runs."""
    return Encoder(tokenizer, pattern)


def tokenized(documents: DataFrame, tokenizer: str, pattern: str, source: str = "source", separator: int = SEPARATOR) -> DataFrame:
    """doc_id, queue, part, at, n, ids: each document's ids (with the separator) as little-endian unsigned 32-bit numbers.

    ``part`` is the task that encoded it, ``at`` the tokens of the same source before it in that task, ``n`` its tokens.
    Null texts count as empty; a null source is a source of its own.
    """
    end = np.array([separator], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(tokenizer, pattern)
        part = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            sizes = np.cumsum(batch.column("_chars").to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + BATCH_CHARS, side="right")))
                rows = batch.slice(i, j - i)
                i = j
                ids = [encoded(x) + end for x in rows.column("text").to_pylist()]
                n = [len(x) // 4 for x in ids]
                at = []
                for q, k in zip(rows.column("queue").to_pylist(), n, strict=True):
                    at.append(seen.get(q, 0))
                    seen[q] = at[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("queue"), pa.array([part] * len(n), pa.int64()), pa.array(at, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "queue", "part", "at", "n", "ids"])

    # A letter before the name keeps a null source apart from every named one, and all of them apart from SMALL.
    queue = F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    rows = documents.select("doc_id", queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("_chars", F.length("text")).mapInArrow(encode, f"doc_id {kind}, queue string, part long, at long, n long, ids binary")


def packed(documents: DataFrame, tokenizer: str, pattern: str, length: int = LENGTH, weights: dict[str | None, int] | None = None,
           source: str = "source", separator: int = SEPARATOR) -> DataFrame:
    """Every piece of every document: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``weights`` are the target proportions of tokens by source (positive integers); by default a source's share of all tokens,
    so that all queues run dry together. Sources whose share of a window is below one token share a queue; sources not named in
    ``weights`` are in it too, and without a small named source it has the weight 1.

    Null texts are documents of one separator; null and repeated ids are kept, each row is a document of its own; repeated
    rows are interchangeable. An empty table gives none. Other columns are not read. Which of a source's documents come
    first is the order they are stored in.
    """
    tokens = stored(tokenized(documents, tokenizer, pattern, source, separator), "packing-tokens")
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("_n"))
    totals = parts.groupBy("queue").agg(F.sum("_n").alias("total"))
    spark = documents.sparkSession
    whole = totals.agg(F.sum("total")).first()[0] or 0
    if weights is None:
        large = F.col("total") * length >= whole
    else:
        named = {("n" if k is None else "s") + (k or ""): int(v) for k, v in weights.items()}
        least = sum(named.values())
        large = F.col("queue").isin([q for q, v in named.items() if v * length >= least])
    # At most `length` rows: each has a share of at least 1 / length.
    main = {r["queue"]: r["total"] for r in totals.where(large).orderBy("queue").collect()}
    shares = dict(main) if weights is None else {q: named[q] for q in main}
    rest = whole - sum(main.values())
    if rest:
        main[SMALL] = rest
        shares[SMALL] = rest if weights is None else max(1, sum(named.values()) - sum(shares.values()))
    phases = schedule(main, shares, length)

    queue = F.when(F.col("queue").isin([q for q in main if q != SMALL]), F.col("queue")).otherwise(F.lit(SMALL))
    parts = stored(parts.withColumn("_queue", queue), "packing-parts")
    # Tokens before a task's, then, in the shared queue, before a source's in the task: no window holds more than a row a task.
    earlier = Window.partitionBy("_queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_queue", "part").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    tasks = parts.groupBy("_queue", "part").agg(F.sum("_n").alias("_n")).withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    starts = parts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n").join(tasks, ["_queue", "part"])
    starts = starts.select("queue", "part", "_queue", (F.col("_earlier") + F.col("_ahead")).alias("_before"))
    rows = tokens.join(F.broadcast(starts) if parts.count() <= STARTS else starts, ["queue", "part"])
    rows = rows.select("doc_id", F.col("_queue").alias("queue"), (F.col("at") + F.col("_before")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        served = stretches(phases, length)
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            out: list[tuple] = []
            for doc, q, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "at", "n", "ids")), strict=True):
                for start, size, window, offset in cuts(served[q], at, n, length):
                    out.append((doc, start, size, ids[4 * start:4 * (start + size)], n, window, offset))
                    if len(out) == 50_000:
                        yield _pieces(out, kind)
                        out = []
            if out:
                yield _pieces(out, kind)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _pieces(rows: list[tuple], doc_id: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [doc_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def mixture(pieces: DataFrame, documents: DataFrame, source: str = "source") -> DataFrame:
    """sequence_id, source, tokens: what each sequence holds of each source (for documents with distinct ids)."""
    known = documents.select("doc_id", F.col(source).alias("source"))
    return pieces.join(known, "doc_id").groupBy("sequence_id", "source").agg(F.sum("length").alias("tokens"))
