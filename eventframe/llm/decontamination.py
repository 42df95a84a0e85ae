"""Benchmark decontamination: size-partitioned MinHash containment search for short items inside long documents.

A whole document is so much larger than an item that their Jaccard similarity says nothing. So items are partitioned by
size, and for each partition a document is seen as overlapping windows hardly larger than the items of that partition: an
item of 2^s to 2^(s+1) shingles that occurs in the document lies in a window of 3 * 2^s shingles, and one that is contained
to 80 % has a Jaccard similarity of at least 0.25 with that window. Window and item then share one of 48 hash minima but for
one case in a million. Items under 8 shingles meet windows of a single shingle, which misses none of their shingles. Items
and documents of fewer words than a shingle count as one sequence, so an item of 1 to 4 words is only found in a document that
consists of exactly these words, never inside a longer one. A candidate is verified on the shingles of the whole document: the share of the item's distinct shingles that occur anywhere in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words

SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 48
TINY = 8                        # items with fewer shingles are looked up by each of these
BLOCK_SHINGLES = 1_000_000      # shingles of the items that one pass over the documents looks for
BLOCK_ITEMS = 50_000


SLICE = 1 << 14                 # shingles of a document that are hashed together
FILTER_BITS = 22                # a bit map over the high bits of the wanted values spares most look-ups


@dataclass
class Items:
    """A block of items: the distinct shingles of each, and the sorted values to look for with the item of each.

    Values of all partitions and hash functions are kept together: a hit of an item by a window of another partition, or
    under another function, is one more candidate for the exact check.
    """

    ids: list
    sets: list[np.ndarray]
    sizes: list[int]            # the size partitions in use, as exponents
    values: np.ndarray
    items: np.ndarray
    tiny: bool

    def __post_init__(self) -> None:
        self.map = np.zeros(1 << FILTER_BITS, bool)
        self.map[self.values >> np.uint64(64 - FILTER_BITS)] = True

    def hit(self, probes: np.ndarray) -> np.ndarray:
        """Items with a value among the probes."""
        probes = np.unique(probes[self.map[probes >> np.uint64(64 - FILTER_BITS)]])
        low, high = np.searchsorted(self.values, probes, side="left"), np.searchsorted(self.values, probes, side="right")
        found = [self.items[s:e] for s, e in zip(low, high, strict=True) if s < e]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def sketch(rows: list[tuple], k: int) -> Items:
    sets = [np.unique(s) for s in words.shingles(pa.array([r[1] for r in rows], pa.large_string()), k)]
    a, b = words.hash_functions(HASHES, 1)
    values, items, sizes, tiny = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], set(), False
    for i, own in enumerate(sets):
        if len(own):
            if len(own) < TINY:
                tiny = True
                values.append(own)
            else:
                sizes.add(len(own).bit_length() - 1)
                values.append(np.min(own[:, None] * a + b, axis=0))
            items.append(np.full(len(values[-1]), i))
    flat, owner = np.concatenate(values), np.concatenate(items)
    order = np.argsort(flat, kind="stable")
    return Items([r[0] for r in rows], sets, sorted(sizes), flat[order], owner[order], tiny)


def candidates(s: np.ndarray, block: Items, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Items that share a hash minimum with a window of the document's shingles ``s``."""
    probes = [s] if block.tiny else []
    if block.sizes:
        level = block.sizes[0]
        minima = np.concatenate([
            np.minimum.reduceat(part[:, None] * a + b, np.arange(0, len(part), 1 << level), axis=0)
            for part in (s[i:i + max(SLICE, 1 << level)] for i in range(0, len(s), max(SLICE, 1 << level)))])
        for p in block.sizes:
            while level < p:            # blocks of twice the length
                pairs = minima[:len(minima) // 2 * 2]
                minima = np.concatenate([np.minimum(pairs[::2], pairs[1::2]), minima[len(pairs):]])
                level += 1
            if len(minima) > 2:
                window = np.minimum(np.minimum(minima[:-2], minima[1:-1]), minima[2:])
            else:
                window = minima.min(axis=0)
            probes.append(window.ravel())
    return block.hit(np.concatenate(probes)) if probes else np.zeros(0, np.int64)


def search(documents: DataFrame, block: Items, k: int, containment: float) -> DataFrame:
    """(doc_id, item, shared) for every row and item of the block that is contained in it; no shuffle."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    a, b = words.hash_functions(HASHES, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, item, shared = [], [], []
            for i, s in enumerate(words.shingles(batch.column("text"), k)):
                if not len(s):
                    continue
                close = candidates(s, block, a, b)
                if len(close):
                    own = np.unique(s)
                    for c in close.tolist():
                        both = int(np.isin(block.sets[c], own, assume_unique=True).sum())
                        if both >= containment * len(block.sets[c]) - 1e-9:
                            at.append(i)
                            item.append(c)
                            shared.append(both)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(item, pa.int32()), pa.array(shared, pa.int64())],
                                             ["doc_id", "item", "shared"])

    return documents.select("doc_id", "text").mapInArrow(words.tidy(run), f"doc_id {kind}, item int, shared long")


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, in the order of their ids; null and empty texts are never contained."""
    held, size = [], 0
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += r["text"].count(" ") + 1
        if size >= BLOCK_SHINGLES or len(held) >= BLOCK_ITEMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(documents: DataFrame, benchmark: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: all pairs of a row and an item contained in it.

    n_item is the number of the item's distinct shingles, n_shared how many of them the document has. What goes to each
    task is one block of items, bounded by BLOCK_SHINGLES; a larger benchmark takes more passes over the documents.
    An item of fewer than ``k`` words is contained only in a document of exactly these words. Repeated rows or items give repeated pairs; null and empty texts give none; an empty benchmark gives no rows.
    """
    kinds = {c: f.dataType.simpleString() for c, f in (("doc_id", documents.schema["doc_id"]), ("item_id", benchmark.schema["item_id"]))}
    spark: SparkSession = documents.sparkSession
    out = spark.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_item long, n_shared long, containment double")
    for rows in blocks(benchmark):
        block = sketch(rows, k)
        names = spark.createDataFrame([(i, x, len(s)) for i, (x, s) in enumerate(zip(block.ids, block.sets, strict=True))],
                                      f"item int, item_id {kinds['item_id']}, n_item long")
        hits = search(documents, block, k, containment).join(F.broadcast(names), "item")     # at most BLOCK_ITEMS rows
        out = out.unionByName(hits.select("doc_id", "item_id", "n_item", F.col("shared").alias("n_shared"), (F.col("shared") / F.col("n_item")).alias("containment")))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The rows that contain no item, with all their columns; one pass over the documents per block of items, no shuffle."""
    a, b = words.hash_functions(HASHES, 1)
    out = documents
    for rows in blocks(benchmark):
        block = sketch(rows, k)

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for s in words.shingles(batch.column("text"), k):
                    close = candidates(s, block, a, b) if len(s) else ()
                    own = np.unique(s) if len(close) else s
                    keep.append(not any(np.isin(block.sets[c], own, assume_unique=True).sum() >= containment * len(block.sets[c]) - 1e-9 for c in close))
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(words.tidy(run), out.schema)
    return out
