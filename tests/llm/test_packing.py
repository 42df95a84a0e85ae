"""Mixture-controlled packing against a plain reading of its rules."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventframe.llm import packing

SF = "/root/testdata/sf0.1"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def simulate(phases, length):
    """Walk through all rounds: tokens per queue and window."""
    out = []
    for p in phases:
        for w in range(p.rounds):
            out.append({q: p.had(s, w + 1, length) - p.had(s, w, length) for s, q in enumerate(p.names)})
    return out


@pytest.mark.parametrize("totals", [{"a": 100_000, "b": 3_000, "c": 777, "d": 40_001}, {"a": 5}, {"a": 1024}, {"a": 1023, "b": 1}, {}])
def test_schedule_serves_everything_in_full_windows(totals):
    windows = simulate(packing.schedule(totals, totals, 1024), 1024)
    assert all(min(w.values()) >= 0 for w in windows)
    assert all(sum(w.values()) == 1024 for w in windows[:-1])
    served = {q: sum(w.get(q, 0) for w in windows) for q in totals}
    assert served == totals
    whole = sum(totals.values())
    assert len(windows) == -(-whole // 1024)
    for n in range(1, len(windows) - 3):     # the carried deficit of a queue stays below a token
        for q, total in totals.items():
            assert abs(sum(w.get(q, 0) for w in windows[:n]) - n * 1024 * total / whole) < 1


def test_weights_hold_until_a_queue_runs_dry():
    totals, weights = {"a": 9_000, "b": 50_000, "small": 700}, {"a": 3, "b": 1, "small": 1}
    windows = simulate(packing.schedule(totals, weights, 1000), 1000)
    assert all(w["a"] == 600 and w["b"] == 200 and w["small"] == 200 for w in windows[:3])
    assert {q: sum(w.get(q, 0) for w in windows) for q in totals} == totals
    assert all(sum(w.values()) == 1000 for w in windows[:-1])


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    model = Tokenizer.from_file(VOCABULARY)
    encoder = packing.Encoder(VOCABULARY, public_tokenizers.PATTERN)
    alphabet = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "​", "a", "can't", "12", "é", "🙂", "!", "<|endoftext|>", "x" * 30, "᠎", "﻿"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [encoder(t) for t in texts] == want


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_encoder_equals_the_tokenizer_on_documents(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    model = Tokenizer.from_file(VOCABULARY)
    encoder = packing.Encoder(VOCABULARY, public_tokenizers.PATTERN)
    assert [encoder(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]


def check(rows, documents, length=1024):
    """The contract, read plainly."""
    model = Tokenizer.from_file(VOCABULARY)
    encoded = sorted((d, [*model.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in documents)
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for d, ids in encoded:
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    fill = [sum(r["length"] for r in p) for _, p in sorted(sequences.items())]
    assert set(fill[:-1]) <= {length} and sorted(sequences) == list(range(len(fill)))


def test_packing_against_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i in range(400):
        source = rng.choice(["hot"] * 6 + ["b", "c", None])
        docs.append((i, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(0, 300))), source))
    docs += [(1000 + i, "tiny", f"rare{i}") for i in range(60)] + [(2000, None, "b"), (2001, "", None), (2002, "long " * 20_000, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    pieces = packing.packed(df, VOCABULARY, public_tokenizers.PATTERN).cache()
    check(packing.digest(pieces).collect(), [(d, t) for d, t, _ in docs])
    shares = {}
    for r in packing.mixture(pieces, df).collect():
        shares.setdefault(r["source"], {})[r["sequence_id"]] = r["tokens"]
    whole = sum(sum(s.values()) for s in shares.values())
    last = max(max(s) for s in shares.values())
    for source in ("hot", "b", "c", None):
        quantum = 1024 * sum(shares[source].values()) / whole
        assert all(abs(shares[source].get(w, 0) - quantum) <= 2 for w in range(last - 3))


def test_packing_awkward(spark):
    rows = [(None, "a b", None), (None, "a b", None), (3, "same", "s"), (3, "same", "s"), (4, None, "s")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, source string, offset int, ids int")
    out = packing.digest(packing.packed(df, VOCABULARY, public_tokenizers.PATTERN)).collect()
    assert sum(r["length"] for r in out) == 3 + 3 + 2 + 2 + 1
    assert sorted(r["offset"] for r in out)[0] == 0 and {r["sequence_id"] for r in out} == {0}
    assert packing.packed(df.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
