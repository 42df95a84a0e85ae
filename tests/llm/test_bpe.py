"""Byte-pair encoding: tables and memory of a vocabulary against tiktoken."""

from __future__ import annotations

import gc
import random

import public_tokenizers
import regex
import tiktoken

from eventframe.llm import bpe


def test_pieces_of_all_lengths_and_remembered_strings():
    vocab = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.rank, special_tokens={})
    rng = random.Random(5)
    for a in range(256):
        for b in rng.sample(range(256), 8):
            assert vocab.byte_pairs[a << 8 | b] == vocab.pairs.get(int(vocab.byte[a]) * vocab.width + int(vocab.byte[b]), -1)
    letters = "abcdeinorst" * 4 + "éßя中😀\0\x85,.7"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [" ".join(word(rng.choice([1, 2, 3, 5, 8, 17, 48, 49, 130, 260, 700])) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += ["", " ", " a", "a \n b", "the  end ", "\0 \0"]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for _ in range(2):      # the second time from memory
        got = vocab.encode_texts(texts, pattern)
        assert [list(memoryview(ids).cast("i")) for ids in got] == [known.encode_ordinary(t) for t in texts]
    assert gc.isenabled()
    assert max(map(len, vocab.chunks.young)) <= bpe.MEMO_CHARS


def test_memory_keeps_what_was_used(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 2)
    memo = bpe.Memo()
    memo.known({"a", "b", "c"}).add({"a": b"1", "b": b"2", "c": b"3"})
    again = memo.known({"a", "d"})
    assert (again.found, again.missing) == ({"a": b"1"}, {"d"})
    assert (memo.young, memo.old) == ({"a": b"1"}, {"a": b"1", "b": b"2", "c": b"3"})
