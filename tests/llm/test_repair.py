"""Conversation repair against a plain search over all edit sequences."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from eventframe.llm import audit, repair

SPACE = " \t\n\x0b\x0c\r"


def cost_of(letters, rows):
    """Cost of an edit sequence over (initial, fault) rows, or None where it is not allowed; with the roles it gives."""
    cost, at, roles = 0, 0, ""
    for c in letters:
        due = "a" if roles.endswith("u") else "u"
        if c == "I":
            cost, roles = cost + 2, roles + due
            continue
        if at == len(rows):
            return None
        initial, fault = rows[at]
        at += 1
        if c == "D":
            cost += 3
        elif fault in (audit.BLANK, audit.DUPLICATE):
            return None
        else:
            cost += (fault == audit.TRUNCATED) + (2 if c == "R" else 0)
            roles += due if c == "R" else initial
    return cost if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles) else None


def search(rows):
    best = None
    for n in range(len(rows) + 4):
        for letters in product("DIKR", repeat=n):
            if letters.count("I") <= 3:
                c = cost_of(letters, rows)
                if c is not None:
                    best = min(best or (c, "~"), (c, "".join(letters)))
    return best


def plain(rows):
    """The same by least strings per state, for longer conversations."""
    def closed(best):
        for s, e in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if s in best:
                best[e] = min(best.get(e, (1 << 60, "")), (best[s][0] + 2, best[s][1] + "I"))
        return best
    best = closed({0: (0, "")})
    for initial, fault in rows:
        new = {}
        for s, (c, t) in best.items():
            moves = [(s, 3, "D")]
            if fault not in (audit.BLANK, audit.DUPLICATE):
                extra = fault == audit.TRUNCATED
                moves.append(({0: 2, 1: 2, 3: 2, 2: 3}[s], 2 + extra, "R"))
                if (s, initial) in {(0, "s"), (0, "u"), (1, "u"), (3, "u"), (2, "a")}:
                    moves.append(({"s": 1, "u": 2, "a": 3}[initial], extra, "K"))
            for e, more, letter in moves:
                new[e] = min(new.get(e, (1 << 60, "")), (c + more, t + letter))
        best = closed(new)
    return min(best[s] for s in (0, 3) if s in best)


def solved(rows, cuts=()):
    best, stretch = audit.begin(audit.NOTHING), None
    bounds = [0, *cuts, len(rows)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        stretch = audit.Stretch(best={s: audit.begin(s) for s in range(4)})
        for initial, fault in rows[a:b]:
            stretch.add(None, initial, fault)
        best = audit.joined(best, {(s, e): (c, t) for s, e, c, t in stretch.ways()})
    return audit.finished(best)


def test_least_edits_against_all_sequences():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice([0, 1, 2, 3, 3, 3])) for _ in range(rng.randrange(0, 5))]
        assert search(rows) == plain(rows) == solved(rows)


def test_stretches_join_to_the_whole():
    rng = random.Random(5)
    for n in (7, 40, 300):
        for _ in range(20):
            rows = [(rng.choice("suuuaaax"), rng.choice([0, 1, 2, 3, 3, 3, 3])) for _ in range(n)]
            cuts = sorted(rng.randrange(n) for _ in range(rng.randrange(4)))
            assert solved(rows, cuts) == plain(rows)


def test_ties_by_longest_common_prefix(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(audit, "_MOD", 5)       # hashes collide all the time and have to be verified
    words = ["", "a", "b", "ab", "ba", "aab", "abab"]
    for _ in range(500):
        nodes = []
        for _ in range(2):
            node = audit.ROOT
            for _ in range(rng.randrange(9)):
                node = audit.Node(node, rng.choice(words[1:]))
            nodes.append(node)
        a, b = nodes
        assert audit.same(a, b) == (audit.text(a) == audit.text(b))
        assert audit.less(a, b) == (audit.text(a) < audit.text(b))


def expected(table):
    """The contract, row by row in Python; table: (conv, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, [])
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        role0, text0 = role or " " if role is None else role, " " if text is None else text
        text1 = "" if f == 1 else re.sub("[.!?]", "", text0) if f == 2 else text0
        groups[conv] += [(turn, role0, text0, "user" if f == 4 else role0, text1)] * (2 if f == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, _, _, role, text in rows:
            body = text.rstrip(SPACE)
            faults.append(0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3)
            seen.add((role, text))
        given = [r[0] for r in rows if r[0] is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        initials = [r[3][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters = plain(list(zip(initials, faults)))
        lines, at = [], 0
        for c in letters:
            due = "assistant" if lines and lines[-1].startswith("u") else "user"
            if c == "I":
                lines.append(due + ":")
                continue
            if c != "D":
                lines.append(f"{rows[at][3] if c == 'K' else due}:{rows[at][4]}")
            at += 1
        out[conv] = (gaps, faults.count(0), faults.count(1), faults.count(2), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("stretch", [4096, 3])
def test_repair_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rng = random.Random(7)
    says = ["Yes.", "no", "What?  ", "", " \n", "ok!\t", "a b c", None, "é.", "Same."]
    table = []
    for conv in [*range(80), None]:
        turn = 0
        for _ in range(rng.randrange(1, 12) if conv != 7 else 400):
            table.append((conv, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(says) if conv != 7 else f"t{turn % 300}."))
            turn += rng.choice([1, 1, 1, 2])
    # Rows without a turn have no order of their own among each other: keep one a conversation.
    seen, rows = set(), []
    for r in table:
        if r[1] is not None or r[0] not in seen:
            rows.append(r)
        if r[1] is None:
            seen.add(r[0])
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, cost int, audit int").repartition(6)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(df, damage=True).collect()}
    assert got == expected(rows)


def test_repaired_turns_match_the_digest(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "And?"), (2, 0, "user", " "), (3, 5, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    taken = repair.turns(df)
    audited = repair.conversation_audits(taken, df)
    assert {r["conv_id"]: r["audit"] for r in audited.collect()} == {1: "KRK", 2: "D", 3: "KI"}
    turns = {}
    for r in sorted(repair.repaired_turns(taken, audited).collect(), key=lambda r: (r["conv_id"], r["position"])):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    shas = {r["conv_id"]: r["repaired_sha256"] for r in repair.digest(taken, audited).collect()}
    assert all(hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() == s for c, s in shas.items())


def test_repair_awkward(spark):
    kinds = "conv_id long, turn int, role string, text string"
    assert repair.repaired(spark.createDataFrame([], kinds), damage=True).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = repair.repaired(spark.createDataFrame([(dropped, 0, "user", "Hi."), (None, None, None, None), (5, 3, "user", "x. " * 100_000)], kinds), damage=True)
    rows = {r["conv_id"]: r for r in out.collect()}
    assert tuple(rows[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and set(rows) == {dropped, None, 5}
