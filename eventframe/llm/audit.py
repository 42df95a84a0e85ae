"""Cheapest edit sequences of a conversation, as persistent strings.

States of a conversation so far: nothing yet, a system turn, a user turn, an assistant turn. A row is kept, re-roled or deleted, and
turns may be inserted; of all sequences that lead to a state the cheapest counts, the ASCII-least of equally cheap ones. Sequences
share their beginnings: each is a linked node with a letter, binary-lifting ancestors and a rolling hash. Two of equal cost are
compared at the end of their longest common prefix, which the ancestors' hashes locate; equal hashes of different nodes are
verified letter by letter.

Cost and state only depend on the letters and the rows, so two different sequences of equal cost over the same rows are never
prefixes of each other. Hence the least sequence of a whole is made of least sequences of its parts: stretches of rows are
solved on their own, from every state to every state, and put together in order, again with shared nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

STATES = 4
NOTHING, SYSTEM, USER, ASSISTANT = range(STATES)
FINAL = (NOTHING, ASSISTANT)
#: Where a turn with this role initial leads; no entry: it may not stand there.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where a user or assistant turn of the repair's own leads: user first and after an assistant, assistant after a user.
OWN = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
KEEP, REROLE, DELETE, INSERT, UNTERMINATED = 0, 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)

_BASE, _MOD = 1_000_003, (1 << 61) - 1


class Node:
    """The string of the parent's letters and a piece of its own."""

    __slots__ = ("hash", "length", "piece", "up")

    def __init__(self, parent: Node | None, piece: str):
        self.piece = piece
        if parent is None:
            self.length, self.hash, self.up = 0, 0, []
            return
        self.length = parent.length + len(piece)
        h = parent.hash
        for c in piece.encode():
            h = (h * _BASE + c) % _MOD
        self.hash = h
        self.up = [parent]      # up[k]: the ancestor 2^k nodes above
        k = 0
        while k < len(self.up[k].up):
            self.up.append(self.up[k].up[k])
            k += 1

    @property
    def parent(self) -> Node | None:
        return self.up[0] if self.up else None


ROOT = Node(None, "")


def text(node: Node) -> str:
    out = []
    while node.up:
        out.append(node.piece)
        node = node.up[0]
    return "".join(reversed(out))


def _depth(node: Node) -> int:
    n = 0
    while node.up:
        k = len(node.up) - 1
        n += 1 << k
        node = node.up[k]
    return n


def _raised(node: Node, by: int) -> Node:
    k = 0
    while by:
        if by & 1:
            node = node.up[k]
        by, k = by >> 1, k + 1
    return node


def same(a: Node, b: Node) -> bool:
    """Whether two nodes spell the same string; the hash says no, or is verified along the pieces up to a shared node."""
    if a is b:
        return True
    if a.hash != b.hash or a.length != b.length:
        return False
    x, y = "", ""       # letters still to compare, of the side that is ahead
    while a is not b or x or y:
        if not x and a.up:
            x, a = a.piece, a.up[0]
        if not y and b.up:
            y, b = b.piece, b.up[0]
        n = min(len(x), len(y))
        if n == 0 or x[-n:] != y[-n:]:
            return False
        x, y = x[:-n], y[:-n]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether string a sorts before string b."""
    if a is b:
        return False
    da, db = _depth(a), _depth(b)
    x, y = _raised(a, max(0, da - db)), _raised(b, max(0, db - da))
    if same(x, y):
        return a.length < b.length
    for k in range(len(x.up) - 1, -1, -1):      # to the first nodes whose strings differ
        if k < len(x.up) and k < len(y.up) and not same(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    n = min(len(x.piece), len(y.piece))
    if x.piece[:n] != y.piece[:n]:
        return x.piece < y.piece
    return _tail(a, x) < _tail(b, y)


def _tail(node: Node, first: Node) -> str:
    """Letters from node ``first`` on."""
    out = [node.piece]
    while node is not first:
        node = node.up[0]
        out.append(node.piece)
    return "".join(reversed(out))


Best = list[tuple[int, Node] | None]


def _offer(best: Best, state: int, cost: int, parent: Node, piece: str) -> None:
    known = best[state]
    if known is not None and known[0] < cost:
        return
    node = Node(parent, piece) if piece else parent
    if known is None or cost < known[0] or less(node, known[1]):
        best[state] = (cost, node)


def _inserted(best: Best) -> Best:
    """With turns inserted behind; two in a row at most, as a third would lead where one does."""
    for state in (NOTHING, SYSTEM, ASSISTANT, USER):
        if best[state] is not None:
            cost, node = best[state]
            _offer(best, OWN[state], cost + INSERT, node, "I")
    return best


def begin(state: int) -> Best:
    best: Best = [None] * STATES
    best[state] = (0, ROOT)
    return _inserted(best)


def step(best: Best, initial: str, fault: int) -> Best:
    """The sequences with one more row."""
    new: Best = [None] * STATES
    extra = UNTERMINATED if fault == TRUNCATED else 0
    for state in range(STATES):
        if best[state] is None:
            continue
        cost, node = best[state]
        _offer(new, state, cost + DELETE, node, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        if (state, initial) in NEXT:
            _offer(new, NEXT[state, initial], cost + KEEP + extra, node, "K")
        _offer(new, OWN[state], cost + REROLE + extra, node, "R")
    return _inserted(new)


def joined(best: Best, ways: dict[tuple[int, int], tuple[int, str]]) -> Best:
    """The sequences with one more stretch of rows, given the best way through it from each state to each."""
    new: Best = [None] * STATES
    for (start, end), (cost, piece) in sorted(ways.items()):
        if best[start] is not None:
            _offer(new, end, best[start][0] + cost, best[start][1], piece)
    return new


def finished(best: Best) -> tuple[int, str]:
    """Cost and letters of the best complete sequence."""
    ends: Best = [None]
    for state in FINAL:
        if best[state] is not None:
            known, (cost, node) = ends[0], best[state]
            if known is None or cost < known[0] or cost == known[0] and less(node, known[1]):
                ends[0] = (cost, node)
    return ends[0][0], text(ends[0][1])


@dataclass
class Stretch:
    """Consecutive rows of a conversation: counts, what its edges show, and its best ways from state to state."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_initial: str | None = None
    last_initial: str | None = None
    best: dict[int, Best] | None = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.rows += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        if self.last_initial is None:
            self.first_initial = initial
        elif not legal(self.last_initial, initial):
            self.illegal += 1
        self.last_initial = initial
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        for start, best in self.best.items():
            self.best[start] = step(best, initial, fault)

    def ways(self) -> Iterator[tuple[int, int, int, str]]:
        for start, best in self.best.items():
            for end, found in enumerate(best):
                if found is not None:
                    yield start, end, found[0], text(found[1])


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")
