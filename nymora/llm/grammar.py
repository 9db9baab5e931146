"""Cheapest repairs of role sequences by a grammar: Re-Pair rules over many sequences, one min-plus transfer matrix a rule.

A sequence is a string of TERMINALS, one a turn. The language ``(s?(ua)+)?`` has four states: 0 nothing yet, 1 after s, 2 after u, 3 after a. A symbol's
matrix holds, for each pair of states, the least cost of taking its turns from one to the other and the ASCII-least string of edits (audit) of
that cost. Edits: K keeps a turn, R gives it the role that the state asks for, D deletes it, I inserts a turn of the role that the state asks for.

Audits are ropes: a rule's entry points at the state between its two halves. They are never compared as strings. Insertions stand before the edit of a
turn, so an entry's audit ends with an edit of its last turn and none is a beginning of another; hence the order of two audits follows from
the ranks of their first halves, then of their second halves, and each matrix keeps the ranks of its 16 entries, exact at any length.
"""

from __future__ import annotations

import numpy as np

STATES = 4
#: Turns by the initial of their role (s, u, a, or another: o); upper case: truncated; x: blank or repeated, must go.
TERMINALS = "suaoSUAOx"
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: State -> the state after a turn of the role that it asks for.
ASKED = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What brings a state to an accepting one.
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}
NEVER = 1 << 40


def _leaves() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(costs, ranks, audits) of the terminals; audits by ``16 * terminal + 4 * from + to``."""
    costs, ranks, audits = np.full((len(TERMINALS), STATES, STATES), NEVER, "int64"), np.full((len(TERMINALS), STATES, STATES), 15, "int64"), []
    for c, terminal in enumerate(TERMINALS):
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for start in range(STATES):
            at, spent, said = start, 0, ""
            for _ in range(STATES):
                moves = [(at, DELETE, "D")]
                if terminal != "x":
                    more = TRUNCATED if terminal.isupper() else 0
                    moves.append((ASKED[at], RENAME + more, "R"))
                    if at in KEEP.get(terminal.lower(), {}):
                        moves.append((KEEP[terminal.lower()][at], more, "K"))
                for to, cost, edit in moves:
                    one = (spent + cost, said + edit)
                    best[start, to] = min(best.get((start, to), one), one)
                at, spent, said = ASKED[at], spent + INSERT, said + "I"
        order = sorted({audit for _, audit in best.values()})
        for (start, to), (cost, audit) in best.items():
            costs[c, start, to], ranks[c, start, to] = cost, order.index(audit)
        audits += [best.get((i, j), (0, ""))[1] for i in range(STATES) for j in range(STATES)]
    return costs, ranks, audits


LEAF_COSTS, LEAF_RANKS, LEAF_AUDITS = _leaves()
CODES = np.full(128, -1, "int64")
CODES[[ord(c) for c in TERMINALS]] = range(len(TERMINALS))


def product(costs: np.ndarray, ranks: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(costs, ranks, states between) of the matrices ``left`` times ``right``: the least cost, then the least audit."""
    keys = ((costs[left][:, :, :, None] + costs[right][:, None, :, :]) << 8) | (ranks[left][:, :, :, None] << 4) | ranks[right][:, None, :, :]
    between = keys.argmin(2)
    best = np.take_along_axis(keys, between[:, :, None, :], 2)[:, :, 0, :]
    cost = np.minimum(best >> 8, NEVER)
    order = np.where(cost < NEVER, best & 255, 256).reshape(len(left), -1)
    places = order.argsort(1, kind="stable")
    fell = np.take_along_axis(order, places, 1)
    dense = np.zeros_like(order)
    np.put_along_axis(dense, places, np.cumsum(np.diff(fell, axis=1, prepend=fell[:, :1]) != 0, 1), 1)
    return cost, dense.reshape(cost.shape), between


class Grammar:
    """A Re-Pair grammar of ``sequences`` (strings of TERMINALS, none empty) and the matrices of its symbols.

    Each round counts the adjacent pairs of all sequences at once and replaces the most frequent ones that can't overlap; below ``share`` of the
    symbols a round costs more than its rules save. What is left of each sequence is then halved pair by pair, so every sequence is one symbol.
    """

    def __init__(self, sequences: list[str], share: float = 1 / 256):
        self.costs, self.ranks, self.between = LEAF_COSTS, LEAF_RANKS, np.zeros_like(LEAF_COSTS)
        self.left, self.right = np.zeros(len(TERMINALS), "int64"), np.zeros(len(TERMINALS), "int64")
        self.place: dict[str, int] = {}
        for s in sequences:
            self.place.setdefault(s, len(self.place))
        codes = CODES[np.frombuffer("\0".join([*self.place, ""]).encode("ascii"), "uint8")]
        if (codes < 0).sum() != len(self.place):
            raise ValueError(f"sequences are strings of {TERMINALS}")
        replaced = len(codes)
        while replaced and replaced >= share * len(codes):
            codes, replaced = self._round(codes)
        replaced = len(codes)
        while replaced:
            codes, replaced = self._halved(codes)
        self.roots = codes[codes >= 0]
        if len(self.roots) != len(self.place):
            raise ValueError("a sequence is empty")

    def _add(self, left: np.ndarray, right: np.ndarray) -> None:
        cost, rank, between = product(self.costs, self.ranks, left, right)
        self.costs, self.ranks, self.between = np.concatenate([self.costs, cost]), np.concatenate([self.ranks, rank]), np.concatenate([self.between, between])
        self.left, self.right = np.concatenate([self.left, left]), np.concatenate([self.right, right])

    def _round(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """(codes with the most frequent pairs replaced, number of places)."""
        size = len(self.left)
        pair = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * size + codes[1:], -1)
        kinds, counts = np.unique(pair[pair >= 0], return_counts=True)
        firsts, seconds, chosen = set(), set(), []
        for i in np.argsort(-counts, kind="stable").tolist():
            x, y = divmod(int(kinds[i]), size)
            if counts[i] < 2:
                break
            if x not in seconds and y not in firsts and (x != y or x not in firsts and y not in seconds):
                firsts.add(x)
                seconds.add(y)
                chosen.append(int(kinds[i]))
        if not chosen:
            return codes, 0
        chosen = np.sort(np.array(chosen, "int64"))
        which = np.searchsorted(chosen, pair).clip(max=len(chosen) - 1)
        held = chosen[which] == pair
        # Of a run x x x ... every second pair: those at even places after the run's begin.
        place = np.arange(len(pair))
        begins = np.maximum.accumulate(np.where(held & ~np.concatenate([[False], held[:-1] & (pair[1:] == pair[:-1])]), place, 0))
        held &= (place - begins) % 2 == 0
        at = np.flatnonzero(held)
        self._add(chosen // size, chosen % size)
        codes = codes.copy()
        codes[at] = size + which[at]
        return np.delete(codes, at + 1), len(at)

    def _halved(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """(codes with the first, third, ... pair of each sequence replaced, number of places)."""
        ends = np.flatnonzero(codes < 0)
        begin = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(len(codes)) - np.repeat(begin, ends + 1 - begin)
        at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0) & (place[:-1] % 2 == 0))
        if not len(at):
            return codes, 0
        size = len(self.left)
        kinds, which = np.unique(codes[at] * size + codes[at + 1], return_inverse=True)
        self._add(kinds // size, kinds % size)
        codes = codes.copy()
        codes[at] = size + which
        return np.delete(codes, at + 1), len(at)

    def matrices(self, sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(costs, ranks), 4 x 4 each, of the sequences."""
        roots = self.roots[[self.place[s] for s in sequences]] if sequences else np.zeros(0, "int64")
        return self.costs[roots], self.ranks[roots]

    def audits(self, asked: list[tuple[str, int, int]]) -> list[str]:
        """The audit of each (sequence, from, to); the ropes of all are unrolled together, a level at a time."""
        kinds = list(dict.fromkeys(asked))
        at = np.array([(self.roots[self.place[s]], i, j) for s, i, j in kinds], "int64").reshape(-1, 3)
        own = np.arange(len(at))
        while (inner := at[:, 0] >= len(TERMINALS)).any():
            begin = np.concatenate([[0], np.cumsum(1 + inner)])
            rule, i, j = at[inner].T
            k = self.between[rule, i, j]
            new = np.zeros((begin[-1], 3), "int64")
            new[begin[:-1][~inner]] = at[~inner]
            new[begin[:-1][inner]] = np.stack([self.left[rule], i, k], 1)
            new[begin[:-1][inner] + 1] = np.stack([self.right[rule], k, j], 1)
            at, own = new, np.repeat(own, 1 + inner)
        leaves = (16 * at[:, 0] + STATES * at[:, 1] + at[:, 2]).tolist()
        ends = np.searchsorted(own, np.arange(len(kinds)), "right").tolist()
        text = [LEAF_AUDITS[x] for x in leaves]
        said = {kind: "".join(text[a:b]) for kind, a, b in zip(kinds, [0, *ends], ends, strict=False)}
        return [said[x] for x in asked]


def alone(costs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, last state) of the cheapest way from state 0 through each matrix by itself."""
    keys = ((costs[:, 0, :] + [INSERT * len(CLOSING[t]) for t in range(STATES)]) << 8) | ranks[:, 0, :]
    to = keys.argmin(1)
    return keys[np.arange(len(to)), to] >> 8, to


def cheapest(costs: np.ndarray, ranks: np.ndarray) -> tuple[int, list[int]]:
    """(cost, states) of the cheapest way through a row of matrices (n x 4 x 4) from state 0: the state before each and after the last.

    The same product as within a grammar, folded from the left.
    """
    cost, rank = np.full(STATES, NEVER, "int64"), np.zeros(STATES, "int64")
    cost[0] = 0
    back = []
    for c, r in zip(costs, ranks, strict=True):
        keys = ((cost[:, None] + c) << 8) | (rank[:, None] << 4) | r
        k = keys.argmin(0)
        best = keys[k, range(STATES)]
        cost, tie = np.minimum(best >> 8, NEVER), best & 255
        rank = np.unique(tie, return_inverse=True)[1]
        back.append(k)
    to = min(range(STATES), key=lambda t: (int(cost[t]) + INSERT * len(CLOSING[t]), int(rank[t])))
    total, states = int(cost[to]) + INSERT * len(CLOSING[to]), [to]
    for k in reversed(back):
        states.append(int(k[states[-1]]))
    return total, states[::-1]


def applied(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[str]:
    """``role:text`` of the turns (role, text) as the ``audit``'s edits leave them, from ``state`` on."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = ASKED[state]
            out.append(f"{ROLE[state]}:")
            continue
        role, text = turns[at]
        at += 1
        if edit == "R":
            state = ASKED[state]
            role = ROLE[state]
        elif edit == "K":
            state = KEEP[role[0]][state]
        if edit != "D":
            out.append(f"{role}:{text}")
    return out
