"""BPE merges compiled into a lazily determinised finite-state transducer.

A cut of a word into tokens is its encoding exactly if any two neighbours may
stand side by side, that is if no merge across their border comes before the
merges that build them. The machine reads symbol by symbol and guesses that a
token starts anywhere: the set of places in the trie of tokens where the guesses
stand is its state. States and moves are determinised when first reached (the
set is named by its deepest place; the others are suffixes of it). Where guesses
end a token, exactly one fits the token before it, so each prefix read has one
last token. A guess lives for the length of the longest token at most, so tokens
that all guesses share are emitted after bounded lookahead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice


class Transducer:
    """``base``: number of symbols; token ``base + i`` is made by ``merges[i]``,
    a pair of tokens. Symbols are tokens themselves."""

    MAX_PAIRS = 1_000_000
    FLUSH = 1024

    def __init__(self, base: int, merges: list[tuple[int, int]]):
        self.halves = [(i, i) for i in range(base)] + merges
        self.joined = {pair: base + i for i, pair in enumerate(merges)}
        if len(self.joined) != len(merges):
            raise ValueError("a pair is merged twice")
        self.spelling: list[tuple[int, ...]] = [(i,) for i in range(base)]
        for a, b in merges:
            self.spelling.append(self.spelling[a] + self.spelling[b])
        self.children: list[dict[int, int]] = [{}]
        self.parent = [(0, -1)]
        self.depth = [0]
        self.token_at = [-1]
        for token, word in enumerate(self.spelling):
            node = 0
            for x in word:
                if x not in self.children[node]:
                    self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.parent.append((node, x))
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                node = self.children[node][x]
            if self.token_at[node] >= 0:
                raise ValueError("two merges make the same token")
            self.token_at[node] = token
        self.moves: list[dict[int, int]] = [{} for _ in self.children]
        self.back: list[int] = [-1] * len(self.children)
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.children)
        #: which tokens were found to stand after a token, or not
        self.after: list[dict[int, bool]] = [{} for _ in self.halves]
        self.pairs = 0

    def adjacent(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay two tokens side by side."""
        x, y, limit, halves = a, b, 1 << 60, self.halves
        while True:
            over = self.joined.get((x, y))
            if over is not None and over < limit:
                return False
            # undo the later of the merges that built the sides of the border
            if (x > y and halves[x][1] != x) or halves[y][0] == y:
                if halves[x][1] == x:
                    return True
                limit, x = x, halves[x][1]
            else:
                limit, y = y + 1, halves[y][0]

    def _shorter(self, state: int) -> int:
        """The state for the guesses of ``state`` but the oldest."""
        if self.back[state] < 0:
            up, symbol = self.parent[state]
            self.back[state] = 0 if up == 0 else self.move(self._shorter(up), symbol)
        return self.back[state]

    def move(self, state: int, symbol: int) -> int:
        to = self.moves[state].get(symbol)
        if to is None:
            to = self.children[state].get(symbol)
            if to is None:
                to = 0 if state == 0 else self.move(self._shorter(state), symbol)
            self.moves[state][symbol] = to
        return to

    def endings(self, state: int) -> tuple[tuple[int, int], ...]:
        """Tokens that guesses end here with their lengths, longest first."""
        got = self.ends[state]
        if got is None:
            got = () if state == 0 else self.endings(self._shorter(state))
            if state and self.token_at[state] >= 0:
                got = ((self.depth[state], self.token_at[state]), *got)
            self.ends[state] = got
        return got

    def _read(self, last: list[int], state: int, symbols: list[int]) -> int:
        """Read on from ``state``; ``last`` has the last token of each prefix."""
        moves, ends, after, i = self.moves, self.ends, self.after, len(last) - 1
        for symbol in symbols:
            i += 1
            to = moves[state].get(symbol)
            state = to if to is not None else self.move(state, symbol)
            for length, token in ends[state] or self.endings(state):
                if length > i:
                    continue
                before = last[i - length]
                if before < 0:  # the word starts here
                    break
                fits = after[before].get(token)
                if fits:
                    break
                if fits is None:
                    fits = after[before][token] = self.adjacent(before, token)
                    self.pairs += 1
                    if fits:
                        break
            else:
                raise AssertionError("no token fits")
            last.append(token)
        return state

    def encode(self, word: list[int]) -> list[int]:
        if len(word) > self.FLUSH:
            return [t for part in self.stream(word) for t in part]
        if self.pairs > self.MAX_PAIRS:
            self.after, self.pairs = [{} for _ in self.halves], 0
        last = [-1]
        self._read(last, 0, word)
        return self._walk(last, len(word))

    def stream(self, word: Iterable[int]) -> Iterator[list[int]]:
        """Tokens of ``word`` as soon as they are certain. The last tokens of the
        prefixes since the last certain border are held: a few times FLUSH."""
        word, last, state = iter(word), [-1], 0
        while part := list(islice(word, self.FLUSH)):
            state = self._read(last, state, part)
            i = len(last) - 1
            at = set(range(max(0, i - self.depth[state]), i + 1))
            while len(at) > 1:  # borders that the chains of all live guesses share
                top = max(at)
                at.remove(top)
                at.add(top - len(self.spelling[last[top]]))
            if (cut := at.pop()) > 0:
                yield self._walk(last, cut)
                last = last[cut:]
        yield self._walk(last, len(last) - 1)

    def _walk(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.spelling[last[at]])
        out.reverse()
        return out
