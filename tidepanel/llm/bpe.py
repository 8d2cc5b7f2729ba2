"""Merge rules as a left-to-right recursion.

A byte-pair encoding of a string is right exactly when every two neighbouring tokens are the encoding of their own
concatenation. So the encoding of a prefix is known by its last token alone: the one token that ends there and agrees with the last token
of the prefix before it. That turns merging into a forward recursion, which automata and shared prefixes can use.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

#: Remembered pairs; beyond, the memory starts anew.
PAIRS = 500_000


def merged(symbols: Sequence[str], rank: Callable[[str, str], float | None]) -> tuple[list[str], tuple[float, str, str] | None]:
    """Encode by the rule itself: join the best-ranked neighbours, leftmost first, until none is left. Also the last join made."""
    out, last = list(symbols), None
    while len(out) > 1:
        best, where = None, -1
        for i in range(len(out) - 1):
            r = rank(out[i], out[i + 1])
            if r is not None and (best is None or r < best):
                best, where = r, i
        if best is None:
            break
        last = best, out[where], out[where + 1]
        out[where : where + 2] = [out[where] + out[where + 1]]
    return out, last


class Pairs:
    """Whether two tokens may stand side by side.

    Joins are undone from the latest back. Before the latest one, the border lay between smaller tokens; if these have a join
    of their own that comes first, it would have been made, and the pair cannot stand. Of equal ranks the left join comes first.
    """

    def __init__(self, rank: Callable[[str, str], float | None], symbols: Callable[[str], Sequence[str]] = list):
        self.rank, self.symbols = rank, symbols
        self.known: dict[tuple[str | None, str], bool] = {}
        self.made: dict[str, tuple[float, str, str] | None | bool] = {}

    def _made(self, token: str):
        """The last join of a token: None for a single symbol, False for one that no joins lead to."""
        got = self.made.get(token, True)
        if got is True:
            whole, last = merged(self.symbols(token), self.rank)
            got = self.made[token] = last if whole == [token] else False
        return got

    def _stand(self, left: str, right: str) -> bool:
        a, b = self._made(left), self._made(right)
        if a is False or b is False:
            return False
        limit, tie = float("inf"), False
        while True:
            r = self.rank(left, right)
            if r is not None and (r < limit or (tie and r == limit)):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, tie, left = a[0], False, a[2]
                a = self._made(left)
            else:
                limit, tie, right = b[0], True, b[1]
                b = self._made(right)

    def agree(self, left: str | None, right: str) -> bool:
        got = self.known.get((left, right))
        if got is None:
            if len(self.known) > PAIRS:
                self.known.clear()
            got = self._made(right) is not False if left is None else self._stand(left, right)
            self.known[left, right] = got
        return got
