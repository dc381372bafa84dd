"""Many strings searched at once: leftmost matches, of these the longest, in one pass however many strings there are."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator


class Automaton:
    """A trie with a link from each state to the longest state that ends it (Aho and Corasick), over characters."""

    def __init__(self, words: Iterable[str]):
        self._next: list[dict[str, int]] = [{}]
        self._depth, self._longest = [0], [0]  # the longest word that ends a state, in characters
        for word in words:
            at = 0
            for c in word:
                if c not in self._next[at]:
                    self._next[at][c] = len(self._next)
                    self._next.append({})
                    self._depth.append(self._depth[at] + 1)
                    self._longest.append(0)
                at = self._next[at][c]
            self._longest[at] = len(word)
        self._link = [0] * len(self._next)
        waiting = deque(self._next[0].values())
        while waiting:
            at = waiting.popleft()
            self._longest[at] = self._longest[at] or self._longest[self._link[at]]
            for c, to in self._next[at].items():
                self._link[to] = self._step(self._link[at], c)
                waiting.append(to)

    def __len__(self) -> int:
        return len(self._next)

    def _step(self, at: int, c: str) -> int:
        while at and c not in self._next[at]:
            at = self._link[at]
        return self._next[at].get(c, 0)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Matches that do not overlap: the leftmost, of those that start together the longest, then on from its end.

        A match is settled once no state can be part of one that starts as early; the search then goes on from the match's
        end, so a place is looked at again only where a longer match was hoped for.
        """
        step, onward, depth, longest, link = self._step, self._next, self._depth, self._longest, self._link
        i = at = 0
        start = end = -1
        n = len(text)
        while True:
            if i < n:
                c = text[i]
                i += 1
                if c in onward[at]:
                    at = onward[at][c]
                elif at:
                    at = step(link[at], c)
                if longest[at]:
                    first = i - longest[at]
                    if start < 0 or first <= start:
                        start, end = first, i
            if start >= 0 and (i >= n or i - depth[at] > start):
                yield start, end
                i, at, start = end, 0, -1
            elif i >= n:
                return
