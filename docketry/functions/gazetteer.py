"""Many strings found in a text at once, and where the best partial match of a string lies."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick

#: Kept hits that a new one is compared with.
LOOKBACK = 6
#: Shorter strings are left out.
LEAST = 2


class Gazetteer:
    """An Aho-Corasick automaton over a table of strings: one pass over a text, however many strings there are."""

    def __init__(self, strings: tuple[str, ...], least: int = LEAST):
        self._automaton = ahocorasick.Automaton()
        for s in strings:
            if len(s) >= least:
                self._automaton.add_word(s, len(s))
        if len(self._automaton):
            self._automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int]]:
        """Start and end of every place of every string, by start, longer ones first."""
        if not len(self._automaton) or not text:
            return []
        found = [(last - size + 1, last + 1) for last, size in self._automaton.iter(text)]
        found.sort(key=lambda h: (h[0], -h[1]))
        return found

    def maximal(self, text: str) -> list[tuple[int, int]]:
        """Hits that none of the last ``LOOKBACK`` kept ones holds as its part."""
        kept: list[tuple[int, int]] = []
        for a, b in self.hits(text):
            if not any(x <= a and b <= y and y - x > b - a for x, y in kept[-LOOKBACK:]):
                kept.append((a, b))
        return kept


@lru_cache(maxsize=32)
def gazetteer(strings: tuple[str, ...], least: int = LEAST) -> Gazetteer:
    """Built once a worker for each table."""
    return Gazetteer(strings, least)
