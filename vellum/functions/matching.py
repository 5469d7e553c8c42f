"""Keywords in folded texts: all of a row's keywords are found in one pass over each text."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

from vellum.functions import text

_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
_LATIN = dict(zip(text.ACCENTED, text.PLAIN, strict=True))


@functools.cache
def _folded(c: str) -> str:
    """A Latin letter's base letter, as in text.fold(), nothing for a mark that has no width, any other character itself."""
    return _LATIN.get(c) or ("" if unicodedata.category(c) == "Mn" else c)


def fold(found: str) -> str:
    """text.fold_plain() for one string."""
    found = found.lower()
    return " ".join((found if found.isascii() else _BEYOND_ASCII.sub(lambda m: _folded(m[0]), found)).split())


class Matcher:
    """Counts whole-word occurrences of folded phrases; those of one phrase don't overlap, an empty phrase has none."""

    #: With more phrases than this an automaton over all of them reads a text once; fewer are looked for one after another.
    FEW = 6

    def __init__(self, phrases: tuple[str, ...]):
        self.phrases = phrases
        self.distinct = [p for p in dict.fromkeys(phrases) if p]
        self.automaton = None
        if len(self.distinct) > self.FEW:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for p in self.distinct:
                self.automaton.add_word(p, p)
            self.automaton.make_automaton()

    def _places(self, found: str) -> Iterator[tuple[str, int]]:
        for last, p in self.automaton.iter(found):
            yield p, last - len(p) + 1

    def counts(self, found: str) -> list[int]:
        """How often each phrase stands in a folded text."""
        if self.automaton is None:
            few = {p: count(found, p) for p in self.distinct}
            return [few.get(p, 0) for p in self.phrases]
        n, free = dict.fromkeys(self.distinct, 0), dict.fromkeys(self.distinct, 0)
        for p, at in self._places(found):
            end = at + len(p)
            if at >= free[p] and alone(found, at, end):
                n[p] += 1
                free[p] = end
        return [n.get(p, 0) for p in self.phrases]


def _wordly(c: str) -> bool:
    """As \\w."""
    return c.isalnum() or c == "_"


def alone(found: str, start: int, end: int) -> bool:
    """Whether no word goes on at either end."""
    return not (start and _wordly(found[start - 1])) and not (end < len(found) and _wordly(found[end]))


def count(found: str, phrase: str) -> int:
    n, at = 0, found.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if alone(found, at, end):
            n += 1
            at = found.find(phrase, end)
        else:
            at = found.find(phrase, at + 1)
    return n


@functools.lru_cache(maxsize=1_000)
def matcher(phrases: tuple[str, ...]) -> Matcher:
    """Rows of one campaign share their keywords."""
    return Matcher(phrases)
