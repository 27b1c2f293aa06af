"""Names in texts by a multi-pattern automaton.

An automaton over all names reads a text once, however many names there are, and
reports every place where one ends. What a set of places means is decided afterwards:
longest names claim their places first over the whole text, which no alternation can do,
as that settles each place from left to right.

Automata are built once in each Python worker; texts come in Arrow batches.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import lexicon

Pairs = tuple[tuple[str, str], ...]


class Finder:
    """Finds the names of (name, code) ``pairs``; of pairs with one name the first counts."""

    def __init__(self, pairs: Pairs) -> None:
        self.automaton = ahocorasick.Automaton()
        order = sorted(pairs, key=lambda p: -len(p[0]))
        self.codes: list[str] = []
        for name, code in order:
            if name and name not in self.automaton:
                self.automaton.add_word(name, (len(self.codes), len(name)))
                self.codes.append(code)
        self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """(rank of the name, longest first; start; end) of every occurrence."""
        if not self.codes:
            return []
        return [(rank, end + 1 - size, end + 1) for end, (rank, size) in self.automaton.iter(text)]

    def claimed(self, text: str) -> list[str]:
        """Codes of the names that begin where no letter or digit stands before and whose place no longer name has claimed, longest names first, each once."""
        taken, found = bytearray(len(text)), {}
        for rank, start, end in sorted(self.places(text)):
            if (start == 0 or not text[start - 1].isalnum()) and not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                found[self.codes[rank]] = None
        return list(found)

    def longest(self, text: str) -> str | None:
        """The code of the longest name in ``text``; of equally long ones the first listed."""
        best = min(self.places(text), default=None)
        return None if best is None else self.codes[best[0]]


@lru_cache(maxsize=16)
def finder(pairs: Pairs) -> Finder:
    return Finder(pairs)


def at_least(pairs: list[tuple[str, str]], least: int = 2) -> Pairs:
    return tuple((n, c) for n, c in pairs if len(n) >= least)


SPELLED = at_least(lexicon.SPELLINGS)
NUMBERS = re.compile(r"\d+장|\d+\s*:?\s*\d*")
HANGUL = re.compile("[가-\udbff]")
NUMBERED = tuple((re.compile(rf"(?:{digit}|{word}|{roman})\s*{name}\b"), digit + letters) for name, letters in lexicon.NUMBERED.items() for digit, (_, word, roman) in lexicon.ORDINALS.items() if digit + letters in lexicon.BOOKS)
KOREAN_NAMES = tuple((n, c) for n, c in lexicon.ALIAS_TO_BOOK.items() if len(n) > 1 and HANGUL.search(n))
ANYWHERE = tuple(lexicon.NUMBERED_NAMES.items())
#: In a Korean question only spellings of six characters or more count anywhere, in another one of three or more.
LEAST_KOREAN, LEAST = 6, 3


@lru_cache(maxsize=1)
def _question_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in {*lexicon.KOREAN_FULL, *dict(KOREAN_NAMES), *dict(ANYWHERE), *lexicon.KOREAN_NUMBERED}:
        found.add_word(name, name)
    found.make_automaton()
    return found


def numbered(text: str) -> list[str]:
    """Numbered books in lower-cased ``text``. Nothing is asked of what stands before the number: "ii peter" names both."""
    return [code for pattern, code in NUMBERED if pattern.search(text)]


def of_question(text: str) -> list[str]:
    """Books that a question names: numbered ones, full Korean names anywhere, Korean spellings whose first place begins a word, spellings of numbered books anywhere."""
    low = text.lower().strip()
    first: dict[str, int] = {}
    for end, name in _question_automaton().iter(low):
        first.setdefault(name, end + 1 - len(name))
    found = dict.fromkeys(numbered(low))
    found |= dict.fromkeys(c for n, c in lexicon.KOREAN_FULL.items() if n in first)
    for name, code in KOREAN_NAMES:
        if name in first and (first[name] == 0 or not low[first[name] - 1].isalnum()):
            found.setdefault(code)
    least = LEAST_KOREAN if HANGUL.search(text) else LEAST
    found |= dict.fromkeys(c for n, c in (*ANYWHERE, *lexicon.KOREAN_NUMBERED.items()) if len(n) >= least and n in first)
    return list(found)


def books_claimed(c: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """Codes of the books that a text names by spellings of two characters or more, longest names first, each once.

    Numbers go first, so numbered books are found by ``books_of_question`` alone. A name begins where no letter or digit stands
    before it; its end is open, as particles attach to it. What a longer name covers no shorter one takes, wherever it stands.
    """
    own = SPELLED if pairs is None else at_least(pairs)

    @F.arrow_udf("array<string>")
    def claimed(texts: pa.Array) -> pa.Array:
        find = finder(own).claimed
        return pa.array([find(NUMBERS.sub("", t.lower()).strip()) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return claimed(c)


def books_of_question(c: Column) -> Column:
    """Codes of the books that a question names by number or in Korean, each once, in the order in which they are tried."""

    @F.arrow_udf("array<string>")
    def named(texts: pa.Array) -> pa.Array:
        return pa.array([of_question(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return named(c)


def longest_name(c: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """The code of the longest spelling of two characters or more anywhere in a text, null without one."""
    own = at_least(list(lexicon.ALIAS_TO_BOOK.items()) if pairs is None else pairs)

    @F.arrow_udf("string")
    def longest(texts: pa.Array) -> pa.Array:
        find = finder(own).longest
        return pa.array([find(t) if t else None for t in texts.to_pylist()], pa.string())

    return longest(c)
