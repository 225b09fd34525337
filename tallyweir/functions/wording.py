"""What a sentence says, by vocabulary and closeness.

A sentence is first brought to plain words: lower case, single blanks, numbers
without separators. A vocabulary is a list of phrases of such words, in which a
star stands for any ending and ``#`` for a number. ``said`` asks whether a phrase
occurs, ``near`` whether a phrase of one vocabulary stands within so many words of a
phrase of another. Both compile to one expression of the JVM, and are only tried
where a plain search finds the beginning of one of the phrases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vocabulary = tuple[str, ...]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def worded(text: Column) -> Column:
    """Plain words with a blank before, between and behind; quotation marks are words."""
    joined = F.regexp_replace(F.lower(text), r"(?<=[0-9])[,.](?=[0-9])", "")
    quoted = F.regexp_replace(joined, '"', ' " ')
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(quoted, r"[^a-z0-9$%\"]+", " ")), F.lit(" "))


def pattern(phrase: str) -> str:
    out = []
    for word in phrase.split(" "):
        out.append(re.escape(word).replace(r"\*", "[a-z0-9]*").replace(r"\#", "[0-9]+").replace("#", "[0-9]+"))
    return " ".join(out)


def _one_of(phrases: Vocabulary) -> str:
    return "(?:" + "|".join(pattern(p) for p in phrases) + ")"


def _begin(phrase: str) -> str:
    """The text before the first star or number, which every match holds."""
    return " " + re.split(r"[*#]", phrase)[0].rstrip() if phrase[0] not in "*#" else ""


def holds(words: Column, phrases: Vocabulary) -> Column:
    """Whether the beginning of a phrase is there: true wherever ``said`` is."""
    begins = {_begin(p) for p in phrases}
    if "" in begins:
        return F.lit(True)
    short = {b for b in begins if not any(b != c and b.startswith(c) for c in begins)}
    return reduce(lambda a, b: a | b, [F.contains(words, F.lit(b)) for b in sorted(short)])


def said(words: Column, phrases: Vocabulary) -> Column:
    return holds(words, phrases) & words.rlike(f" {_one_of(phrases)} ")


def near(words: Column, one: Vocabulary, other: Vocabulary, within: int, either: bool = False) -> Column:
    """``one`` before ``other``, or with ``either`` in any order, no more than ``within`` words between."""
    gap = f" (?:[^ ]+ ){{0,{within}}}?"
    a, b = _one_of(one), _one_of(other)
    test = words.rlike(f" {a}{gap}{b} ")
    if either:
        test = test | words.rlike(f" {b}{gap}{a} ")
    return holds(words, other) & holds(words, one) & test


@dataclass(frozen=True)
class Clause:
    """One way to say a thing: a phrase alone, or one near another; ``number`` asks
    for a number of so many digits in the sentence as well."""

    one: Vocabulary
    other: Vocabulary = ()
    within: int = 0
    either: bool = False
    number: int = 0

    def test(self, words: Column) -> Column:
        got = near(words, self.one, self.other, self.within, self.either) if self.other else said(words, self.one)
        return got & words.rlike(f" \\$?[0-9]{{{self.number},}}%? ") if self.number else got


@dataclass(frozen=True)
class Saying:
    """A thing sentences can say in several ways, the words that belie it, and words
    one of which must be there as well."""

    name: str
    clauses: tuple[Clause, ...]
    unless: Vocabulary = ()
    also: Vocabulary = ()

    def test(self, words: Column) -> Column:
        got = reduce(lambda a, b: a | b, [c.test(words) for c in self.clauses])
        got = got & said(words, self.also) if self.also else got
        return got & ~said(words, self.unless) if self.unless else got

    def place(self, sentence: Column) -> Column:
        """About where in a sentence the words of the thing begin, from 1; 1 if unclear."""
        low = F.concat(F.lit(" "), F.lower(sentence))
        starts = sorted({_begin(p).split(" ")[1] for c in self.clauses for p in (c.other or c.one) if _begin(p)})
        found = [F.nullif(F.instr(low, " " + s), F.lit(0)) for s in starts]
        return F.coalesce(F.least(*found) if len(found) > 1 else found[0] if found else F.lit(1), F.lit(1))


def sayings(words: Column, all_of: tuple[Saying, ...]) -> Column:
    """array<string> of the names of what is said."""
    return F.array_compact(F.array(*[F.when(s.test(words), F.lit(s.name)) for s in all_of]))
