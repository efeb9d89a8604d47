"""Large lexicons: one pass over a text, however many terms there are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Characters all terms of a lexicon may have together; it is held by every Python worker (some 100 bytes a character).
MOST_CHARACTERS = 4_000_000


def _checked(terms: list[str]) -> list[str]:
    terms = list(dict.fromkeys(t for t in terms if t))
    if sum(map(len, terms)) > MOST_CHARACTERS:
        raise ValueError(f"the terms have more than {MOST_CHARACTERS} characters: join them as a table instead")
    return terms


def _automaton(terms: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(t, i)
    if terms:
        found.make_automaton()
    return found


def held_terms(text: Column, terms: list[str]) -> Column:
    """The different ``terms`` that ``text`` contains, in their given order; null for null, empty where none occurs.

    Equals one ``contains`` a term, case and all; empty and repeated terms are left out.
    """
    terms = _checked(terms)

    @F.pandas_udf("array<string>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(terms)
        for texts in batches:
            yield texts.map(lambda t: [terms[i] for i in sorted({i for _, i in automaton.iter(t)})] if terms else [], na_action="ignore")

    return held(text)


def lowered(text: str) -> str:
    """Lower case that keeps every character's place: one that would become several stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def whole_matches(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, end, term) of the matches that are whole words, without overlap: from the left, the longest at each place."""
    word = lambda c: c.isalnum() or c == "_"
    longest: dict[int, tuple[int, int]] = {}
    for last, (i, n) in automaton.iter(lowered(text)):
        start, end = last - n + 1, last + 1
        before = start > 0 and word(text[start - 1]) and word(text[start])
        after = end < len(text) and word(text[end]) and word(text[end - 1])
        if not before and not after:
            longest[start] = max(longest.get(start, (0, 0)), (end, i))
    out, free = [], 0
    for start in sorted(longest):
        if start >= free:
            end, i = longest[start]
            out.append((start, end, i))
            free = end
    return out


def replaced_terms(text: Column, replacements: dict[str, str]) -> Column:
    """``text`` with every whole word or words among the keys replaced, whatever their case; what was put in is not looked at again.

    The longest key at a place wins, places go from the left. Null stays null.
    """
    keys = _checked([lowered(k) for k in replacements])
    by_key = {lowered(k): v for k, v in replacements.items()}

    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, k in enumerate(keys):
            automaton.add_word(k, (i, len(k)))
        if keys:
            automaton.make_automaton()

        def changed(t: str) -> str:
            parts, at = [], 0
            for start, end, i in whole_matches(t, automaton) if keys else []:
                parts += [t[at:start], by_key[keys[i]]]
                at = end
            return "".join([*parts, t[at:]])

        for texts in batches:
            yield texts.map(changed, na_action="ignore")

    return replaced(text)
