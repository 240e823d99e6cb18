"""Phrases of a large lexicon in texts: one pass over a text, whatever the number of phrases."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: A lexicon goes to every worker with the plan; so many characters at most.
MOST_CHARACTERS = 32 << 20


@lru_cache(4)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        made.add_word(term, (k, len(term)))
    made.make_automaton()
    return made


def _inner(letter: str) -> bool:
    return letter.isalnum() or letter == "_"


def found_in(text: str, terms: tuple[str, ...]) -> list[str]:
    """The terms that stand in the text with no letter, digit or underscore right before or after, in the lexicon's order."""
    hits: set[int] = set()
    for end, (k, size) in automaton(terms).iter(text):
        if k not in hits and (end + 1 == len(text) or not _inner(text[end + 1])) and (end < size or not _inner(text[end - size])):
            hits.add(k)
    return [terms[k] for k in sorted(hits)]


def phrase_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """``found_in`` for a column of folded texts, in Arrow batches; a null text gives null. Each worker builds the automaton once."""
    if (size := sum(map(len, terms))) > MOST_CHARACTERS:
        raise ValueError(f"a lexicon of {size} characters; at most {MOST_CHARACTERS} go with a plan")

    @pandas_udf(ArrayType(StringType()))
    def hits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else found_in(x, terms))

    return hits(text)
