"""Rules of any form, and large lexicons."""

import random
import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.functions import phrases
from tessera.functions import text as t
from tessera.lexicon import SAMPLE, Lexicon, Rule
from tessera.operators import scoring


def lexicon(**more):
    base = {"entities": {"asset": {"Coin": ["coin"], "Token": ["token"]}, "company": {"Bank": ["bank"]}}, "direct": "asset", "high_value": ["Coin"], "terms": {"move": ["moves", "moved to"], "calm": ["calm"], "names": ["ODL"], "desk": ["wire"]}, "patterns": {"deal": ["[Pp]artners? with [A-Z][a-z]+"]}}
    return base | more


def ruled(spark, lex, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, title string, summary string, source_id string, quality string")
    return {r.k: list(r.categories) for r in scoring.with_categories(scoring.with_entities(df, lex), lex).collect()}


def test_rules_of_every_kind(spark):
    import json

    rules = [
        {"name": "both", "when": {"all": ["name:Coin", "entity:company"]}}, {"name": "either", "when": {"any": ["name:Token", "calm"]}}, {"name": "else", "when": {"all": ["move", {"not": "category:either"}]}},
        {"name": "written", "when": "exact:names"}, {"name": "in_title", "when": {"any": ["title:move", "title_exact:names"]}}, {"name": "dealt", "when": "pattern:deal"}, {"name": "dealt_title", "when": "title_pattern:deal"},
        {"name": "from_desk", "when": {"all": ["source:desk", "quality:primary"]}}, {"name": "two", "when": {"atleast": 2, "of": ["move", "calm", "name:Coin"]}},
    ]
    lex = Lexicon.read(json.dumps(lexicon(rules=rules)))
    got = ruled(
        spark, lex,
        ("Coin moves", "to a bank", "wire", "primary"), ("Calm", "all moved to town", "wire", "discovery"), ("odl and ODLs", "ODL", "x", None), ("Partner with Acme", None, None, "primary"), (None, "they partner with Acme, partner with us", "wire", None), ("removes", "movesx", "", ""),
    )
    assert got == {0: ["both", "else", "in_title", "from_desk", "two"], 1: ["either", "two"], 2: ["written"], 3: ["dealt", "dealt_title"], 4: ["dealt"], 5: []}


@pytest.mark.parametrize("when", ["nothing", "name:Nobody", "category:later", "pattern:none", "odd:move", {"all": ["move"], "any": []}, {"atleast": "2", "of": ["move"]}, 7, {"not": ["move"]}])
def test_rules_that_cant_be(when):
    with pytest.raises(ValueError):
        replace(SAMPLE, rules=(Rule("r", when), Rule("later", "topic")))


def test_phrases_equal_the_patterns(spark):
    dice = random.Random(5)
    letters = ["a", "b", "ab", "ba", "ü", "_", "1", "日"]
    word = lambda: "".join(dice.choices(letters, k=dice.randint(1, 3)))
    terms = tuple(dict.fromkeys(dice.choice([word(), f"{word()} {word()}", f"{word()}-{word()}", f"{word()}.", f"{word()} {word()} {word()}"]) for _ in range(400)))
    texts = ["".join(dice.choice([word(), " ", " ", "-", ". ", "  "]) for _ in range(60)) for _ in range(40)] + ["", None, "a", terms[0]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    assert len(terms) > t.FEW
    found = {r.k: r.h for r in df.select("k", t.term_hits(F.col("x"), terms).alias("h")).collect()}
    for k, x in enumerate(texts):
        want = None if x is None else [y for y in terms if re.search(rf"(?<!\w){re.escape(y)}(?!\w)", x)]
        assert found[k] == want
    few = terms[: t.FEW]
    plain = {r.k: r.h for r in df.select("k", t.term_hits(F.col("x"), few).alias("h")).collect()}
    assert all(x is None or set(plain[k]) == set(found[k]) & set(few) for k, x in enumerate(texts))


def test_a_large_lexicon_costs_no_more_than_twice_a_small_one():
    dice = random.Random(6)
    words = ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3_000)]
    every = tuple(dict.fromkeys(" ".join(dice.choices(words, k=dice.randint(1, 3))) for _ in range(10_500)))[:10_000]
    text = " ".join(dice.choices(words, k=60_000))

    def cost(terms):
        phrases.automaton(terms)
        took = []
        for _ in range(5):
            began = time.process_time()
            phrases.found_in(text, terms)
            took.append(time.process_time() - began)
        return min(took)

    # the larger one finds far more as well
    assert cost(every) <= 3 * cost(every[::100]) + 0.05
    with pytest.raises(ValueError, match="characters"):
        phrases.phrase_hits(None, ("x" * (phrases.MOST_CHARACTERS + 1),))
