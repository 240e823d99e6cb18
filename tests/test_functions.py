import random
from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions import times


def values(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_boundaries_of_phrases(spark):
    rows = [("an elle here",), ("ELLE",), ("belle",), ("éelle",), ("elle_1",), ("(elle)",), (None,)]
    assert [r.x for r in values(spark, rows, "s string", x=t.contains_any(F.col("s"), ("elle",)))] == [True, True, False, False, False, True, None]


def test_canonical_urls(spark):
    rows = [("HTTPS://A.Example",), ("https://a.example/P?q=1#f",), ("http://a.example/",), ("https://u@a.example/",), ("nonsense",), (None,)]
    assert [r.x for r in values(spark, rows, "s string", x=t.canonical_url(F.col("s")))] == ["https://a.example/", "https://a.example/P?q=1", None, None, None, None]


def test_titles_lose_their_source(spark):
    rows = [("A title - Src", "src"), ("A title | src", "Src"), ("A - b", "src"), ("- src", "src")]
    assert [r.x for r in values(spark, rows, "a string, b string", x=t.without_source(F.col("a"), F.col("b")))] == ["A title", "A title", "A - b", "- src"]


def test_fingerprints(spark):
    rows = [("https://a/1", "One two three four five six seven", datetime(2024, 1, 1, 23)), ("https://b/2", "ONE two-three four, five six seven!", datetime(2024, 1, 1, 1)), ("https://b/2", "One two three four five six seven", datetime(2024, 1, 2)), ("https://c", "short", None)]
    a, b, c, d = values(spark, rows, "u string, h string, p timestamp", e=t.event_fingerprint(F.col("u"), F.col("h"), F.col("p")), f=t.fingerprint(F.col("u"), F.col("h")))
    assert a.e == b.e != c.e and a.f != b.f and d.e == d.f


def test_tokens_and_amounts(spark):
    rows = [("The Bank of 12 moves $1.5 billion and 20m, to it",)]
    r = values(spark, rows, "s string", k=t.title_tokens(F.col("s")), a=t.amounts(F.col("s")))[0]
    assert r.k == ["1", "12", "20m", "5", "bank", "billion", "moves"] and r.a == [1.5e9, 20e6]


def test_amounts_match(spark):
    rows = [([100.0], [103.0]), ([100.0], [104.0]), ([], [1.0]), ([5.0, 100.0], [98.0])]
    assert [r.x for r in values(spark, rows, "a array<double>, b array<double>", x=t.amounts_match(F.col("a"), F.col("b")))] == [True, False, False, True]


def test_ratio_bounds_do_not_change_what_passes():
    rng = random.Random(8)
    pairs = [("abcdef ghij", "abcdef ghik"), ("abc", "xyz"), ("same", "same"), ("aab", "baa"), ("", ""), ("", "a")]
    for _ in range(300):
        x = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 80)))
        y = list(x)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        pairs.append((x, "".join(y)))
    for x, y in pairs:
        for least in (0.72, 0.82, 0.94):
            assert (t.ratio(x, y) >= least) == (t.ratio(x, y, least) >= least)


def test_stated_negatives(spark):
    said = {
        "The court rejected the plan.": True, "The court has not rejected the plan.": False, "It could be rejected.": False, "It may grow, but the deal was cancelled.": True, None: None, "": False,
        "It was not yet being suspended; it was halted": True, "They never denied it": False, "x" * 130 + " might " + "y" * 130 + " failed": True, "might " + "y" * 100 + " failed": False, "Rejected or possibly rejected": True,
    }
    rows = spark.createDataFrame([(k,) for k in said], "x string")
    assert {r.x: r.n for r in rows.select("x", t.confirmed_negative(F.col("x")).alias("n")).collect()} == {k: bool(v) for k, v in said.items()}


def test_terms_are_found_folded_and_whole(spark):
    rows = spark.createDataFrame([("Ｒipple and GROẞE Straße; auch  nicht, auch nicht!",), ("ripples großen",), (None,), ("e\u0301t\u00e9 auch-nicht",)], "x string")
    hits = t.term_hits(t.folded(F.coalesce("x", F.lit(""))), ("Ripple", "große", "straße", "auch nicht", "été", "auch-nicht"))
    assert [sorted(r.h) for r in rows.select(hits.alias("h")).collect()] == [["auch nicht", "grosse", "ripple", "strasse"], [], [], ["auch-nicht", "été"]]


def test_html_text():
    assert t.plain_text("<p>a&amp;b<script>x()</script> <b>c</b></p>") == "a&b c" and t.plain_text(None) == ""


def test_dates(spark):
    rows = [("Mon, 01 Jan 2024 10:00:00 GMT",), ("Tue, 2 Jan 2024 10:00:00 +0200",), ("2024-01-03T00:00:00Z",), ("January 4, 2024",), ("5 Sept 2024",), ("06/07/2024",), ("soon",), (None,)]
    got = [r.x for r in values(spark, rows, "s string", x=times.parse_any(F.col("s")).cast("string"))]
    assert got == ["2024-01-01 10:00:00", "2024-01-02 08:00:00", "2024-01-03 00:00:00", "2024-01-04 00:00:00", "2024-09-05 00:00:00", "2024-06-07 00:00:00", None, None]


def test_ages(spark):
    now = F.lit(datetime(2024, 1, 15))
    rows = [(datetime(2024, 1, 1),), (datetime(2023, 12, 31),), (datetime(2024, 1, 16),), (datetime(2024, 1, 16, 0, 0, 1),), (None,)]
    got = [tuple(r) for r in values(spark, rows, "p timestamp", s=times.is_stale(F.col("p"), now, 14), f=times.is_future(F.col("p"), now), d=times.age_days(F.col("p"), now))]
    assert got == [(False, False, 14), (True, False, 15), (False, False, 0), (False, True, 0), (False, False, None)]


def test_signatures(spark):
    rows = [(["one two three four five", "Read more"], "a b c d e f g h i https://x.y/z j"), (["short one"], None)]
    got = [r.x for r in values(spark, rows, "a array<string>, s string", x=t.signatures(F.col("a"), F.col("s"), ("read more",)))]
    assert len(got[0]) == 2 and got[1] == []


def test_steady_letters_are_folded_in_the_jvm(spark, monkeypatch):
    """Each alone and beside others as in Python, and none goes to a worker."""
    letters = [chr(c) for a, b in t.STEADY for c in range(a, b + 1)]
    random.Random(3).shuffle(letters)
    rows = [(x,) for x in (*letters, *("a".join(letters[k : k + 40]) for k in range(0, len(letters), 40)), "ÉTÉ Straße ΟΔΟΣ, ΣΑΣ", None)]

    def none_in_python(text):
        return F.when(text.isNotNull(), F.raise_error(F.lit("a text went to Python")).cast("string"))

    monkeypatch.setattr(t, "nfkc_casefold", none_in_python)
    monkeypatch.setattr(t, "nfkc", none_in_python)
    got = spark.createDataFrame(rows, "x string").select("x", t.folded(F.col("x")).alias("f"), t.composed(F.col("x")).alias("c")).collect()
    assert len(got) == len(rows) and all((r.f, r.c) == ((None, None) if r.x is None else (t.fold(r.x), r.x)) for r in got)


def test_other_letters_are_folded_in_python(spark):
    texts = ["ﬁn", "ét", "İx", "ſ", "x²", "½", " ", "ΐ", "ﾊﾟ", "가", "é ﬁ"]
    assert [r.f for r in spark.createDataFrame([(x,) for x in texts], "x string").coalesce(1).select(t.folded(F.col("x")).alias("f")).collect()] == list(map(t.fold, texts))


def test_an_opening_is_clipped_as_the_whole_text(spark):
    rng = random.Random(8)
    pieces = ["a", "Word", "é", "&amp;", "&", "&#0000000000000000000000065;", "&#x41;", "&notit;", "&lt", "@*", ";", "#", " ", "\n\n", "\t   ", "<", "😀"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 90))),) for _ in range(600)] + [(None,), (" " * 500 + "late",), ("&" + "#0" * 300 + " end",), ("x" * 300,), ("&#" + "0" * 300 + "65;" + "y" * 40,)]
    say = lambda x, n: t.clipped(t.escaped(t.unescaped(x)), n)
    d = spark.createDataFrame(rows, "x string")
    for n in (1, 7, 20, 60):
        assert d.where(~say(F.col("x"), n).eqNullSafe(say(t.opening(F.col("x"), n), n))).count() == 0
    prose = spark.createDataFrame([("some words &amp; more " * 1000,)], "x string")
    assert prose.select(F.char_length(t.opening(F.col("x"), 20)).alias("n")).collect()[0].n <= 40
