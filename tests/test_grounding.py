import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import enrich, grounding

SOURCES = [("Acme News", "Acme buys Beta for $20 million", "The deal closed. RLUSD grows 5% in Q3."), ("Wire", "BNY selected as custodian", "A$AP (x) [y] \\E is named")]
RULES = grounding.Rules(terms={"xrp": ("xrp",), "xrpl": ("xrpl", "xrp ledger"), "rlusd": ("rlusd", "ripple usd")}, expansions={"bny": ("the bank of new york mellon",)}, acquired=("acquire", "takeover"))


def answer(**fields):
    return json.dumps({"event_summary": "Acme buys Beta", "claims": [{"text": "Acme buys Beta", "evidence": ["source-1 title"]}]} | fields)


def claim(text, *labels, **more):
    return answer(claims=[{"text": text, "evidence": list(labels), **more}])


@pytest.fixture(scope="module")
def judged(spark):
    cases = {
        "held": answer(),
        "repaired": claim("Acme buys Beta after Q3", "source-1 summary"),
        "first_field": claim("RLUSD and BNY", "source-1 title"),
        "invented": claim("Gamma wins 30%", "source-1 title"),
        "part_of_word": claim("It grows 0 million", "source-1 title"),
        "attribution": claim("According to Acme News, a deal closed", "source-1 publisher"),
        "noun": claim("A deal closed, the Wire report says", "source-2 publisher"),
        "actor": claim("Wire appoints a custodian", "source-2 publisher"),
        "wrong_label": claim("a deal", "source-3 title"),
        "no_label": claim("a deal"),
        "no_claim": answer(claims=[]),
        "blank_claims": answer(claims=[{"text": " "}, 7, None]),
        "not_json": "{",
        "list": "[1]",
        "null": None,
        "parts": answer(event_summary=["Acme buys", "Beta"]),
        "object": answer(event_summary={"a": 1}),
        "mixed": answer(significance=["a", 1]),
        "entity": answer(entities=["Acme", "Delta"]),
        "entities": answer(entities=["Acme", " Acme ", "", 3, "Wire"] + ["Beta"] * 30),
        "alias": answer(entities=["RLUSD"], significance="RLUSD grows"),
        "term": answer(significance="What XRP gains"),
        "history": answer(significance="Omega follows"),
        "outside": answer(event_summary="Omega buys"),
        "conflict": answer(conflicts=["Zeta says no"]),
        "uncertain": answer(uncertainties=["Source 1 is silent on Kappa"]),
        "numbered": answer(uncertainties=["Source 12 is silent"]),
        "publisher_named": answer(event_summary="Acme buys Beta, Wire writes"),
        "acquisition": answer(event_type="acquisition"),
        "custody": answer(event_type="filing"),
        "unknown_type": answer(event_type="party"),
        "expanded": claim("The Bank of New York Mellon selected", "source-2 title"),
        "long": claim("x" * 2000, "source-1 title", claim_type="y" * 200, certainty=3),
    }
    rows = spark.createDataFrame([(k, v, "old") for k, v in cases.items()], "key string, answer string, summary string")
    sources = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(grounding.FIELDS, s, strict=True)]) for s in SOURCES])
    return {r.key: r for r in grounding.checked(rows.withColumns({"sources": sources, "history": F.lit("Omega came before")}), RULES).collect()}


HELD = {"held", "repaired", "first_field", "attribution", "noun", "parts", "entities", "alias", "history", "numbered", "publisher_named", "custody", "unknown_type", "expanded", "long"}


def test_what_holds(judged):
    assert {k for k, r in judged.items() if r.ok} == HELD
    assert all((r.error is None) == r.ok for r in judged.values())


@pytest.mark.parametrize(("key", "part"), [
    ("invented", "30%"), ("part_of_word", "names 0"), ("actor", "names wire"), ("wrong_label", "source-3 title"), ("no_label", "no evidence"), ("no_claim", "no claim"), ("blank_claims", "no claim"),
    ("not_json", "not JSON"), ("null", "not JSON"), ("list", "not an object"), ("object", "event_summary"), ("mixed", "significance is neither"), ("entity", "Delta"), ("term", "xrp"),
    ("outside", "summary names what no source does: omega"), ("conflict", "zeta"), ("uncertain", "kappa"), ("acquisition", "acquisition"),
])
def test_why_the_rest_is_refused(judged, key, part):
    assert part in judged[key].error


def test_labels_are_repaired_and_fields_bounded(judged):
    assert judged["repaired"].claims[0].evidence == ["source-1 summary", "source-1 title"]
    assert judged["first_field"].claims[0].evidence == ["source-1 title", "source-2 title", "source-1 summary"]
    assert judged["custody"].event_type == "partnership" and judged["unknown_type"].event_type == "other"
    assert judged["expanded"].claims[0].text == "BNY selected"
    assert judged["entities"].entities == ["Acme", "Wire", "Beta"] and judged["parts"].summary == "Acme buys Beta"
    long = judged["long"].claims[0]
    assert (len(long.text), len(long.claim_type), long.certainty) == (500, 80, "unknown")


def test_nulls_and_empty_tables(spark):
    shape = "key int, answer string, sources array<struct<publisher: string, title: string, summary: string>>"
    rows = spark.createDataFrame([(1, answer(), None), (2, answer(), [(None, None, None)]), (3, claim("a deal", "source-1 title"), [(None, "Acme buys Beta", None)])], shape)
    assert {r.key: r.ok for r in grounding.checked(rows).collect()} == {1: False, 2: False, 3: True}
    assert grounding.checked(spark.createDataFrame([], shape)).count() == 0


def test_refused_answers_are_asked_again_with_their_error(spark):
    rows = spark.createDataFrame([(k, [("Wire", f"Acme buys {k}", "")]) for k in ("Learns", "Never", "Stuck", "Fails")], "cluster_id string, sources array<struct<publisher: string, title: string, summary: string>>")

    def provider(asked):
        again = asked.count("The last answer was refused") + asked.count("last try")
        if "buys Fails" in asked:
            raise ValueError("cut off")
        if "buys Learns" in asked:
            return claim("Acme buys Learns", "source-1 title").replace("Beta", "Learns") if again == 2 else (claim("Zeta buys", "source-1 title") if again else "{")
        return claim("Omega buys", "source-1 title") if "buys Stuck" in asked else [claim("One-X1 buys", "source-1 title"), claim("Two-X2 buys", "source-1 title"), claim("Three-X3 buys", "source-1 title")][again]

    got = {r.cluster_id: r for r in enrich.enrich(rows, provider).collect()}
    assert {k: (r.ok, r.attempts) for k, r in got.items()} == {"Learns": (True, 3), "Never": (False, 3), "Stuck": (False, 2), "Fails": (False, 2)}
    assert got["Learns"].claims[0].text == "Acme buys Learns" and "omega" in got["Stuck"].error and "not JSON" in got["Fails"].error


def test_letters_of_a_word_are_told(spark):
    rows = spark.createDataFrame([("Eriner", "uneêti eriné"), ("Eriner", "une eriné"), ("Eriner", "unes eriné")], "text string, source string")
    named = lambda *letter: [r[0] for r in rows.select(grounding.one_naming(F.col("text"), F.col("source"), {"une": ("eriner",)}, *letter)).collect()]
    assert named() == ["Eriner", "UNE", "Eriner"]
    # as RE2 has it, in which the SQL of acronyms is written
    assert named("[A-Za-z0-9_]") == ["UNE", "UNE", "Eriner"]


def test_grounded_answers_equal_their_sql_where_names_are_pieces_of_words(spark, tmp_path):
    # titles of which every eleventh item's claim cites a label that no source has
    import duckdb

    from tessera.plans import queries, sql

    titles = ["key 7a0f55bb is set", "x" * 494 + " Quellen are cut here", "Sammen gone", "no name here", "part 7a0f of a key", "Ordinary Names stand"]
    texts = [f"{titles[k // 11 % 6] if k % 11 == 0 else 'plain words'}\n{'7a and Sammen are words here, Quel too' if k // 66 % 2 else 'nothing more'}" for k in range(264)]
    rows = spark.createDataFrame([(k, x, "en", f"src{k % 20}", len(x)) for k, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r for r in own.sql(sql.SQL["grounded_answers"]).fetchall()}
    assert {r.item_id: tuple(r) for r in queries.grounded_answers(spark, str(tmp_path)).collect()} == want and len(want) == 264


def test_a_quote_tells_the_label_that_was_meant(spark):
    cases = {"quoted": claim("cquires 7a0", "source-9 title"), "told": claim("The Beta deal", "source-9 title"), "good_label": claim("cquires 7a0", "source-1 summary")}
    rows = spark.createDataFrame([(k, v, [("Wire", "Beta acquires 7a0f", "a deal")]) for k, v in cases.items()], "key string, answer string, sources array<struct<publisher: string, title: string, summary: string>>")
    got = {r.key: (r.error, r.claims[0].evidence) for r in grounding.checked(rows).collect()}
    assert got["quoted"][1] == got["told"][1] == ["source-9 title", "source-1 title"] and "source-9 title" in got["quoted"][0] and "source-9 title" in got["told"][0]
    assert got["good_label"] == ("a claim names 0, which no source does: cquires 7a0", ["source-1 summary"])
