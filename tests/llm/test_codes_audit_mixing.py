"""Vector codes, source audit and mixing: against brute force and SQL, on odd rows, and as registered queries."""

import collections
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import mixing, queries, source_audit, vector_codes

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def by_sql(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(sql)


@needs_tables
@pytest.mark.parametrize(("name", "table"), [("op11_vector_codes", "embeddings"), ("op12_source_audit", "documents")])
def test_queries_equal_sql(spark, name, table):
    want = by_sql(queries.SQL[name], table)
    found = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want.fetchall())


# ---------------------------------------------------------------- vector codes


def test_codes_equal_brute_force_on_odd_rows(spark):
    dice = random.Random(1)
    rows = [(k, [dice.choice((-1.5, -0.0001, 0.0, 0.25, 3.0)) + dice.random() for _ in range(16)], k % 3 or None) for k in range(90)]
    rows += [(200 + k, rows[4][1], 7) for k in range(40)]  # equal vectors
    rows += [(1, None, 1), (-1, [1.0] * 15 + [None], 1), (-2, [math.nan] * 16, 1), (-3, [math.inf] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, n string, components int").repartition(7)
    found, books = vector_codes.codes(df)
    want, want_books = vector_codes.brute_force([r[:2] for r in rows])
    assert books.tolist() == want_books
    got = {r.id: (r.code, r.error) for r in found.collect()}
    assert got == want
    sums = collections.Counter()
    label = {k: x for k, v, x in rows if k in want}
    for k, (_, e) in want.items():
        sums[label[k]] += e
    assert all(r.label_error == sums[label[r.id]] for r in found.collect())


def test_codes_of_few_short_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label string"
    assert vector_codes.codes(spark.createDataFrame([], schema))[0].count() == 0
    found, books = vector_codes.codes(spark.createDataFrame([(2, [0.5] * 9, None), (1, [], ""), (None, [1.0] * 3, None)], schema))
    assert books.shape == (8, 3, 2)  # three entries; nine components are filled up to sixteen
    rows = {r.id: r for r in found.collect()}
    assert rows[1].code == "00" * 8 and all(r.error == 0 for r in rows.values())
    assert vector_codes.decoded(spark.createDataFrame([(rows[2].code,)], "code string"), books).first().decoded == [0.5] * 9 + [0.0] * 7
    empty, books = vector_codes.codes(spark.createDataFrame([(1, [], None)], schema))
    assert books.size == 0 and [(r.code, r.error) for r in empty.collect()] == [("00" * 8, 0)]
    with pytest.raises(ValueError, match="long"):
        vector_codes.codes(spark.createDataFrame([(1, [1e30] * 8, None)], schema))


def test_repeated_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, [float(k)] * 8, None) for k in (3, 1, 2, 1)], "vec_id bigint, embedding array<float>, label int")
    found, books = vector_codes.codes(df)
    assert found.count() == 4 and books[0, :, 0].tolist() == [4096, 4096, 8192, 12288]
    assert sorted(r.code[:2] for r in found.collect()) == ["00", "00", "02", "03"]


# ---------------------------------------------------------------- source audit


def audit_by_hand(rows):
    low = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
    docs, count = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, words = lang or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(text))
        docs[lang].update(set(words))
        count[lang, source or ""].update(words)
    found = set()
    for lang in {x for x, _ in count}:
        kept = sorted(w for w, n in docs[lang].items() if n >= source_audit.LEAST)
        groups = {s: c for (x, s), c in count.items() if x == lang}

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        own, whole = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), collections.Counter()))
        for s, c in groups.items():
            pairs = [(-sum(abs(own[s][w] - own[o][w]) for w in kept), o) for o in groups if o != s]
            terms = [(whole[w] - own[s][w], w) for w in kept if c[w] and own[s][w] > whole[w]]
            for part, values in (("pair", sorted(pairs)), ("term", sorted(terms)[: source_audit.TOP])):
                found |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(values, 1)}
    return found


def odd_documents():
    dice = random.Random(2)
    words = ["the", "The", "o'er", "über", "Ünder", "x1y", "日本語", "a_b", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))]
    rows = [(dice.choice(["en", "de", None, ""]), dice.choice(["s", None, "", *(f"s{k}" for k in range(9))]), " ".join(dice.choice(words[: dice.choice([9, 60, 308])]) for _ in range(dice.randrange(120)))) for _ in range(700)]
    return rows + [("fr", None, None), ("fr", "a", ""), ("fr", "b", "rare"), (None, None, None)] + [("en", "s1", "same same")] * 40 + [("en", "s2", "long " * 90_000)]


@pytest.mark.parametrize(("words", "sources"), [(source_audit.WORDS, source_audit.SOURCES), (7, 3)])
def test_audit_equals_counting_by_hand(spark, monkeypatch, words, sources):
    monkeypatch.setattr(source_audit, "WORDS", words)
    monkeypatch.setattr(source_audit, "SOURCES", sources)
    rows = odd_documents()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, side string").repartition(5)
    found = [tuple(r) for r in source_audit.audit(df).collect()]
    assert len(found) == len(set(found)) and set(found) == audit_by_hand(rows)


def test_audit_of_no_rows(spark):
    assert source_audit.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


# ---------------------------------------------------------------- mixing


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - most * sum(sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: most * sizes[s] for s in full}
        full |= over


def check_mix(docs, found):
    """docs: (id, source, text); found: rows of copies()."""
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for _, s, t in docs:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want = water(sizes)
    n = collections.Counter()
    for r in found:
        n[r.id, r.source, r.size] += r.n
        taken[r.source] += r.n * r.copies * r.size
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3 and (r.size == 0 or math.floor(rate + 1e-9) <= r.copies <= math.ceil(rate - 1e-9))
    assert n == collections.Counter((d, s, size(t)) for d, s, t in docs)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-3 for s in want)


def odd_mix():
    dice = random.Random(3)
    docs = [(k, dice.choice(["a", "b", "c", "d", None, ""]), " ".join("w" * dice.choice([1, 1, 3, 9, 200]))) for k in range(400)]
    return docs + [(None, "a", "x y"), (None, "a", None), (5000, "only", "one two three"), (5001, "void", " \t"), (5002, "b", "long\x0b" * 20_000)] + [(6000, "hot", "equal rows here")] * 900


def test_mix_comes_to_its_targets_whatever_the_partitions(spark, monkeypatch):
    docs = odd_mix()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, source string, text string, n int, block string")
    first = mixing.copies(df).collect()
    check_mix(docs, first)
    again = mixing.copies(df.repartition(9)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    monkeypatch.setattr(mixing, "BLOCK", 20)  # many blocks and a tree of several steps
    monkeypatch.setattr(mixing, "FAN", 4)
    small = mixing.copies(df).collect()
    check_mix(docs, small)
    assert collections.Counter(r.source for r in small) and sum(r.n for r in small) == len(docs)


def test_mix_repeats_documents(spark):
    docs = spark.createDataFrame([(1, "a", "one two"), (2, "a", "three"), (2, "a", "three"), (3, "b", "four " * 40), (4, None, "")], "doc_id bigint, source string, text string").withColumnRenamed("text", "body")
    times = collections.Counter()
    for r in mixing.copies(docs, text="body").collect():
        times[r.id] += r.n * r.copies
    found = mixing.mixed(docs, text="body")
    assert found.columns == docs.columns
    assert collections.Counter(r.doc_id for r in found.collect()) == +times and times[1] == 3 and times[2] == 6
    assert mixing.mixed(docs.limit(0), text="body").count() == 0


def test_rounding_keeps_expectations_and_words():
    dice = np.random.default_rng(4)
    sizes, p = [50, 20, 20, 9, 5, 4, 4, 3, 2, 1, 1, 1], 0.37
    hits = np.zeros(len(sizes))
    for _ in range(4000):
        taken, left, rest = mixing.rounded(sizes, p, dice.random(len(sizes)).tolist())
        words = sum(s for s, x in zip(sizes, taken, strict=True) if x) + (sizes[left] * rest if left >= 0 else 0)
        assert abs(words - p * sum(sizes)) < 1e-6
        hits += taken
        if left >= 0:
            hits[left] += rest
    assert np.abs(hits / 4000 - p).max() < 0.04
    q = [0.2, 0.9, 0.5, 0.5, 0.01]
    hits = np.zeros(5)
    for _ in range(4000):
        taken, left, rest = mixing.paired([9, 5, 5, 2, 1], q, dice.random(5).tolist())
        words = sum(s for s, x in zip([9, 5, 5, 2, 1], taken, strict=True) if x) + ([9, 5, 5, 2, 1][left] * rest if left >= 0 else 0)
        assert abs(words - sum(a * b for a, b in zip([9, 5, 5, 2, 1], q, strict=True))) < 1e-6
        hits += taken
        if left >= 0:
            hits[left] += rest
    assert np.abs(hits / 4000 - q).max() < 0.04


@needs_tables
def test_registered_mix(spark):
    docs = duckdb.sql(f"SELECT doc_id, source, text FROM '{SF}/documents.parquet'").fetchall()
    found = {r.doc_id: r for r in queries.op13_source_mixing(spark, SF).collect()}
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for d, s, t in docs:
        n = len(re.findall("[^\x20\x09-\x0d]+", t or ""))
        assert found[d].size == n and found[d].taken in (0, n, 2 * n, 3 * n)
        sizes[s] += n
        largest[s] = max(largest[s], n)
        taken[s] += found[d].taken
    want = water(sizes)
    assert len(found) == len(docs)
    assert all(abs(found[d].target - want[s]) < 1e-6 * want[s] and found[d].source_size == sizes[s] for d, s, _ in docs)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in want)
