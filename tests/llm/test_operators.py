"""Each operator on small tables: brute force, round trips, and the defined results for odd rows."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest

from tessera.llm import chat_format, decontamination, html_extraction, language_id, language_model, media, minhash_dedup, quality, sentencepiece_codec, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {"en": "the of and that with from this shion tion ther".split(), "de": "der die und nicht sich ein mit heit keit ung".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "e", "on", "ar"]) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, "en" if k % 2 else "de", rng.randint(1, 120)) for k in range(60)]
    passage = prose(rng, "en", 70)
    rows = [(k, t, "en" if k % 2 else "de") for k, t in enumerate(base)]
    rows += [(100, base[3], "en"), (101, base[3], "en"), (102, base[5] + " tail", "en"), (103, base[5].upper(), "en")]
    rows += [(110 + k, prose(rng, "en", 20) + " " + passage + " " + prose(rng, "en", 9), "en") for k in range(6)]
    rows += [(120, None, "en"), (121, "", "de"), (122, " \n\t", None), (123, "...", "de"), (124, prose(rng, "en", 6000), "en")]
    return rows


def test_near_duplicates_equal_brute_force(spark, texts):
    found = {r.doc_id: r.class_id for r in minhash_dedup.classes(table(spark, texts)).collect()}
    assert found == minhash_dedup.brute_force([(i, t) for i, t, _ in texts])


def test_near_duplicates_of_one_group_with_chains(spark):
    rng = random.Random(3)
    words = prose(rng, "en", 60).split()
    rows = []
    for k in range(80):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(w), "en"))
    found = {r.doc_id: r.class_id for r in minhash_dedup.classes(table(spark, rows)).collect()}
    assert found == minhash_dedup.brute_force([(i, t) for i, t, _ in rows])


def test_near_dedup_keeps_one_and_rows_without_id(spark, texts):
    rows = [*texts, (None, "no id", "en"), (0, texts[0][1], "en")]
    kept = minhash_dedup.keep_first(table(spark, rows)).collect()
    ids = [r.doc_id for r in kept]
    assert None in ids and 100 not in ids and 3 in ids and {120, 121, 122, 124} <= set(ids)


@pytest.mark.parametrize("hot", [2, 2000])
def test_substring_dedup_equals_brute_force(spark, texts, hot):
    docs = table(spark, texts)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(docs, substring_dedup.find(docs, hot=hot)).collect()}
    assert found == substring_dedup.brute_force([(i, t) for i, t, _ in texts])
    assert found[111][1] >= 70 and found[110][1] == 0


def test_substring_clean_cuts_and_drops_what_is_empty(spark, texts):
    kept = {r.doc_id: r.text for r in substring_dedup.clean(table(spark, texts)).collect()}
    assert kept[110] == texts[[i for i, *_ in texts].index(110)][1]
    assert len(kept[111].split()) < 40


def test_decontamination_equals_brute_force(spark, texts):
    items = [("a", texts[111 - 111 + 64][1]), (7, " ".join(texts[3][1].split()[:12])), ("short", "tiona"), ("none", None), ("blank", ".")]
    bench = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.digest(decontamination.find(table(spark, texts), bench)).collect()}
    assert found == decontamination.brute_force([(i, t) for i, t, _ in texts], [(str(i), t) for i, t in items])


def test_decontamination_in_blocks_of_phrases(spark, texts):
    items = [(str(k), " ".join(t.split()[:14])) for k, t, _ in texts[:20] if t]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.digest(decontamination.find(table(spark, texts), bench, phrase_bytes=300)).collect()}
    assert found == decontamination.brute_force([(i, t) for i, t, _ in texts], items)


def test_decontamination_cuts_once_for_all_blocks(spark):
    words = [f"w{k}" for k in range(30)]
    # items that overlap, and one that only words left and right of a cut make up
    items = [("a", words[2:12]), ("b", words[7:17]), ("c", [*words[:2], *words[17:25]])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    docs = table(spark, [(1, " ".join(words), "en"), (1, " ".join(words[5:9]), "en"), (None, " ".join(words[7:17]), "en"), (3, None, "en")])
    for size in (10, 1 << 20):
        kept = decontamination.clean(docs, bench, phrase_bytes=size).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(1, " ".join([*words[:2], *words[17:]])), (1, " ".join(words[5:9])), (3, "")]


def test_pieces_equal_the_library(texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    pieces = sentencepiece_codec.Pieces.read()
    odd = ["  two  blanks ", "日本語 é 😀", "y" * 900, "tab\tand\nline", "<s> </s> <0x41>"]
    own = [t or "" for _, t, _ in texts] + odd
    flat, counts = pieces.encode(own)
    at, got = 0, []
    for n in counts.tolist():
        got.append(flat[at : at + n].tolist())
        at += n
    assert got == [sp.encode(t) for t in own]
    assert pieces.decode(flat, counts) == own


def test_language_is_learned_and_told(spark, texts):
    docs = table(spark, [r for r in texts if r[0] < 100])
    found = {r.doc_id: r for r in language_id.predict(table(spark, texts), language_id.fit(docs)).collect()}
    told = [(found[i].lang_pred, lang) for i, t, lang in texts if t and len(t.split()) > 5 and lang]
    assert sum(a == b for a, b in told) / len(told) > 0.95
    assert {found[k].lang_pred for k in (120, 121, 122, 123)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found.values())


def test_quality_tells_good_from_bad(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, "en", 80) if k % 2 else " ".join(rng.choice(["buy", "$$$", "click!!", "XXX", "win"]) for _ in range(80)), "en") for k in range(160)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(160)], "doc_id bigint, quality int, toxic int")
    docs = table(spark, rows)
    model = quality.fit(docs, labels)
    held = [r for r in quality.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.95
    odd = {r.doc_id: r.score for r in quality.score(table(spark, [(1, None, None), (2, "", None), (3, "é" * 100_000, None)]), model).collect()}
    assert len(odd) == 3 and all(0 <= s <= 1 for s in odd.values())


def test_quality_learns_from_long_texts_and_scores_them(spark):
    rng = random.Random(6)
    bad = lambda n: " ".join(rng.choice(["buy", "$$$", "click!!", "XXX", "win"]) for _ in range(n))
    # every labelled text has more than 20,000 characters
    rows = [(k, prose(rng, "en", 5000) if k % 2 else bad(8000), "en") for k in range(24)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(24)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(table(spark, rows), labels, held_out=None)
    assert model.good and model.score(prose(rng, "en", 300).encode()) > 0.7 > 0.3 > model.score(bad(300).encode())
    # the difference does not go to 0 with the length
    short, long = prose(rng, "en", 4000).encode()[:20_000], prose(rng, "en", 200_000).encode()
    assert model.difference(long) > 0.8 * model.difference(short) > 0


def test_language_model_beats_the_base_on_its_own_kind(spark):
    rng = random.Random(2)
    heads = ["red", "blue", "green"]
    tails = ["car", "bike", "boat"]
    rows = [(k, " ".join(f"{rng.choice(heads)} {rng.choice(tails)}" for _ in range(30)), "en") for k in range(60)]
    docs = table(spark, rows)
    model, counts = language_model.fit(docs.where("doc_id < 50"), n_classes=4)
    found = {r.doc_id: r for r in language_model.score(table(spark, [*rows, (90, None, None), (91, "purple", None)]), model, counts).collect()}
    assert all(found[k].score > found[k].base_score for k in range(50, 60))
    assert found[90].n_tokens == 1 and found[91].n_tokens == 2 and found[91].n_known == 1
    total = 50 * 61
    assert found[55].train_tokens == total


def test_every_word_of_the_language_model_gets_a_class(spark):
    rng = random.Random(4)
    # 60 cars and 60 runs, 25 times each or so: too rare to be broadcast at this rate
    rows = [(k, " ".join(f"the {rng.choice(['red', 'blue'])} car{rng.randrange(60)} then {rng.choice(['he', 'she'])} runs{rng.randrange(60)}" for _ in range(30)), "en") for k in range(50)]
    docs = table(spark, rows)
    model, rare = language_model.fit(docs, n_classes=8, rate=0.01)
    classes = {r.word: r["class"] for r in language_model.class_words(docs, model, rare).collect()}
    assert set(classes) == {w for _, t, _ in rows for w in t.split()}
    kinds = [{c for w, c in classes.items() if w.startswith(x)} for x in ("car", "runs")]
    assert not kinds[0] & kinds[1] and all(c < 8 for c in classes.values())
    counts = {r.word: r.n for r in language_model.class_words(docs, model, rare).collect()}
    assert sum(counts.values()) + len(rows) == model.total
    # broadcast or joined, a word's score is that of the same classes
    found = {r.doc_id: r for r in language_model.score(table(spark, [(0, rows[0][1], "en"), (1, "car1 runs1 zzz car2", "en")]), model, rare).collect()}
    vocabulary = {w: (k, counts[w]) for w, k in classes.items()}
    for i, t in ((0, rows[0][1]), (1, "car1 runs1 zzz car2")):
        before, want, base = 9, 0.0, 0.0
        for w in [*t.split(), None]:
            k, n = (9, len(rows)) if w is None else vocabulary.get(w, (8, 0))
            emit = 1.0 if k > 7 else n / sum(counts[x] for x in classes if classes[x] == k)
            unigram = (n + 1) / (model.total + model.distinct + 1)
            want += math.log10(0.95 * model.move[before, k] * emit + 0.05 * unigram)
            base += math.log10(unigram)
            before = k
        assert found[i].score == pytest.approx(want) and found[i].base_score == pytest.approx(base)
    assert found[1].n_known == 4


def test_media_round_trip(spark, texts):
    store = media.stored_payloads(table(spark, texts))
    rows = {r.digest: r for r in media.described(store).collect()}
    by_id = {r.key: r.digest for r in media.resolved(media.sequences(store.select("key", "html")), media.described(store), "key").where("digest IS NOT NULL").select("key", "digest").collect()}
    for i, t, _ in texts:
        payload = media.padded((t or "").encode())
        r = rows[by_id[i]]
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert media.from_png(media.to_png(payload)) == payload


def test_pages_of_one_host(spark):
    body = "<html><head><title>t</title></head><body><nav><a href=/a>menu</a></nav><div class='cookie'>cookies!</div><article><h1>Head {k}</h1><p>Text &amp; more {k}.<br>line</p><p>Two  words</p></article><aside>side</aside><section class='comments'><p>I say</p></section><footer>foot</footer></body></html>"
    rows = [(k, f"https://a.example/{k}", body.replace("{k}", str(k))) for k in range(8)] + [(20, None, None), (21, "https://b.example/", ""), (22, "https://c.example/x", "<p>alone</p>")]
    found = {r.page_id: r.main_text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[3].split("\n\n")[0] == "Head 3" and "Text & more 3." in found[3] and "Two words" in found[3]
    assert not any(x in found[3] for x in ("menu", "cookies", "side", "I say", "foot"))
    assert found[20] == found[21] == "" and found[22] == "alone"


def test_links_in_an_article_are_no_menu(spark):
    linked = "<article><h2>A{k}</h2><p>x{k} <a href=/l>l</a></p><h2>B{k}</h2><p>y{k} <a href=/m>m</a></p></article>"
    listed = "<article><h1>H{k}</h1><ul><li><a href=/1>one{k}</a></li><li><a href=/2>two{k}</a></li></ul></article>"
    bare = "<ul><li><a href=/1>home</a></li><li><a href=/2>about</a></li></ul><p>x{k} <a href=/l>l</a></p><p>y{k} <a href=/m>m</a></p>"
    hosts = [(linked, 1), (linked, 5), (listed, 5), (bare, 5)]
    rows = [(10 * h + k, f"https://h{h}.example/{k}", html.replace("{k}", str(k))) for h, (html, n) in enumerate(hosts) for k in range(n)]
    found = {r.page_id: r.main_text.split("\n\n") for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[0] == ["A0", "x0 l", "B0", "y0 m"] and found[13] == ["A3", "x3 l", "B3", "y3 m"]
    assert found[24] == ["H4", "one4", "two4"] and found[32] == ["x2 l", "y2 m"]


def test_text_of_the_template_goes_whatever_its_class(spark):
    page = "<body><div class='c7'>Every page says this</div><div class='inhalt'><p>Own {k}</p></div><div class='hinweis'>Und dies</div></body>"
    rows = [(k, f"https://a.example/{k}", page.replace("{k}", str(k))) for k in range(5)]
    rows += [(10 + k, f"https://b.example/{k}", "<p>One text</p>") for k in range(5)] + [(20, "https://c.example/", page)]
    rows += [(30 + k, f"https://d.example/{k}", f"<article><p>Same</p></article><!--{k}-->") for k in range(5)]
    found = {r.page_id: r.main_text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [found[k] for k in range(5)] == [f"Own {k}" for k in range(5)]
    # nothing else on the page, a host of one page, an article
    assert found[10] == "One text" and "Every page says this" in found[20] and found[30] == "Same"


def test_quotes_are_linked(spark):
    rows = [(1, 0, "user", "How are you today?\nFine weather."), (1, 1, "assistant", "> How are you today?\nWell, thanks."), (1, 2, "user", ">> How are you today?\n> Well, thanks.\nGood."), (1, 3, "assistant", "> never said\nhm"), (2, 0, None, None)]
    found = {(r.conv_id, r.turn): r for r in chat_format.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert found[1, 1].reply_to == 0 and found[1, 2].reply_to == 1 and found[1, 2].depth == 2 and found[1, 2].thread == 0
    assert found[1, 1].text == "Well, thanks." and found[1, 3].reply_to is None and found[2, 0].text == ""


def test_parts_of_messages_are_quoted(spark):
    said = "line one here\nline two here\nline three here\nline four. And a second sentence in it.\n\nNext paragraph is\nwrapped like this one.\n\nThird paragraph."
    replies = [
        "> line two here\n> line three here\nmiddle lines",
        "> line one here\n> line two here\n> line three here\n> line four. And a second sentence in it.\n>\n> Next paragraph is wrapped\n> like this one.\ntwo paragraphs",
        "> And a second sentence in it.\na sentence",
        "> wrapped\n> like this\na part of a paragraph",
        "> line one\n>\n> Third paragraph.\nparts apart",
        "> line one three\nwords not in a row",
    ]
    rows = [(1, 0, "user", "something else"), (1, 1, "user", said)] + [(1, 2 + k, "assistant", t) for k, t in enumerate(replies)]
    found = {r.turn: r for r in chat_format.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [found[k].reply_to for k in range(2, 8)] == [1, 1, 1, 1, 1, None]
    assert [found[k].n_linked for k in range(2, 8)] == [1, 2, 1, 1, 2, 0] and found[2].text == "middle lines"


def test_clashing_and_extra_columns(spark, texts):
    docs = table(spark, texts).withColumnRenamed("source", "class_id").withColumnRenamed("n_chars", "_key")
    assert minhash_dedup.keep_first(docs).columns == docs.columns
    assert substring_dedup.clean(docs).columns == docs.columns
    bench = spark.createDataFrame([(1, texts[3][1])], "item_id bigint, text string")
    assert decontamination.clean(docs, bench).columns == docs.columns
    pages = spark.createDataFrame([(1, "https://a.example/", "<p>x</p>", 5, 6)], "page_id bigint, url string, html string, _host int, _part int")
    assert [tuple(r) for r in html_extraction.extract(pages).collect()] == [(1, "https://a.example/", "<p>x</p>", 5, 6, "x")]


def test_results_whose_names_are_taken(spark, texts):
    docs = table(spark, texts[:8])
    clash = docs.withColumnsRenamed({"lang": "ids", "source": "decoded_sha256"})
    out = sentencepiece_codec.encode(clash, decoded_sha256="decoded_sha256")
    assert out.columns == [*clash.columns, "_ids", "_decoded_sha256"] and {r.ids for r in out.collect()} == {r[2] for r in texts[:8]}
    assert sentencepiece_codec.decode(out, "_ids", "text").select("_text").first()[0] == texts[0][1]
    taken = docs.withColumnsRenamed({"text": "html", "lang": "Parts"})
    assert media.sequences(taken).columns == [*taken.columns, "_parts"]
    pages = spark.createDataFrame([(1, "https://a.example/", "<p>x</p>", "y", 3)], "page_id bigint, url string, html string, main_text string, _slots int")
    assert [tuple(r) for r in html_extraction.extract(pages).collect()] == [(1, "https://a.example/", "<p>x</p>", "y", 3, "x")]
    odd = table(spark, texts).withColumnsRenamed({"lang": "_doc", "source": "found", "n_chars": "spans"})
    assert {r.doc_id: r.text for r in substring_dedup.clean(odd).collect()} == {r.doc_id: r.text for r in substring_dedup.clean(table(spark, texts)).collect()}


def test_repeated_rows_and_ids(spark, texts):
    rng = random.Random(12)
    a, b, other = (prose(rng, "en", 60) for _ in range(3))
    # id 1 twice with one text, id 5 with two texts that others have
    rows = [(1, a, "en"), (1, a, "en"), (4, a, "en"), (5, b, "en"), (5, other, "en"), (7, other, "en"), (9, b + " more", "en"), (None, a, "en"), (None, a, "en")]
    docs = table(spark, rows)
    found = sorted((r.doc_id, r.class_id) for r in minhash_dedup.classes(docs).collect() if r.doc_id is not None)
    assert found == [(1, 1), (1, 1), (4, 1), (5, 5), (5, 5), (7, 5), (9, 5)]
    kept = minhash_dedup.keep_first(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (0, a), (1, a), (5, min(b, other))])
    # substring dedup: equal ids are not smaller than one another
    found = substring_dedup.digest(docs, substring_dedup.find(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (0, 0), (1, 0), (1, 0), (4, 60), (5, 0), (5, 0), (7, 60), (9, 60)]
    bench = spark.createDataFrame([(1, a), (1, a), (None, b)], "item_id bigint, text string")
    hits = decontamination.digest(decontamination.find(docs, bench)).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in hits) == [(0, 60, 1), (0, 60, 1), (1, 60, 1), (1, 60, 1), (4, 60, 1), (5, 0, 0), (5, 60, 0), (7, 0, 0), (9, 60, 0)]
    model, rare = language_model.fit(docs)
    scores = {(r.doc_id, r.n_tokens): round(r.score, 9) for r in language_model.score(docs, model, rare).collect()}
    assert len(scores) == 6 and language_model.score(docs, model, rare).count() == len(rows)
    told = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(told) == len(rows) and {r.lang_pred for r in told} == {"en"}


def test_one_word_over_and_over(spark):
    rows = [(1, "x " * 30_000, "en"), (2, "x " * 20_000 + "y", "en"), (3, "x " * 49, "en")]
    docs = table(spark, rows)
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.digest(docs, substring_dedup.find(docs)).collect()}
    assert found == {1: (30_000, 0), 2: (20_001, 20_000), 3: (49, 0)}
    assert {r.doc_id: r.class_id for r in minhash_dedup.classes(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_quality_with_one_class_ties_and_repeated_labels(spark):
    docs = table(spark, [(k, f"text {k} " * 20, "en") for k in range(8)])
    labels = spark.createDataFrame([(k % 4, 1, 0) for k in range(8)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels, held_out=None)
    found = quality.score(docs, model).collect()
    assert len({r.score for r in found}) == 1 and found[0].predicted == 1
    # a score of just the threshold is accepted
    assert {r.predicted for r in quality.score(docs, model, threshold=found[0].score).collect()} == {1}
    assert quality.keep_good(docs, model, threshold=found[0].score).count() == 8


def test_probabilities_of_all_words_add_up(spark):
    docs = table(spark, [(k, "a b c a b d a", "en") for k in range(5)])
    model, rare = language_model.fit(docs, n_classes=3)
    words = ["a", "b", "c", "d"]
    asked = table(spark, [(k, w, None) for k, w in enumerate(words)] + [(9, "", None), (10, "unseen", None)])
    found = {r.doc_id: r for r in language_model.score(asked, model, rare).collect()}
    # of an empty text the score is that of the end; first words and the end together leave something for unseen words
    end = 10 ** found[9].score
    assert 0 < end < 1 and all(0 < 10 ** found[k].score < 1 for k in (0, 1, 2, 3, 10))


def test_slots_of_pages_without_an_article(spark):
    rng = random.Random(5)
    rows = []
    for k in range(9):
        own = "".join(f"<p>{prose(rng, 'en', 80)}</p>" for _ in range(1 + k % 3))
        # no element or class says what it is
        page = f"<body><div class='ua'>{prose(rng, 'de', 4)}</div><div class='ub'><h1>T{k}</h1><span>by x</span></div><div class='uc'><div class='ud'>{own}</div></div><div class='ue'>{prose(rng, 'de', 5)}</div></body>"
        rows.append((k, f"https://a.example/{k}", page))
    # an article of two parts keeps both
    for k in range(9):
        rows.append((20 + k, f"https://b.example/{k}", f"<body><div class='a'><p>{prose(rng, 'en', 20)}</p></div><div class='b'><p>{prose(rng, 'en', 20)}</p></div></body>"))
    # one page alone has no template to go by
    rows.append((40, "https://c.example/", rows[0][2]))
    found = {r.page_id: r.main_text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k, _, page in rows[:9]:
        wanted = [f"T{k}", *[x.split("</p>")[0] for x in page.split("<p>")[1:]]]
        assert found[k] == "\n\n".join(wanted)
        # without the template the page can't tell
        assert html_extraction.main_text(page, set(), set(), set()) != found[k]
    assert all(len(found[20 + k].split("\n\n")) == 2 for k in range(9)) and len(found[40].split("\n\n")) == 5


def test_classes_that_do_not_nest_are_no_template():
    token = lambda t, up, vector, n=4, kind=0, size=0, at=0: dict(token=t, pages=4, n=n, vector=vector, up=up, kind=kind, size=size, at=at)
    rows = [token(1, 0, 10, kind=html_extraction.CONTAINER, size=100), token(2, 1, 10, kind=html_extraction.CONTAINER, size=90), token(3, 99, 11), token(4, 3, 12), token(5, 2, 13, n=9)]
    template, menus, slots = html_extraction.deduced(rows, 4)
    # 3 stands in what is on few pages, and 4 in 3; 5 repeats alone
    assert template == [1, 2] and menus == [] and slots == [2]


@pytest.mark.parametrize("source", ["<" + "a" * 100, "<a ", "<a '\"", "<a='\"", "<p><a href='", "<div class=a>x", "<p>x", "<div>x", "<b>", "<b></i>x", "<!--", "<script '", "<script>", "</", "<a class=\"", "class="])
def test_broken_pages_cost_no_more_than_their_length(source):
    page = source * (1_000_000 // len(source)) if source[1:3] != "aa" else "<" + "a" * 1_000_000
    began = time.time()
    html_extraction.main_text(page, set(), set(), set())
    html_extraction.main_text(page, {1}, {2}, {3})
    html_extraction.Page(page).text_sizes()
    assert time.time() - began < 30  # some 5 s at most on a free machine


def test_random_broken_pages_cost_no_more_than_their_length():
    dice = random.Random(6)
    parts = ["<", ">", '"', "'", "=", "a", "div", "script", "style", "<!--", "-->", "</", "/", " ", "<p>", "class", "x" * 50, "<a href=", "&amp", "<title"]
    for n in range(2, len(parts)):
        page = "".join(dice.choices(dice.sample(parts, n), k=60_000))
        began = time.time()
        html_extraction.main_text(page, set(), set(), set())
        assert time.time() - began < 10


def test_pages_that_repeat_and_tie(spark):
    page = "<body><div class='u'><p>same text here</p></div></body>"
    rows = [(k, "https://a.example/", page) for k in (1, 1, 2)] + [(None, None, page), (5, None, page)]
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(found) == 5 and {r.main_text for r in found} == {"same text here"}


def test_suffix_array_is_sorted_and_finds_every_piece():
    pieces = sentencepiece_codec.Pieces.read()
    pieces.ready()
    rng = np.random.default_rng(3)
    raw = ["ab" * 40, "internationalisation", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "unbelievable", " ".join("the of and".split()), "internationalisation!"]
    text = np.frombuffer(b"\xff".join(x.encode() for x in raw) + b"\xff", np.uint8)
    begins = np.flatnonzero(text != 0xFF)
    start, end, ids = pieces.edges(text, rng.permutation(begins))
    found = set(zip(start.tolist(), end.tolist(), ids.tolist(), strict=True))
    whole = text.tobytes()
    wanted = {(k, k + len(b), n) for b, n in ((p.encode(), n) for p, n in pieces.ids.items()) for k in begins.tolist() if whole.startswith(b, k)}
    assert found == wanted and len(found) == len(start)


def test_many_references_to_one_digest(spark):
    store = media.stored_payloads(table(spark, [(k, "same" if k % 3 else f"t{k}", None) for k in range(300)] + [(None, "same", None)]))
    shown = media.sequences(store.select("key", "html"))
    lost = spark.createDataFrame([(900, f'<img src="sha256:{"0" * 64}"><img src="x.png" alt="y">')], "key bigint, html string")
    found = media.resolved(shown.unionByName(media.sequences(lost)), media.described(store), "key").where("kind = 'img'").collect()
    assert len(found) == 303 and sum(r.payload_bytes == 64 for r in found) == 301
    assert sorted((r.position, r.digest is None, r.caption, r.payload_bytes) for r in found if r.key == 900) == [(0, False, None, None), (1, True, "y", None)]


def test_empty_tables(spark):
    docs = table(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert minhash_dedup.classes(docs).count() == 0
    assert substring_dedup.digest(docs, substring_dedup.find(docs)).count() == 0
    assert decontamination.digest(decontamination.find(docs, bench)).count() == 0
    assert language_id.predict(docs, language_id.fit(docs)).count() == 0
    assert quality.score(docs, quality.fit(docs, labels)).count() == 0
    assert sentencepiece_codec.encode(docs).count() == 0
    model, counts = language_model.fit(docs)
    assert language_model.score(docs, model, counts).count() == 0
    assert media.described(media.stored_payloads(docs)).count() == 0
    assert html_extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert chat_format.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
