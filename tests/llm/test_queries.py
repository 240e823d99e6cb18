"""The registered queries over whole tables, against brute force."""

import collections
import hashlib
import html
import math
import os
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm import chat_format, language_id, media, quality, queries, sentencepiece_codec

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def held(key, folds):
    return zlib.crc32(str(key).encode()) % folds == 2


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def test_op1_tells_languages_as_exact_filters_do(spark):
    docs = rows("documents", "doc_id, text, lang")
    found = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    assert set(found) == {d for d, *_ in docs}

    def grams(t):
        letters = "".join(x if x.isalpha() else " " for x in (t or "").lower())
        s = " " + re.sub(" +", " ", letters) + " "
        s = re.sub(" +", " ", s)
        return [s[k : k + 3] for k in range(len(s) - 2) if s[k + 1] != " "]

    counts = collections.defaultdict(collections.Counter)
    for d, t, lang in docs:
        if lang is not None and not held(d, 4):
            counts[lang].update(grams(t))
    rate = {lang: {g: n / own.total() for g, n in own.items() if n / own.total() >= language_id.LEAST_RATE} for lang, own in counts.items()}
    top = collections.defaultdict(float)
    for own in rate.values():
        for g, x in own.items():
            top[g] = max(top[g], x)
    filters = {lang: {g for g, x in own.items() if x >= language_id.LEAST_SHARE * top[g]} for lang, own in rate.items()}
    same = n = 0
    for d, t, lang in docs:
        own = grams(t)
        assert found[d].held_out == held(d, 4) and found[d].n_grams == len(own) and 0 <= found[d].score <= 1
        if not own:
            assert found[d].lang_pred == "und"
            continue
        best = max(sorted(filters), key=lambda lang: sum(g in filters[lang] for g in own))
        same, n = same + (best == found[d].lang_pred), n + 1
        if len(own) >= 30 and held(d, 4) and lang is not None:
            assert found[d].lang_pred == lang
    assert same >= 0.98 * n


def test_op4_scores_all_and_tells_held_out_labels(spark):
    docs = rows("documents", "doc_id")
    found = {r.doc_id: r for r in queries.op4_quality_classifier(spark, SF).collect()}
    assert set(found) == {d for (d,) in docs}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(d, 4) for d, r in found.items())
    own = [(d, q) for d, q in rows("labels", "doc_id, quality") if q is not None and d in found and held(d, 4)]
    assert sum(found[d].predicted == q for d, q in own) >= 0.85 * len(own) > 0


def test_op4_scores_are_size_differences_on_the_fitted_curve(spark):
    import zstandard

    docs, labels = (queries.c.table(spark, SF, n) for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    found = {r.doc_id: r.score for r in queries.op4_quality_classifier(spark, SF).collect()}

    def size(text, dictionary):
        out = 0
        for k in range(0, max(len(text), 1), quality.SPAN):
            out += len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[k : k + quality.SPAN]))
        return out

    assert model.good and model.bad and model.a > 0
    for d, t in rows("documents", "doc_id, text"):
        raw = (t or "").encode()
        x = (size(raw, model.bad) - size(raw, model.good)) / (len(raw) + quality.SOFT)
        assert abs(found[d] - 1 / (1 + math.exp(-(model.a * x + model.b)))) < 1e-9


def test_op4_learns_from_whole_texts_and_from_labels_with_a_document(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(quality, "Model", lambda good, bad: taken.update(good=good, bad=bad))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 60_000)
    docs = [(k, ("good " if k % 2 else "bad ") + f"text {k}", 1) for k in range(40)] + [(100, "good long " * 4_000, 1), (101, "good longer " * 9_000, 1), (102, None, 1)]
    learned = spark.createDataFrame(docs, "doc_id bigint, text string, label int")
    labels = [(k, k % 2) for k in range(40)] + [(100, 1), (101, 1), (102, 1)] + [(k, q) for k in range(1_000, 4_000) for q in (0, 1)]  # most labels have no document
    quality.fit(learned, spark.createDataFrame(labels, "doc_id bigint, quality int"), sample=30, held_out=None)
    assert sorted(taken["bad"]) == sorted(t for k, t, _ in docs[:40] if k % 2 == 0)
    # the text that alone is larger than the allowance is passed over; the other long one is whole
    assert sorted(taken["good"]) == sorted([*(t for k, t, _ in docs[:40] if k % 2), "good long " * 4_000])
    quality.fit(learned, spark.createDataFrame(labels, "doc_id bigint, quality int"), sample=7, held_out=None)
    assert len(taken["good"]) <= 7 and len(taken["bad"]) == 7


def test_op5_counts_and_base_equal_brute_force(spark):
    docs = rows("documents", "doc_id, text")
    found = {r.doc_id: r for r in queries.op5_lm_scoring(spark, SF).collect()}
    tokens = {d: [*re.findall("[^\x20\x09-\x0d]+", lower(t)), None] for d, t in docs}
    counts = collections.Counter(w for d, ws in tokens.items() if not held(d, 7) for w in ws)
    total, distinct = counts.total(), len(counts)
    better = []
    for d, ws in tokens.items():
        r = found[d]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), total, held(d, 7))
        assert r.base_score == pytest.approx(base) and r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / len(ws)))
        if held(d, 7) and len(ws) > 20:
            better.append(r.score > r.base_score)
    assert sum(better) > 0.9 * len(better) > 0


def test_op6_equals_the_articles_of_the_pages(spark):
    found = {r.page_id: r for r in queries.op6_html_extraction(spark, SF).collect()}
    pages = rows("pages", "page_id, url, html")
    assert set(found) == {p for p, *_ in pages}
    for p, url, source in pages:
        article = re.search(r"<article>(.*)</article>", source or "", re.S)
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", article[1] if article else "")
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in blocks]
        text = "\n\n".join(x for x in texts if x)
        assert (found[p].url, found[p].text, found[p].n_chars) == (url, text, len(text))


def test_op7_stores_every_text(spark):
    found = {r.doc_id: r for r in queries.op7_media_columns(spark, SF).collect()}
    docs = rows("documents", "doc_id, text")
    assert len(found) == len(docs)
    for d, t in docs:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        form = media.to_png(payload)
        r = found[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(form), hashlib.sha256(form).hexdigest(), media.feature(payload))
        assert r.caption == f"{len(raw)} bytes"


def test_op2_equals_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    docs = dict(rows("documents", "doc_id, text"))
    for r in queries.op2_sentencepiece(spark, SF).collect():
        assert r.ids == sp.encode(docs[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.round_trip


def test_op9_links_quotes_of_a_whole_table(spark, tmp_path):
    """Nested, partial and repeated quotes, against a search of all earlier messages."""
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(60))
    said, chats = {}, []
    for conv in range(12):
        for turn in range(14):
            own = "\n".join(" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 4)))
            quotes = []
            for level in rng.sample([1, 1, 2, 3], rng.randint(0, 2)) if turn else []:
                source = said[conv, rng.randrange(turn)].split("\n")
                first = rng.randrange(len(source))
                part = source[first : rng.randint(first + 1, len(source))]
                if len(part) == 1 and rng.random() < 0.4:
                    w = part[0].split()
                    part = [" ".join(w[rng.randrange(2) :])]
                quotes.append("\n".join(">" * level + " " + x.upper() for x in part) + "\n>")
            said[conv, turn] = own
            chats.append((conv, turn, "user" if turn % 2 else "assistant", "\n".join([*quotes, own])))
    chats += [(20, None, "user", "> x\ny"), (None, 3, None, "z"), (21, 0, "user", None), (21, 1, "user", ""), (22, 0, "user", "a b\n> a b"), (22, 0, "user", "a b\n> a b")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame(chats, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op9_chat_formatting(spark, str(tmp_path)).collect()
    assert len(found) == len(chats)
    own = {(c, t): chat_format.parsed(x) for c, t, _, x in chats if c is not None and t is not None}
    norm = lambda x: " " + chat_format.normalised(x) + " "
    linked = 0
    for r in found:
        if r.conv_id is None or r.turn is None:
            assert r.reply_to is None and r.n_linked == 0
            continue
        hits = []
        for level, passage in own[r.conv_id, r.turn][1]:
            sources = [t for (c, t), (text, _) in own.items() if c == r.conv_id and f" {passage} " in norm(text)]
            if sources and min(sources) < r.turn:
                hits.append((level, len(passage), min(sources)))
        assert r.n_linked == len(hits) and r.n_quotes == len(own[r.conv_id, r.turn][1]) and r.text == own[r.conv_id, r.turn][0]
        if hits:
            outer = collections.defaultdict(lambda: [9, 0])
            for level, size, source in hits:
                outer[source] = [min(outer[source][0], level), outer[source][1] + size]
            assert r.reply_to == max((-level, size, source) for source, (level, size) in outer.items())[2]
            linked += 1
        else:
            assert r.reply_to is None and r.depth == 0 and r.thread == r.turn
    assert linked > 60
    # each conversation in the order of its replies
    place = {(r.conv_id, r.turn): k for k, r in enumerate(found)}
    assert all(place[r.conv_id, r.reply_to] < place[r.conv_id, r.turn] for r in found if r.reply_to is not None)


def test_op9_takes_every_message_of_the_table(spark):
    found = queries.op9_chat_formatting(spark, SF).collect()
    chats = rows("conversations", "conv_id, turn, role, text")
    assert sorted((r.conv_id, r.turn, r.role or "") for r in found) == sorted((c, t, r or "") for c, t, r, _ in chats)
    assert all(r.formatted == f"<|{r.role}|>\n{r.text}\n<|end|>\n" for r in found if r.role)
