"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as c
from tessera.llm import chat_format, decontamination, html_extraction, language_id, language_model, media, minhash_dedup, mixing, quality, sentencepiece_codec, source_audit, substring_dedup, vector_codes


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark")))


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
      FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM n),
g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, l WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, g.n, k FROM g JOIN n USING (n, g)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return substring_dedup.digest(docs, substring_dedup.find(docs))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, k, sha256(array_to_string(w[k:k + 49], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM g JOIN f USING (g) WHERE least < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) w
      LEFT JOIN r ON r.doc_id = w.doc_id AND r.p = w.p WHERE r.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(c.table(spark, sf_dir, "documents"))



def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    filters = language_id.fit(docs.where(c.fold("doc_id", 4) != 2))
    found = language_id.predict(docs, filters)
    return found.select("doc_id", (c.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_grams")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = quality.fit(docs, c.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (c.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")



def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model, counts = language_model.fit(docs.where(c.fold("doc_id", 7) != 2))
    found = language_model.score(docs, model, counts)
    return found.select("doc_id", (c.fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")



def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again: ids, their number, the decoded text's digest, and whether it is the text (blanks for U+2581)."""
    docs = c.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = sentencepiece_codec.encode(docs, decoded_sha256="decoded_sha256")
    same = F.sha2(F.translate("text", sentencepiece_codec.BLANK, " "), 256) == F.col("decoded_sha256")
    return found.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "decoded_sha256", same.alias("round_trip"))



def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(c.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image in an interleaved document, resolved by digest."""
    store = media.stored_payloads(c.table(spark, sf_dir, "documents"))
    shown = media.sequences(store.select("key", "n_bytes", "html"))
    each = media.resolved(shown, media.described(store), ["key", "n_bytes"]).where("digest IS NOT NULL")
    return each.select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")



def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(c.table(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.codes(c.table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


#: A round: the nearest entries, their parts' means rounded down, and the next codebooks.
_FIT = "".join(
    f"""
a{k} AS MATERIALIZED (SELECT id, part, arg_min(entry, gap) AS entry, min(gap.far) AS far FROM (
      SELECT v.id, v.part, b.entry, {{'far': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': b.entry}} AS gap
      FROM v JOIN b{k} b ON b.part = v.part) GROUP BY id, part),
m{k} AS (SELECT part, entry, list(CAST(floor_sum AS BIGINT) ORDER BY place) AS x FROM (
      SELECT part, entry, place, sum(n) // count(*) - CASE WHEN sum(n) < 0 AND sum(n) % count(*) <> 0 THEN 1 ELSE 0 END AS floor_sum
      FROM (SELECT v.part, a.entry, unnest(v.x) AS n, unnest(range(len(v.x))) AS place FROM v JOIN a{k} a ON a.id = v.id AND a.part = v.part)
      GROUP BY part, entry, place) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry),"""
    for k in range(6)
)

OP11_SQL = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS x FROM e, range(8) AS r(part)),
b0 AS (SELECT part, id AS entry, x FROM v WHERE id < 16),{_FIT}
a6 AS (SELECT id, part, arg_min(entry, gap) AS entry, min(gap.far) AS far FROM (
      SELECT v.id, v.part, b.entry, {{'far': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': b.entry}} AS gap
      FROM v JOIN b6 b ON b.part = v.part) GROUP BY id, part),
c AS (SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far) AS error FROM a6 GROUP BY id),
d AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN e ON e.id = c.id, d
"""


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(c.table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, count(*) AS words, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang, l.words, l.total AS total_lang,
             sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n,
             CAST(1 + (CAST(1000000000 AS HUGEINT) * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * words AS HUGEINT) AS BIGINT) AS p,
             CAST(1 + (CAST(1000000000 AS HUGEINT) * CAST(n_lang + 5 AS HUGEINT)) // CAST(total_lang + 5 * words AS HUGEINT) AS BIGINT) AS q
      FROM f),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM a)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: equal documents that are taken equally often are one row of the operator."""
    rows = mixing.copies(c.table(spark, sf_dir, "documents")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op9_chat_formatting": op9_chat_formatting, "op6_html_extraction": op6_html_extraction, "op7_media_columns": op7_media_columns, "op2_sentencepiece": op2_sentencepiece, "op5_lm_scoring": op5_lm_scoring, "op1_language_id": op1_language_id, "op4_quality_classifier": op4_quality_classifier, "op10_minhash_dedup": op10_minhash_dedup, "op8_substring_dedup": op8_substring_dedup, "op3_decontamination": op3_decontamination, "op11_vector_codes": op11_vector_codes, "op12_source_audit": op12_source_audit, "op13_source_mixing": op13_source_mixing}
SQL = {"op8_substring_dedup": OP8_SQL, "op3_decontamination": OP3_SQL, "op11_vector_codes": OP11_SQL, "op12_source_audit": OP12_SQL}
