"""The registered queries of the training-data operators, with SQL where DuckDB can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exactdedup, langid, linededup, negatives, pii, quality, repair, simhash, sstable, substring, warc, winnow
from .common import documents, prepare

#: Name of the vocabulary file that the contracts fix.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return linededup.report(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.report(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return winnow.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sstable.digests(documents(spark, sf_dir), vocabulary())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.identify(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.classes(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring.deduplicated(documents(spark, sf_dir), texts=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.report(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repair.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exactdedup.report(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return negatives.mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_token_output": op4_token_output,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Words by ASCII white space, and lines, as DuckDB list expressions.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = "string_split(text, chr(10))"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASCII_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_PHRASES = ", ".join(map(_quoted, quality.PHRASES))
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
WITH l AS (SELECT doc_id, source, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS pos FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) END AS key FROM l),
b AS (SELECT key, min((doc_id, pos)) AS place FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT source) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, b.key IS NOT NULL AND (k.doc_id, k.pos) != b.place AS gone FROM k LEFT JOIN b ON k.key = b.key),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id""",
    "op3_decontamination": rf"""
WITH i AS (SELECT item_id, {_ASCII_WORDS} AS w FROM benchmark), iw AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS g FROM iw), wins AS (SELECT DISTINCT item_id, n, g FROM win), sizes AS (SELECT DISTINCT n FROM wins),
d AS (SELECT doc_id, {_ASCII_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS g FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN wins ON dw.n = wins.n AND dw.g = wins.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op7_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest(list_transform(range(1, len(w) - 48), lambda k: md5(array_to_string(w[k : k + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM (SELECT doc_id, p FROM g JOIN f ON g.h = f.h WHERE first < doc_id)),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT e.doc_id, count(*) FILTER (r.q IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.q) FILTER (r.q IS NULL), '') AS kept FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.q = e.q GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op8_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT doc_id, ls, list_filter(ls, lambda x: NOT (
  (len(regexp_extract_all(x, '{quality.SYMBOLS}')) >= 3 AND 20 * len(regexp_extract_all(x, '{quality.SYMBOLS}')) > length(x))
  OR (len(regexp_extract_all(x, '\p{{L}}')) >= 20 AND 2 * len(regexp_extract_all(x, '\p{{Lu}}')) > len(regexp_extract_all(x, '\p{{L}}')))
  OR list_bool_or(list_transform([{_PHRASES}], lambda p: contains(lower(x), p)))
  OR (NOT contains({_quoted(quality.ENDS)}, right(rtrim(x, {_BLANKS}), 1)) AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 10))) AS good FROM l),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS h FROM d WHERE len(w) >= 3),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls)::BIGINT AS n_lines, (len(ls) - len(good))::BIGINT AS n_failed_lines, length(array_to_string(ls, '')) AS c0, length(array_to_string(good, '')) AS c1 FROM d JOIN b ON d.doc_id = b.doc_id LEFT JOIN n ON n.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (c0 - c1 > 0.5 * c0) AS kept, n_lines, n_failed_lines FROM m""",
    "op12_exact_dedup": rf"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY d.t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    "op13_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.r != c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, cr) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.cr) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score) WHERE rank <= 5""",
}
