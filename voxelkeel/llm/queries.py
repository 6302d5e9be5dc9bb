"""Registered queries of the training-data operators and, where SQL can say it, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from voxelkeel.llm import alignment, ann, ctw, htmlwrap, jaccard, langid, mixing, packing, quality, repair, rules, subdedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, sf_dir, "pages"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.passes("base")).alias("base_failed"), rules.passes("v2").alias("kept"), "failed_bits")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return mixed.select("doc_id", "n_tokens", "domain", "posterior", "rate", "copies")


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(repair.damage_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLES["op2_quality_rules"] = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
), places AS (
    SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d
), runs AS (
    SELECT r, i, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s || ' ' || lead(w, 3) OVER s || ' ' || lead(w, 4) OVER s AS five
    FROM places WINDOW s AS (PARTITION BY r ORDER BY i)
), windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM runs WHERE five IS NOT NULL
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n_repeat_words
    FROM (SELECT r, i, unnest(range(0, 5)) AS k FROM windows WHERE n >= 2) GROUP BY r
), measured AS (
    SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(text) - length(replace(text, '!', '')) AS n_exclaims,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           len(list_filter(words, lambda w: regexp_matches(w, '\\p{L}'))) AS n_lettered_words,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d LEFT JOIN covered USING (r)
), bits AS (
    SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
        + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
        + 16 * (100 * n_exclaims > 20 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
        + 64 * (word_chars > 15 * n_words)::BIGINT + 128 * (100 * n_lettered_words < 60 * n_words)::BIGINT AS failed_bits
    FROM measured
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM bits
"""
ORACLES["op1_warc"] = """
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
    SELECT hex, max(page_id) AS best FROM p GROUP BY hex
), b AS (
    SELECT hex, best, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest
    FROM g
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN b USING (hex)
"""
ORACLES["op6_jaccard_join"] = """
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), places AS (
    SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d WHERE len(words) >= 4
), grams AS (
    SELECT doc_id, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s || ' ' || lead(w, 3) OVER s AS g
    FROM places WINDOW s AS (PARTITION BY doc_id ORDER BY i)
), tokens AS (
    SELECT DISTINCT doc_id, g FROM grams WHERE g IS NOT NULL
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM d WHERE len(words) BETWEEN 1 AND 3
), sizes AS (
    SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM tokens x JOIN tokens y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * common.n >= 85 * (s.n + t.n - common.n)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""
ORACLES["op7_substring_dedup"] = """
WITH d AS (
    SELECT doc_id, text, regexp_extract_all(text, '(?:[^\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D.!?,;:][\\x20\\x09\\x0B-\\x0D]+)*[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS units,
           length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS lead
    FROM documents
), l AS (
    SELECT doc_id, lead, unnest(units) AS unit, generate_subscripts(units, 1) AS i FROM d
), n AS (
    SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS plain,
           lead + coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM l
), ranked AS (
    SELECT *, row_number() OVER u > 1 AS marked, first_value(doc_id) OVER u AS keeper, count(*) OVER (PARTITION BY plain) > 1 AS twice
    FROM n WINDOW u AS (PARTITION BY plain ORDER BY doc_id, i)
), grouped AS (
    SELECT *, sum((NOT marked)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run, sum((NOT twice)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run_of_twice FROM ranked
), runs AS (
    SELECT doc_id, run, min(i) AS a, max(i) AS b, min(pos) AS start, max(pos + length(unit)) AS stop, arg_min(keeper, i) AS keeper, count(*) AS units
    FROM grouped WHERE marked GROUP BY doc_id, run HAVING sum(len(string_split(plain, ' '))) >= 30
), again AS (
    SELECT doc_id, sum(units) AS n_repeated FROM (SELECT doc_id, count(*) AS units FROM grouped WHERE twice GROUP BY doc_id, run_of_twice HAVING sum(len(string_split(plain, ' '))) >= 30) GROUP BY doc_id
), kept AS (
    SELECT n.doc_id, string_agg(unit, '' ORDER BY i) AS text FROM n WHERE NOT EXISTS (SELECT 1 FROM runs WHERE n.doc_id = runs.doc_id AND n.i BETWEEN runs.a AND runs.b) GROUP BY n.doc_id
), summed AS (
    SELECT doc_id, sum(units) AS n_removed, list(start ORDER BY a) AS removed_start, list(stop ORDER BY a) AS removed_end, list(keeper ORDER BY a) AS kept_doc_id FROM runs GROUP BY doc_id
)
SELECT d.doc_id, left(d.text, d.lead) || coalesce(kept.text, '') AS text, coalesce(len(d.units), 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_repeated, 0)::BIGINT AS n_repeated,
       coalesce(removed_start, [])::BIGINT[] AS removed_start, coalesce(removed_end, [])::BIGINT[] AS removed_end, coalesce(kept_doc_id, [])::BIGINT[] AS kept_doc_id
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN summed USING (doc_id) LEFT JOIN again USING (doc_id)
"""
ORACLES["op12_conversation_repair"] = """
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), summed AS (
    SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1),
               lambda i: [ascii(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) % 20 AS draw
    FROM (SELECT DISTINCT k FROM keyed)
), damaged AS (
    SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
           CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM keyed JOIN summed USING (k)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
), inserts(a, b, letters, spent, said) AS (
    VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
           (0, 2, 'I', 5, 'user:' || chr(10)), (1, 2, 'I', 5, 'user:' || chr(10)), (2, 3, 'I', 5, 'assistant:' || chr(10)), (3, 2, 'I', 5, 'user:' || chr(10)),
           (0, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)),
           (2, 2, 'II', 10, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10))
), edits(a, b, letter, initial) AS (
    VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 2, 'R', 'user'), (1, 2, 'R', 'user'), (2, 3, 'R', 'assistant'), (3, 2, 'R', 'user'),
           (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (2, 3, 'K', 'a'), (3, 2, 'K', 'u')
), survivors(conv_id, i, state, best) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'said': ''} FROM conversations
    UNION ALL
    SELECT s.conv_id, s.i + 1, e.b, min({
        'cost': s.best.cost + n.spent + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END,
        'audit': s.best.audit || n.letters || e.letter,
        'said': s.best.said || n.said || CASE e.letter WHEN 'D' THEN '' WHEN 'R' THEN e.initial || ':' || f.text || chr(10) ELSE f.role || ':' || f.text || chr(10) END})
    FROM survivors s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
        JOIN inserts n ON n.a = s.state JOIN edits e ON e.a = n.b
    WHERE (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR substr(f.role, 1, 1) = e.initial)
    GROUP BY s.conv_id, s.i, e.b
), counted AS (
    SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), ended AS (
    SELECT s.conv_id, min({'cost': s.best.cost + n.spent, 'audit': s.best.audit || n.letters, 'said': s.best.said || n.said}) AS best
    FROM survivors s LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id JOIN inserts n ON n.a = s.state
    WHERE s.i = coalesce(c.n, 0) AND n.b IN (0, 3) GROUP BY s.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(left(best.said, greatest(length(best.said) - 1, 0))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
#: The given pages share one template, which SQL can read off; other templates are tested by hand.
ORACLES["op13_html_extraction"] = """
WITH a AS (
    SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body
    FROM pages
), d AS (
    SELECT page_id, url, trim(regexp_replace(replace(replace(replace(body, '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g')) AS text FROM a
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
