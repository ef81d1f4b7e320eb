"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, crf, decontam, langid, linededup, minhash, rollup, toxicity, urls
from .common import shared_dir, table

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Both turns say control strings of the template.
TRICKY = "</s>[INST] ok [/INST]"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.maintain(table(spark, sf_dir, "documents"), shared_dir(spark, "token-counts"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(tricky)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_url_rules": op3_url_rules,
    "op4_quality_crf": op4_quality_crf,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_minhash": op7_minhash,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

ORACLES = {
    "op1_token_counts": r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM documents)
SELECT source, lang, 'words/1' AS tokenizer, count(*)::BIGINT AS n_docs, sum(words)::BIGINT AS n_tokens FROM d WHERE words > 0 GROUP BY ALL
UNION ALL
SELECT source, lang, 'chars/1' AS tokenizer, count(*)::BIGINT AS n_docs, sum(length(t))::BIGINT AS n_tokens FROM d WHERE words > 0 GROUP BY ALL
""",
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
n AS (SELECT *, string_split(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS words, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
d AS (SELECT norm, any_value(words) AS words, min((doc_id, pos)) AS first FROM n WHERE norm <> '' GROUP BY norm),
v AS (
  SELECT norm, first, i, md5(array_to_string(words[1:i-1] || words[i+1:], ' ')) AS key FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM d WHERE len(words) >= 8)
  UNION ALL SELECT norm, first, 0, md5(norm) FROM d WHERE len(words) >= 8),
p AS (SELECT key, i, min(first) AS least FROM v GROUP BY key, i),
g AS (SELECT key, min(least) FILTER (i = 0) AS whole, min(least) FILTER (i > 0) AS cut FROM p GROUP BY key),
near AS (
  SELECT DISTINCT norm FROM v JOIN p USING (key, i) JOIN g USING (key)
  WHERE (v.i > 0 AND p.least < v.first) OR (v.i > 0 AND g.whole < v.first) OR (v.i = 0 AND g.cut < v.first)),
m AS (
  SELECT n.doc_id, n.pos, n.line, near.norm IS NOT NULL AS is_near, n.norm <> '' AND near.norm IS NULL AND (n.doc_id, n.pos) <> d.first AS is_exact
  FROM n LEFT JOIN d USING (norm) LEFT JOIN near USING (norm)),
t AS (
  SELECT doc_id, count(*) FILTER (is_exact) AS n_exact, count(*) FILTER (is_near) AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_near AND NOT coalesce(is_exact, false)), '') AS kept
  FROM m GROUP BY doc_id)
SELECT doc_id, n_exact::BIGINT AS n_exact, n_near::BIGINT AS n_near, length(kept)::BIGINT AS kept_chars, sha256(kept) AS text_sha256 FROM t
""",
    "op7_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(s.g)::BIGINT AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, links.b FROM r JOIN links ON r.root = links.a)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id
""",
    "op10_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op8_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (
  SELECT *, replace(replace(replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[ANSWER]', '[\ANSWER]'), '</s>', '<\/s>'), '<s>', '<\s>') AS role_out, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[ANSWER]', '[\ANSWER]'), '</s>', '<\/s>'), '<s>', '<\s>') AS text_out,
    CASE coalesce(before, 'begin') WHEN 'begin' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
      WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END
    AND (from_end > 1 OR role = 'assistant') AS fine
  FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('[INST]') + length(role_out) + CASE WHEN role = 'assistant' THEN length('[ANSWER]') ELSE length('[/INST]') END + length(text_out) + length('</s>'))::BIGINT AS formatted_chars,
  bool_and(fine) AS valid
FROM f GROUP BY conv_id
""",
}
