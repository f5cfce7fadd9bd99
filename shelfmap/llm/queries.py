"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, divergence, exact_dedup, mixing, omh, pieces, quality_pu, quality_trees, records, repeats, token_prefix, toxicity
from .common import documents, held_out, table, text_or_empty

LIMIT = 2048
OWN_TEXT = "</s>[INST] ok [/INST]"


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = records.token_records(documents(spark, sf_dir), public_tokenizers.path(records.TOKENIZER))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    own = spark.createDataFrame([(-7, 0, "user", OWN_TEXT), (-7, 1, "assistant", OWN_TEXT)],
                                "conv_id long, turn long, role string, text string")
    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return chat.formatted_conversations(turns, public_tokenizers.path(chat.TOKENIZER))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_pieces(documents(spark, sf_dir), public_tokenizers.path(pieces.MODEL))
    plain = F.replace(text_or_empty("text"), F.lit(pieces.SPACE), F.lit(" "))
    return coded.select("doc_id", "n_pieces", "ids_crc32", F.length("decoded").cast("long").alias("decoded_chars"),
                        (F.col("decoded") == plain).alias("round_trip"))


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_pu.fit(docs, table(spark, sf_dir, "labels"))
    return quality_pu.score_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_trees.fit(docs, table(spark, sf_dir, "labels"))
    return quality_trees.judge_quality(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_classes(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "class_size",
                                                             F.col("class_kept").alias("kept"))


def op10_token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefix.token_counts(documents(spark, sf_dir), public_tokenizers.path(token_prefix.TOKENIZER))
    return counted.select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_pu": op6_quality_pu,
    "op7_quality_trees": op7_quality_trees,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_order_minhash": op9_order_minhash,
    "op10_token_prefix": op10_token_prefix,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_collocations": op12_collocations,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op2_chat_format": r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + length('<|turn|><|body|><|end|>')
    + len(regexp_extract_all(text, '<\\*(\|(turn|body|end|im_start|im_end|startoftext|endoftext)\|>|/?s>|</?SYS>>)|\[\\*/?INST\]'))
    + len(regexp_extract_all(role, '<\\*(\|(turn|body|end|im_start|im_end|startoftext|endoftext)\|>|/?s>|</?SYS>>)|\[\\*/?INST\]'))
    AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op4_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
fill AS (  -- share among the open sources, close those above three times their size, repeat
  SELECT 0 AS i, []::VARCHAR[] AS closed
  UNION ALL
  SELECT i + 1, (SELECT list(coalesce('s' || source, 'n') ORDER BY source NULLS LAST) FROM s
    WHERE list_contains(f.closed, coalesce('s' || source, 'n'))
       OR 3 * source_size * (SELECT sum(w) FROM s WHERE NOT list_contains(f.closed, coalesce('s' || source, 'n')))
          <= ((SELECT sum(source_size) FROM s)
              - coalesce((SELECT sum(3 * source_size) FROM s WHERE list_contains(f.closed, coalesce('s' || source, 'n'))), 0)) * w)
  FROM fill f WHERE i <= (SELECT count(*) FROM s)),
last AS (SELECT coalesce(closed, []::VARCHAR[]) AS closed FROM fill ORDER BY i DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN list_contains(closed, coalesce('s' || source, 'n')) THEN (3 * source_size)::DOUBLE
    ELSE ((SELECT sum(source_size) FROM s)
          - coalesce((SELECT sum(3 * source_size) FROM s, last WHERE list_contains(closed, coalesce('s' || source, 'n'))), 0))::DOUBLE
         / (SELECT sum(w) FROM s, last WHERE NOT list_contains(closed, coalesce('s' || source, 'n'))) * w END AS target
  FROM s, last),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS repeats FROM t),
g AS (SELECT source, h, sum(size) AS g FROM d GROUP BY source, h),
c AS (
  SELECT source, h, g, sum(g) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - g AS before FROM g)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (r.repeats + CASE WHEN 2 * c.before + c.g < 2 * (r.target - r.repeats * r.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h""",
    "op8_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM n""",
    "op11_repeated_passages": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM d WHERE len(words) >= 13),
w AS (SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM s),
m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.r, w.i FROM w JOIN m ON w.win = m.win WHERE m.least < w.doc_id),
g AS (SELECT DISTINCT r, i + unnest(range(13)) AS i FROM h),
u AS (SELECT r, unnest(generate_series(1, len(words))) AS i, unnest(words) AS word FROM d),
k AS (SELECT u.r, count(g.i) AS n_removed, string_agg(u.word, ' ' ORDER BY u.i) FILTER (g.i IS NULL) AS kept
      FROM u LEFT JOIN g ON u.r = g.r AND u.i = g.i GROUP BY u.r)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)""",
    "op12_collocations": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
s AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM w WHERE len(words) > 0),
u AS (SELECT lang, words, i, unnest(generate_series(1, least(5, len(words) - i + 1))) AS size FROM s),
f AS (SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, size, count(*)::HUGEINT AS n
      FROM u GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(words))::HUGEINT AS total FROM w GROUP BY lang),
c AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
k AS (SELECT lang, phrase, a, words, unnest(generate_series(1, size - 1)) AS k, size FROM c),
x AS (
  SELECT k.lang, k.phrase, k.a, t.total, k.k, l.n AS l, r.n AS r, (1000 * k.a * t.total) // (l.n * r.n) AS score
  FROM k JOIN t ON t.lang = k.lang JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.words[1:k.k], ' ')
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.words[k.k + 1:k.size], ' ')),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM x),
z AS (
  SELECT y.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y
  WHERE cut = 1 AND NOT EXISTS (
    SELECT 1 FROM c o WHERE o.lang = y.lang AND o.phrase <> y.phrase AND o.a >= y.a
      AND contains(' ' || o.phrase || ' ', ' ' || y.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n, score::BIGINT AS score
FROM z WHERE rank <= 2000""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(v.v, 0)::HUGEINT AS v, coalesce(v.lang_total, 0)::HUGEINT AS lang_total,
        coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total
      FROM g LEFT JOIN v ON v.lang = g.lang),
m AS (  -- the whole matrix of shares
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + s.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (s.lang_total + s.v) AS q
  FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM m x JOIN m y ON x.term = y.term
              WHERE x.lang = a.lang AND x.source = a.source AND y.lang = b.lang AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
found AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM m WHERE n > 0 AND p > q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM found),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM w WHERE part = 'pair' OR rank <= 200""",
}
