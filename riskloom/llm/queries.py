"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import chroma, langid, linedup, minhash, mixing, neighbours, packing, quotes, records, warc
from riskloom.llm._common import Scratch, table

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.build(table(spark, sf_dir, "conversations"), Scratch(spark, "op2"))


OP2_SQL = r"""
WITH RECURSIVE msgs AS (
  SELECT row_number() OVER () AS m, * FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations)),
cut AS (SELECT m, str_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM msgs),
lines AS (SELECT m, unnest(range(0, len(ls))) AS i, unnest(ls) AS l FROM cut),
marked AS (
  SELECT m, i, len(regexp_replace(regexp_extract(l, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(l, '^(?:[ \t]*>)+ ?', '') AS body,
    regexp_matches(l, '^(?:On .{1,300} wrote:|-+ ?Original Message ?-+)[ \t]*$') AS attribution
  FROM lines),
ahead AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY m ORDER BY i), 0) AS next_level FROM marked),
kept AS (SELECT * FROM ahead WHERE NOT (attribution AND level = 0 AND next_level > 0)),
turns AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY m ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM kept),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY m ORDER BY i) AS run FROM turns),
runs AS (SELECT m, run, min(level) AS level, string_agg(body, chr(10) ORDER BY i) AS body FROM numbered GROUP BY m, run),
own AS (SELECT m, regexp_replace(string_agg(body, chr(10) ORDER BY run), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS own FROM runs WHERE level = 0 GROUP BY m),
parsed AS (SELECT msgs.m, conv_id, turn, role, coalesce(own, '') AS own, (SELECT count(*) FROM runs r WHERE r.m = msgs.m AND level > 0) AS n_quotes FROM msgs LEFT JOIN own USING (m)),
pieces AS (
  SELECT m, level, unnest(list_concat([body], str_split_regex(body, '\n[ \t]*\n'), str_split(body, chr(10)))) AS said FROM runs
  UNION ALL SELECT m, 0, own FROM parsed),
clean AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(said), '[ \t\r\n]+', ' ', 'g')) AS said
  FROM pieces JOIN msgs USING (m) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
here AS (SELECT conv_id, said, min(turn) AS here_turn FROM clean WHERE level = 0 AND said <> '' GROUP BY 1, 2),
first AS (SELECT said, min({'c': conv_id, 't': here_turn}) AS f FROM here GROUP BY 1),
linked AS (
  SELECT c.conv_id, c.turn, c.level, len(str_split(c.said, ' ')) AS words,
    CASE WHEN here_turn < c.turn THEN c.conv_id WHEN (f.c, f.t) < (c.conv_id, c.turn) AND len(str_split(c.said, ' ')) >= 5 THEN f.c END AS orig_conv,
    CASE WHEN here_turn < c.turn THEN here_turn WHEN (f.c, f.t) < (c.conv_id, c.turn) AND len(str_split(c.said, ' ')) >= 5 THEN f.t END AS orig_turn
  FROM clean c LEFT JOIN here h ON c.conv_id = h.conv_id AND c.said = h.said LEFT JOIN first ON c.said = first.said
  WHERE c.level > 0 AND c.said <> ''),
votes AS (SELECT conv_id, turn, level, orig_conv, orig_turn, sum(words) AS words FROM linked WHERE orig_conv IS NOT NULL GROUP BY ALL),
parents AS (
  SELECT conv_id, turn, orig_conv AS reply_conv, orig_turn AS reply_turn FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, words DESC, orig_conv, orig_turn) = 1),
climb AS (
  SELECT conv_id, turn, reply_conv AS c, reply_turn AS t, CAST(1 AS BIGINT) AS depth FROM parents
  UNION ALL SELECT climb.conv_id, climb.turn, p.reply_conv, p.reply_turn, depth + 1 FROM climb JOIN parents p ON p.conv_id = climb.c AND p.turn = climb.t),
roots AS (SELECT conv_id, turn, arg_max(c, depth) AS c, arg_max(t, depth) AS t, max(depth) AS depth FROM climb GROUP BY 1, 2)
SELECT p.conv_id, p.turn, role, own AS text, reply_conv, reply_turn, coalesce(c, p.conv_id) AS thread_conv, coalesce(t, p.turn) AS thread_turn,
  coalesce(depth, 0) AS depth, n_quotes, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || own AS formatted
FROM parsed p LEFT JOIN parents USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn)"""


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return packed.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), id_col="vec_id", media_col="embedding", decode=chroma.melodies)
    return chroma.groups(prints, Scratch(spark, "op4")).withColumnRenamed("rec_id", "vec_id")


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op5").path("archive")
    warc.write(table(spark, sf_dir, "pages"), path, id_col="page_id", url_col="url", payload_col="html")
    return warc.pages(warc.read(spark, path))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS d, CASE WHEN strlen(html) >= 0 THEN max(page_id) OVER (PARTITION BY sha1(html)) END AS kept FROM p),
bits AS (
  SELECT page_id, n, kept, d,
    list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(d || '000', 1 + (5 * i) // 4, 3) AS BIGINT) >> (12 - 5 - (5 * i) % 4)) & 31) AS INTEGER) + 1, 1)) AS b
  FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(b, '') AS payload_digest,
  CASE WHEN kept IS NULL OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM bits"""


def op6_pairwise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op6"))
    return found.select(
        "doc_id", F.col("_removed_words").alias("removed_words"), F.col("_removed_blocks").alias("removed_blocks"), F.col("_overlaps").alias("overlaps"),
        F.length("text").cast("long").alias("kept_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


def op7_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.link(table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM good),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS least FROM v UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id AND r.least < l.b),
comp AS (SELECT id, min(least) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON id = vec_id"""


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    path = scratch.path("records")
    records.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORDS))
    index = records.build_index(spark, path, scratch.path("index"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(PIECES)
    learned = langid.fit(langid.sample(docs, id_col="doc_id", text_col="text", lang_col="lang", may_learn=~held_out(F.col("doc_id")), docs_per_language=250, longest=20_000), path)
    return langid.predict(docs, learned, path, keep={"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))})


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return used.select("doc_id", "source", "n_tokens", "epoch", "block", "position", F.round("weight", 9).alias("weight"))


OP10_SQL = """
WITH RECURSIVE units AS (
  SELECT doc_id, source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)) AS BIGINT) AS n_tokens
  FROM documents GROUP BY 1, 2),
src AS (SELECT source AS s, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM units GROUP BY 1),
ends AS (SELECT ln(CAST(min(tokens) AS DOUBLE)) AS low, ln(CAST(max(tokens) AS DOUBLE)) AS top FROM src WHERE tokens > 0),
bisect AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN exp((1 - (lo + hi) / 2) * (top - low)) <= 1.5 THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN exp((1 - (lo + hi) / 2) * (top - low)) <= 1.5 THEN (lo + hi) / 2 ELSE hi END
  FROM bisect, ends WHERE step < 40),
chosen AS (SELECT CASE WHEN exp(top - low) <= 1.5 THEN 0 ELSE hi END AS a, top FROM bisect, ends WHERE step = 40),
whole AS (SELECT sum(exp(a * ln(CAST(tokens AS DOUBLE)))) AS z FROM src, chosen WHERE tokens > 0),
share AS (
  SELECT s, tokens, docs, CASE WHEN tokens > 0 THEN exp(a * ln(CAST(tokens AS DOUBLE))) / z ELSE 0 END AS weight,
    greatest(CASE WHEN tokens > 0 THEN CAST(floor(exp(a * ln(CAST(tokens AS DOUBLE)) + (1 - a) * top) + 1e-6) AS BIGINT) ELSE 0 END, tokens) AS budget
  FROM src, chosen, whole),
alltok AS (SELECT CAST(sum(budget) AS BIGINT) AS all_tokens FROM share),
placed AS (
  SELECT doc_id, source, n_tokens, tokens, budget, weight, all_tokens,
    CAST(coalesce(sum(n_tokens) OVER (PARTITION BY source
      ORDER BY CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM units JOIN share ON source IS NOT DISTINCT FROM s, alltok),
passes AS (
  SELECT *, greatest(1, CASE WHEN n_tokens = 0 OR tokens = 0 THEN 1 ELSE CAST(floor(CAST(budget - before + tokens - 1 AS DOUBLE) / tokens) AS BIGINT) END) AS p FROM placed),
used AS (SELECT *, unnest(range(0, p)) AS epoch FROM passes)
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch,
  CAST(least(floor(CAST(epoch * tokens + before AS DOUBLE) / greatest(budget, 1) * greatest(1, ceil(all_tokens / 1048576.0))),
    greatest(1, ceil(all_tokens / 1048576.0)) - 1) AS BIGINT) AS block,
  CAST('0x' || substr(md5('mix-block:' || CAST(epoch AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS position,
  round(weight, 9) AS weight
FROM used"""


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_quotation_linking, op3_power_of_two_packing, op4_chroma_fingerprints, op5_warc_salvage, op6_pairwise_lines, op7_product_quantisation, op8_token_records, op9_language_id, op10_temperature_mixing)}
SQL = {"op2_quotation_linking": OP2_SQL, "op5_warc_salvage": OP5_SQL, "op7_product_quantisation": OP7_SQL, "op10_temperature_mixing": OP10_SQL}
