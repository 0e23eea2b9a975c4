"""The registered queries of the operators, each over a whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import chat, crosspoly, fertility, langid, minhash, mixing, phrases, pieces, resampling, tagpaths, urlrules, warc, whitening


def op1_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.fertility(read_table(spark, folder, "documents")).drop("lang")


def op2_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.remove_repeats(read_table(spark, folder, "documents"))


def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_digests(read_table(spark, folder, "documents"))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_chats(chat.format_chats(read_table(spark, folder, "conversations").unionByName(planted)))


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, folder, "documents"), width=3, per_cent=85)


def op6_langid(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    langs, table = langid.identify(documents)
    asked = documents.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(asked, langs, table).drop("text")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.records(warc.read_archives(warc.write_archives(read_table(spark, folder, "pages"))))


def op8_tagpaths(spark: SparkSession, folder: str) -> DataFrame:
    return tagpaths.extract(read_table(spark, folder, "pages"))


def op9_crosspoly(spark: SparkSession, folder: str) -> DataFrame:
    return crosspoly.search(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.per_document(mixing.mixed_blocks(read_table(spark, folder, "documents")))


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_urlrules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judged(read_table(spark, folder, "pages"), rules)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(read_table(spark, folder, "embeddings"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_fertility, op2_phrases, op3_pieces, op4_chat, op5_minhash, op6_langid, op7_warc, op8_tagpaths,
                                   op9_crosspoly, op10_mixing, op11_urlrules, op12_whitening, op13_resampling)}

PHRASES_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50),
windows AS (
  SELECT doc_id, pos, sha256(array_to_string(list_slice(words, pos, pos + 49), ' ')) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM windows GROUP BY k),
hits AS (SELECT DISTINCT doc_id, pos FROM windows JOIN firsts USING (k) WHERE first_doc < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
marked AS (
  SELECT e.doc_id, e.pos, e.word,
         max(h.pos) OVER (PARTITION BY e.doc_id ORDER BY e.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM each e LEFT JOIN hits h ON e.doc_id = h.doc_id AND e.pos = h.pos),
done AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN done ON w.doc_id = done.doc_id
"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(replace(text, '<', ''), '[', '')) AS shown,
         length(role) + length(role) - length(replace(replace(replace(role, '<', ''), '[', ''), chr(10), '')) AS named FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + named + 1 + shown + 11)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

WARC_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS newest FROM p),
digits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> (15 - 5 * k)) % 32, 1), '' ORDER BY g, k) AS digest
  FROM (SELECT page_id, g, unnest(range(4)) AS k, ('0x' || substr(hex, 1 + 5 * g, 5))::INT AS v
        FROM (SELECT page_id, hex, unnest(range(8)) AS g FROM p))
  GROUP BY page_id)
SELECT r.page_id, payload_bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN r.page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r.page_id <> newest THEN newest END AS refers_to
FROM r JOIN digits ON r.page_id = digits.page_id
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 12))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, (([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS spare, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS wide
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap * wide <= spare * weight THEN cap
              ELSE weight * (SELECT arg_min(spare / wide, cap / weight) FROM levels WHERE NOT cap * wide <= spare * weight) END AS target
  FROM levels),
placed AS (
  SELECT d.*, source_size, target, round(target)::BIGINT AS wanted,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passed AS (
  SELECT *, wanted // greatest(source_size, 1) AS passes, greatest(0, least(size, wanted - wanted // greatest(source_size, 1) * source_size - before)) AS part FROM placed)
SELECT doc_id, size, source_size, target, (passes * size + part)::BIGINT AS taken,
       CASE WHEN size > 0 THEN passes + (part > 0)::INT ELSE 0 END::BIGINT AS n_copies
FROM passed
"""

URL_RULES_SQL = r"""
WITH rules (rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fits ON u.n = fits.n
"""

RESAMPLING_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
held AS (SELECT n, unnest(words) AS word FROM d),
spelled AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM held UNION SELECT word FROM b)),
bucketed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)),
                               lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, crc_table),
counts AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t
  FROM (SELECT bucket, count(*) AS s, 0 AS t FROM held JOIN bucketed USING (word) GROUP BY bucket
        UNION ALL SELECT bucket, 0, count(*) FROM b JOIN bucketed USING (word) GROUP BY bucket) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT count(*) FROM held) + 10000))::DOUBLE / ((s + 1) * ((SELECT count(*) FROM b) + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts),
weights AS (
  SELECT n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM held JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY n),
scored AS (
  SELECT d.n, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights w ON d.n = w.n),
ranked AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON s.n = r.n
"""

ORACLE_SQL = {"op2_phrases": PHRASES_SQL, "op4_chat": CHAT_SQL, "op7_warc": WARC_SQL, "op10_mixing": MIXING_SQL,
              "op11_urlrules": URL_RULES_SQL, "op13_resampling": RESAMPLING_SQL}
