"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.chat import format_chat
from scriptorium.llm.collocations import collocations
from scriptorium.llm.common import read_table
from scriptorium.llm.decontaminate import contamination_report
from scriptorium.llm.mixing import mixture
from scriptorium.llm.quality import quality_report
from scriptorium.llm.repair import repair_report
from scriptorium.llm.repeats import repeat_report
from scriptorium.llm.secrets import find_secrets
from scriptorium.llm.sentence_pieces import piece_report
from scriptorium.llm.sharding import shard_report
from scriptorium.llm.simhash import near_duplicates
from scriptorium.llm.token_files import token_report
from scriptorium.llm.tool_turns import SCHEMAS, tool_turns
from scriptorium.llm.warc import page_archive


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return find_secrets(read_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of the benchmark in every document."""
    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_token_id_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from its token file."""
    return token_report(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_report(read_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to equal shares of their sources."""
    return mixture(read_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated strings."""
    return repeat_report(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_report(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives written."""
    return page_archive(read_table(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, call and result of all conversations that call tools, in order keys and canonical JSON."""
    turns = tool_turns(read_table(spark, sf_dir, "conversations"))
    rows = format_chat(turns, SCHEMAS)
    return rows.withColumn("problems", F.array_join("problems", ","))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    return repair_report(read_table(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digests of every document's piece ids, and of the text decoded from them."""
    return piece_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_token_id_binary_output": op3_token_id_binary_output,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_sharding": op8_sharding,
    "op9_warc": op9_warc,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sentencepiece": op13_sentencepiece,
}

_OP2_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT cast(item_id AS varchar) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM item WHERE len(w) > 0)),
seen AS (
  SELECT d.r, d.p, s.size, array_to_string(d.w[d.p : d.p + s.size - 1], ' ') AS win
  FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS p FROM doc) d
  JOIN (SELECT DISTINCT size FROM wins) s ON d.p + s.size - 1 <= len(d.w)),
hits AS (SELECT DISTINCT r, p, win, size FROM seen SEMI JOIN wins USING (win, size)),
words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(generate_series(p, p + size - 1)) AS q FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits JOIN wins USING (win, size)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_OP4_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT r, p, array_to_string(w[p : p + 7], ' ') AS win
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS p FROM doc)),
twice AS (SELECT r, win FROM win GROUP BY r, win HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT q) AS n
  FROM (SELECT r, unnest(generate_series(p, p + 7)) AS q FROM win SEMI JOIN twice USING (r, win)) GROUP BY r),
m AS (
  SELECT doc_id, t, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM doc LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 10 > n_words
    OR len(regexp_extract_all(t, '!')) * 10 > n_words * 3
    OR len(regexp_extract_all(t, '\p{Lu}')) * 10 > len(regexp_extract_all(t, '\p{L}')) * 6
    OR n_dup_lines * 2 > len(lines) OR word_chars > n_words * 40
    OR len(regexp_extract_all(t, '\p{L}')) * 5 < length(t)) AS kept
FROM m
"""

_OP6_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS BIGINT) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM sizes)
    * (SELECT CAST(sum(size) AS BIGINT) FROM sizes)::DOUBLE / size::DOUBLE AS rate FROM sizes),
tables AS (
  SELECT source, greatest(CAST(ceil(rate / 4.0::DOUBLE) AS INTEGER), 1) AS parts,
    rate / greatest(CAST(ceil(rate / 4.0::DOUBLE) AS INTEGER), 1)::DOUBLE AS mean FROM rates),
terms AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM tables
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE FROM terms WHERE k < 39),
cumulative AS (SELECT source, list(c ORDER BY k) AS cs FROM terms GROUP BY source),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, d.source, text, parts, cs,
    md5(concat_ws('|', '11', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS row_hash
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
  JOIN cumulative c ON d.source IS NOT DISTINCT FROM c.source),
draws AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', row_hash, CAST(j AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, unnest(generate_series(1, parts)) AS j FROM docs)),
counts AS (SELECT r, sum(len(list_filter(cs, lambda x: x <= u))) AS n FROM draws GROUP BY r)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS mix_copy,
  md5(concat_ws('|', row_hash, 'order', CAST(copy AS VARCHAR))) AS mix_key
FROM (SELECT docs.*, unnest(generate_series(0, CAST(n AS BIGINT) - 1)) AS copy FROM docs JOIN counts USING (r) WHERE n > 0)
"""

_OP9_SQL = """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
first AS (SELECT digest, min(page_id) AS first_id FROM page WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM page LEFT JOIN first USING (digest)
"""

# Written from the rules of the view alone: a call's place and links follow from the turns around it.
_OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text, coalesce(text, '') AS said, (length(coalesce(text, '')) + coalesce(turn, 0)) % 8 AS mark FROM conversations),
assistant AS (SELECT conv_id, turn, bool_and(mark = 6) AS cyclic FROM t WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY ALL),
answer AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM t WHERE role = 'user' AND turn > 0),
said AS (SELECT *, CAST(to_json(said) AS VARCHAR) AS q FROM t),
message AS (
  SELECT conv_id, turn, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS name, 'message' AS status,
    CAST(NULL AS VARCHAR) AS problems, turn AS order_turn, 0 AS order_level, 0 AS order_kind, 0 AS order_index,
    '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
  FROM t),
lookup AS (
  SELECT s.conv_id, s.turn, role, 'call' AS kind, 'c' || s.turn AS call_id, CASE mark WHEN 0 THEN 'unlisted' ELSE 'lookup' END AS name,
    CASE WHEN a.turn IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
    CASE mark WHEN 0 THEN 'unknown_tool' WHEN 1 THEN 'missing:query' WHEN 2 THEN 'type:turn' WHEN 3 THEN 'unknown:extra'
      WHEN 4 THEN 'arguments' WHEN 5 THEN 'enum:mode' ELSE '' END AS problems,
    s.turn AS order_turn, 0 AS order_level, 1 AS order_kind, 0 AS order_index,
    '{"arguments":' || CASE mark WHEN 1 THEN '{"turn":' || s.turn || '}' WHEN 2 THEN '{"query":' || q || ',"turn":"' || s.turn || '"}'
      WHEN 3 THEN '{"extra":true,"query":' || q || ',"turn":' || s.turn || '}' WHEN 4 THEN '"no JSON"'
      WHEN 5 THEN '{"mode":"fast","query":' || q || ',"turn":' || s.turn || '}' ELSE '{"query":' || q || ',"turn":' || s.turn || '}' END
      || ',"id":"c' || s.turn || '","name":"' || CASE mark WHEN 0 THEN 'unlisted' ELSE 'lookup' END || '","role":"assistant","type":"tool_call"}' AS json
  FROM said s LEFT JOIN answer a ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.turn = s.turn WHERE role = 'assistant' AND s.turn IS NOT NULL),
combine AS (
  SELECT t.conv_id, t.turn, role, 'call' AS kind, 'd' || t.turn AS call_id, 'combine' AS name, 'unanswered' AS status,
    CASE WHEN cyclic THEN 'cycle' ELSE '' END AS problems, t.turn AS order_turn, CASE WHEN cyclic THEN 0 ELSE 1 END AS order_level,
    1 AS order_kind, 1 AS order_index,
    '{"arguments":{"parts":["c' || t.turn || '","c' || (t.turn - 2) || '"]},"id":"d' || t.turn
      || '","name":"combine","role":"assistant","type":"tool_call"}' AS json
  FROM t JOIN assistant a ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.turn = t.turn WHERE role = 'assistant'),
result AS (
  SELECT s.conv_id, s.turn, 'tool' AS role, 'result' AS kind, 'c' || (s.turn - 1) AS call_id, CAST(NULL AS VARCHAR) AS name,
    CASE WHEN a.turn IS NULL THEN 'orphan' ELSE 'linked' END AS status, CAST(NULL AS VARCHAR) AS problems,
    s.turn AS order_turn, 0 AS order_level, 2 AS order_kind, 0 AS order_index,
    '{"content":' || q || ',"role":"tool","tool_call_id":"c' || (s.turn - 1) || '"}' AS json
  FROM said s LEFT JOIN assistant a ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.turn = s.turn - 1 WHERE role = 'user' AND s.turn > 0)
SELECT * FROM message UNION ALL SELECT * FROM lookup UNION ALL SELECT * FROM combine UNION ALL SELECT * FROM result
"""

_OP11_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
gram AS (
  SELECT lang, size, array_to_string(w[p : p + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM piece, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cut AS (SELECT *, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : ], ' ') AS tail
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c)),
scored AS (
  SELECT cut.*, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[p : p + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(generate_series(1, size - m + 1)) AS p
    FROM (SELECT *, unnest(generate_series(2, size - 1)) AS m FROM c WHERE size > 2)) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op11_phrase_collocations": _OP11_SQL,
    "op2_benchmark_decontamination": _OP2_SQL,
    "op4_quality_rules": _OP4_SQL,
    "op6_mixing_sources": _OP6_SQL,
    "op9_warc": _OP9_SQL,
    "op10_chat_formatting": _OP10_SQL,
}
