"""The queries that apply each corpus operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import id_remainder, table

#: Resolved where it is read.
VOCABULARY = "word_bpe_49k.json"


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.language_id import learn, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_remainder("doc_id", 4) == 2).alias("held_out"))
    prototypes = learn(docs.filter("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.lm_score import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, id_remainder("doc_id", 5) != 1)
    return scored.withColumn("held_out", id_remainder("doc_id", 5) == 1)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.line_dedup import drop_common_lines

    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("es_n_lines").alias("n_lines"), F.col("es_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col(f"es_{c}").alias(c) for c in counts), F.col("es_base_failed").alias("base_failed"), F.col("es_kept").alias("kept"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.token_count import count_pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_pieces(docs, VOCABULARY, keep_text=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    at = lambda k: F.round(F.get("takes", F.lit(k))["position"], 6).alias(f"position_{k + 1}")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", at(0), at(1))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.substring_dedup import drop_repeated_windows

    kept = drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("es_n_words").alias("n_words"), F.col("es_n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from echosieve.llm.packing import pack, pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs, VOCABULARY))


QUERIES = {f.__name__: f for f in (op1_nearest_vectors, op2_language_id, op3_lm_score, op4_line_dedup, op5_quality_rules, op6_token_count, op7_mixing, op8_substring_dedup, op9_simhash, op10_packing)}

_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         {_LOWER.format(f"regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', '')")} AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.last AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key AND length(k.key) >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5_SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM win, (VALUES (0), (1), (2)) AS t(k) WHERE n >= 2 GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN covered USING (doc_id)),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeats,
         n_symbols * 1000 // greatest(word_chars, 1) AS symbols,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
         word_chars * 100 // greatest(n_words, 1) AS length
  FROM counted),
each AS (
  UNPIVOT (SELECT lang, source, repeats, symbols, dup_lines, length FROM rated WHERE NOT base_failed)
  ON repeats, symbols, dup_lines, length INTO NAME ratio VALUE v),
bucketed AS (
  SELECT lang, source, ratio,
         CASE WHEN v < 64 THEN v ELSE (v // (1::BIGINT << (length(bin(v)) - 6))) * (1::BIGINT << (length(bin(v)) - 6)) END AS low
  FROM each),
fences AS (
  SELECT lang, source, ratio, grouping(lang) + grouping(source) AS level, count(*) AS docs,
         quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.75) AS q75
  FROM bucketed GROUP BY GROUPING SETS ((lang, source, ratio), (lang, ratio), (ratio))),
bounds AS (
  SELECT *, 8 * greatest(q75 - q25, CASE ratio WHEN 'repeats' THEN 40 WHEN 'symbols' THEN 10 WHEN 'dup_lines' THEN 60 ELSE 40 END) AS wide
  FROM fences),
picked AS (
  SELECT o.lang, o.source, o.ratio,
         CASE WHEN o.docs >= 100 THEN o.q75 + o.wide WHEN l.docs >= 100 THEN l.q75 + l.wide ELSE a.q75 + a.wide END AS high,
         CASE WHEN o.docs >= 100 THEN o.q25 - o.wide WHEN l.docs >= 100 THEN l.q25 - l.wide ELSE a.q25 - a.wide END AS low
  FROM bounds o
  JOIN bounds l ON l.level = 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.ratio = l.ratio
  JOIN bounds a ON a.level = 2 AND o.ratio = a.ratio
  WHERE o.level = 0),
verdict AS (
  SELECT r.doc_id, bool_or(
    CASE p.ratio WHEN 'repeats' THEN r.repeats > p.high WHEN 'symbols' THEN r.symbols > p.high
                 WHEN 'dup_lines' THEN r.dup_lines > p.high ELSE r.length > p.high OR r.length < p.low END) AS beyond
  FROM rated r JOIN picked p ON r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source
  GROUP BY r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(beyond, FALSE) AS kept
FROM rated LEFT JOIN verdict USING (doc_id)
"""

OP7_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([3, 1, 2])[(place % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM per),
filling AS (
  SELECT *, 100 * (sum(cap) OVER up * weight + cap * (sum(weight) OVER () - sum(weight) OVER up)) <= 150 * total * weight AS filled
  FROM weighed WINDOW up AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)),
goal AS (
  SELECT source, source_size, place, CASE WHEN filled THEN cap::DOUBLE ELSE
         (weight * (150 * total - 100 * sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()))::DOUBLE
         / (100 * sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM filling),
placed AS (
  SELECT doc_id, size, source_size, place, target,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT *, k, greatest(0, least(size, floor(target)::BIGINT - k * source_size - start)) AS n
  FROM placed, (VALUES (0), (1)) AS t(k)),
timed AS (
  SELECT *, (k * source_size + start + n / 2) / greatest(target, 1.0) AS u,
         ([[1.5, 1.0, 0.5], [0.5, 1.0, 1.5], [1.0, 1.0, 1.0]])[(place % 3 + 1)::INT] AS r
  FROM passes WHERE n > 0),
halves AS (
  SELECT *, (r[1] + r[2]) / 4 AS first_half, (r[2] + r[3]) / 4 AS second_half FROM timed),
needs AS (
  SELECT *, u * (first_half + second_half) < first_half AS early,
         u * (first_half + second_half) - CASE WHEN u * (first_half + second_half) < first_half THEN 0 ELSE first_half END AS need,
         CASE WHEN u * (first_half + second_half) < first_half THEN r[1] ELSE r[2] END AS v,
         CASE WHEN u * (first_half + second_half) < first_half THEN r[2] ELSE r[3] END AS w
  FROM halves),
positions AS (
  SELECT doc_id, k, n, CASE WHEN early THEN 0 ELSE 0.5 END + 2 * need / (v + sqrt(greatest(v * v + 4 * (w - v) * need, 0.0))) AS position
  FROM needs),
summed AS (
  SELECT doc_id, sum(n)::BIGINT AS taken, max(CASE WHEN k = 0 THEN position END) AS p1, max(CASE WHEN k = 1 THEN position END) AS p2
  FROM positions GROUP BY doc_id)
SELECT p.doc_id, size, source_size::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, round(p1, 6) AS position_1, round(p2, 6) AS position_2
FROM placed p LEFT JOIN summed s ON p.doc_id = s.doc_id
"""

#: Approximate searches, trained models and tokenizers have no SQL form; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL, "op7_mixing": OP7_SQL}
