"""Queries of the training-data operators and the DuckDB texts of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome_spark.llm.common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.line_dedup import line_dedup

    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("_kept", F.lit("")), 256)
    return out.select("_row.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, n, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10)) AS BIGINT) AS place FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM sized GROUP BY source),
ranked AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
goal AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target FROM ranked),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goal),
upto AS (
  SELECT source, place, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto, words
  FROM (SELECT source, place, sum(size) AS words FROM sized GROUP BY source, place)),
edge AS (
  SELECT p.source, min({'place': u.place, 'upto': u.upto, 'words': u.words}) AS e
  FROM upto u JOIN passes p ON u.source IS NOT DISTINCT FROM p.source WHERE u.upto > p.target - p.epochs * p.source_size GROUP BY p.source),
bounds AS (
  SELECT p.*, CASE WHEN e.e IS NULL THEN 1099511627776
                   WHEN e.e.upto - (target - epochs * source_size) < (target - epochs * source_size) - (e.e.upto - e.e.words) THEN e.e.place + 1
                   ELSE e.e.place END AS edge
  FROM passes p LEFT JOIN edge e ON p.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN place < edge AND epochs * source_size < target THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.simhash_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.substring_dedup import substring_dedup

    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM starts),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM windows),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM judged WHERE again) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN g.ps IS NULL THEN w.w ELSE list_transform(list_filter(list_zip(w.w, range(1, len(w.w) + 1)), lambda x: NOT list_contains(g.ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.toxicity import toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, read_table(spark, sf_dir, "labels")).select("_row.doc_id", "held_out", "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.language_id import language_id

    return language_id(read_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.ann import neighbours

    return neighbours(read_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.media import media_columns

    # the timed clips go along as text
    return media_columns(read_table(spark, sf_dir, "documents")).withColumn("clips", F.to_json("clips"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mobilome_spark.llm.warc import captures

    return captures(read_table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> d.page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_simhash": op2_simhash, "op3_substring_dedup": op3_substring_dedup, "op4_toxicity": op4_toxicity, "op5_ann": op5_ann, "op6_mixing": op6_mixing, "op7_packing": op7_packing, "op8_language_id": op8_language_id, "op9_media": op9_media, "op10_warc": op10_warc}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op10_warc": OP10_SQL}
