"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.substring import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.language import languages

    return languages(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.licenses import licenses

    return licenses(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.bbit import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrid.llm.resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality": op3_quality,
    "op4_nearest": op4_nearest,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_whitening": op11_whitening,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_resampling": op13_resampling,
}
OP8 = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 12)) AS pos, words FROM w WHERE len(words) >= 13
), keyed AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS key FROM windows
), firsts AS (
  SELECT key, min(doc_id) AS least FROM keyed GROUP BY key
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 12)) AS place
  FROM keyed JOIN firsts USING (key) WHERE least < doc_id
), words AS (
  SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS place FROM w WHERE len(words) > 0
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(kept.n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS pos FROM w WHERE len(words) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 3], ' ') AS shingle FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)
), ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w
  UNION
  SELECT reach.x, ways.y FROM reach JOIN ways ON ways.x = reach.y
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT w.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least ON least.x = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id
"""
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT doc_id, {WORDS} AS words FROM documents
), b AS (
  SELECT {WORDS} AS words FROM benchmark
), dw AS (
  SELECT doc_id, unnest(words) AS word FROM d
), bw AS (
  SELECT unnest(words) AS word FROM b
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(word) + 1),
      lambda i: ('0x' || substr(hex(word), (2 * i - 1)::INT, 2))::BIGINT)),
    lambda c, v: xor(c >> 8, steps[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc
), s AS (
  SELECT bucket, count(*) AS n FROM dw JOIN buckets USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM bw JOIN buckets USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM dw)::DOUBLE AS s, (SELECT count(*) FROM bw)::DOUBLE AS t
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000)
    / ((s.n + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights ON weights.doc_id = d.doc_id
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT scored.*, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN places ON places.doc_id = scored.doc_id
"""

ORACLES: dict[str, str] = {
    "op8_substring_dedup": OP8, "op12_minhash_near_dedup": OP12, "op13_resampling": OP13,
}
