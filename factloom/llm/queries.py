"""Queries over ``documents``: each applies one operator to the whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import alignment, decontaminate, langid, licenses, lines, lm, quality, runs, secrets, sentencepiece_codec, sharding, simhash, substrings


#: A public SentencePiece model; only the driver opens it. The session's
#: ``factloom.sentencepiece.model`` names another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A public byte-level tokenizer; the session's ``factloom.byte_bpe.json`` names another.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


def model_path(spark: SparkSession) -> str:
    return spark.conf.get("factloom.sentencepiece.model", MODEL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(documents(spark, sf_dir), sentencepiece_codec.load(model_path(spark)))
    return coded.select("doc_id", "ids", "n_tokens", "n_bytes", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir)).withColumn("log_score", F.round("log_score", 4))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(documents(spark, sf_dir))
    return found.select("row.doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"), "lines")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def repeated_tail(doc_id: int, n: int) -> tuple[int, int] | None:
    """Of every tenth document, by CRC-32 of its id, a tail is repeated."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return (g % n, 1 + (n - g % n) // (3 + g % 8)) if h % 10 == 0 and n else None


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(documents(spark, sf_dir), repeated_tail))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


def tokenizer_paths(spark: SparkSession) -> tuple[str, str]:
    """Of the byte-level tokenizer and the SentencePiece model; only the driver opens them."""
    return spark.conf.get("factloom.byte_bpe.json", BYTE_BPE), model_path(spark)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(documents(spark, sf_dir), *map(sentencepiece_codec.load, tokenizer_paths(spark)))
    spelled = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", spelled.alias("groups_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_langid": op2_langid,
    "op3_substrings": op3_substrings,
    "op4_lines": op4_lines,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_lm": op8_lm,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_runs": op11_runs,
    "op12_licenses": op12_licenses,
    "op13_alignment": op13_alignment,
}

_WORDS = r"""
docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""

ORACLES: dict[str, str] = {
    "op3_substrings": f"""
WITH {_WORDS},
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (k), range(13) AS r(j) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS text
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""",
    "op8_lm": f"""
WITH {_WORDS},
grams AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
one AS (SELECT c AS x, count(*) AS n FROM grams GROUP BY c),
two AS (SELECT b AS x, c AS y, count(*) AS n FROM grams WHERE i > 1 GROUP BY b, c),
three AS (SELECT a AS x, b AS y, c AS z, count(*) AS n FROM grams WHERE i > 2 GROUP BY a, b, c),
own1 AS (SELECT doc_id, c AS x, count(*) AS n FROM grams GROUP BY doc_id, c),
own2 AS (SELECT doc_id, b AS x, c AS y, count(*) AS n FROM grams WHERE i > 1 GROUP BY doc_id, b, c),
own3 AS (SELECT doc_id, a AS x, b AS y, c AS z, count(*) AS n FROM grams WHERE i > 2 GROUP BY doc_id, a, b, c),
counted AS (
  SELECT grams.doc_id, i, three.n - own3.n AS abc, ab.n - oab.n AS ab, bc.n - obc.n AS bc, ub.n - ob.n AS b, uc.n - oc.n AS c,
    greatest((SELECT sum(n) FROM one) - count(*) OVER (PARTITION BY grams.doc_id), 1) AS others
  FROM grams
  LEFT JOIN three ON three.x = grams.a AND three.y = grams.b AND three.z = grams.c
  LEFT JOIN own3 ON own3.doc_id = grams.doc_id AND own3.x = grams.a AND own3.y = grams.b AND own3.z = grams.c
  LEFT JOIN two AS ab ON ab.x = grams.a AND ab.y = grams.b
  LEFT JOIN own2 AS oab ON oab.doc_id = grams.doc_id AND oab.x = grams.a AND oab.y = grams.b
  LEFT JOIN two AS bc ON bc.x = grams.b AND bc.y = grams.c
  LEFT JOIN own2 AS obc ON obc.doc_id = grams.doc_id AND obc.x = grams.b AND obc.y = grams.c
  LEFT JOIN one AS ub ON ub.x = grams.b
  LEFT JOIN own1 AS ob ON ob.doc_id = grams.doc_id AND ob.x = grams.b
  LEFT JOIN one AS uc ON uc.x = grams.c
  LEFT JOIN own1 AS oc ON oc.doc_id = grams.doc_id AND oc.x = grams.c),
scored AS (
  SELECT doc_id, CASE WHEN abc > 0 THEN 3 WHEN bc > 0 THEN 2 ELSE 1 END AS k,
    CASE WHEN abc > 0 THEN ln(abc / ab)
         WHEN bc > 0 THEN ln(bc / b) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
         ELSE ln(greatest(c, 1) / others) + least(i - 1, 2) * ln(0.4) END AS s
  FROM counted),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 3) AS n_order3, count(*) FILTER (WHERE k = 2) AS n_order2,
         count(*) FILTER (WHERE k = 1) AS n_order1, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_order3, 0) AS n_order3, coalesce(n_order2, 0) AS n_order2,
       coalesce(n_order1, 0) AS n_order1, round(coalesce(s, 0.0), 4) AS log_score
FROM docs LEFT JOIN summed USING (doc_id)""",
}
