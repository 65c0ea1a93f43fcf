"""Queries on parts of the operators' results that SQL can express, each beside its DuckDB SQL.

They go through the operators, like the queries of the operators themselves, and return what a second engine can
compute: base scores, targets of sources, counts of known secrets, and payloads as read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.llm.common import LOWER, UPPER
from stylomill.llm.lm import op5_lm_score
from stylomill.llm.media import op8_media_chunks
from stylomill.llm.mixing import op4_mix_sources
from stylomill.llm.secrets import op6_secret_scan

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op5_lm_score doesn't depend on the model."""
    found = op5_lm_score(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


LM_BASE_SQL = rf"""
WITH RECURSIVE crc(i, k, c) AS (
    SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
docs AS (
    SELECT doc_id, list_append({_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")}, chr(10)) AS w,
           list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])) AS r FROM documents, tab),
dealt AS (SELECT doc_id, w, xor(r, 4294967295) % 7 = 2 AS held_out FROM docs),
tokens AS (SELECT doc_id, held_out, unnest(w) AS token FROM dealt),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens,
       round(sum(log10(coalesce(c, 0) + 1) - log10(n + v + 1)), 5) AS base_score
FROM tokens LEFT JOIN counts ON tokens.token = counts.token, n GROUP BY doc_id, held_out, n
"""


def mix_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4_mix_sources isn't drawn; a document may take at most three times its words, and only whole copies."""
    found = op4_mix_sources(spark, sf_dir)
    ok = (F.col("taken") <= 3 * F.col("size")) & ((F.col("size") == 0) | (F.col("taken") % F.greatest("size", F.lit(1)) == 0))
    return found.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), ok.alias("whole"))


MIX_TARGETS_SQL = rf"""
WITH docs AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source),
capped AS (SELECT *, [5, 2, 1][place % 3 + 1] AS w, source_size * 3 AS cap FROM per),
levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM capped WINDOW o AS (ORDER BY cap / w, source NULLS LAST))
SELECT doc_id, size, source_size, round(least(cap::DOUBLE, (SELECT max(level) FROM levels) * w), 4) AS target, TRUE AS whole
FROM docs JOIN levels ON docs.source IS NOT DISTINCT FROM levels.source
"""


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of known patterns op6_secret_scan finds."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
SECRET_COUNTS_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       len(list_filter(regexp_extract_all(t, '({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM docs
"""


def media_payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as op8_media_chunks has read them back."""
    return op8_media_chunks(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


MEDIA_PAYLOADS_SQL = r"""
WITH docs AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT *, greatest(64, (n_bytes + 63) // 64 * 64) AS payload_bytes FROM docs)
SELECT doc_id, n_bytes, payload_bytes, sha256(b || unhex(repeat('00', payload_bytes - n_bytes))) AS payload_sha256 FROM sized
"""

QUERIES = {"lm_base_scores": lm_base_scores, "mix_source_targets": mix_source_targets, "secret_base_counts": secret_base_counts, "media_payload_digests": media_payload_digests}
ORACLE_SQL = {"lm_base_scores": LM_BASE_SQL, "mix_source_targets": MIX_TARGETS_SQL, "secret_base_counts": SECRET_COUNTS_SQL, "media_payload_digests": MEDIA_PAYLOADS_SQL}
